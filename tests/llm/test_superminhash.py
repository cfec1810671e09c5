"""SuperMinHash links against all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pytest

from flowsight.llm import superminhash
from flowsight.llm.superminhash import UnionFind, near_duplicates, shingles, signatures

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text, width=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain_components(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    names = {root: min((d for d in ids if d is not None), default=None) for root, ids in groups.items()}
    out = []
    for i, (doc_id, _) in enumerate(rows):
        name = names[find(i)]
        out.append((doc_id, len(sets[i]), name, doc_id == name))
    return out


def ordered(rows):
    return sorted(repr(tuple(r)) for r in rows)


def variants(rnd, n, size=120, most=30):
    """A base text and copies of it with some words changed, linked and not."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(most)):
            words[rnd.randrange(size)] = f"x{rnd.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_signatures_estimate_similarity_with_less_variance():
    rnd = np.random.default_rng(5)
    errors = []
    for _ in range(120):
        items = rnd.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(items[:45]), np.unique(items[15:])
        one, two = signatures([a, b], 64)
        errors.append((one == two).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02
    # Independent minima would have a variance of 0.25 / 64.
    assert np.var(errors) < 0.8 * 0.25 / 64


def test_signature_does_not_depend_on_the_batch():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 500, 2, 90_000, 0)]
    together = signatures(sets)
    for s, row in zip(sets, together):
        assert (signatures([s])[0] == row).all()
    assert (together[-1] == np.iinfo(np.uint64).max).all()
    # Every register is dealt a value, and no two of one element share a rank.
    assert sorted((together[0] >> np.uint64(48)).tolist()) == list(range(96))


def test_union_find():
    forest = UnionFind()
    assert forest.unite(3, 5) and forest.unite(5, 9) and not forest.unite(9, 3)
    assert forest.find(9) == 3 and forest.find(4) == 4


def test_whole_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert ordered(found.collect()) == ordered(plain_components(rows))


@pytest.mark.parametrize("tile", [4, 1024])
def test_groups_of_any_size_equal_all_pairs(docs_of, monkeypatch, tile):
    monkeypatch.setattr(superminhash, "TILE_ROWS", tile)
    rnd = random.Random(tile)
    rows = [(i, t) for i, t in enumerate(variants(rnd, 60, most=12) + variants(rnd, 40, most=40) + variants(rnd, 25, size=6, most=3))]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600 + i, rows[3][1].upper()) for i in range(3)]
    rnd.shuffle(rows)
    assert ordered(near_duplicates(docs_of(rows)).collect()) == ordered(plain_components(rows))


def test_large_groups_by_characters(docs_of, monkeypatch):
    monkeypatch.setattr(superminhash, "TILE_CHARS", 3000)
    rows = list(enumerate(variants(random.Random(8), 40, most=20)))
    assert ordered(near_duplicates(docs_of(rows)).collect()) == ordered(plain_components(rows))


def test_odd_rows(docs_of):
    rows = [
        (1, None), (2, ""), (3, " \n"), (None, ""), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (None, "one two"),
        (None, "alone here"), (None, "alone here"), (7, "a b c d e"), (7, "a b c d e"), (8, "A b c d e"), (9, "x " * 5000), (10, "x " * 7000),
    ]
    found = near_duplicates(docs_of(rows)).collect()
    assert ordered(found) == ordered(plain_components(rows))
    assert all(r.kept for r in found if r.n_shingles == 0)
    assert near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_the_border_of_eighty_percent(docs_of):
    base = [f"w{i}" for i in range(93)]  # 90 shingles
    near = base[:-10] + [f"y{i}" for i in range(10)]  # 80 in common of 100 together
    far = base[:-11] + [f"z{i}" for i in range(11)]  # 79 of 101
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3} and len(shingles(rows[0][1])) == 90
