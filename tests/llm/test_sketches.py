import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsight.llm.sketches import Tables, Versions, _slices, changed_paragraphs, differences, fingerprints, paragraph_digests, paragraphs_of


def versions(*key_sets):
    made = Versions([""] * len(key_sets))
    made.keys = np.concatenate(key_sets)
    made.sizes = np.array([len(k) for k in key_sets])
    made.first = np.cumsum(made.sizes) - made.sizes
    made.tables.add(made.keys, np.repeat(np.arange(len(key_sets)), made.sizes))
    return made


def test_peeling_finds_all_differences_of_many_pairs():
    rng = np.random.default_rng(1)
    pairs = []
    for shared, only_a, only_b in [(0, 0, 0), (5, 0, 1), (100, 3, 2), (1000, 40, 0), (0, 300, 300), (20, 0, 2000), (3, 1, 1)]:
        keys = rng.integers(0, 1 << 63, shared + only_a + only_b, dtype=np.uint64)
        pairs.append((keys[: shared + only_a], np.concatenate((keys[:shared], keys[shared + only_a :]))))
    every = np.arange(len(pairs))
    keys, owner, signs = differences(versions(*(a for a, _ in pairs)), versions(*(b for _, b in pairs)), every, every)
    for i, (a, b) in enumerate(pairs):
        assert set(keys[(owner == i) & (signs == 1)].tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(keys[(owner == i) & (signs == -1)].tolist()) == set(b.tolist()) - set(a.tolist())


def test_a_table_too_small_says_so():
    tables = Tables(np.array([15, 15]))
    tables.add(np.arange(1, 500, dtype=np.uint64), np.zeros(499, dtype=np.int64))
    tables.add(np.array([7], dtype=np.uint64), np.ones(1, dtype=np.int64))
    keys, owner, _, stuck = tables.peel()
    assert stuck.tolist() == [True, False] and keys[owner == 1].tolist() == [7]


def test_paragraphs():
    texts = ["one. two\nthree", "", " \n", "one. two", "x " * 300, "three"]
    together, sizes = paragraphs_of(texts)
    assert sizes.tolist() == [len(paragraph_digests(t)) for t in texts]
    assert together.tolist() == [k for t in texts for k in paragraph_digests(t).tolist()]
    assert len(paragraph_digests("")) == len(paragraph_digests(" \n ")) == 0
    one, two = paragraph_digests("first line\nsecond line"), paragraph_digests("second line\nfirst line\nfirst line")
    assert set(one.tolist()) < set(two.tolist()) and len(two) > len(one)
    gone, new = changed_paragraphs("first line\nsecond line", "first line\nthird line")
    assert gone and new


def plain(rows, digests=None):
    """Everything by plain sets of paragraphs."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digests[r[1]] if digests else 0))
    sets = lambda text: set(paragraph_digests(text).tolist())
    near = lambda a, b: 1 - len(sets(a) ^ sets(b)) / (len(sets(a)) + len(sets(b))) if sets(a) or sets(b) else 1.0
    out = Counter()
    for i, (d, text) in enumerate(ordered):
        own, follows = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + follows[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out[d, len(own), digest, round(near(own, edited), 9), round(near(own, follows), 9)] += 1
    return out


@pytest.mark.parametrize("count", [0, 1, 2, 70])
def test_equals_plain_version(docs_of, count):
    rng = random.Random(count)
    rows = [(d, "".join(rng.choices("ab. \né🙂", k=rng.randint(0, 200)))) for d in rng.sample(range(1000), count)]
    if count > 2:
        rows += [(2000, None), (2001, ""), (None, "no id"), (2002, "long " * 40_000), (2003, rows[0][1])]
    found = fingerprints(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == plain(rows)
    if count > 2:
        by_id = {r.doc_id: r for r in found}
        assert by_id[2003].fingerprint == by_id[rows[0][0]].fingerprint
        assert all(0 <= r.near_next <= 1 for r in found)


def test_rows_that_share_a_doc_id(docs_of):
    found = fingerprints(docs_of([(1, "one"), (2, "two"), (2, "two"), (None, "x"), (None, "x")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 2), (False, 2), (True, 0), (True, 0)]


def test_frequent_and_null_doc_ids_are_spread_in_order(docs_of):
    """A doc_id and the nulls hold a third of all rows each; the order of rows is the same, over many slices."""
    rng = random.Random(9)
    say = lambda: "".join(rng.choices("ab. \n", k=rng.randint(5, 120)))
    big = 1 << 60
    rows = [(500, say()) for _ in range(300)] + [(None, say()) for _ in range(300)]
    rows += [(d, say()) for d in rng.sample(range(1000), 150)] + [(big + d, say()) for d in range(150)] + [(-3, say())]
    docs = docs_of(rows)
    digests = {r.text: r.digest for r in docs.select("text", F.xxhash64("text").alias("digest")).collect()}
    assert len(digests) == len(rows)
    sliced, follows = _slices(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")))
    placed = sorted(sliced.select("_slice", "doc_id", "digest").collect(), key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))
    assert placed == sorted(placed, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert max(Counter(r[0] for r in placed).values()) < len(rows) / 6 and len(follows) > 12
    found = fingerprints(docs).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)
    assert got == plain(rows, digests)
