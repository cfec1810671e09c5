import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from flowsight.llm.components import components
from flowsight.llm.simhash import _code, fingerprint, grid_masks, links, near_duplicates, spanning_links


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    digests = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in digests) * 2 > len(digests))


def plain_classes(values, most=4):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def plain_result(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    roots = plain_classes({f for _, f in prints})
    least = defaultdict(list)
    for d, f in prints:
        least[roots[f]] += [d] if d is not None else []
    return Counter((d, f"{f:016x}", min(least[roots[f]], default=None)) for d, f in prints)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeÄé", k=rng.randint(1, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 160))) for _ in range(n)]
    near = []
    for text in base[: n // 2]:
        own = text.split(" ")
        own[rng.randrange(len(own))] = "CHANGED"
        near.append(" ".join(own))
    return base + near + base[:5] + [base[0].upper(), "  \t\n", "", None, "one"]


def test_equals_plain_version(spark, docs_of):
    rows = list(enumerate(texts(60))) + [(None, "a b c d e"), (None, None), (7, "again"), (7, "again")]
    found = near_duplicates(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == plain_result(rows)


def test_long_text():
    text = "word other Third " * 60_000
    assert fingerprint(text) == plain_fingerprint(text)


def test_no_rows(docs_of):
    assert near_duplicates(docs_of([])).collect() == []


def test_counts_bound_differing_bits():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    for x, y in zip(a.tolist(), b.tolist()):
        counts = [sum(abs((v >> 2 * i & 3).bit_count() - (w >> 2 * i & 3).bit_count()) for i in range(32)) for v, w in [(x, y)]]
        code = int(np.bitwise_count(_code(np.uint64(x)) ^ _code(np.uint64(y))))
        assert code == counts[0] <= (x ^ y).bit_count()


def test_some_grid_holds_every_link():
    rng = random.Random(5)
    masks = grid_masks(4, 7)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        x, y = (int(_code(np.uint64(v))) for v in (a, b))
        assert any(x & m == y & m for m in masks)


def crowd(n, seed=2):
    """Fingerprints around a few centres, many of them close to each other."""
    rng = random.Random(seed)
    found = set()
    while len(found) < n:
        value = rng.choice([0, (1 << 64) - 1, 0x123456789ABCDEF0])
        for bit in rng.sample(range(64), rng.randint(0, 9)):
            value ^= 1 << bit
        found.add(value)
    return sorted(found)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def classes_of(pairs, values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for v in values:
        groups[find(v)].add(v)
    return {frozenset(g) for g in groups.values()}


def test_large_cells_are_compared_tile_by_tile(spark):
    values = crowd(400)
    want = classes_of([(signed(a), signed(b)) for a in values for b in values if (a ^ b).bit_count() <= 4], [signed(v) for v in values])
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    for tile in (20, 1 << 16):
        pairs = [(r.a, r.b) for r in links(nodes, tile=tile).collect()]
        assert classes_of(pairs, [signed(v) for v in values]) == want


def test_links_of_a_cell_are_fewer_than_its_rows():
    fps = np.array(crowd(300), dtype=np.uint64)
    a, b = spanning_links(fps, 4)
    assert len(a) < len(fps)
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(-5, -5), (200, 201), (201, 200)]
    pairs += [(None, 3), (7, None)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
