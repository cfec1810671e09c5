import random
import zlib
from collections import Counter, defaultdict

from flowsight.llm.sharding import SlotMap, load_map, shard_documents, store_map


def test_rebalancing_moves_few_slots():
    rng = random.Random(1)
    weights = [rng.randint(0, 1000) for _ in range(500)]
    first = SlotMap.first(7, 500)
    even = first.rebalanced(weights)
    load = Counter()
    for slot, shard in enumerate(even.owner):
        load[shard] += weights[slot]
    assert max(load.values()) - min(load.values()) <= 2
    assert even.version == 1 and len(even.moved) < 100
    grown = even.rebalanced(weights, shards=8)
    assert {grown.owner[s] for s in range(500)} == set(range(8))
    assert len(grown.moved) < 2 * 500 / 8 and grown.version == 2
    assert SlotMap.first(3, 9).rebalanced([0] * 9).moved == ()


def test_versions_are_kept(spark, tmp_path):
    path = str(tmp_path / "maps")
    first = SlotMap.first(2, 6)
    store_map(spark, first, path)
    store_map(spark, first.rebalanced([9, 1, 1, 1, 1, 1]), path)
    assert load_map(spark, path, 0) == first
    assert load_map(spark, path).version == 1


def test_places_and_sizes(docs_of):
    rng = random.Random(2)
    rows = [(d, "é" * rng.randint(0, 300)) for d in range(700)] + [(None, f"none {i}") for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "twice"), (1002, "twice"), (1003, "long " * 2000)]
    found = shard_documents(docs_of(rows), shards=5, slots=256).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    places, load = defaultdict(list), Counter()
    for r in found:
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert set(places) == set(range(5))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= 10
    assert {(r.law, r.grown_shard, r.map_version) for r in found} == {("bytes", None, 1)}
    assert len({r.virtual_slot for r in found if r.doc_id is None}) > 20
    assert shard_documents(docs_of([])).collect() == []


def test_a_frequent_doc_id_at_full_size(docs_of):
    """A third of all rows share a doc_id: at 24 shards and 8,192 slots the sums of bytes stay near equal."""
    rng = random.Random(5)
    rows = [(7, f"{i} " + "x" * rng.randint(0, 400)) for i in range(3000)] + [(d, "y" * rng.randint(0, 400)) for d in range(10, 6010)]
    found = shard_documents(docs_of(rows)).collect()
    load, slots = Counter(), Counter()
    for r in found:
        load[r.shard] += r["size"]
        slots[r.virtual_slot] += 1
    assert len(found) == len(rows) and len(load) == 24
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values()) / 24 + 10
    assert max(slots.values()) < 20
