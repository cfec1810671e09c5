import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from flowsight.llm.packing import make_plan, pack
from flowsight.llm.tokens import Encoder, vocabulary
from flowsight.llm.wavelet import Shard, encode_shard, occurrences, read_shards, write_shards

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PLAIN = {name: Tokenizer.from_file(vocabulary(name)) for name in NAMES}
OURS = {name: Encoder(vocabulary(name), remembered=50) for name in NAMES}
for tokenizer in PLAIN.values():
    tokenizer.encode_special_tokens = True


def plain_ids(name, text):
    return PLAIN[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 　'sSé́İßΣab1.,<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library(name, text):
    assert OURS[name].ids([text, text])[1].tolist() == plain_ids(name, text)


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_special_strings_and_long_texts(name):
    texts = ["<|endoftext|> a<|startoftext|>", "x" * 3000, "a  b   c\n\n\nd \n e", "don't  can't", "", " ", "ab " * 20_000]
    assert [i.tolist() for i in OURS[name].ids(texts)] == [plain_ids(name, t) for t in texts]


def test_wavelet_matrix_access_count_find():
    rng = np.random.default_rng(4)
    for top, n in ((50_000, 9000), (3, 5000), (1, 10), (70_000, 50)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = Shard(encode_shard(ids, [4, None], np.array([n - 3, 3])))
        assert shard.ids.tolist() == ids.tolist() and shard.doc_ids == [4, None]
        assert shard.document(1).tolist() == ids[n - 3 :].tolist()
        for at in rng.integers(0, n, 40).tolist():
            value = int(ids[at])
            places = np.flatnonzero(ids == value)
            assert shard.access(at) == value and shard.count(value) == len(places)
            assert shard.count(value, 5, at) == int(((places >= 5) & (places < at)).sum()) or at < 5
            nth = int(rng.integers(0, len(places)))
            assert shard.find(value, nth) == places[nth]
        assert shard.count(1 << 20) == 0
        with pytest.raises(IndexError):
            shard.find(int(ids[0]), n + 1)


def test_shards_read_back(docs_of):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choices(["alpha", "beta", "Gamma", "\n", "été"], k=rng.randint(0, 60)))) for d in rng.sample(range(500), 60)]
    rows += [(None, "no id"), (700, None), (701, ""), (702, "twice"), (702, "twice"), (703, "long " * 30_000)]
    shards = write_shards(docs_of(rows), shard_ids=500)
    found = read_shards(shards).collect()
    start, want = 0, Counter()
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain_ids(NAMES[0], text) + [0], dtype="<u4")
        want[d, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == want
    assert sum(r.n for r in occurrences(shards, 0).collect()) >= len(rows)
    assert read_shards(write_shards(docs_of([]))).collect() == []


def check_plan(histogram, capacity):
    plan = make_plan(histogram, capacity)
    ranks, sequences = defaultdict(list), defaultdict(list)
    for length, first, number, sequence, offset in plan.runs:
        ranks[length] += range(first, first + number)
        for i in range(number):
            sequences[sequence + i].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_plans_hold_every_piece_and_are_tight():
    rng = random.Random(8)
    for capacity, pieces in ((10, 40), (64, 3000), (200, 20_000)):
        histogram = Counter(min(capacity, 1 + int(rng.expovariate(1 / (capacity / 4)))) for _ in range(pieces))
        least = -(-sum(n * c for n, c in histogram.items()) // capacity)
        assert check_plan(histogram, capacity) <= least * 1.02 + 2
    assert check_plan({6: 7}, 10) == 7 and check_plan({5: 7, 10: 2}, 10) == 6 and check_plan({}, 10) == 0
    assert check_plan({7: 5000, 3: 5000, 4: 10}, 10) <= 5010


def test_pack(docs_of):
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 90)))) for d in range(80)]
    rows += [(None, "no id"), (100, None), (101, ""), (102, "twice"), (102, "twice"), (103, "long " * 3000)]
    found = pack(docs_of(rows), capacity=64).collect()
    want = Counter()
    for d, text in rows:
        ids = np.array(plain_ids(NAMES[1], text) + [1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            want[d, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in found) // 64)
    assert len(sequences) <= least + 3
    assert pack(docs_of([])).collect() == []
