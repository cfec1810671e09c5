import random

import numpy as np

from flowsight.llm.leaks import (
    FEATURES, PASSAGE, STRIDE, Limits, _hashed, common_subsequence, features, find_leaks, fit_space, sample_passages,
)


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert common_subsequence(a, b) == plain_subsequence(a.tolist(), b.tolist())


def world(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(1500)]
    common = words[:40]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, say(rng.randint(14, 60))) for i in range(30)]
    rows, leaks = [], set()
    for d in range(300):
        text = say(rng.randint(1, 400))
        kind = d % 10
        if kind < 3:
            i, own = rng.choice(items)
            own = list(own)
            if kind == 1:  # every tenth word changed
                own = ["changed" if j % 10 == 4 else w for j, w in enumerate(own)]
            if kind == 2:  # a quarter of the first part gone, the answer kept
                own = [w for j, w in enumerate(own[:-6]) if j % 5 != 1] + own[-6:]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
            leaks.add((d, i))
        rows.append((d, " ".join(text).capitalize()))
    return rows, [(i, " ".join(w)) for i, w in items], leaks


def plain_leaks(rows, items, limits):
    """Common subsequence over windows of twice the item's length plus a passage; the answer anywhere in it."""
    out = set()
    for d, text in rows:
        doc = (text or "").lower().split()
        for i, item in items:
            own = item.lower().split()
            if len(set(own) & set(doc)) < 0.6 * len(set(own)):
                continue
            for at in range(0, len(doc), 16):
                span = doc[max(0, at - len(own)) : at + 48 + len(own)]
                share = plain_subsequence(own, span) / len(own)
                answer = " ".join(own[-limits.answer :]) in " ".join(span)
                if share >= limits.whole or share >= limits.most and answer:
                    out.add((d, i))
    return out


def test_recall_against_plain_search(spark, docs_of):
    rows, items, planted = world()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs_of(rows), benchmark).collect()}
    want = plain_leaks(rows, items, Limits())
    assert len(planted & want) >= 0.9 * len(planted)
    assert found <= want and len(found) >= 0.95 * len(want)


def test_edge_cases(spark, docs_of):
    rows, items, _ = world()
    item = items[0][1]
    rows = rows[:50] + [(None, item), (900, None), (901, ""), (902, item), (902, item), (903, "filler " * 70_000 + item + " filler" * 90)]
    items = [*items[:3], (None, item), (77, None), (78, " "), (0, item)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = [(r.doc_id, r.item_id) for r in find_leaks(docs_of(rows), benchmark).collect()]
    assert found.count((902, 0)) == 4 and found.count((902, None)) == 2
    assert (None, 0) in found and (903, 0) in found
    assert not {900, 901} & {d for d, _ in found} and not {77, 78} & {i for _, i in found}
    assert find_leaks(docs_of([]), benchmark).collect() == []
    assert find_leaks(docs_of(rows), benchmark.limit(0)).collect() == []
    assert len(features(None)) == 0


def test_space_equals_an_exact_decomposition(docs_of):
    """With fewer words than dimensions the sketch loses nothing: scaled passage vectors have unit second moments."""
    rng = random.Random(4)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(5)]
    rows = [(d, " ".join(rng.choices(topics[d % 5], k=48))) for d in range(400)]
    space = fit_space(docs_of(rows))
    counts = np.zeros((400, FEATURES))
    for i, (_, text) in enumerate(rows):
        np.add.at(counts[i], _hashed(features(text)), 1)
    passages = counts * space.idf
    passages /= np.sqrt((counts * space.idf**2).sum(axis=1, keepdims=True))
    rank = np.linalg.matrix_rank(passages)
    assert space.basis.shape[1] == rank <= 60
    folded = passages @ space.basis
    assert np.allclose(folded.T @ folded, np.eye(rank), atol=0.02)


def test_leaks_are_found_whatever_the_sample_holds(spark, docs_of):
    """Few distinct texts with many copies: the sample of the latent space may be empty or hold one text."""
    rng = random.Random(12)
    texts = [" ".join(f"t{t}w{rng.randrange(400)}" for _ in range(120)) for t in range(3)]
    items = [(t, " ".join(text.split()[30:60])) for t, text in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of([(d, texts[d % 3]) for d in range(60)])
    for seed in (7, 8):
        space = fit_space(docs, fit_passages=0 if seed == 7 else 240, seed=seed)
        found = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark, space=space).collect()}
        assert found == {(d, d % 3) for d in range(60)}


def test_sample_is_of_passages_of_distinct_texts(docs_of):
    """The sample reaches its number whatever the copies, and no text gives more than its share."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    short, long = [say(100) for _ in range(200)], say(16_000)
    blocks = lambda n: -(-n // STRIDE) - 2
    rows = [(d, short[0]) for d in range(3000)] + [(d, t) for d, t in enumerate(short)] + [(None, long), (7, None), (8, ""), (9, " ")]
    docs = docs_of(rows)
    every = 200 * blocks(100) + blocks(16_000)
    assert sample_passages(docs, 10**6, 1e5).count() == every
    found = sample_passages(docs, 500, 3200.0 * blocks(100) + blocks(16_000)).collect()
    assert len(found) == 500 == len({(r.owner, r.place) for r in found})
    share = sum(r.place >= blocks(100) for r in found) / 500
    assert abs(share - (blocks(16_000) - blocks(100)) / every) < 0.15
    known = set()
    for text in [*short, long]:
        at = _hashed(features(text)).astype("<u2")
        known |= {at[i : i + PASSAGE].tobytes() for i in range(0, len(at), STRIDE)}
    assert all(bytes(r.words) in known for r in found)
    assert sample_passages(docs, 0, 100.0).count() == 0
    assert sample_passages(docs_of([]), 10, 0.0).count() == 0


def test_space_is_fitted_on_every_passage(docs_of):
    """More passages than the space was once fitted on, with a long text and copies, which count once."""
    rng = np.random.default_rng(5)
    names = np.array([f"w{i}" for i in range(50)])
    texts = [rng.integers(0, 50, n) for n in [70_000, *[1_640] * 1_000]]
    written = [" ".join(names[t]) for t in texts]
    docs = docs_of([(d, t) for d, t in enumerate([*written, *written[:40], *written[:40]])])
    space = fit_space(docs)
    column = _hashed(features(" ".join(names)))
    assert len(set(column.tolist())) == 50
    second, n = np.zeros((50, 50)), 0
    for text in texts:
        blocks = np.zeros((-(-len(text) // STRIDE), 50))
        np.add.at(blocks, (np.arange(len(text)) // STRIDE, text), 1)
        counts = blocks[:-2] + blocks[1:-1] + blocks[2:]
        passages = counts * space.idf[column]
        passages /= np.sqrt((counts * space.idf[column] ** 2).sum(axis=1, keepdims=True))
        second += passages.T @ passages
        n += len(passages)
    assert n > 100_000
    folded = space.basis[column].T @ second @ space.basis[column]
    assert space.basis.shape[1] == 50 and np.allclose(folded, np.eye(50), atol=0.02)
