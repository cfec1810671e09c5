import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowsight.llm.substrings import least_of_runs, remove_repeats


def plain(rows, span):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - span + 1):
                key = tuple(w[i : i + span])
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - span + 1):
                if first[tuple(w[i : i + span])] < d:
                    gone[i : i + span] = [True] * span
        out[d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


@pytest.mark.parametrize(("span", "k", "letters"), [(6, 3, "ab"), (8, 8, "abc"), (5, 2, "abcdefgh")])
def test_equals_plain_version(docs_of, span, k, letters):
    rng = random.Random(span)
    rows = []
    for d in range(60):
        text = rng.choices(letters, k=rng.randint(0, 60))
        if rows and rng.random() < 0.6:
            other = (rows[rng.randrange(len(rows))][1] or "").split()
            cut = rng.randrange(len(other) + 1)
            text[3:3] = other[cut : cut + rng.randint(0, 30)]
        rows.append((d * 3 % 100, "\t\n ".join(text)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, rows[1][1]), (502, rows[1][1]), (502, rows[2][1]), (503, "a " * 5000)]
    rng.shuffle(rows)
    found = remove_repeats(docs_of(rows), span, k).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == plain(rows, span)


def test_default_span_and_digest(docs_of):
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(5, f"start {passage} end"), (2, passage), (9, "Ünï " + passage[:200]), (11, " ".join(passage.split()[:49]))]
    found = {r.doc_id: r for r in remove_repeats(docs_of(rows), digest_only=True).collect()}
    want = {key[0]: key for key in plain(rows, 50)}
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in found.items()} == {
        d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (_, n, gone, kept) in want.items()
    }
    assert found[5].n_removed == 70 and found[11].n_removed == 0


def test_no_rows(docs_of):
    assert remove_repeats(docs_of([])).collect() == []


def test_least_of_runs():
    rng = np.random.default_rng(1)
    for run in (1, 2, 3, 5, 8, 13):
        values = rng.integers(0, 20, 60, dtype=np.uint64)
        want = sorted({i + j for i in range(60 - run + 1) for j in range(run) if values[i + j] == values[i : i + run].min()})
        assert least_of_runs(values, run).tolist() == want
    assert len(least_of_runs(values[:5], 6)) == 0
