"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import re
import zlib

import pytest

from flowsight.llm import queries
from flowsight.llm.periods import find_runs, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, least=12):
    n, out = len(words), []
    for lag in range(1, n // 2 + 1):
        i = 0
        while i + lag < n:
            if words[i] == words[i + lag]:
                j = i
                while j + lag < n and words[j] == words[j + lag]:
                    j += 1
                stretch = words[i : j + lag]
                size = len(stretch)
                smaller = any(all(stretch[x] == stretch[x + p] for x in range(size - p)) for p in range(1, lag))
                if size >= max(least, 2 * lag) and not smaller:
                    out.append((i, size, lag))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    dropped = {i for start, size, lag in runs for i in range(start + lag, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize("least", [4, 5, 7, 12, 20])
def test_runs_equal_plain_search(least):
    rnd = random.Random(least)
    for _ in range(80):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            n, kinds = rnd.choice([0, 1, 5, 11, 12, 13, 40, 90]), rnd.choice([1, 2, 3, 8])
            words = [b"%d" % rnd.randrange(kinds) for _ in range(n)]
            if n > 20 and rnd.random() < 0.5:
                lag, start = rnd.randint(1, n // 3), rnd.randrange(n // 2)
                for i in range(start + lag, min(n, start + lag * rnd.randint(2, 5))):
                    words[i] = words[i - lag]
            texts.append(words)
        found = [[tuple(r) for r in runs.tolist()] for runs in find_runs(texts, least)]
        assert found == [plain_runs(w, least) for w in texts]


def test_one_word_many_times_is_one_run():
    assert find_runs([[b"a"] * 50_000])[0].tolist() == [[0, 50_000, 1]]


def test_nested_runs():
    inner = [b"a", b"b"] * 8
    words = (inner + [b"c"]) * 3
    found = [tuple(r) for r in find_runs([words])[0].tolist()]
    assert found == plain_runs(words)
    assert (0, 51, 17) in found and (0, 16, 2) in found


def test_table_of_odd_rows(docs_of):
    song = "la le li lo lu " * 4
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "ho " * 12), (4, "ho " * 12), (None, song), (5, "ho " * 11), (6, "é x " * 20)]
    found = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs(docs_of(rows)).collect()}
    assert found == {
        (1, ""): [], (2, ""): [], (3, ""): [], (4, "ho"): [(0, 12, 1)], (None, "la le li lo lu"): [(0, 20, 5)],
        (5, ("ho " * 11).strip()): [], (6, "é x"): [(0, 20, 1)],
    }
    assert periodic_runs(docs_of(rows)).count() == len(rows)
    assert periodic_runs(docs_of([(1, "x")]).limit(0)).count() == 0
    clashing = docs_of(rows).selectExpr("*", "1 AS runs", "'x' AS collapsed")
    assert periodic_runs(clashing).where("doc_id = 4").first().collapsed == "ho"


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(WORD.findall(text or ""))
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = best[1] * 1000 // best[2] if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(plain_collapsed(words, runs)))


def test_query_equals_plain_search(spark, tmp_path):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [(d, t) for d, t in texts if len(WORD.findall(t or "")) < 400] + [(10_000 + i, "a b c d e f " * (i % 9)) for i in range(60)]
    texts += [(20_000, None), (20_001, " x\x0by\x0cz\x1fq ")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_row(*row) for row in texts]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert sum(row[1] > 0 for row in want) > 10
