"""Resampling and exact ranks against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowsight.llm import queries
from flowsight.llm.importance import feature_words, first_ranks, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    count = lambda texts: Counter(bucket(f) for t in texts for f in plain_features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for doc_id, text in docs:
        words, features = plain_features(text)
        weight = math.floor(sum(gain(bucket(f)) for f in features) / len(features)) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, None, len(words) >= least])
    chosen = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(chosen[: len(chosen) * percent // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted(tuple(r) for r in ((repr(x) for x in row) for row in rows))


def test_words():
    words = feature_words("Ab-c \u00c4\u00e4 x_1\x00\u2003y Q")
    assert [w.decode() for w in words] == ["ab", "c", "\u00c4\u00e4", "x", "1", "\u2003y", "q"]
    assert feature_words(None) == [] == feature_words(" .-")


def test_query_equals_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = queries.op12_importance_resampling(spark, folder)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample(docs, target)
    assert ordered(found.collect()) == ordered(want)
    assert max(r[4] or 0 for r in want) > 20


def test_many_segments_and_odd_rows(spark, docs_of):
    rnd = random.Random(3)
    words = ["wort", "äpfel", "Haus", "x1", "und", "der"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(10, 60)))) for i in range(300)]
    rows += [(None, "der Haus " * 15)] * 4 + [(7, "und der " * 20)] * 5 + [(1000, None), (1001, ""), (1002, "-- ..")]
    target = ["Haus und äpfel", None, "", "der der der"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_resample(rows, target)
    # Ranks of rows that agree in everything may be exchanged, so the rows as a whole are compared.
    for sorting in ({}, {"segment_rows": 10, "samples": 400}, {"runs": 2, "segment_rows": 40, "samples": 1000}):
        found = resample(docs_of(rows), bench, **sorting).collect()
        assert ordered(found) == ordered(want), sorting


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "text string")
    assert resample(docs_of([(1, "x")]).limit(0), bench).collect() == []
    rows = resample(docs_of([(1, "a b " * 20), (2, "c d " * 20)]), bench, percent=100).collect()
    assert sorted(r.rank for r in rows) == [1, 2]


@pytest.mark.parametrize("wanted", [0, 1, 137, 1999, 2000, 5000])
def test_ranks_with_one_value_almost_everywhere(spark, wanted):
    rows = spark.range(0, 2000, 1, 7).select(F.col("id"), F.when(F.col("id") % 9 == 0, F.col("id") % 5).otherwise(3).alias("v"))
    ranked = first_ranks(rows, {"v": F.col("v"), "id": F.col("id")}, wanted, segment_rows=100, samples=500)
    found = {r["id"]: r["rank"] for r in ranked.collect()}
    order = sorted(range(2000), key=lambda i: (i % 5 if i % 9 == 0 else 3, i))
    assert found == {i: (n if n <= wanted else None) for n, i in enumerate(order, 1)}
