"""Resampling of documents towards a target distribution, and exact ranks of any number of rows by regular sampling.

The features of a text are its runs of one and two words, each counted in a hashed bucket. Where the target texts have a
larger share of a bucket than the documents its gain is positive; the gains lie in one array, and a text's weight is
the mean over its features. Gumbel noise from a digest of the doc_id turns the largest scores into a draw without
replacement.

Ranks: scores are sorted in runs where they lie; every so many rows of each run a sample is taken, and evenly spaced
samples are splitters. The segment of each run between two splitters goes to the splitters' task, which merges the segments it
gets; counts of the segments before it give each row its exact rank. Equal scores are split by doc_id, then by place, so
no value, however frequent, makes a segment large.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsight.llm.common import Batches, map_rows, stored

BUCKETS = 10_000
#: Words are runs of ASCII digits, ASCII letters and anything beyond ASCII; all else separates.
_SEPARATE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Runs that are sorted on their own, samples over all runs, and rows a segment is meant to hold.
RUNS, SAMPLES, SEGMENT_ROWS = 1024, 1 << 16, 1 << 20
_LAST = (1 << 63) - 1


def feature_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split()


def feature_buckets(words: list[bytes], width: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to `width` words, joined by a space: CRC-32 modulo buckets."""
    crc = zlib.crc32
    level, out = [crc(w) for w in words], []
    for size in range(1, width + 1):
        out.append(np.array(level, dtype=np.int64))
        level = [crc(w, crc(b" ", c)) for c, w in zip(level, words[size:])]
    return np.concatenate(out) % buckets


def bucket_counts(texts: DataFrame, width: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column text) fall into each bucket; as many numbers as buckets come to the driver."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                total += np.bincount(feature_buckets(feature_words(text), width, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = map_rows(texts.select(F.col("text").cast("string").alias("text")), run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down; one is added to each count."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    ratio = lambda a, b: (b + 1.0) * (s + n) / ((a + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a digest of seed and doc_id (null: of the seed alone)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, width: int = 2, seed: int = 7) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score), one per row of docs, from an array of gains."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = feature_words(text)
                found = feature_buckets(words, width, len(gain))
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                out.append((doc_id, len(words), len(found), weight, weight + noise(doc_id, seed)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _segments(rows: DataFrame, names: list[str], splitters: list[tuple[int, ...]]) -> DataFrame:
    """rows with a column segment: how many splitters are not after the row's key."""
    cuts = np.array(splitters, dtype=np.int64).reshape(-1, len(names))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys = np.concatenate((cuts, np.stack([batch[c].to_numpy() for c in names], axis=1)))
            # Stable, so that a splitter comes before the row it was taken from.
            order = np.lexsort(keys.T[::-1])
            passed = np.empty(len(keys), dtype=np.int64)
            passed[order] = np.cumsum(order < len(cuts))
            yield pa.record_batch([*batch.columns, pa.array(passed[len(cuts) :])], [*batch.schema.names, "segment"])

    return map_rows(rows, run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, segment bigint", 10_000)


def first_ranks(
    rows: DataFrame, keys: dict[str, Column], wanted: int,
    runs: int = RUNS, samples: int = SAMPLES, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """rows with a column rank: 1, 2, 3, ... for the `wanted` first rows in ascending order of keys, null for the others.

    keys are BIGINT expressions without nulls; rows that agree in all of them are ranked in any order. The driver sees
    about `samples` samples and a count per segment, whatever the number of rows. Only segments that hold wanted rows
    are exchanged.
    """
    named = {f"_key{i}": column for i, column in enumerate(keys.values())}
    names = [*named, "_place"]
    # Sorted runs, numbered by run and place and stored, so that every later reading sees the same numbers.
    sorted_runs = rows.withColumns(named).coalesce(runs).sortWithinPartitions(*named)
    held = stored(sorted_runs.withColumn("_place", F.monotonically_increasing_id()))
    total = held.count()
    wanted = max(0, min(wanted, total))
    if not wanted:
        return held.select(*rows.columns, F.lit(None).cast("bigint").alias("rank"))
    step = max(1, total // samples)
    regular = held.where(F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) % step == step // 2)
    taken = sorted(tuple(row) for row in regular.select(*names).collect())
    parts = max(1, min(-(-total // segment_rows), len(taken) // 16))
    splitters = [taken[len(taken) * i // parts] for i in range(1, parts)]

    counted = _segments(held.select(*names), names, splitters).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    sizes = {row["segment"]: row["n"] for row in counted.collect()}
    before, offsets = 0, {}
    for segment in range(parts):
        if before >= wanted:
            break
        offsets[segment] = before
        before += sizes.get(segment, 0)
    if len(offsets) < parts:
        border = splitters[len(offsets) - 1]
        inside = F.struct(*names) < F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, border)])
    else:
        inside = F.lit(True)
    chosen = _segments(held.where(inside), names, splitters)
    merged = F.row_number().over(Window.partitionBy("segment").orderBy(*names))
    # One number per segment.
    offset = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in offsets.values()]), (F.col("segment") + 1).cast("int"))
    rank = merged + offset
    ranked = chosen.withColumn("rank", rank).select(
        *rows.columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("bigint").alias("rank")
    )
    rest = held.where(~inside).select(*rows.columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, width: int = 2,
    buckets: int = BUCKETS, seed: int = 7, **sorting,
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one per row of docs; rank numbers the drawn ones by score.

    Of the documents with at least least_words words, percent in a hundred (rounded down) with the highest scores are drawn,
    ties going to the smaller doc_id, then to fewer features. docs and target have a column text each.

    Null or empty text: no features, weight 0, never drawn unless least_words is 0. Null doc_id: noise of the seed alone, last
    among ties. Repeated rows give repeated results; of rows that agree in everything any may be drawn. Empty tables: no rows,
    or counts of zero for the target. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    scored = stored(score_documents(docs, gain, width, seed))
    long_enough = F.col("n_words") >= least_words
    eligible = scored.where(long_enough)
    keys = {"score": -F.col("score"), "doc_id": F.coalesce("doc_id", F.lit(_LAST)), "n_features": F.col("n_features")}
    ranked = first_ranks(eligible, keys, eligible.count() * percent // 100, **sorting)
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
