"""Removal of repeated passages through a compacted de Bruijn graph of word k-mers.

Edges of the graph are k-mers of words, thinned to those whose digest is the least of some run of consecutive
k-mers. A window of `span` words holds exactly one such run, so wherever its words stand, they select the same edge
at the same place. An edge continues on both sides by the words that share a window with it. Where all sources of an
edge continue alike, they lie on a path without branches: it is kept in the smallest document, and joins mark it as
repeated in all others. Where edges branch, each different continuation is kept once, and its single windows
are compared by 128-bit digests at their source coordinates.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsight.llm.common import Batches, Spans, map_rows, stored, word_digests


def least_of_runs(values: np.ndarray, run: int) -> np.ndarray:
    """Places whose value is the least of some `run` consecutive values (all places of a tie)."""
    if len(values) < run:
        return np.empty(0, dtype=np.int64)

    def sliding(x: np.ndarray, best) -> np.ndarray:
        width = 1
        while width * 2 <= run:
            x = best(x[:-width], x[width:])
            width *= 2
        return best(x[: len(x) - (run - width)], x[run - width :]) if run > width else x

    least = sliding(values, np.minimum)
    padded = np.concatenate((np.zeros(run - 1, np.uint64), least, np.zeros(run - 1, np.uint64)))
    return np.flatnonzero(sliding(padded, np.maximum) == values)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text (for repeated doc_ids) and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def edges(keyed: DataFrame, span: int, k: int) -> DataFrame:
    """Rows (doc_id, digest, pos, edge, context): the selected k-mers and the digest of the words they share windows with."""
    run = span - k + 1

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            rows, columns = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                words = word_digests(_bytes(text))
                if len(words) < span:
                    continue
                spans = Spans(words)
                starts = np.arange(len(words) - k + 1)
                grams = spans.digest(starts, starts + k)
                at = least_of_runs(grams, run)
                from_, to = np.maximum(at + k - span, 0), np.minimum(at + span, len(words))
                # The place of the edge counts, so that a context cut off by the end of a text is another one.
                context = spans.digest(from_, to) ^ (at - from_).astype(np.uint64)
                rows.append(np.full(len(at), i))
                columns.append((at.astype(np.int32), grams[at].view(np.int64), context.view(np.int64)))
            if rows:
                taken = pa.array(np.concatenate(rows))
                pos, edge, context = (pa.array(np.concatenate(c)) for c in zip(*columns))
                yield pa.record_batch(
                    [batch["doc_id"].take(taken), batch["digest"].take(taken), pos, edge, context],
                    ["doc_id", "digest", "pos", "edge", "context"],
                )

    return map_rows(keyed, cut, "doc_id bigint, digest bigint, pos int, edge bigint, context bigint")


def _verdicts(found: DataFrame) -> DataFrame:
    """Per document the places of edges on repeated paths (sure) and of those that need a comparison of windows (open)."""
    # Aggregates are stored before they are joined: Spark splits hot keys only in joins of freshly shuffled rows.
    seen = stored(found.groupBy("edge").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.min("context").alias("low"), F.max("context").alias("high"),
    ).where("least < most").select("edge", "least", (F.col("low") == F.col("high")).alias("straight")))
    repeated = stored(found.join(seen, "edge"))
    # Paths without a branch: every source but the smallest repeats it.
    straight = repeated.where("straight and doc_id > least").select("doc_id", "digest", "pos", F.lit(True).alias("sure"))
    branching = repeated.where("not straight").drop("straight", "least")
    first = stored(branching.groupBy("edge", "context").agg(F.min("doc_id").alias("first")))
    forks = branching.join(first, ["edge", "context"]).select(
        "doc_id", "digest", "pos", (F.col("doc_id") > F.col("first")).alias("sure")
    )
    places = straight.unionByName(forks)
    return places.groupBy("doc_id", "digest").agg(
        F.collect_set(F.when(F.col("sure"), F.col("pos"))).alias("sure"),
        F.collect_set(F.when(~F.col("sure"), F.col("pos"))).alias("open"),
    )


def _packed(keyed: DataFrame) -> DataFrame:
    """The texts compressed, so that moving them costs less."""

    def pack(batches: Batches) -> Batches:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([coder.compress(_bytes(t)) for t in batch["text"].to_pylist()], pa.binary())
            yield pa.record_batch([batch["doc_id"], batch["digest"], texts], ["doc_id", "digest", "packed"])

    return map_rows(keyed, pack, "doc_id bigint, digest bigint, packed binary")


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(data: bytes, removed: np.ndarray) -> tuple[int, int, bytes]:
    words = data.split()
    return len(words), int(removed.sum()), b" ".join(compress(words, (~removed).tolist()))


_RESULT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_JUDGED = pa.schema([
    *_RESULT, ("row", pa.int64()), ("packed", pa.binary()), ("sure", pa.list_(pa.int32())),
    ("windows", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())),
])


def remove_repeats(docs: DataFrame, span: int = 50, k: int = 12, digest_only: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): the words left when passages that an earlier document has are removed.

    A word goes if some `span` consecutive words that hold it also stand in a document with a smaller doc_id; words
    are separated by blanks 0x20 and 0x09-0x0D and compared unchanged. Passages are judged on the given texts, not on
    what is left. kept joins the words left by one space; with digest_only it is the lowercase hexadecimal SHA-256 of that.

    Null or empty text, or fewer than `span` words: nothing is removed. Rows with a null doc_id are kept whole and are
    no source. Rows that share a doc_id do not remove from each other, and repeated rows give repeated results. Other
    columns are not read. Empty table: no rows.

    Only selected edges are shuffled (about one word in 20), partial minima go first, and texts move compressed.
    """
    if not 0 < k <= span:
        raise ValueError("k must be between 1 and span")
    keyed = _keyed(docs)
    sources = keyed.where("doc_id is not null")
    verdicts = _verdicts(stored(edges(sources, span, k)))
    open_words = span - k

    def settle(data: bytes, removed: np.ndarray) -> tuple[int, int, str]:
        n, gone, kept = _kept(data, removed)
        return n, gone, hashlib.sha256(kept).hexdigest() if digest_only else kept.decode("utf-8", "surrogatepass")

    def judge(batches: Batches) -> Batches:
        reader = zstandard.ZstdDecompressor()
        row = TaskContext.get().partitionId() << 40  # names the row of an open text; kept as it is stored
        for batch in batches:
            out = []
            for packed, sure, doubt in zip(batch["packed"].to_pylist(), batch["sure"].to_pylist(), batch["open"].to_pylist()):
                data = reader.decompress(packed)
                words = word_digests(data)
                n = len(words)
                at = np.array(sure or [], dtype=np.int64)
                from_, to = np.maximum(at + k - span, 0), np.minimum(at + span, n)
                removed = _covered(n, from_, to)
                windows = np.empty(0, dtype=np.int64)
                if doubt:
                    at = np.array(doubt, dtype=np.int64)
                    asked = _covered(n, np.maximum(at - open_words, 0), np.minimum(at, n - span) + 1)
                    # Windows inside the context of a repeated path are decided already.
                    known = _covered(n, from_, to - span + 1)
                    windows = np.flatnonzero(asked & ~known)
                if len(windows):
                    h1, h2 = (Spans(words, w).digest(windows, windows + span).view(np.int64) for w in (0, 1))
                    out.append((None, None, None, row, packed, sure or [], windows.tolist(), h1.tolist(), h2.tolist()))
                    row += 1
                else:
                    out.append((*settle(data, removed), None, None, None, None, None, None))
            columns = list(zip(*out))
            if out:
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _JUDGED)]
                yield pa.record_batch([batch["doc_id"], *arrays], ["doc_id", *_JUDGED.names])

    judged = stored(map_rows(
        _packed(keyed).join(verdicts, ["doc_id", "digest"], "left").select("doc_id", "packed", "sure", "open"), judge,
        "doc_id bigint, n_words bigint, n_removed bigint, kept string, row bigint, packed binary, "
        "sure array<int>, windows array<int>, h1 array<bigint>, h2 array<bigint>",
    ))
    clear = judged.where("packed is null").select("doc_id", "n_words", "n_removed", "kept")
    unsure = judged.where("packed is not null")
    each = unsure.select("doc_id", "row", F.explode(F.arrays_zip("windows", "h1", "h2")).alias("w")).select(
        "doc_id", "row", F.col("w.windows").alias("pos"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")
    )
    ends = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    first = stored(ends.where("least < most"))
    hits = each.join(first, ["h1", "h2"]).where("doc_id > least").groupBy("row").agg(F.collect_list("pos").alias("hits"))

    def finish(batches: Batches) -> Batches:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, sure, hit in zip(batch["packed"].to_pylist(), batch["sure"].to_pylist(), batch["hits"].to_pylist()):
                data = reader.decompress(packed)
                n = len(data.split())
                at, hit = np.array(sure, dtype=np.int64), np.array(hit or [], dtype=np.int64)
                from_ = np.append(np.maximum(at + k - span, 0), hit)
                out.append(settle(data, _covered(n, from_, np.append(np.minimum(at + span, n), hit + span))))
            if out:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)]
                yield pa.record_batch([batch["doc_id"], *arrays], ["doc_id", *_RESULT.names])

    rest = map_rows(
        unsure.select("row", "doc_id", "packed", "sure").join(hits, "row", "left").drop("row"),
        finish, "doc_id bigint, n_words bigint, n_removed bigint, kept string",
    )
    return clear.unionByName(rest)
