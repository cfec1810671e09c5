"""Document fingerprints as invertible Bloom lookup tables over paragraph digests.

A text is cut into paragraphs, and each paragraph's digest is added to three cells of a small table: a counter, a sum of
digests and a sum of check digests. Two tables are subtracted cell by cell, which cancels what both texts share.
Cells that hold one digest are then peeled off one after the other until the whole difference is known. If peeling gets
stuck, both tables are built again, large enough for the paragraphs of both texts, and twice as large if that fails too.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from flowsight.llm.common import Batches, Spans, map_rows, mixed, word_bounds, word_digests

#: Cells of a fingerprint, in three equal parts.
CELLS = 15
#: Characters of texts that are compared side by side.
TOGETHER = 1 << 19
_MARKS = np.frombuffer(b".!?", dtype=np.uint8)
_SALTS = np.array([0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC3A5C85C97CB3127], dtype=np.uint64)


def paragraphs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of the paragraphs of many texts, one for each occurrence, and how many each text has.

    A paragraph ends at a line break, after a word that ends in a full stop, exclamation or question mark, and after
    about every sixteenth word, chosen by its digest, so that a text of one long line has paragraphs too. Blanks between
    words do not count. Digests stand in the order of texts.
    """
    parts = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = b"\n".join(parts)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    words = word_digests(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    # The break between two texts ends a paragraph like any other.
    last = np.isin(raw[ends - 1], _MARKS) | (words & np.uint64(15) == 0)
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[-1] = True
    to = np.flatnonzero(last) + 1
    digests = Spans(words).digest(np.concatenate(([0], to[:-1])), to)
    borders = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(borders, starts[to - 1], side="right")
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    # Repeats in a text get a number, so that each counts on its own.
    firsts = np.concatenate(([True], (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])))
    places = np.arange(len(digests))
    number = places - np.maximum.accumulate(np.where(firsts, places, 0))
    return mixed(digests + number.astype(np.uint64) * _SALTS[3]), np.bincount(owner, minlength=len(texts))


def paragraph_digests(text: str) -> np.ndarray:
    return paragraphs_of([text])[0]


class Tables:
    """Many tables of cells side by side, each with its own number of cells in three equal parts."""

    def __init__(self, cells: np.ndarray):
        self.part = np.asarray(cells, dtype=np.int64) // 3
        self.start = np.concatenate(([0], np.cumsum(3 * self.part)))
        size = int(self.start[-1])
        self.counts = np.zeros(size, dtype=np.int64)
        self.keys, self.checks = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, signs: np.ndarray | int = 1) -> np.ndarray:
        """Add digests to tables (or take them out, with signs of -1); the cells they are in."""
        part = self.part[owner]
        wide = part.astype(np.uint64)
        at = np.concatenate([
            self.start[owner] + i * part + (mixed(keys ^ salt) % wide).astype(np.int64) for i, salt in enumerate(_SALTS[:3])
        ])
        signs = np.broadcast_to(np.asarray(signs, dtype=np.int64), keys.shape)
        factor = signs.astype(np.uint64)  # minus one is the largest unsigned number: sums wrap round
        np.add.at(self.counts, at, np.tile(signs, 3))
        np.add.at(self.keys, at, np.tile(keys * factor, 3))
        np.add.at(self.checks, at, np.tile(mixed(keys + _SALTS[3]) * factor, 3))
        return at

    def less(self, other: Tables, mine: np.ndarray, theirs: np.ndarray) -> Tables:
        """Tables `mine` of this less `theirs` of the other, cell by cell; all of one size."""
        left = Tables(3 * self.part[mine])
        width = 3 * int(self.part[0])
        for name in ("counts", "keys", "checks"):
            a, b = getattr(self, name).reshape(-1, width), getattr(other, name).reshape(-1, width)
            setattr(left, name, (a[mine] - b[theirs]).reshape(-1))
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests recovered with their tables and signs, and which tables have too few cells to tell all."""
        owner_of = np.repeat(np.arange(len(self.part)), 3 * self.part)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cells = np.arange(len(self.counts))
        while len(cells):
            at = cells[np.abs(self.counts[cells]) == 1]
            factor = self.counts[at].astype(np.uint64)
            keys = self.keys[at] * factor
            alone = mixed(keys + _SALTS[3]) == self.checks[at] * factor
            at, keys = at[alone], keys[alone]
            owner = owner_of[at]
            order = np.lexsort((keys, owner))
            at, keys, owner = at[order], keys[order], owner[order]
            once = np.ones(len(at), dtype=bool)
            once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner, signs = keys[once], owner[once], self.counts[at[once]]
            if not len(keys):
                break
            found.append((keys, owner, signs))
            # Only cells that have just lost a digest can hold a single one now.
            cells = np.unique(self.add(keys, owner, -signs))
        stuck = np.zeros(len(self.part), dtype=bool)
        stuck[owner_of[(self.counts != 0) | (self.keys != 0) | (self.checks != 0)]] = True
        keys, owner, signs = (np.concatenate(c) for c in zip(*found)) if found else (self.keys[:0], owner_of[:0], self.counts[:0])
        return keys, owner, signs, stuck

    def text(self, number: int) -> str:
        """A table as base64: counters (32 bits), sums of digests (64) and of checks (32), little-endian."""
        cells = slice(self.start[number], self.start[number + 1])
        parts = (self.counts[cells].astype("<i4"), self.keys[cells].astype("<u8"), self.checks[cells].astype("<u4"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode("ascii")


class Versions:
    """Texts with their paragraph digests and fingerprints."""

    def __init__(self, texts: list[str]):
        self.keys, self.sizes = paragraphs_of(texts)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.tables = Tables(np.full(len(texts), CELLS))
        self.tables.add(self.keys, np.repeat(np.arange(len(texts)), self.sizes))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of some texts, and to which of them each belongs."""
        sizes = self.sizes[numbers]
        owner = np.repeat(np.arange(len(numbers)), sizes)
        return self.keys[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[numbers], sizes)], owner


def differences(a: Versions, b: Versions, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests in which pairs of texts differ, with the pair of each and 1 or -1 for the first or second text.

    Fingerprints are subtracted first. Pairs whose difference they are too small to tell get tables of two cells per
    paragraph of both texts, which is enough but for bad luck, against which tables double.
    """
    keys, owner, signs, stuck = a.tables.less(b.tables, mine, theirs).peel()
    found = [(keys[~stuck[owner]], owner[~stuck[owner]], signs[~stuck[owner]])]
    left = np.flatnonzero(stuck)
    cells = 2 * (a.sizes[mine] + b.sizes[theirs]) + CELLS
    while len(left):
        tables = Tables(cells[left])
        tables.add(*a.of(mine[left]))
        tables.add(*b.of(theirs[left]), -1)
        keys, owner, signs, stuck = tables.peel()
        good = ~stuck[owner]
        found.append((keys[good], left[owner[good]], signs[good]))
        left = left[stuck]
        cells *= 2
    return tuple(np.concatenate(c) for c in zip(*found))


def likeness(a: Versions, b: Versions, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Share of paragraphs that pairs of texts have in common, 1 for two without any."""
    total = a.sizes[mine] + b.sizes[theirs]
    apart = np.bincount(differences(a, b, mine, theirs)[1], minlength=len(mine))
    return 1.0 - apart / np.maximum(total, 1)


def changed_paragraphs(text: str, other: str) -> tuple[list[int], list[int]]:
    """Digests of the paragraphs that only the first and only the second version of a text has."""
    one = np.zeros(1, dtype=np.int64)
    keys, _, signs = differences(Versions([text]), Versions([other]), one, one)
    return keys[signs > 0].tolist(), keys[signs < 0].tolist()


def compare(pairs: list[tuple[int | None, str, str]]) -> list[tuple]:
    """Result rows for (doc_id, text, next text)."""
    texts, own, following = [], [], []
    for _, text, after in pairs:
        if not texts or texts[-1] is not text:
            texts.append(text)
        own.append(len(texts) - 1)
        texts.append(after)
        following.append(len(texts) - 1)
    edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, after in pairs]
    before, changed = Versions(texts), Versions(edited)
    own, following, every = np.array(own), np.array(following), np.arange(len(pairs))
    near, apart = likeness(before, changed, own, every), likeness(before, before, own, following)
    return [
        (
            doc_id, len(text), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(),
            before.tables.text(own[i]), changed.tables.text(i), float(near[i]), float(apart[i]),
        )
        for i, (doc_id, text, _) in enumerate(pairs)
    ]


def _slices(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int | None, int]]]:
    """rows with a slice number that rises in their order, and the first row (doc_id, digest) behind each slice.

    The order is by falling doc_id, nulls last, then by digest. A doc_id that spans several quantiles, and the null doc_ids, are
    cut into as many slices by digest.
    """
    slices = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts"), F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("n"))
    cuts, known, n = found.first()
    spans = Counter(cuts or [])
    order = F.col("doc_id").cast("double")
    if spans:
        splits = [float("-inf"), *sorted({float(cut) for cut in spans}), float("inf")]
        edges = Bucketizer(splits=splits, inputCol="_order", outputCol="_slice", handleInvalid="keep")
        rows = edges.transform(rows.withColumn("_order", F.coalesce(order, F.lit(float("-inf"))))).drop("_order")
        last = len(splits) - 1
        number = F.lit(last) - F.col("_slice").cast("int")
    else:
        last, number = 0, F.lit(0)
    share = F.col("digest").cast("double") / F.lit(2.0**64) + F.lit(0.5)

    def part(parts: Column) -> Column:
        return F.least(F.floor(share * parts).cast("int"), parts - F.lit(1))

    # Within its bucket such a doc_id is the smallest, so its rows come last. Doubles tell doc_ids below 2**53 apart.
    hot = {cut: times for cut, times in spans.items() if times > 1 and abs(cut) < 1 << 53}
    inside = F.lit(0)
    if hot:
        times = F.create_map(*(F.lit(v).cast(kind) for pair in hot.items() for v, kind in zip(pair, ("bigint", "int"))))
        parts = F.try_element_at(times, F.col("doc_id"))
        inside = F.when(parts.isNull(), 0).otherwise(F.lit(1) + part(parts))
    nulls = F.lit(max(1, -(-(n - known) * slices // max(1, n))))
    at = F.when(F.col("doc_id").isNull(), F.lit((last + 1) * 2 * slices) + part(nulls)).otherwise(number * F.lit(2 * slices) + inside)
    rows = rows.withColumn("_slice", at.cast("int"))
    first = F.max(F.struct("doc_id", F.bitwise_not("digest").alias("least"))).alias("first")
    heads = {r["_slice"]: (r["first"]["doc_id"], ~r["first"]["least"]) for r in rows.groupBy("_slice").agg(first).collect()}
    used = sorted(heads)
    return rows, [(s, *heads[used[(i + 1) % len(used)]]) for i, s in enumerate(used)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next smaller doc_id, after the smallest the largest; a single document follows
    itself. The edited text replaces the last half of the code points (rounded down) by the first as many of the next
    document, or all if it has fewer. near_edited and near_next (0 to 1) compare a document's paragraphs with those of its
    edited text and of the next document. Equal texts have equal fingerprints.

    Null text: as empty. Rows with one doc_id follow each other by text digest, rows with a null doc_id come last.
    Repeated rows are documents of their own. Other columns are not read. Empty table: no rows.

    doc_ids are cut into slices at approximate quantiles, which only balance the work, frequent and null doc_ids by text digest; a
    text moves once, and a second time if it is the first of its slice, to be seen from the slice before. Rows equal in doc_id
    and text share a slice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows, follows = _slices(rows.withColumn("digest", F.xxhash64("text")))
    own = F.struct(F.col("_slice").alias("slice"), F.lit(0).alias("later"))
    spark = docs.sparkSession
    heads = spark.createDataFrame(follows, "_before int, _head bigint, _digest bigint")
    # One row per slice: a bounded table.
    same = F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("digest") == F.col("_digest"))
    rows = rows.join(F.broadcast(heads), same, "left")
    later = F.struct(F.col("_before").alias("slice"), F.lit(1).alias("later"))
    rows = rows.select(
        "doc_id", "text", "digest",
        F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, later))).alias("_at"),
    ).select("doc_id", "text", "digest", "_at.slice", "_at.later")
    rows = rows.repartition("slice").sortWithinPartitions("slice", "later", F.col("doc_id").desc_nulls_last(), "digest")

    def pair(batches: Batches) -> Batches:
        held = None  # the row that waits for its next: slice, doc_id, text
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        pairs, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*compare(pairs)), kinds)], names)

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("slice", "later", "doc_id", "text"))
            for part, later, doc_id, text in zip(*columns):
                if later and (held is None or held[0] != part):
                    continue  # the slice has met its next already
                if held is not None:
                    pairs.append((held[1], held[2], text))
                    size += len(held[2])
                    if size >= TOGETHER:
                        yield done()
                        pairs, size = [], 0
                held = None if later else (part, doc_id, text)
        if pairs:
            yield done()

    return map_rows(
        rows.select("slice", "later", "doc_id", "text"), pair,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )

