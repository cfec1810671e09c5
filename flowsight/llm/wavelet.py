"""Token ids in wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

Layout of a file: the eight bytes WVLTMTX1, eight little-endian unsigned 32-bit numbers (version, bit planes, blocks of
a plane, ids, documents, end id, 0, 0), then zstd frames, each after its length as an unsigned 32-bit number: first the
document directory (doc_ids as signed 64-bit numbers, flags of null doc_ids, lengths as unsigned 32-bit numbers), then
for each plane, from the highest bit, its zeros and the ones before each block of 4,096 bits as unsigned 32-bit
numbers followed by the bits, eight to a byte, lowest first.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsight.llm.common import Batches, map_rows, stored
from flowsight.llm.tokens import encoder, vocabulary

MAGIC = b"WVLTMTX1"
BLOCK = 4096
_HEADER = struct.Struct("<8s8I")


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, end_id: int = 0) -> bytes:
    """The file of a shard: ids of its documents one after the other, each document's length with its end id."""
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    coder = zstandard.ZstdCompressor(level=1)
    parts = []

    def add(*arrays: np.ndarray) -> None:
        frame = coder.compress(b"".join(a.tobytes() for a in arrays))
        parts.extend((struct.pack("<I", len(frame)), frame))

    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    add(np.array([d or 0 for d in doc_ids], dtype="<i8"), nulls, lengths.astype("<u4"))
    row = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes - 1, -1, -1):
        bits = (row >> row.dtype.type(plane)).astype(np.uint8) & 1
        ones = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.uint32) if len(bits) else bits.astype(np.uint32)
        before = np.concatenate(([0], np.cumsum(ones)))[: len(ones)]
        add(np.array([len(bits) - ones.sum()], dtype="<u4"), before.astype("<u4"), np.packbits(bits, bitorder="little"))
        chosen = bits.astype(bool)
        row = np.concatenate((row[~chosen], row[chosen]))
    blocks = -(-len(ids) // BLOCK)
    return _HEADER.pack(MAGIC, 1, planes, blocks, len(ids), len(doc_ids), end_id, 0, 0) + b"".join(parts)


class Shard:
    """A file read back. Places and ranges count ids of the shard from 0; ranges exclude their end."""

    def __init__(self, data: bytes):
        magic, version, self.planes, self.blocks, self.size, self.documents, self.end_id, _, _ = _HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard file of version 1")
        reader, at, frames = zstandard.ZstdDecompressor(), _HEADER.size, []
        for _ in range(self.planes + 1):
            length, = struct.unpack_from("<I", data, at)
            frames.append(reader.decompress(data[at + 4 : at + 4 + length]))
            at += 4 + length
        n = self.documents
        ids = np.frombuffer(frames[0], "<i8", n)
        nulls = np.frombuffer(frames[0], np.uint8, n, 8 * n)
        self.doc_ids = [None if null else int(d) for d, null in zip(ids, nulls)]
        self.lengths = np.frombuffer(frames[0], "<u4", n, 9 * n).astype(np.int64)
        self.zeros = [int(np.frombuffer(f, "<u4", 1)[0]) for f in frames[1:]]
        self.before = [np.frombuffer(f, "<u4", self.blocks, 4) for f in frames[1:]]
        self.bits = [np.frombuffer(f, np.uint8, -1, 4 + 4 * self.blocks) for f in frames[1:]]

    def _rank(self, plane: int, at: int) -> int:
        """Ones of a plane before a place."""
        block = min(at // BLOCK, self.blocks - 1)
        if at == 0:
            return 0
        part = np.unpackbits(self.bits[plane][block * BLOCK // 8 : -(-at // 8)], bitorder="little")
        return int(self.before[plane][block]) + int(part[: at - block * BLOCK].sum())

    def _select(self, plane: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) zero or one of a plane."""
        before = self.before[plane].astype(np.int64)
        if not bit:
            before = np.arange(self.blocks) * BLOCK - before
        block = int(np.searchsorted(before, nth, side="right")) - 1
        part = np.unpackbits(self.bits[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        part = part[: self.size - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[nth - int(before[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            bit = int(self.bits[plane][at // 8] >> (at % 8)) & 1
            ones = self._rank(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(self.planes):
            low, high = self._rank(plane, start), self._rank(plane, end)
            if value >> (self.planes - 1 - plane) & 1:
                start, end = self.zeros[plane] + low, self.zeros[plane] + high
            else:
                start, end = start - low, end - high
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a range."""
        if value >> self.planes:
            return 0
        low, high = self._range(value, start, self.size if end is None else end)
        return high - low

    def find(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        at = self._range(value, 0, self.size)[0] + nth
        for plane in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    @cached_property
    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane upwards."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        row = np.zeros(self.size, dtype=kind)
        for plane in range(self.planes - 1, -1, -1):
            bits = np.unpackbits(self.bits[plane], count=self.size, bitorder="little").view(bool)
            above = np.empty_like(row)
            above[~bits] = row[: self.zeros[plane]]
            above[bits] = row[self.zeros[plane] :] | kind(1 << (self.planes - 1 - plane))
            row = above
        return row.astype(np.uint32)

    def document(self, number: int) -> np.ndarray:
        """The ids of a document by its place in the shard."""
        end = int(self.lengths[: number + 1].sum())
        return self.ids[end - int(self.lengths[number]) : end]


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 0, shard_ids: int = 1 << 20) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; rows (part, number, first_ids, n_ids, file).

    Files hold whole documents and are closed once they have shard_ids ids. (part, number) orders them, first_ids counts
    the ids in earlier files. The files are rows of a stored table, so a file of a task that is run again takes the
    place of the lost one; file is the whole file for Shard(). path: a vocabulary file of the tokenizers library.

    Null text: as empty, so only the end id. Null doc_ids come first; rows with one doc_id stand in the order of their text
    digests. Other columns are not read. Empty table: no rows.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digest").drop("digest")

    def write(batches: Batches) -> Batches:
        part, number, inside = TaskContext.get().partitionId(), 0, 0
        ids, names, lengths, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            file = encode_shard(np.concatenate(ids), names, np.array(lengths), end_id)
            return pa.record_batch(
                [pa.array([part]), pa.array([number]), pa.array([inside]), pa.array([size]), pa.array([file], pa.binary())],
                ["part", "number", "inside", "n_ids", "file"],
            )

        for batch in batches:
            found = encoder(path).ids(batch["text"].to_pylist())
            for name, own in zip(batch["doc_id"].to_pylist(), found):
                ids += [own, np.array([end_id], dtype=np.uint32)]
                names.append(name)
                lengths.append(len(own) + 1)
                size += len(own) + 1
                if size >= shard_ids:
                    yield close()
                    number, inside = number + 1, inside + size
                    ids, names, lengths, size = [], [], [], 0
        if names:
            yield close()

    files = stored(map_rows(rows, write, "part bigint, number bigint, inside bigint, n_ids bigint, file binary"))
    # The number of parts is that of Spark's partitions, whatever the number of files.
    totals, before = {}, 0
    for row in files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect():
        totals[row["part"]] = before
        before += row["n_ids"]
    firsts = files.sparkSession.createDataFrame(list(totals.items()), "part bigint, before bigint")
    placed = files.join(F.broadcast(firsts), "part")
    return placed.select("part", "number", (F.col("before") + F.col("inside")).alias("first_ids"), "n_ids", "file")


def read_shards(shards: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from files: ids before the document, its ids with the end id."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for first, file in zip(batch["first_ids"].to_pylist(), batch["file"]):
                shard = Shard(file.as_py())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                ids = shard.ids.astype("<u4")
                crc = [zlib.crc32(ids[s:e].data) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_rows(shards.select("first_ids", "file"), read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", 8)


def occurrences(shards: DataFrame, value: int) -> DataFrame:
    """Rows (part, number, n): how often an id occurs in each file, counted in the bit planes."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            found = [Shard(file.as_py()).count(value) for file in batch["file"]]
            yield pa.record_batch([batch["part"], batch["number"], pa.array(found, pa.int64())], ["part", "number", "n"])

    return map_rows(shards.select("part", "number", "file"), count, "part bigint, number bigint, n bigint", 8)
