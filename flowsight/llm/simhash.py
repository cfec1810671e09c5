"""Near-duplicate documents by SimHash fingerprints, linked through a grid of segment bit counts.

The 64 bits of a fingerprint are read as 32 segments of two bits. The number of bits set in each segment is a point
with 32 coordinates from 0 to 2, and the Manhattan distance of two points is never more than the number of
differing bits. Two points within distance `most` agree wholly on at least `blocks - most` of `blocks` blocks of
coordinates, so links meet in a cell of one of the grids made of that many blocks. Inside a cell the Manhattan
distance is tested first and the differing bits are counted last.

Counts are kept in thermometer code (0, 1, 2 as 00, 01, 11), in which a Manhattan distance is the number of bits set
in an exclusive or.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowsight.llm.common import map_rows, stored
from flowsight.llm.components import components

LOW_BITS = 0x5555555555555555
#: Distinct fingerprints of one cell that a task holds at a time; larger cells are compared tile by tile.
TILE = 65_536
#: Cells up to this size are compared row against following rows, for all cells of a batch at once.
SHORT = 16


def shingle_digests(words: list[bytes], width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `width` words joined by a space (all words, if there are fewer), in pieces."""
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: -(width - 1) or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        yield np.array([digest(text[s:e], seed) for s, e in pairs], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a whole text: a bit is set if it is set in more than half of the shingle digests. No words: 0."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the blanks 0x20 and 0x09-0x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    set_bits, total = np.zeros(64, dtype=np.int64), 0
    for digests in shingle_digests(words, width):
        bits = np.unpackbits(digests.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        total += len(digests)
    return int(np.packbits(set_bits * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """Rows (doc_id, fp): one per document, fp the fingerprint's bits as BIGINT. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id bigint, fp bigint")


def counts_code(fp: Column) -> Column:
    """The 32 segment counts of a fingerprint in thermometer code."""
    next_bit = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(most: int, blocks: int) -> list[int]:
    """The coordinates of each grid as a bit mask; one grid for each choice of blocks - most blocks."""
    if not 0 <= most < blocks <= 32:
        raise ValueError("blocks must be over the number of differing bits, and at most 32")
    bounds = [round(i * 32 / blocks) for i in range(blocks + 1)]
    parts = [((1 << 2 * (e - s)) - 1) << 2 * s for s, e in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - most)]


def _code(fp: np.ndarray) -> np.ndarray:
    low, after = np.uint64(LOW_BITS), fp >> np.uint64(1)
    return ((fp | after) & low) | ((fp & after & low) << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Places where a and b link: first the lower bound on all, then differing bits on those that are left."""
    at = np.flatnonzero(np.bitwise_count(_code(a) ^ _code(b)) <= most)
    return at[np.bitwise_count(a[at] ^ (b[at] if np.ndim(b) else b)) <= most]


def spanning_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of fps that are connected through links of at most `most` differing bits.

    Each fingerprint is compared once with those not reached so far, so a group of near copies costs little more than
    its size, and there are fewer links than fingerprints.
    """
    left, from_, to = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            at = _near(left, one, most)
            if len(at):
                near = left[at]
                from_.append(np.full(len(near), one))
                to.append(near)
                queue.extend(near)
                left = np.delete(left, at)
    empty = np.empty(0, dtype=np.uint64)
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (empty, empty)


def _links_of_cells(batches: Iterator[pa.RecordBatch], most: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Links inside the cells of rows sorted by cell. A cell over `tile` rows gives one row with its key instead."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])

    def out(a, b) -> pa.RecordBatch:
        a, b = np.ascontiguousarray(a).view(np.int64), np.ascontiguousarray(b).view(np.int64)
        return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)

    def large(cell: int) -> pa.RecordBatch:
        return pa.record_batch([[None], [None], [cell]], schema=schema)

    def closed(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.append(starts, len(cells)))
        for start, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            a, b = spanning_links(fps[start : start + size], most)
            if len(a):
                yield out(a, b)
        short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
        cells, fps = cells[short], fps[short]
        for step in range(1, SHORT):
            same = np.flatnonzero(cells[step:] == cells[:-step])
            if not len(same):
                break
            at = same[_near(fps[same], fps[same + step], most)]
            if len(at):
                yield out(fps[at], fps[at + step])

    cells, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    skipped = None  # the cell found too large, whose rows are passed over
    for batch in batches:
        cells = np.concatenate((cells, batch["cell"].to_numpy()))
        fps = np.concatenate((fps, batch["fp"].to_numpy().view(np.uint64)))
        if skipped is not None:
            keep = np.searchsorted(cells, skipped, side="right")
            cells, fps = cells[keep:], fps[keep:]
            if not len(cells):
                continue
            skipped = None
        if not len(cells):
            continue
        last = np.searchsorted(cells, cells[-1])
        yield from closed(cells[:last], fps[:last]) if last else ()
        cells, fps = cells[last:], fps[last:]
        if len(cells) > tile:
            skipped = cells[0]
            yield large(int(skipped))
            cells, fps = cells[:0], fps[:0]
    if len(cells) and skipped is None:
        yield from closed(cells, fps)


def links(nodes: DataFrame, most: int = 4, blocks: int = 7, tile: int = TILE) -> DataFrame:
    """Rows (a, b) of fingerprints that connect every pair of nodes with at most `most` differing bits.

    nodes holds distinct fingerprints in a column fp. Pairs that are connected through other links may be missing; a
    path of links between them is not.
    """
    fp = F.col("fp")
    # A cell is named by the digest of its grid and counts; two cells with one name only add pairs to test.
    grids = [
        F.xxhash64(F.lit(i), counts_code(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        for i, mask in enumerate(grid_masks(most, blocks))
    ]
    cells = nodes.select("fp", F.explode(F.array(*grids)).alias("cell"))
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell")
    schema = "a bigint, b bigint, cell bigint"
    found = stored(map_rows(sorted_cells, lambda batches: _links_of_cells(batches, most, tile), schema, 100_000))
    direct = found.where("cell is null").select("a", "b")
    large = found.where("cell is not null").select("cell")
    if large.isEmpty():
        return direct
    # Every row of a large cell goes to each pair of tiles that holds its own, so a task compares two tiles.
    in_large = cells.join(large, "cell").select("cell", "fp")
    sizes = in_large.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = in_large.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    pairs = each.select(pair.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    tiled = map_rows(pairs, lambda batches: _links_of_cells(batches, most, 1 << 62), schema)
    return direct.unionByName(tiled.select("a", "b"))


def near_duplicates(docs: DataFrame, most: int = 4, width: int = 4, blocks: int = 7, tile: int = TILE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, copies), one per row of docs.

    Documents link if their fingerprints differ in at most `most` bits; component_id is the smallest doc_id that links
    reach, the document's own included. copies counts the rows with the same fingerprint.

    Null text: as empty. Texts without words share fingerprint zero and link like any other. Null doc_id: the row keeps
    its place in a component but never names it; component_id is null if no row of it has a doc_id. Repeated rows give
    repeated results. Empty table: no rows. Other columns of docs are not read.

    Equal fingerprints are counted before anything is compared, so copies cost one shuffled row per task. Fingerprints
    that differ are never paired within a whole group: a cell gives fewer links than it has rows.
    """
    marked = stored(fingerprints(docs, width))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    reached = components(links(nodes.select("fp"), most, blocks, tile))
    roots = nodes.join(reached, nodes["fp"] == reached["node"], "left").select(
        "fp", "first", "copies", F.coalesce("root", "fp").alias("root")
    )
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = roots.join(named, "root").select("fp", "copies", "component_id")
    joined = marked.join(classes, "fp")
    return joined.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies"
    )
