"""Near copies by SuperMinHash: signatures from correlated ranks, bands that propose, full shingle sets that decide.

A text is the set of its runs of `width` words. For its signature each element deals the numbers 0, 1, 2, ... out to the
registers in an order of its own (a permutation drawn step by step), each with a random fraction added; a register keeps
the least value it is dealt. An element's registers get different ranks, so the registers of a signature are spread more
evenly than independent minima and estimate a similarity with less variance. Once all registers of a text hold less than
the next rank no further step can change them, and dealing stops, for all but short texts after two or three steps.

Texts that agree in a band of ROWS registers meet. A pair at a similarity of 0.8 misses all BANDS bands with a chance of
(1 - 0.8**4)**24, three in a million, or less.

Texts with one set are one node. Nodes that meet form candidate groups. A small group goes to one task, which compares
its sets. In a large one all sets are first compared with a representative, slice by slice; those that link to it need no
comparison among themselves, only bands that hold one that does not link are compared, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsight.llm.common import Batches, Spans, map_rows, mixed, stored, word_digests
from flowsight.llm.components import components

WIDTH, PERCENT = 4, 80
BANDS, ROWS = 24, 4
#: Sets and characters of texts that one comparing task holds at a time; larger groups are cut.
TILE_ROWS, TILE_CHARS = 1024, 1 << 22
#: Elements that are dealt out at the same time.
AT_ONCE = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit digests of the distinct runs of `width` words (all words, if there are fewer; none without words)."""
    words = word_digests((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    starts = np.arange(max(1, len(words) - width + 1))
    return np.unique(Spans(words).digest(starts, np.minimum(starts + width, len(words))))


def signatures(sets: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set: a row of registers, each a rank (upper 16 bits) and a fraction (lower 48 bits)."""
    found = np.full((len(sets), registers), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = found.reshape(-1)
    elements = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for begin in range(0, len(elements), AT_ONCE):
        element, owner = elements[begin : begin + AT_ONCE], owners[begin : begin + AT_ONCE]
        dealt = np.tile(np.arange(registers, dtype=np.int16), (len(element), 1))
        row = np.arange(len(element))
        for rank in range(registers):
            draw = mixed(element + np.uint64((int(_STEP) * (rank + 1)) & 0xFFFFFFFFFFFFFFFF))
            # The next register of each element's permutation, by a swap with one of those that are left.
            other = rank + (draw & np.uint64(0xFFFF)).astype(np.int64) % (registers - rank)
            register = dealt[row, other].astype(np.int64)
            dealt[row, other] = dealt[row, rank]
            value = (draw >> np.uint64(16)) | (np.uint64(rank) << np.uint64(48))
            np.minimum.at(flat, owner * registers + register, value)
            active = np.unique(owner)
            most = np.zeros(len(sets), dtype=np.uint64)
            most[active] = found[active].max(axis=1)
            useful = most[owner] >= np.uint64(rank + 1) << np.uint64(48)
            if not useful.all():
                element, owner, row = element[useful], owner[useful], row[useful]
                if not len(element):
                    break
    return found


def band_names(found: np.ndarray) -> np.ndarray:
    """A name for each band of each signature: an array of (texts, BANDS)."""
    names = np.tile(np.arange(BANDS, dtype=np.uint64), (len(found), 1))
    for column in np.moveaxis(found.reshape(len(found), BANDS, ROWS), 2, 0):
        names = mixed(names ^ column) * _STEP
    return names


class UnionFind:
    """Groups of numbered nodes; unite() tells whether two groups became one."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent.setdefault(up, up)
        return node

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def similar_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets with 100 * common >= percent * together, enough to connect all that such links connect.

    Each set is compared once with those near in size that no link has reached so far, so a group of near copies costs
    little more than its size.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    names, sizes, sets = [nodes[i] for i in order], sizes[order], [sets[i] for i in order]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.append(0, np.cumsum(sizes))
    marked = np.zeros(len(flat), dtype=bool)
    left = np.arange(len(names))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            n = sizes[one]
            # A set that is smaller than percent of the other cannot share that much of both.
            close = left[(sizes[left] * 100 >= n * percent) & (n * 100 >= sizes[left] * percent)]
            if not len(close):
                continue
            own = flat[begins[one] : begins[one + 1]]
            marked[own] = True
            span = sizes[close]
            offsets = np.cumsum(span) - span
            parts = flat[np.arange(span.sum()) + np.repeat(begins[close] - offsets, span)]
            common = np.add.reduceat(marked[parts], offsets, dtype=np.int64)
            marked[own] = False
            near = close[100 * common >= percent * (span + n - common)]
            yield from ((names[one], names[other]) for other in near.tolist())
            queue.extend(near.tolist())
            left = np.setdiff1d(left, near, assume_unique=True)


def _grouped(batches: Batches) -> Iterator[tuple[list[int], list[bool], list[str]]]:
    """Groups (nodes, whether each leads, texts) of rows sorted by key; a node that comes twice counts once."""
    current, seen = None, {}
    for batch in batches:
        for key, node, leads, text in zip(*(batch[c].to_pylist() for c in ("key", "node", "leads", "text"))):
            if key != current and current is not None:
                yield list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]
                seen = {}
            current = key
            seen[node] = (leads, text)
    if seen:
        yield list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]


def _links(batches: Batches, width: int, percent: int) -> Batches:
    """A forest of links (a, b) between the nodes of each group."""
    forest, out = UnionFind(), []
    for nodes, _, texts in _grouped(batches):
        if len(nodes) > 1:
            found = similar_links(nodes, [shingles(t, width) for t in texts], percent)
            out.extend((a, b) for a, b in found if forest.unite(a, b))
    a, b = zip(*out) if out else ((), ())
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _judged(batches: Batches, width: int, percent: int) -> Batches:
    """Rows (node, leader, links, near): how each node of a group stands to the group's leader.

    A node that is not near cannot link to one that links to the leader, as distances (one less similarity) obey the triangle
    inequality: near is a distance of at most twice that of a link.
    """
    for nodes, leads, texts in _grouped(batches):
        first = leads.index(True)
        own, out = shingles(texts[first], width), []
        for node, text in zip(nodes, texts):
            other = shingles(text, width)
            common = len(np.intersect1d(own, other, assume_unique=True))
            together = len(own) + len(other) - common
            near = 100 * common >= (2 * percent - 100) * together
            out.append((node, nodes[first], 100 * common >= percent * together, near))
        node, leader, links, near = zip(*out)
        columns = [pa.array(node, pa.int64()), pa.array(leader, pa.int64()), pa.array(links), pa.array(near)]
        yield pa.record_batch(columns, ["node", "leader", "links", "near"])


def _compared(members: DataFrame, texts: DataFrame, function, schema: str) -> DataFrame:
    """Hand groups of members (key, node, leads) with their texts (node, text) to a function, group by group."""
    held = members.hint("shuffle_hash").join(texts, "node").select("key", "node", "leads", "text")
    return map_rows(held.repartition("key").sortWithinPartitions("key"), function, schema)


def _tiles(rows: Column, chars: Column) -> Column:
    return F.greatest(F.ceil(rows / TILE_ROWS), F.ceil(chars / TILE_CHARS)).cast("int")


def _large_groups(groups: DataFrame, cells: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the leaders of large groups, and the members (key, node, leads) of what is still to be compared.

    groups: (node, size, root) of large groups; cells: (cell, node) of bands that hold several nodes.
    """
    groups = stored(groups)
    placed = stored(cells.join(groups, "node").select("cell", "node", "size", "root"))
    by_cell = placed.groupBy("root", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    leaders = by_cell.groupBy("root").agg(F.max_by("node", F.struct("n", -F.col("cell"))).alias("leader"))
    sizes = groups.groupBy("root").agg(_tiles(F.count(F.lit(1)), F.sum("size")).alias("slices"))
    about = stored(leaders.join(sizes, "root"))
    followers = groups.join(about, "root").where("node <> leader").select(
        "root", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), "node", F.lit(False).alias("leads")
    )
    ahead = about.select(
        "root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("leader").alias("node"), F.lit(True).alias("leads")
    )
    members = followers.unionByName(ahead).withColumn("key", F.xxhash64("root", "slice"))
    judged = stored(_compared(
        members.select("key", "node", "leads"), texts, lambda b: _judged(b, width, percent),
        "node bigint, leader bigint, links boolean, near boolean",
    ))
    links = judged.where("links and node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))

    # Bands with nodes that do not link to the leader. Those that do take part where such a node is near enough.
    standing = judged.select("node", "links", "near").distinct()
    marked = stored(placed.join(standing, "node").select("cell", "node", "size", "links", "near"))
    alone = ~F.col("links")
    per_cell = marked.groupBy("cell").agg(
        F.count_if(alone).alias("alone"), F.count_if(alone & F.col("near")).alias("near_ones"), F.count(F.lit(1)).alias("n"),
        _tiles(F.count_if(alone), F.sum(F.when(alone, F.col("size")).otherwise(0))).alias("alone_tiles"),
        _tiles(F.count_if("links"), F.sum(F.when(F.col("links"), F.col("size")).otherwise(0))).alias("linked_tiles"),
    ).where("alone > 0 and (near_ones > 0 or alone > 1)")
    with_linked = F.col("near_ones") > 0
    per_cell = per_cell.select("cell", "alone_tiles", F.when(with_linked, F.col("linked_tiles")).otherwise(0).alias("linked_tiles"))
    left = marked.join(per_cell, "cell").where(alone | (F.col("linked_tiles") > 0))
    # Tiles are numbered with those of nodes that stand alone first; a task gets two tiles, one of them of such nodes.
    own = F.when(alone, F.pmod(F.xxhash64("node"), F.greatest("alone_tiles", F.lit(1)))).otherwise(
        F.col("alone_tiles") + F.pmod(F.xxhash64("node"), F.greatest("linked_tiles", F.lit(1)))
    ).cast("int")
    last = F.when(alone, F.col("alone_tiles") + F.col("linked_tiles")).otherwise(F.col("alone_tiles")) - 1
    each = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    key = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return links, each.select(key.alias("key"), "node", F.lit(False).alias("leads"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of docs.

    Documents link if 100 * common >= percent * together holds for their sets of distinct runs of `width` words (all words
    as one run, if there are fewer; A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`). component_id is the smallest doc_id
    that links reach, the document's own included; kept tells whether it is the document's own.

    Null, empty and blank texts: n_shingles 0, linked with nothing, component_id their own doc_id. Null doc_id: the row takes
    part, but never names a component; component_id is null if no row of it has a doc_id, and kept is true where both are
    null. Repeated rows give repeated results, all kept or none. Empty table: no rows. Other columns of docs are not read.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch["text"].to_pylist()
            sets = [shingles(t, width) for t in texts]
            cells = pa.array(list(band_names(signatures(sets)).view(np.int64)), pa.list_(pa.int64()))
            digests = np.array([[np.bitwise_xor.reduce(mixed(s)), np.add.reduce(s * s, dtype=np.uint64)] for s in sets], dtype=np.uint64)
            digests = digests.reshape(-1, 2).view(np.int64)
            counts, sizes = (pa.array([len(x) for x in xs], pa.int64()) for xs in (sets, [t or "" for t in texts]))
            yield pa.record_batch(
                [batch["doc_id"], counts, pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), sizes, cells, batch["text"]],
                ["doc_id", "n_shingles", "d1", "d2", "size", "cells", "text"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, size bigint, cells array<bigint>, text string"
    # Rows are numbered once and stored with their texts, so that one row of each node can be found again.
    marked = stored(map_rows(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))
    same = ["n_shingles", "d1", "d2"]
    nodes = stored(marked.where("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min("doc_id").alias("first")))
    one = marked.select(F.col("row").alias("node"), "cells").join(nodes.select("node"), "node", "left_semi")
    cells = stored(one.select("node", F.explode("cells").alias("cell")))
    met = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1").select("cell", "low"))
    shared = stored(cells.join(met, "cell").select("cell", "low", "node"))
    reached = components(shared.select(F.col("node").alias("a"), F.col("low").alias("b")))
    # The texts of all nodes that met another are fetched once. What is joined with texts is dealt out by hash at every size.
    texts = stored(marked.select(F.col("row").alias("node"), "size", "text").join(reached.hint("shuffle_hash"), "node"))
    totals = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    large = stored(totals.where((F.col("n") > TILE_ROWS) | (F.col("chars") > TILE_CHARS)).select("root"))
    big = texts.select("node", "size", "root").join(large, "root", "left_semi")
    small = texts.select("node", "root").join(large, "root", "left_anti")
    members = small.select(F.col("root").alias("key"), "node", F.lit(False).alias("leads"))
    texts = texts.select("node", "text")
    links = None
    if not large.isEmpty():
        links, more = _large_groups(big, shared.select("cell", "node"), texts, width, percent)
        members = members.unionByName(more)
    compared = _compared(members, texts, lambda b: _links(b, width, percent), "a bigint, b bigint")
    linked = components(compared if links is None else stored(compared).unionByName(links))

    roots = nodes.join(linked, "node", "left").select(*same, "first", F.coalesce("root", "node").alias("root"))
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = roots.join(named, "root").select(*same, "component_id")
    worded = marked.where("n_shingles > 0").select("doc_id", *same).join(classes, same).select("doc_id", "n_shingles", "component_id")
    blank = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
