"""Shards through fixed virtual slots and a versioned map from slots to shards.

Records are hashed into a fixed number of slots, far more than there are shards. Which shard a slot belongs to is kept
in a small stored map. Rebalancing never moves single records: it writes a new version of the map in which a few slots
belong to another shard.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowsight.llm.common import stored

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot; version and the slots that the last edit moved."""

    shards: int
    owner: tuple[int, ...]
    version: int = 0
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0: slots dealt out in turn."""
        if not 0 < shards <= slots:
            raise ValueError("there must be a shard, and a slot for each")
        return cls(shards, tuple(i % shards for i in range(slots)))

    def _edited(self, shards: int, owner: list[int]) -> SlotMap:
        moved = tuple(i for i, (a, b) in enumerate(zip(self.owner, owner)) if a != b)
        return SlotMap(shards, tuple(owner), self.version + 1, moved)

    def rebalanced(self, weights: list[int], shards: int | None = None) -> SlotMap:
        """The next version, with near equal weights per shard; with more shards the new ones are filled from the others.

        Slots move from the heaviest shard to the lightest, or change places with a lighter slot, as long as that brings
        the two closer. Each step takes the move that comes nearest to half of their difference.
        """
        shards = max(self.shards, shards or self.shards)
        owner, load = list(self.owner), [0] * shards
        held: list[set[int]] = [set() for _ in range(shards)]
        for slot, shard in enumerate(owner):
            load[shard] += weights[slot]
            held[shard].add(slot)
        for _ in range(4 * len(owner)):
            heavy, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[heavy] - load[light]
            give = self._best_move(held[heavy], held[light], weights, gap)
            if give is None:
                break
            out, back = give
            for slot, source, target in ((out, heavy, light), (back, light, heavy)):
                if slot is not None:
                    held[source].remove(slot)
                    held[target].add(slot)
                    owner[slot] = target
                    load[source] -= weights[slot]
                    load[target] += weights[slot]
        return self._edited(shards, owner)

    @staticmethod
    def _best_move(heavy: set[int], light: set[int], weights: list[int], gap: int) -> tuple[int, int | None] | None:
        best, found = gap, None
        mine = sorted(heavy, key=lambda s: (weights[s], s))
        theirs = sorted(light, key=lambda s: (weights[s], s))
        for slot in mine:
            left = abs(gap - 2 * weights[slot])
            if weights[slot] and left < best:
                best, found = left, (slot, None)
        at = 0
        for slot in mine:  # both lists rise, so the partner nearest to half of the gap rises too
            while at + 1 < len(theirs) and abs(gap - 2 * (weights[slot] - weights[theirs[at + 1]])) <= abs(
                gap - 2 * (weights[slot] - weights[theirs[at]])
            ):
                at += 1
            if theirs:
                left = abs(gap - 2 * (weights[slot] - weights[theirs[at]]))
                if weights[slot] > weights[theirs[at]] and left < best:
                    best, found = left, (slot, theirs[at])
        return found


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the maps kept at a path. Earlier versions stay readable."""
    row = (slot_map.version, slot_map.shards, json.dumps(slot_map.owner), json.dumps(slot_map.moved))
    frame = spark.createDataFrame([row], "version int, shards int, owner string, moved string")
    frame.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the maps kept at a path, the latest by default."""
    maps = spark.read.parquet(path)
    row = (maps if version is None else maps.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise KeyError(f"no version {version}")
    return SlotMap(row["shards"], tuple(json.loads(row["owner"])), row["version"], tuple(json.loads(row["moved"])))


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record, from its doc_id and text, so that records with a null or frequent doc_id spread."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version), one per row of docs.

    Shards have near equal sums of sizes (law `bytes`): size is the UTF-8 bytes of the text (null: none) plus 8. Records go to
    virtual slots by hash, bytes are summed per virtual slot, and version 0 of the map, which deals slots out in turn, is
    edited into version 1, which balances the sums; both are kept at `path` (by default below the shared checkpoint folder).
    slot is the record's place in its shard, gapless from 0: by virtual slot, then by doc_id and text. grown_shard is null,
    as this law has none.

    Null and repeated doc_ids spread by their text. Repeated rows share a slot and have places of their own. A text larger than a shard's share makes
    its shard larger. Other columns are not read. Empty table: no rows.

    The driver holds one number per slot. Texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    data = F.coalesce(text, F.lit("")).cast("binary")
    rows = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(data) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        slot_of(F.col("doc_id").cast("bigint"), text, slots).alias("virtual_slot"),
    ))
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    weights, counts = [0] * slots, [0] * slots
    for row in sums:
        weights[row["virtual_slot"]], counts[row["virtual_slot"]] = row["size"], row["n"]
    before = SlotMap.first(shards, slots)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/slot-map-{uuid.uuid4().hex}"
    store_map(spark, before, path)
    store_map(spark, before.rebalanced(weights), path)
    current = load_map(spark, path)
    places, used = [], [0] * current.shards
    for slot, shard in enumerate(current.owner):
        places.append((slot, shard, used[shard], current.version))
        used[shard] += counts[slot]
    table = spark.createDataFrame(places, "virtual_slot int, shard int, first bigint, map_version int")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # The map has one row per slot, whatever the size of the data.
    return rows.withColumn("_place", F.row_number().over(inside) - 1).join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("_place")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version",
    )
