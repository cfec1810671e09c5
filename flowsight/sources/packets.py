"""Packet sequences from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsight.functions.numeric import to_number
from flowsight.runtime import cut_lineage
from flowsight.sources.numbered import number_records, text_records

_SESSIONS = "array<struct<features:array<array<string>>,meta:struct<src_ip:string,dst_ip:string>>>"
_LISTS = "array<array<array<string>>>"

# The messages of files that hold no sequence.
EMPTY_FILE = "Empty file or invalid format"
UNSUPPORTED = "Unsupported file format"


def parse_packet_sequences(files: DataFrame) -> DataFrame:
    """(file, value) to one row per packet: (file, src_ip, dst_ip, pos, ts, size, error).

    Takes the first session of a file, either an object with features and meta or a bare list of packets. A
    file that holds neither gives one row with an error.
    """
    text = F.trim("value")
    parsed = files.withColumns({
        "_sessions": F.from_json("value", _SESSIONS), "_lists": F.from_json("value", _LISTS),
    })
    as_object = text.rlike(r"^\[\s*\{") & F.get("_sessions", F.lit(0)).isNotNull()
    has_features = as_object & F.get_json_object("value", "$[0].features").isNotNull()
    as_list = text.rlike(r"^\[\s*\[\s*\[")
    empty = F.coalesce(text == "", F.lit(True)) | text.rlike(r"^(\[\s*\]|\{\s*\}|null)$")
    features = F.when(has_features, F.get("_sessions", F.lit(0))["features"]).when(as_list, F.get("_lists", F.lit(0)))
    meta = F.when(has_features, F.get("_sessions", F.lit(0))["meta"])
    error = F.when(empty, EMPTY_FILE).when(~(has_features | as_list), UNSUPPORTED)
    sessions = parsed.select(
        "file", F.coalesce(meta["src_ip"], F.lit("unknown")).alias("src_ip"),
        F.coalesce(meta["dst_ip"], F.lit("unknown")).alias("dst_ip"), features.alias("features"), error.alias("error"),
    )
    return sessions.select("file", "src_ip", "dst_ip", "error", F.posexplode_outer("features").alias("pos", "packet")).select(
        "file", "src_ip", "dst_ip", "pos", to_number(F.get("packet", F.lit(0))).alias("ts"),
        to_number(F.get("packet", F.lit(2))).alias("size"), "error"
    )


# What stands before the first packet in the two shapes, and settings in the first record and after the last packet. A record
# is what stands before a closing bracket; the first object of a file ends with the first brace that closes it.
_OBJECT = r"(?s)^\s*\[\s*\{(?:[^{}]|\{[^{}]*\})*?\"features\"\s*:\s*\["
_LIST = r"(?s)^\s*\[\s*\[\s*\["
_META_FIRST = r"(?s)^\s*\[\s*\{[^{}]*\"meta\"\s*:\s*(\{[^{}]*\})"
_META_AFTER = r"(?s)^[^{}]*\"meta\"\s*:\s*(\{[^{}]*\})"
#: A text that holds nothing, in at most two records.
_NOTHING = r"^\s*(\[\s*\]|\[|\{\s*\}|null)?\s*$"


def read_packet_sequences(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Every file of a folder tree whose name fits pattern, as parse_packet_sequences does, but as a stream of records, one to each closing bracket.

    A packet is a flat list, so a record holds one packet, and a file of any length is read in splits by several tasks; no
    task holds a file. Settings of a session are looked for before its first packet and right after its last one. A
    file that breaks off gives the packets before the break. Column path tells files of one name apart.
    """
    # A listing and a reader write local paths with different numbers of slashes.
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    read = text_records(spark, path, "]", pattern)
    records = number_records(read).withColumn("path", plain)
    heads = records.where("no = 0").select("path", F.col("value").alias("head"))
    starts = heads.select("path", "head", F.col("head").rlike(_OBJECT).alias("as_object"), F.col("head").rlike(_LIST).alias("as_list"))
    # The list of packets ends with a record that is blank: two closing brackets in a row. Without a bracket of its own after
    # the list's, the first record holds no packet, and the list ends with it.
    begin = F.when(F.col("as_object"), F.regexp_replace("head", _OBJECT, "")).otherwise(F.regexp_replace("head", r"(?s)^\s*\[\s*\[", ""))
    has_packet = begin.contains("[")
    stops = records.where("no > 0").where(F.col("value").rlike(r"^\s*$")).groupBy("path").agg(F.min("no").alias("stop"))
    known = cut_lineage(starts.join(stops, "path", "left").select(
        "path", "head", "as_object", "as_list", F.when(has_packet, F.coalesce("stop", F.lit((1 << 62)))).otherwise(F.lit(0)).alias("stop")
    ))
    session = records.join(known, "path").where((F.col("as_object") | F.col("as_list")) & (F.col("no") <= F.col("stop") + 1))
    found = F.when(F.col("no") == 0, F.regexp_extract("value", _META_FIRST, 1)).when(
        F.col("no") == F.col("stop") + 1, F.regexp_extract("value", _META_AFTER, 1)
    )
    meta = session.select("path", "no", F.nullif(found, F.lit("")).alias("meta")).where("meta is not null")
    meta = meta.groupBy("path").agg(F.min_by("meta", "no").alias("meta"))
    fields = F.split(F.regexp_replace(F.substring_index("value", "[", -1), r'[\s"]', ""), ",")
    field = lambda i: to_number(F.get(fields, F.lit(i)))
    packets = session.where((F.col("no") < F.col("stop")) & F.col("value").contains("[")).select(
        "path", F.col("no").cast("int").alias("pos"), field(0).alias("ts"), field(2).alias("size")
    )
    side = lambda name: F.coalesce(F.get_json_object("meta", f"$.{name}"), F.lit("unknown")).alias(name)
    # Files without a packet still have a row, and so have empty files, which only a listing knows.
    every = spark.createDataFrame([(file,) for file in read.inputFiles()], "path string").withColumn("path", plain)
    counted = records.groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    about = every.join(known, "path", "left").join(meta, "path", "left").join(counted, "path", "left")
    shaped = F.coalesce(F.col("as_object") | F.col("as_list"), F.lit(False))
    empty = F.coalesce(F.col("head").rlike(_NOTHING) & (F.col("records") <= 2), F.lit(True))
    error = F.when(~shaped, F.when(empty, EMPTY_FILE).otherwise(UNSUPPORTED))
    sessions = about.select("path", side("src_ip"), side("dst_ip"), error.alias("error"))
    return sessions.join(packets, "path", "left").select(
        F.substring_index("path", "/", -1).alias("file"), "src_ip", "dst_ip", "pos", "ts", "size", "error", "path"
    )
