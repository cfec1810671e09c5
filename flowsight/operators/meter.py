"""Flow metering: packets to bidirectional flow records.

A flow is a conversation between two endpoints, split where it is silent for longer than idle_gap and, if asked,
into pieces no longer than max_age. The source is the side that sent the first packet. Both limits, and
the pairing rule for response times (a server packet right after a client packet), are parameters or choices
of this package.

Packets are moved once, to the task of their pair, where they are sorted and their flows are added up. Where a pair is too
busy for that, time is cut into slices no wider than idle_gap, so a slice can hold no silence that splits a flow: flow
borders follow from one summary row per endpoint pair and slice, and only previous-packet look-ups sort packets,
slice by slice. A busy pair is then spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsight.functions.numeric import epoch_us, us_to_timestamp
from flowsight.operators.ordered import whole_number_median, whole_number_mode
from flowsight.runtime import cut_lineage
from flowsight.schema import FLOW_COLUMNS

PAIR = ["a_ip", "a_port", "b_ip", "b_port"]
FLOW = [*PAIR, "session_us", "age"]

# A pair's packets inside this many microseconds are sorted together.
MAX_SLICE_US = 60_000_000


def seconds_to_us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def pair_packets(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation under one key, with from_a telling which side sent the packet."""
    seq = F.col("seq").cast("bigint") if "seq" in packets.columns else F.lit(0).cast("bigint")
    side = lambda ip, port: F.struct(
        F.coalesce(F.col(ip), F.lit("unknown")).alias("ip"), F.coalesce(F.col(port), F.lit(0)).alias("port")
    )
    sides = packets.where(F.col("ts").isNotNull()).select(
        side("src_ip", "src_port").alias("src"), side("dst_ip", "dst_port").alias("dst"),
        epoch_us(F.col("ts")).alias("us"), seq.alias("seq"), F.col("length").cast("bigint").alias("length"),
        F.col("ts").alias("event_time"),
    )
    from_a = F.col("src") <= F.col("dst")
    pick = lambda first, second, field: F.when(from_a, F.col(f"{first}.{field}")).otherwise(
        F.col(f"{second}.{field}")
    )
    return sides.select(
        pick("src", "dst", "ip").alias("a_ip"), pick("src", "dst", "port").alias("a_port"),
        pick("dst", "src", "ip").alias("b_ip"), pick("dst", "src", "port").alias("b_port"),
        from_a.alias("from_a"), "us", "seq", "length", "event_time",
    )


def _place() -> Column:
    """Time, sequence number and direction as one fixed-width value, so min_by and max_by stay hash aggregates and packets
    of one moment without sequence numbers have an order."""
    moment = F.col("us").cast("decimal(38,0)") * F.lit("20000000000000000000").cast("decimal(20,0)")
    return moment + F.col("seq").cast("decimal(38,0)") * 2 + F.col("from_a").cast("int")


def _slices(pairs: DataFrame, idle_gap_us: int, hot_packets: int) -> DataFrame:
    """One row per pair and slice: the session it belongs to and the last packet before it."""
    slices = pairs.groupBy(*PAIR, "slice").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"),
        F.min_by("from_a", _place()).alias("first_from_a"), F.max_by("from_a", _place()).alias("last_from_a"),
    )
    along = Window.partitionBy(*PAIR).orderBy("slice")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("prev_us", F.lag("last_us").over(along))
    opens = F.col("prev_us").isNull() | (F.col("first_us") - F.col("prev_us") > idle_gap_us)
    slices = slices.withColumn("opens", opens).select(
        *PAIR, "slice", "n", "prev_us",
        F.lag("last_from_a").over(along).alias("prev_from_a"),
        F.last(F.when(F.col("opens"), F.col("first_us")), ignorenulls=True).over(upto).alias("session_us"),
        F.last(F.when(F.col("opens"), F.col("first_from_a")), ignorenulls=True).over(upto).alias("opened_by_a"),
    )
    session = Window.partitionBy(*PAIR, "session_us")
    return slices.withColumn("hot", F.sum("n").over(session) > hot_packets).drop("n")


def packets_per_pair(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))


def assign_flows(
    pairs: DataFrame, slices: DataFrame, max_age: float | None
) -> DataFrame:
    """Packets with the flow they belong to and the time since the packet before them in that flow."""
    inside = Window.partitionBy(*PAIR, "slice").orderBy("us", "seq", "from_a", "length")
    # Both sides are merged: the window sorts the packets by the same keys anyway, and there may be nearly as many slices as packets,
    # which estimates made before a shuffle do not show.
    rows = pairs.join(slices.hint("merge"), [*PAIR, "slice"])
    rows = rows.withColumns({
        "prev_us": F.coalesce(F.lag("us").over(inside), F.col("prev_us")),
        "prev_from_a": F.coalesce(F.lag("from_a").over(inside), F.col("prev_from_a")),
    })
    return _in_flows(rows, max_age)


def assign_flows_by_pair(pairs: DataFrame, idle_gap_us: int, max_age: float | None) -> DataFrame:
    """As assign_flows, from the packets of a pair sorted together: one shuffle, by pair, which suits the flows' totals too."""
    along = Window.partitionBy(*PAIR).orderBy("us", "seq", "from_a", "length")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Packets without a sequence number have no place, so none of them is the last one of its slice.
    placed = F.last(F.when(F.col("seq").isNotNull(), F.struct("slice", "from_a")), ignorenulls=True).over(before)
    rows = pairs.withColumns({
        "prev_us": F.lag("us").over(along), "prev_slice": F.lag("slice").over(along),
        "prev_from_a": F.lag("from_a").over(along), "placed": placed,
    })
    opens = F.col("prev_us").isNull() | (F.col("us") - F.col("prev_us") > idle_gap_us)
    rows = rows.withColumns({
        "session_us": F.last(F.when(opens, F.col("us")), ignorenulls=True).over(upto),
        "prev_from_a": F.when(F.col("prev_slice") == F.col("slice"), F.col("prev_from_a")).when(
            F.col("prev_slice") == F.col("placed.slice"), F.col("placed.from_a")
        ),
    })
    return _in_flows(rows, max_age)


def _in_flows(rows: DataFrame, max_age: float | None) -> DataFrame:
    """The piece of its session that a packet is in, its time in the session and that since the packet it answers."""
    age = F.lit(0).cast("bigint")
    same_flow = F.col("prev_us") >= F.col("session_us")
    if max_age is not None:
        piece = lambda us: F.floor((us - F.col("session_us")) / seconds_to_us(max_age))
        age = piece(F.col("us"))
        same_flow = same_flow & (piece(F.col("prev_us")) == age)
    gap = F.when(same_flow & (F.col("from_a") != F.col("prev_from_a")), F.col("us") - F.col("prev_us"))
    return rows.withColumns({
        "age": age,
        "rel_us": F.col("us") - F.col("session_us"),
        "answer_a_us": F.when(F.col("from_a"), gap),
        "answer_b_us": F.when(~F.col("from_a"), gap),
    })


def moments(value: Column, name: str) -> list[Column]:
    return [
        F.count(value).alias(f"{name}_n"), F.var_pop(value).alias(f"{name}_var"),
        F.stddev_pop(value).alias(f"{name}_std"), F.avg(value).alias(f"{name}_mean"),
    ]


def middle(value: Column, name: str) -> list[Column]:
    return [
        F.median(value).alias(f"{name}_median"),
        F.mode(value, True).cast("double").alias(f"{name}_mode"),
    ]


def flow_totals() -> list[Column]:
    """Aggregates of any flow; each is combined before the shuffle."""
    return [
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("rel_us").alias("start_rel"),
        F.count(F.lit(1)).alias("packets"),
        F.min_by("from_a", _place()).alias("from_a"),
        F.coalesce(F.sum(F.when(F.col("from_a"), F.col("length"))), F.lit(0)).alias("bytes_a"),
        F.coalesce(F.sum(F.when(~F.col("from_a"), F.col("length"))), F.lit(0)).alias("bytes_b"),
        *moments(F.col("length"), "length"), *moments(F.col("rel_us"), "time"),
        *moments(F.col("answer_a_us"), "answer_a"), *moments(F.col("answer_b_us"), "answer_b"),
    ]


def _small_flows(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FLOW).agg(
        *flow_totals(), *middle(F.col("length"), "length"), *middle(F.col("rel_us"), "time"),
        *middle(F.col("answer_a_us"), "answer_a"), *middle(F.col("answer_b_us"), "answer_b"),
    )


def _large_flows(rows: DataFrame) -> DataFrame:
    """As _small_flows, but times, which are mostly distinct, are never gathered in one task.

    Packet lengths have at most 65,536 distinct values, so their exact median and mode stay small.
    """
    flows = rows.groupBy(*FLOW).agg(*flow_totals(), *middle(F.col("length"), "length"))
    for value, name in (("rel_us", "time"), ("answer_a_us", "answer_a"), ("answer_b_us", "answer_b")):
        flows = flows.join(whole_number_median(rows, FLOW, value, f"{name}_median"), FLOW, "left")
        flows = flows.join(whole_number_mode(rows, FLOW, value, f"{name}_mode"), FLOW, "left")
    return flows


def _spread(prefix: str, var: Column, std: Column, mean: Column, median: Column, mode: Column) -> list[Column]:
    # Fixed values: -10 stands for a skew without spread, -1 for a variation around a zero mean.
    skew = lambda numerator: F.when(std == 0, F.lit(-10.0)).otherwise(F.try_divide(numerator, std) + F.lit(0.0))
    return [
        var.alias(f"{prefix}Variance"), std.alias(f"{prefix}StandardDeviation"), mean.alias(f"{prefix}Mean"),
        median.alias(f"{prefix}Median"), mode.alias(f"{prefix}Mode"),
        skew(3 * (mean - median)).alias(f"{prefix}SkewFromMedian"),
        skew(mean - mode).alias(f"{prefix}SkewFromMode"),
        F.when(mean == 0, F.lit(-1.0)).otherwise(F.try_divide(std, mean))
        .alias(f"{prefix}CoefficientofVariation"),
    ]


def flow_record(flows: DataFrame, doh: Column | None = None) -> DataFrame:
    """Aggregated flows to the 35-column record, plus flow_id, start_us and packets."""
    from_a = F.col("from_a")
    by_source = lambda a, b: F.when(from_a, F.col(a)).otherwise(F.col(b))
    answer = lambda part: by_source(f"answer_b_{part}", f"answer_a_{part}")
    duration = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    # Fixed value: -1 stands for a rate over no time and for the statistics of no responses.
    rate = lambda column: F.when(F.col("Duration") == 0, F.lit(-1.0)).otherwise(
        F.try_divide(F.col(column).cast("double"), F.col("Duration"))
    )
    answered = answer("n") > 0
    or_missing = lambda value: F.when(answered, value).otherwise(F.lit(-1.0))
    since_start = lambda part: (F.col(f"time_{part}") - F.col("start_rel")) / F.lit(1e6)
    record = flows.withColumns({
        "SourceIP": by_source("a_ip", "b_ip"), "DestinationIP": by_source("b_ip", "a_ip"),
        "SourcePort": by_source("a_port", "b_port"), "DestinationPort": by_source("b_port", "a_port"),
        "TimeStamp": F.date_trunc("second", us_to_timestamp(F.col("start_us"))),
        "Duration": duration,
        "FlowBytesSent": by_source("bytes_a", "bytes_b"),
        "FlowBytesReceived": by_source("bytes_b", "bytes_a"),
    })
    record = record.withColumns({
        "FlowSentRate": rate("FlowBytesSent"), "FlowReceivedRate": rate("FlowBytesReceived"),
        "DoH": F.lit(False) if doh is None else doh,
        "flow_id": F.concat_ws("|", *[F.col(c).cast("string") for c in [*PAIR, "start_us"]]),
    })
    stats = [
        *_spread(
            "PacketLength", F.col("length_var"), F.col("length_std"), F.col("length_mean"),
            F.col("length_median"), F.col("length_mode"),
        ),
        *_spread(
            "PacketTime", F.col("time_var") / F.lit(1e12), F.col("time_std") / F.lit(1e6), since_start("mean"),
            since_start("median"), since_start("mode"),
        ),
        *_spread(
            "ResponseTimeTime", or_missing(answer("var") / F.lit(1e12)), or_missing(answer("std") / F.lit(1e6)),
            or_missing(answer("mean") / F.lit(1e6)), answer("median") / F.lit(1e6),
            or_missing(answer("mode") / F.lit(1e6)),
        ),
    ]
    plain = [c for c in FLOW_COLUMNS if c in record.columns]
    return record.select("flow_id", "start_us", "packets", *plain, *stats).select(
        "flow_id", *FLOW_COLUMNS, "start_us", "packets"
    )


def doh_predicate(resolvers: Sequence[str]) -> Column:
    """A flow to or from port 443 of a known resolver."""
    to = (F.col("DestinationPort") == 443) & F.col("DestinationIP").isin(*resolvers)
    back = (F.col("SourcePort") == 443) & F.col("SourceIP").isin(*resolvers)
    return to | back


def meter(
    packets: DataFrame,
    idle_gap: float,
    max_age: float | None = None,
    resolvers: Sequence[str] | None = None,
    hot_packets: int = 1_000_000,
    slice_width: float | None = None,
) -> DataFrame:
    """Packets (ts, src_ip, dst_ip, src_port, dst_port, length[, seq]) to flow records; times in seconds.

    A pair of up to hot_packets packets is sorted by one task. Where a pair has more, all are metered by slices: the slice
    summaries are written to the checkpoint folder and sessions of that size take a path that gathers no times; counting packets per pair is one
    aggregate over the key columns, run when this function is called.
    slice_width can be narrowed below the default of min(idle_gap, 60 s) for pairs that are very busy for a
    short time.
    """
    idle_gap_us = seconds_to_us(idle_gap)
    width = min(idle_gap_us, MAX_SLICE_US if slice_width is None else seconds_to_us(slice_width))
    pairs = pair_packets(packets).withColumn("slice", F.floor(F.col("us") / width))
    largest = packets_per_pair(pairs).agg(F.max("n")).first()[0] or 0
    if largest <= hot_packets:
        flows = _small_flows(assign_flows_by_pair(pairs, idle_gap_us, max_age))
    else:
        slices = cut_lineage(_slices(pairs, idle_gap_us, hot_packets))
        flows = _small_flows(assign_flows(pairs, slices.where(~F.col("hot")), max_age))
        rows = cut_lineage(assign_flows(pairs, slices.where(F.col("hot")), max_age))
        flows = flows.unionByName(_large_flows(rows))
    return flow_record(flows, None if resolvers is None else doh_predicate(resolvers))
