from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from flowsight.operators.meter import meter
from flowsight.schema import FLOW_COLUMNS, STATISTIC_COLUMNS

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def packets(spark, rows):
    """rows: (second, outbound, length)."""
    made = []
    for seq, (second, out, length) in enumerate(rows):
        a, b = ("10.0.0.9", 5000), ("10.0.0.1", 443)
        src, dst = (a, b) if out else (b, a)
        made.append((START + timedelta(microseconds=round(second * 1e6)), src[0], dst[0], src[1], dst[1], length, seq))
    return spark.createDataFrame(made, "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, length bigint, seq bigint")


def test_single_packet_has_sentinels(spark):
    row = meter(packets(spark, [(0.0, True, 374)]), 10).first()
    assert (row.Duration, row.FlowSentRate, row.FlowReceivedRate) == (0.0, -1.0, -1.0)
    assert (row.FlowBytesSent, row.FlowBytesReceived) == (374, 0)
    assert (row.PacketLengthMean, row.PacketLengthSkewFromMedian, row.PacketLengthCoefficientofVariation) == (374.0, -10.0, 0.0)
    assert (row.PacketTimeSkewFromMode, row.PacketTimeCoefficientofVariation) == (-10.0, -1.0)
    assert (row.ResponseTimeTimeVariance, row.ResponseTimeTimeMean, row.ResponseTimeTimeMode) == (-1.0, -1.0, -1.0)
    assert row.ResponseTimeTimeMedian is None and row.ResponseTimeTimeSkewFromMedian is None
    assert (row.ResponseTimeTimeSkewFromMode, row.ResponseTimeTimeCoefficientofVariation) == (0.0, 1.0)


def test_directions_statistics_and_ties(spark):
    row = meter(packets(spark, [(0, False, 100), (1, True, 40), (3, False, 100), (4, True, 60)]), 10).first()
    # The server spoke first, so it is the source.
    assert (row.SourcePort, row.DestinationPort) == (443, 5000)
    assert (row.FlowBytesSent, row.FlowBytesReceived, row.Duration) == (200, 100, 4.0)
    lengths = np.array([100, 40, 100, 60.0])
    assert row.PacketLengthVariance == pytest.approx(lengths.var())
    assert (row.PacketLengthMedian, row.PacketLengthMode) == (80.0, 100.0)
    assert row.PacketLengthSkewFromMedian == pytest.approx(3 * (75 - 80) / lengths.std())
    assert row.PacketTimeMode == 0.0 and row.PacketTimeMedian == 2.0
    # Answers: 1 s after the first, 1 s after the third packet.
    assert (row.ResponseTimeTimeMean, row.ResponseTimeTimeVariance) == (1.0, 0.0)


def test_idle_gap_and_age(spark):
    rows = [(0, True, 1), (10, True, 1), (20.5, True, 1), (21, False, 1)]
    assert [r.packets for r in meter(packets(spark, rows), 10).orderBy("start_us").collect()] == [2, 2]
    aged = meter(packets(spark, [(i, i % 2 == 0, 10) for i in range(10)]), 10, max_age=4).orderBy("start_us").collect()
    assert [r.packets for r in aged] == [4, 4, 2]
    assert [r.PacketTimeMean for r in aged] == [1.5, 1.5, 0.5]


def test_same_instant_follows_sequence(spark):
    row = meter(packets(spark, [(0, False, 7), (0, True, 9)]), 10).first()
    assert (row.SourcePort, row.FlowBytesSent, row.FlowBytesReceived) == (443, 7, 9)


def test_columns(spark):
    flows = meter(packets(spark, [(0, True, 1)]), 10)
    assert [c for c in flows.columns if c in FLOW_COLUMNS] == FLOW_COLUMNS


@pytest.mark.parametrize("max_age", [None, 7.0])
def test_busy_pair_takes_the_other_path_with_equal_results(spark, max_age):
    rng = np.random.default_rng(3)
    times = np.sort(np.round(rng.uniform(0, 60, 400), 3))
    rows = [(float(t), bool(o), int(n)) for t, o, n in zip(times, rng.integers(0, 2, 400), rng.integers(40, 60, 400))]
    frame = packets(spark, rows)
    plain = meter(frame, 5, max_age).orderBy("start_us").collect()
    busy = meter(frame, 5, max_age, hot_packets=10, slice_width=0.5).orderBy("start_us").collect()
    assert len(plain) == len(busy)
    for p, b in zip(plain, busy):
        for c in ["flow_id", "FlowBytesSent", "packets", "start_us"]:
            assert p[c] == b[c]
        for c in ["Duration", *STATISTIC_COLUMNS]:
            assert (p[c] is None and b[c] is None) or p[c] == pytest.approx(b[c], rel=1e-9, abs=1e-9), c


def test_packets_without_sequence_number_are_metered_alike(spark):
    """By pair and by slices; some moments are shared, some sequence numbers missing."""
    rng = np.random.default_rng(9)
    times = np.sort(np.round(rng.uniform(0, 90, 500), 1))
    client = rng.integers(0, 3, 500)
    rows = [
        (START + timedelta(seconds=float(t)), *(("c", "s", int(c), 443) if o else ("s", "c", 443, int(c))), int(n), int(q) if q % 3 else None)
        for t, c, o, n, q in zip(times, client, rng.integers(0, 2, 500), rng.integers(40, 60, 500), rng.integers(0, 9, 500))
    ]
    frame = spark.createDataFrame(rows, "ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, length bigint, seq bigint")
    plain, busy = meter(frame, 2, 7.0), meter(frame, 2, 7.0, hot_packets=1)
    key = ["flow_id"]
    assert plain.count() == busy.count() > 10
    for p, b in zip(plain.orderBy(*key).collect(), busy.orderBy(*key).collect()):
        for c in ["flow_id", "FlowBytesSent", "packets", "start_us"]:
            assert p[c] == b[c]
        for c in ["Duration", *STATISTIC_COLUMNS]:
            assert (p[c] is None and b[c] is None) or p[c] == pytest.approx(b[c], rel=1e-9, abs=1e-9), c


def test_packets_are_moved_once(spark):
    flows = meter(packets(spark, [(0, True, 1), (1, False, 2)]), 10)
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
