import pytest
from pyspark.sql import functions as F

from flowsight.operators import decide
from flowsight.operators.rules import (
    STANDARD_RULES, Rule, RuleModel, explain, false_positives, rate_features, rule_score, sequence_report, stat_features,
    threshold_flag,
)

SCHEMA = "name string, PacketLengthMean double, PacketTimeVariance double, FlowReceivedRate double"
CASES = [
    ("burst", 1031.44, 27.07, 42372.0, 1.0), ("classic", 994.79, 58.10, 5579.1, 0.6),
    ("one packet", 374.0, 0.0, -1.0, 0.5), ("two packets", 1391.5, 7.0e-10, 1246955.2, 1.0),
    ("missing", None, None, None, 0.0),
]


def test_standard_rules(spark):
    df = spark.createDataFrame([c[:4] for c in CASES], SCHEMA)
    got = {r["name"]: r["p"] for r in rule_score(df).collect()}
    assert got == pytest.approx({c[0]: c[4] for c in CASES})
    verdicts = decide.decide(rule_score(df).selectExpr("name flow_id", "'rules' model", "p")).collect()
    assert {r.flow_id: r.pred for r in verdicts} == {"burst": 1, "classic": 1, "one packet": 1, "two packets": 1, "missing": 0}


def test_mean_operators_and_unknown(spark):
    df = spark.createDataFrame([("a", 1000.0, 1.0, 5.0)], SCHEMA)
    mean = RuleModel(STANDARD_RULES.rules, "mean")
    assert rule_score(df, mean).first()["p"] == pytest.approx(0.2)
    odd = RuleModel([Rule("PacketLengthMean", "~", 1.0), Rule("FlowReceivedRate", "!=", 5.0), Rule("PacketTimeVariance", "==", 1.0, 0.25)], bias=0.1)
    assert rule_score(df, odd).first()["p"] == pytest.approx(0.35)
    with pytest.raises(ValueError):
        rule_score(df, RuleModel([Rule("Absent", ">", 1.0)]))


def test_from_json():
    model = RuleModel.from_json('{"rules": [{"feature": "x", "op": ">", "value": 3}], "aggregation": "MEAN"}')
    assert model == RuleModel([Rule("x", ">", 3.0, 1.0)], "mean", (0.0, 1.0), 0.0)


def test_flags_and_reasons(spark):
    df = spark.createDataFrame(
        [("a", 0, 0.0, 500.0, 0.0, 0.0, 100.0), ("b", 0, 2.0, 20000.0, 1.0, 10000.0, 300.0), ("c", 1, None, None, None, None, None)],
        "name string, label int, Duration double, FlowBytesSent double, PacketTimeMedian double, FlowSentRate double, PacketLengthMean double",
    )
    flags = {r["name"]: r["flagged"] for r in threshold_flag(rate_features(df)).collect()}
    assert flags == {"a": False, "b": True, "c": False}
    reasons = {r["name"]: r["exceeded"] for r in explain(stat_features(df)).collect()}
    assert reasons == {"a": "", "b": "avg_packet_size,volume_rate", "c": ""}
    assert [r["name"] for r in false_positives(stat_features(df)).collect()] == ["b"]


def test_consensus_and_summary(spark):
    rows = [("f", "a", 0.004), ("f", "b", 0.0), ("f", "c", 0.579), ("g", "a", 0.9), ("g", "b", 0.1)]
    decided = decide.decide(spark.createDataFrame(rows, "flow_id string, model string, p double"), {"a": 0.95})
    votes = {r.flow_id: (r.pred, round(r.confidence, 3)) for r in decide.consensus(decided).collect()}
    assert votes["f"] == (0, 0.858)
    summary = {r.model: (r.benign, r.malicious, r.threshold) for r in decide.summarize(decided).collect()}
    assert summary == {"a": (2, 0, 0.95), "b": (2, 0, 0.5), "c": (0, 1, 0.5)}


def test_consensus_tie_is_malicious(spark):
    rows = [("f", "a", 0.9), ("f", "b", 0.1)]
    decided = decide.decide(spark.createDataFrame(rows, "flow_id string, model string, p double"))
    assert decide.consensus(decided).first()["pred"] == 1


def test_sequence_report(spark):
    rows = [("f.json", "s", "d", 0, 1.0, 100.0, None), ("f.json", "s", "d", 1, 3.0, 400.01, None), ("bad.json", "unknown", "unknown", None, None, None, "Empty")]
    df = spark.createDataFrame(rows, "file string, src_ip string, dst_ip string, pos int, ts double, size double, error string")
    got = {r.file: r for r in sequence_report(df).collect()}
    assert (got["f.json"].avg_payload, got["f.json"].freq_pps, got["f.json"].volume_bps, got["f.json"].suspicious) == (250.01, 1.0, 250.01, True)
    assert got["bad.json"].error == "Empty" and got["bad.json"].suspicious is None


def test_detectors_share_one_call(spark):
    class Own:
        def predict(self, df, identity="flow_id"):
            return df.select(identity, F.lit("own").alias("model"), F.lit(0.7).alias("p"))

    df = spark.createDataFrame([("a", 500.0), ("b", 100.0)], "flow_id string, PacketLengthMean double")
    long = RuleModel([Rule("PacketLengthMean", ">", 400.0, 0.9)], name="long")
    absent = RuleModel([Rule("Nothing", ">", 0.0)], name="absent")
    found = {(r.flow_id, r.model, r.pred) for r in decide.detect(df, [long, absent, Own()], {"own": 0.8}).collect()}
    assert found == {("a", "long", 1), ("b", "long", 0), ("a", "own", 0), ("b", "own", 0)}
    with pytest.raises(ValueError):
        decide.detect(df, [absent])
