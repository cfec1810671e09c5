import base64

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsight.operators import campaign, capture, clean, metrics, neighbours, patterns, sampling


def scored(spark, scores, labels):
    return spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "p double, label int")


def curve_by_hand(scores, labels):
    order = sorted(set(scores), reverse=True)
    points = [(float("inf"), 0, 0)]
    for t in order:
        points.append((t, sum(1 for s, y in zip(scores, labels) if s >= t and y == 0), sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)))
    kept = points[:2]
    for before, here, after in zip(points[1:], points[2:], points[3:]):
        if (here[1] - before[1], here[2] - before[2]) != (after[1] - here[1], after[2] - here[2]):
            kept.append(here)
    return kept + points[-1:] if len(points) > 2 else kept


def test_roc_auc_and_threshold(spark):
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 300)
    scores = np.round(labels * 0.3 + rng.random(300), 2)
    df = scored(spark, scores, labels)
    want = curve_by_hand(scores.tolist(), labels.tolist())
    got = sorted(((r.threshold, r.fp, r.tp) for r in metrics.roc_curve(df).collect()), reverse=True)
    assert got == want
    pos, neg = scores[labels == 1], scores[labels == 0]
    pairs = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
    assert metrics.auc(df).first()["auc"] == pytest.approx(pairs)
    moved = df.withColumn("p", F.exp("p") * 3)
    assert metrics.auc(moved).first()["auc"] == pytest.approx(pairs)
    for target in (0.0, 0.01, 0.2):
        best = min(want, key=lambda x: (abs(x[1] / len(neg) - target), -x[0]))
        assert metrics.threshold_at_fpr(df, target).first()["threshold"] == best[0]


def test_edges(spark):
    one_class = scored(spark, [0.1, 0.2], [1, 1])
    assert metrics.auc(one_class).first()["auc"] is None
    equal = scored(spark, [0.5] * 4, [0, 1, 0, 1])
    assert metrics.auc(equal).first()["auc"] == 0.5
    empty = scored(spark, [], [])
    assert metrics.threshold_at_fpr(empty).first()["threshold"] == 0.5
    report = {r.name: r for r in metrics.classification_report(scored(spark, [0, 0], [1, 0]).withColumn("pred", F.lit(0))).collect()}
    assert (report["Malicious"].precision, report["Malicious"].recall, report["Malicious"].f1) == (0.0, 0.0, 0.0)
    assert report["accuracy"].f1 == 0.5


def test_recorded_report_adds_up(spark):
    # Counts that give a known report of 5,798 benign and 74,992 malicious rows.
    counts = [(0, 0, 4240), (0, 1, 1558), (1, 0, 505), (1, 1, 74487)]
    rows = spark.createDataFrame(counts, "label int, pred int, n int").select("label", "pred", F.explode(F.sequence(F.lit(1), "n")))
    got = {r.name: [round(v, 2) if v is not None else None for v in (r.precision, r.recall, r.f1)] + [r.support] for r in metrics.classification_report(rows).collect()}
    assert got["Benign"] == [0.89, 0.73, 0.8, 5798] and got["Malicious"] == [0.98, 0.99, 0.99, 74992]
    assert got["accuracy"][2:] == [0.97, 80790] and got["macro avg"][:3] == [0.94, 0.86, 0.9]
    assert got["weighted avg"][:3] == [0.97, 0.97, 0.97]


def test_clean_and_labels(spark):
    df = spark.createDataFrame([("1.5", "x"), ("NaN", "x"), ("inf", "y"), ("abc", "x"), ("1d", None), (None, "x"), (" 7 ", "z")], "Duration string, note string")
    assert [r.Duration for r in clean.clean(df, ["Duration"]).collect()] == [1.5, None, None, None, None, None, 7.0]
    kept = clean.clean(df, ["Duration"], inf_as_missing=False)
    assert [r.Duration for r in kept.collect()][2] == float("inf")
    assert clean.drop_incomplete(kept).count() == 2
    labels = spark.createDataFrame([("Malicious",), ("Benign",), ("Other",), (None,)], "Label string")
    assert {r.Label: r.code for r in clean.known_labels(labels, name="code").collect()} == {"Malicious": 1, "Benign": 0}
    assert {r.Label: r.label_idx for r in clean.encode_labels(labels.na.drop()).collect()} == {"Benign": 0, "Malicious": 1, "Other": 2}


def test_cap_ranks_only_the_slices_it_keeps_rows_of(spark, monkeypatch):
    df = spark.range(60000).select("id", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 1000 == 1, None).otherwise("b").alias("y"))
    ranked, real = [], sampling.shuffled_rank
    monkeypatch.setattr(sampling, "shuffled_rank", lambda rows, *rest: (ranked.append(rows.count()), real(rows, *rest))[1])
    kept = {r.id for r in sampling.stratified_cap(df, "y", ["id"], max_rows=900).collect()}
    plain = real(df, ["y"], ["id"], 42).where(F.col("shuffled_rank") <= 300)
    assert kept == {r.id for r in plain.collect()} and len(kept) == 600
    # All rows went through the ranking, and its shuffle, before.
    assert ranked[0] < 1000


def test_sampling(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").otherwise("b").alias("y"))
    capped = sampling.stratified_cap(df, "y", ["id"], max_rows=400).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in capped} == {"a": 200, "b": 100}
    split = sampling.stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in split} == {
        ("a", "test"): 180, ("a", "validation"): 180, ("a", "train"): 540, ("b", "test"): 20, ("b", "validation"): 20, ("b", "train"): 60,
    }
    under = sampling.undersample(df, "y", ["id"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in under} == {"a": 200, "b": 100}
    weights = {r.y: r.weight for r in sampling.class_weights(df, "y").collect()}
    assert weights == pytest.approx({"a": 1000 / 1800, "b": 5.0})


@pytest.mark.parametrize("cell_points", [2048, 40])
def test_neighbours_are_exact_with_copies(spark, cell_points):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(240, 3)), 1)
    x[:80] = x[0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, a double, b double, c double")
    points = neighbours.distinct_points(df, "i", ["a", "b", "c"])
    rows = points.collect()
    found = {r.id: r.neighbours for r in neighbours.nearest_points(points, 5, cell_points=cell_points).collect()}
    for p in rows:
        others = sorted((float(np.linalg.norm(np.array(p.vec) - np.array(q.vec))), q.copies) for q in rows if q.id != p.id)
        want, seen = [], 0
        for distance, copies in others:
            if seen >= 5:
                break
            want.append(distance)
            seen += copies
        assert [n["distance"] for n in found[p.id]][: len(want) - 1] == pytest.approx(want[:-1])
        assert found[p.id][-1]["distance"] == pytest.approx(want[-1])


def test_neighbours_across_tiles(spark):
    """Many small tiles, equal distances, copies, a missing and an infinite coordinate: as a plain search finds them."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 4, size=(150, 3)).astype(float), 1e7 + rng.normal(size=(150, 3))])
    x[7, 1], x[20, 2] = np.nan, np.inf
    rows = [(f"p{i}", [float(c) for c in v], int(rng.integers(1, 3))) for i, v in enumerate(x)]
    points, work = spark.createDataFrame(rows, "id string, vec array<double>, copies bigint"), {}
    found = {r.id: [(n.distance, n.near, n["copies"]) for n in r.neighbours] for r in neighbours.nearest_points(points, 4, cell_points=8, tile_points=24, work=work).collect()}
    assert work["all"] == 300 ** 2 and 0 < work["compared"] < work["all"]
    for i, (name, vec, _) in enumerate(rows):
        with np.errstate(all="ignore"):
            distance = np.sqrt(sum((x[:, d] - vec[d]) ** 2 for d in range(3)))
        want, seen = [], 0
        for at, near, copies in sorted((distance[j], rows[j][0], rows[j][2]) for j in range(300) if j != i and not np.isnan(distance[j])):
            if seen < 4:
                want.append((at, near, copies))
                seen += copies
        assert found.get(name, []) == want


def test_neighbours_do_not_send_points_to_every_block(spark, monkeypatch):
    """In many dimensions no block can be left out; what is stored between the steps stays near the number of points."""
    counts, store = [], neighbours.cut_lineage

    def counting(df):
        kept = store(df)
        counts.append(kept.count())
        return kept

    monkeypatch.setattr(neighbours, "cut_lineage", counting)
    x = np.random.default_rng(6).normal(size=(1500, 32))
    points = spark.createDataFrame([(str(i), [float(c) for c in v], 1) for i, v in enumerate(x)], "id string, vec array<double>, copies bigint")
    assert neighbours.nearest_points(points, 3, cell_points=16).count() == 1500
    assert max(counts) <= 4 * 3 * 1500


def test_smote_lies_between_rows_and_cleaning_follows_the_rule(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (60, 2)), rng.normal(1.5, 1, (20, 2))
    rows = [(str(i), 0, *map(float, v)) for i, v in enumerate(a)] + [(f"m{i}", 1, *map(float, v)) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "i string, y int, u double, v double")
    raised = neighbours.smote(df, "y", "i", ["u", "v"]).toPandas()
    assert raised.groupby("y").size().to_dict() == {0: 60, 1: 60} and raised["i"].is_unique
    distance = np.linalg.norm(b[:, None] - b[None], axis=2)
    for row in raised[raised["i"].str.contains("#")].itertuples():
        base = int(row.i.split("#")[0][1:])
        ends = [j for j in np.argsort(distance[base]) if j != base][:5]
        step = np.array([row.u, row.v]) - b[base]
        assert any(np.isclose(np.cross(step, b[j] - b[base]), 0, atol=1e-9) and -1e-9 <= step @ (b[j] - b[base]) <= (b[j] - b[base]) @ (b[j] - b[base]) + 1e-9 for j in ends)
    cleaned = {r.i for r in neighbours.clean_by_neighbours(df, "y", "i", ["u", "v"]).collect()}
    every, labels = np.vstack([a, b]), np.array([0] * 60 + [1] * 20)
    far = np.linalg.norm(every[:, None] - every[None], axis=2)
    np.fill_diagonal(far, np.inf)
    keep = {rows[i][0] for i in range(80) if (labels[np.argsort(far[i])[:3]] == labels[i]).all()}
    assert cleaned == keep


def test_too_few_rows_leave_the_table(spark):
    df = spark.createDataFrame([(str(i), int(i < 3), float(i)) for i in range(20)], "i string, y int, u double")
    assert neighbours.smote(df, "y", "i", ["u"]).count() == 20


def test_log_verdicts_and_ranking(spark):
    robot = "\U0001F916"
    lines = [
        "   - Malicious: 9", f"x {robot} RANDOM_FOREST:", "   - Benign: 2", "   - Confiance moyenne: 0.9", "   - Malicious: 3", "   - Malicious: 8",
        f"{robot} SVM:", "   - Malicious: 4", "   - Benign: 1", f"{robot} DROPPED:", f"{robot} Consensus:", "   - Benign: 0", "   - Malicious: 5",
    ]
    logs = spark.createDataFrame([("p", "r", "s", i, line) for i, line in enumerate(lines)], "path string, run string, scenario string, line_no int, line string")
    got = {(r.model, r.benign, r.malicious) for r in campaign.parse_verdicts(logs).collect()}
    assert got == {("random_forest", 2, 3), ("consensus", 0, 5)}
    verdicts = spark.createDataFrame([("x", "svm", 1, 3), ("x", "other", 0, 9), ("y", "zeta", 1, 1), ("y", "alpha", 3, 1), ("z", "svm", 0, 0)], "scenario string, model string, benign long, malicious long")
    rates = campaign.scenario_rates(verdicts)
    assert {(r.scenario, r.model, r.rate) for r in rates.collect()} == {("x", "svm", 0.75), ("y", "alpha", 0.25)}
    assert {r.scenario: r["rank"] for r in campaign.coverage_ranking(rates).collect()} == {"y": 1, "x": 2}
    assert campaign.weakest_scenario(rates).first()["scenario"] == "y"
    totals = {r.model: r.detection_rate for r in campaign.model_totals(verdicts.where("scenario = 'z' or model = 'other'")).collect()}
    assert totals == {"svm": None, "other": 100.0}


def test_timing_classes(spark):
    rng = np.random.default_rng(0)
    series = {
        "regular": np.arange(50) * 0.2, "burst": np.cumsum(np.where(np.arange(60) % 10 == 9, 2.0, 0.01)),
        "random": np.cumsum(0.2 + rng.uniform(-0.1, 0.1, 80)), "stealth": np.cumsum(rng.uniform(16, 40, 80)),
        "stealth fast": np.cumsum(rng.uniform(0.4, 1.0, 80)), "random slow": np.cumsum(10 + rng.uniform(-5, 5, 80)), "unknown": np.array([0.0, 5.0]),
    }
    rows = [(name, pd.Timestamp("2025-01-01") + pd.Timedelta(seconds=float(t)), i) for name, times in series.items() for i, t in enumerate(times)]
    events = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "ts", "seq"]))
    assert {r.k: r.pattern for r in patterns.timing_class(events, ["k"], 5.0).collect()} == {k: k.split()[0] for k in series}


def test_alphabets_of_sessions_in_short_chunks(spark):
    rng = np.random.default_rng(1)
    sent = {"hex": lambda b: b.hex(), "base32": lambda b: base64.b32encode(b).decode().rstrip("="), "base64url": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")}
    rows = []
    for name, encode in sent.items():
        text = encode(rng.bytes(233))
        rows += [("a", name, i, text[at:at + 30]) for i, at in enumerate(range(0, len(text), 30))]
    chunks = spark.createDataFrame(rows, "src_ip string, session_id string, idx long, chunk string")
    found = {r.session_id: r.alphabet for r in patterns.payload_alphabet(chunks, ["session_id"]).collect()}
    assert found == {name: name for name in sent}


def test_protocols(spark):
    rows = [(9, 443, "tcp"), (9, 443, "UDP"), (9, 443, None), (9, 53, "udp"), (9, 53, "ICMP")]
    df = spark.createDataFrame(rows, "src_port int, dst_port int, protocol string")
    assert [r.proto_class for r in capture.classify_packets(df).collect()] == ["http", "other", "http", "dns", "other"]


def test_capture(spark):
    rows = [(53, 9, "data.example"), (9, 443, "x.exfill"), (443, 9, None), (9, 8080, "plain"), (9, 80, "leak")]
    df = spark.createDataFrame(rows, "src_port int, dst_port int, qname string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    got = capture.counters(df).first()
    assert (got.total_packets, got.dns_packets, got.http_packets, got.detected, got.uptime, got.detection_rate) == (4, 1, 2, 2, 0.0, 200.0)
