"""Batch queries: metering, rules, cleaning, metrics, sessions, patterns and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsight.operators import (
    campaign, capture, clean, decide, endpoints, meter as metering, metrics, patterns, reassembly, rules, sampling,
)
from flowsight.plans import adapters as a, adapters_sql as q
from flowsight.plans.registry import query
from flowsight.schema import SCENARIO_FIELDS
from flowsight.schema import FEATURES, STATISTICS
from flowsight.sources import config, dns



def sig(value: Column) -> Column:
    """Single precision, so that the order of additions does not show; the factor keeps values off rounding ties."""
    return (value * F.lit(1.00000000123)).cast("float").cast("double")


def r4(value: Column) -> Column:
    return F.round(value, 4) + F.lit(0.0)


SIG_SQL = "CAST(CAST({c} * CAST(1.00000000123 AS DOUBLE) AS FLOAT) AS DOUBLE)"
R4_SQL = "round({c}, 4) + 0.0"


def shown(df: DataFrame, *exact: str, close: tuple[str, ...] = (), rounded: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*exact, *[sig(F.col(c)).alias(c) for c in close], *[r4(F.col(c)).alias(c) for c in rounded])


def shown_sql(*exact: str, close: tuple[str, ...] = (), rounded: tuple[str, ...] = ()) -> str:
    return ", ".join([
        *exact, *[f"{SIG_SQL.format(c=c)} AS {c}" for c in close], *[f"{R4_SQL.format(c=c)} AS {c}" for c in rounded],
    ])


# ---- metering

BASICS = ("flow_id", "SourceIP", "DestinationIP", "SourcePort", "DestinationPort", "FlowBytesSent", "FlowBytesReceived", "packets", "start_us")
RATES = ("Duration", "FlowSentRate", "FlowReceivedRate")


def _stat_columns(measure: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    names = [measure + s for s in STATISTICS]
    return tuple(names[:5] + names[7:]), tuple(names[5:7])


@query("flow_meter_basic", f"WITH {q.EVENT_FLOWS} SELECT {shown_sql(*BASICS, 'epoch(TimeStamp)::BIGINT AS started', close=RATES)} FROM flow_table")
def flow_meter_basic(spark, folder):
    flows = a.event_flows(spark, folder).withColumn("started", F.unix_timestamp("TimeStamp"))
    return shown(flows, *BASICS, "started", close=RATES)


def _register_statistics(name: str, measure: str) -> None:
    close, rounded = _stat_columns(measure)

    @query(name, f"WITH {q.EVENT_FLOWS} SELECT {shown_sql('flow_id', close=close, rounded=rounded)} FROM flow_table")
    def statistics(spark, folder):
        return shown(a.event_flows(spark, folder), "flow_id", close=close, rounded=rounded)


_register_statistics("flow_meter_length_stats", "PacketLength")
_register_statistics("flow_meter_time_stats", "PacketTime")
_register_statistics("flow_meter_response_stats", "ResponseTimeTime")


@query("flow_split_by_age", f"""WITH {q.flows(q.EVENT_PACKETS, q.HALF_DAY_US, 6 * 3600 * 1_000_000)}
SELECT {shown_sql(*BASICS, close=(*RATES, 'PacketTimeMean', 'PacketTimeMedian', 'ResponseTimeTimeMedian', 'ResponseTimeTimeMode'))} FROM flow_table""")
def flow_split_by_age(spark, folder):
    flows = metering.meter(a.event_packets(spark, folder), a.HALF_DAY, max_age=6 * 3600.0)
    return shown(flows, *BASICS, close=(*RATES, "PacketTimeMean", "PacketTimeMedian", "ResponseTimeTimeMedian", "ResponseTimeTimeMode"))


@query("flow_doh_flag", f"""WITH {q.EVENT_FLOWS} SELECT flow_id,
(DestinationPort = 443 AND DestinationIP = '192.0.2.1') OR (SourcePort = 443 AND SourceIP = '192.0.2.1') AS doh FROM flow_table""")
def flow_doh_flag(spark, folder):
    flows = metering.meter(a.event_packets(spark, folder), a.HALF_DAY, resolvers=["192.0.2.1"])
    return flows.select("flow_id", F.col("DoH").alias("doh"))


@query("flow_meter_order_lines", f"WITH {q.ORDER_FLOWS} SELECT {shown_sql('order_id', 'Label', 'FlowBytesSent', 'FlowBytesReceived', close=('Duration', 'PacketLengthMean', 'PacketTimeMedian'))} FROM labelled")
def flow_meter_order_lines(spark, folder):
    flows = a.order_flows(spark, folder).withColumnRenamed("flow_id", "order_id")
    return shown(flows, "order_id", "Label", "FlowBytesSent", "FlowBytesReceived", close=("Duration", "PacketLengthMean", "PacketTimeMedian"))


# ---- rules

RULE_SCORE_SQL = """
rs AS (
  SELECT *, greatest(0.0, least(1.0, CAST((CASE WHEN PacketLengthMean > 400 THEN 0.6 ELSE 0 END)
    + (CASE WHEN PacketTimeVariance < 0.001 THEN 0.5 ELSE 0 END)
    + (CASE WHEN FlowReceivedRate > 20000 THEN 0.4 ELSE 0 END) AS DOUBLE))) AS p FROM flow_table
)"""


def rule_predictions(spark, folder) -> DataFrame:
    scored = rules.rule_score(a.event_flows(spark, folder))
    return decide.decide(scored.select("flow_id", F.lit("rules").alias("model"), "p"))


@query("rule_score_summary", f"""WITH {q.EVENT_FLOWS}, {RULE_SCORE_SQL}
SELECT 'rules' AS model, count(*) FILTER (WHERE p < 0.5) AS benign, count(*) FILTER (WHERE p >= 0.5) AS malicious,
count(*) AS total, CAST(0.5 AS DOUBLE) AS threshold, round(avg(greatest(p, 1 - p)), 4) + 0.0 AS confidence FROM rs""")
def rule_score_summary(spark, folder):
    """Meter packets, score flows by the standard rules, decide and summarise."""
    return shown(decide.summarize(rule_predictions(spark, folder)), "model", "benign", "malicious", "total", "threshold", rounded=("confidence",))


@query("rule_score", f"WITH {q.EVENT_FLOWS}, {RULE_SCORE_SQL} SELECT flow_id, round(p, 4) + 0.0 AS p FROM rs")
def rule_score(spark, folder):
    return shown(rules.rule_score(a.event_flows(spark, folder)), "flow_id", rounded=("p",))


@query("detectors_together", f"""WITH {q.EVENT_FLOWS}, {RULE_SCORE_SQL}, both_models AS (SELECT flow_id, 'rules' AS model, p, CAST(0.5 AS DOUBLE) AS threshold FROM rs
 UNION ALL SELECT flow_id, 'long packets', CASE WHEN PacketLengthMean > 300 THEN 0.9 ELSE 0.0 END, CAST(0.8 AS DOUBLE) FROM flow_table)
 SELECT flow_id, model, round(p, 4) + 0.0 AS p, threshold, CASE WHEN p >= threshold THEN 1 ELSE 0 END AS pred FROM both_models""")
def detectors_together(spark, folder):
    """Two rule models and a detector that the table has no columns for, by one call."""
    simple = rules.RuleModel([rules.Rule("PacketLengthMean", ">", 300.0, 0.9)], name="long packets")
    foreign = rules.RuleModel([rules.Rule("NoSuchColumn", ">", 1.0)], name="foreign")
    found = decide.detect(a.event_flows(spark, folder), [rules.STANDARD_RULES, foreign, simple], {"long packets": 0.8})
    return found.select("flow_id", "model", r4(F.col("p")).alias("p"), "threshold", "pred")


MEAN_RULES = rules.RuleModel([
    rules.Rule("PacketLengthMean", ">=", 400.0, 0.6), rules.Rule("PacketTimeMode", "==", 0.0, 0.5),
    rules.Rule("ResponseTimeTimeMedian", "!=", -1.0, 0.4), rules.Rule("FlowBytesSent", "<=", 1000.0),
], "mean", (0.1, 0.6), 0.05)


@query("rule_score_mean_mode", f"""WITH {q.EVENT_FLOWS} SELECT flow_id, round(greatest(0.1, least(0.6, CAST(
 (CASE WHEN PacketLengthMean >= 400 THEN 0.6 ELSE 0 END) + (CASE WHEN PacketTimeMode = 0 THEN 0.5 ELSE 0 END)
 + (CASE WHEN ResponseTimeTimeMedian <> -1 OR ResponseTimeTimeMedian IS NULL THEN 0.4 ELSE 0 END)
 + (CASE WHEN FlowBytesSent <= 1000 THEN 1.0 ELSE 0 END) AS DOUBLE) / 4 + 0.05)), 4) + 0.0 AS p FROM flow_table""")
def rule_score_mean_mode(spark, folder):
    return shown(rules.rule_score(a.event_flows(spark, folder), MEAN_RULES), "flow_id", rounded=("p",))


FLAG = "coalesce(size > 200, false) OR coalesce(freq > 100, false) OR coalesce(vol > 7500, false)"
REASONS = """array_to_string([x FOR x IN [CASE WHEN size > 200 THEN 'avg_packet_size' END,
 CASE WHEN freq > 100 THEN 'frequency' END, CASE WHEN vol > 7500 THEN 'volume_rate' END] IF x IS NOT NULL], ',')"""
RATE_SQL = """f3 AS (SELECT *, CASE WHEN Duration <> 0 THEN FlowBytesSent / Duration END AS size,
 CASE WHEN PacketTimeMedian <> 0 THEN FlowBytesSent / PacketTimeMedian END AS freq, FlowSentRate AS vol FROM {t})"""
STAT_SQL = """f3 AS (SELECT *, PacketLengthMean AS size, CASE WHEN Duration > 0 THEN
 (CASE WHEN PacketLengthMean > 0 THEN FlowBytesSent / PacketLengthMean ELSE 0 END) / Duration ELSE 0 END AS freq,
 CASE WHEN Duration > 0 THEN FlowBytesSent / Duration ELSE 0 END AS vol FROM {t})"""
THREE = ("avg_packet_size", "frequency", "volume_rate")
THREE_SQL = ", ".join(f"{SIG_SQL.format(c=c)} AS {n}" for c, n in zip(("size", "freq", "vol"), THREE))


@query("threshold_flag_rates", f"WITH {q.EVENT_FLOWS}, {RATE_SQL.format(t='flow_table')} SELECT flow_id, {FLAG} AS flagged, {THREE_SQL} FROM f3")
def threshold_flag_rates(spark, folder):
    return shown(rules.threshold_flag(rules.rate_features(a.event_flows(spark, folder))), "flow_id", "flagged", close=THREE)


@query("threshold_flag_stats", f"WITH {q.EVENT_FLOWS}, {STAT_SQL.format(t='flow_table')} SELECT flow_id, {FLAG} AS flagged, {THREE_SQL} FROM f3")
def threshold_flag_stats(spark, folder):
    return shown(rules.threshold_flag(rules.stat_features(a.event_flows(spark, folder))), "flow_id", "flagged", close=THREE)


def sequences(spark, folder) -> DataFrame:
    """One packet sequence per user: events in the order of their ids, time in seconds."""
    events = a.table(spark, folder, "events")
    return events.select(
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("pos"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), F.floor(F.col("value") * 10).cast("double").alias("size"),
    )


@query("threshold_flag_packets", f"""WITH s AS (
  SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS n, sum(floor(value * 10)) AS bytes,
   arg_max(epoch_us(ts) / 1e6, event_id) - arg_min(epoch_us(ts) / 1e6, event_id) AS span FROM events GROUP BY user_id),
 f3 AS (SELECT file, bytes / n AS size, n / (CASE WHEN span > 0 THEN span ELSE 1 END) AS freq,
   bytes / (CASE WHEN span > 0 THEN span ELSE 1 END) AS vol FROM s)
 SELECT file, {FLAG} AS suspicious, {THREE_SQL} FROM f3""")
def threshold_flag_packets(spark, folder):
    flagged = rules.threshold_flag(rules.sequence_features(sequences(spark, folder)), name="suspicious")
    return shown(flagged, "file", "suspicious", close=THREE)


@query("flag_reasons_false_positives", f"""WITH {q.ORDER_FLOWS}, {STAT_SQL.format(t='labelled')}
SELECT order_id, SourceIP, DestinationIP, {THREE_SQL}, {REASONS} AS exceeded FROM f3 WHERE Label = 'Benign' AND ({FLAG})""")
def flag_reasons_false_positives(spark, folder):
    flows = clean.known_labels(a.order_flows(spark, folder)).withColumnRenamed("flow_id", "order_id")
    return shown(rules.false_positives(rules.stat_features(flows)), "order_id", "SourceIP", "DestinationIP", "exceeded", close=THREE)


# ---- cleaning

def _text_values(spark, folder) -> DataFrame:
    """Event values as text, errors carrying words and infinities instead of numbers."""
    events = a.table(spark, folder, "events")
    text = (
        F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "signup", "NaN")
        .when((F.col("event_type") == "view") & (F.col("value") > 200), "inf").otherwise(F.col("value").cast("string"))
    )
    return events.select("event_id", "user_id", "event_type", text.alias("Duration"))


@query("coerce_numeric", """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') OR (event_type = 'view' AND value > 200)
 THEN NULL ELSE value END AS Duration FROM events""")
def coerce_numeric(spark, folder):
    return clean.clean(_text_values(spark, folder), ["Duration"]).select("event_id", "Duration")


@query("coerce_keep_infinity", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'view' AND value > 200) AS infinite
 FROM events GROUP BY ALL""")
def coerce_keep_infinity(spark, folder):
    kept = clean.clean(_text_values(spark, folder), ["Duration"], inf_as_missing=False)
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("Duration") == float("inf")).alias("infinite")
    )


@query("drop_incomplete", """SELECT event_id, value AS Duration FROM events
 WHERE NOT (event_type IN ('error', 'signup') OR (event_type = 'view' AND value > 200))""")
def drop_incomplete(spark, folder):
    typed = clean.clean(_text_values(spark, folder), ["Duration"], inf_as_missing=False)
    return clean.drop_incomplete(typed).select("event_id", "Duration")


IMPUTED = ("Duration", "ResponseTimeTimeMedian", "ResponseTimeTimeSkewFromMedian", "PacketLengthMean")


@query("median_impute", f"""WITH {q.EVENT_FLOWS}, md AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in IMPUTED)} FROM flow_table)
SELECT flow_id, {', '.join(f"{SIG_SQL.format(c=f'coalesce({c}, m_{c})')} AS {c}" for c in IMPUTED)} FROM flow_table, md""")
def median_impute(spark, folder):
    return shown(clean.impute(a.event_flows(spark, folder), IMPUTED), "flow_id", close=IMPUTED)


@query("label_distribution", f"WITH {q.ORDER_FLOWS} SELECT Label, count(*) AS n FROM labelled GROUP BY Label")
def label_distribution(spark, folder):
    return clean.label_counts(a.order_flows(spark, folder))


@query("label_filter", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def label_filter(spark, folder):
    orders = a.table(spark, folder, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "Malicious").when(F.col("o_orderstatus") == "O", "Benign").otherwise("Unknown")
    return clean.known_labels(orders.withColumn("Label", label)).select("o_orderkey", "label")


@query("label_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS label_idx FROM orders")
def label_encode(spark, folder):
    return clean.encode_labels(a.table(spark, folder, "orders"), "o_orderpriority").select("o_orderkey", "label_idx")


@query("endpoint_split", f"""WITH {q.EVENT_FLOWS} SELECT SourceIP = '10.1.0.7' OR DestinationIP = '10.1.0.7' AS is_match, count(*) AS n,
 CAST(sum(FlowBytesSent) AS BIGINT) AS sent FROM flow_table GROUP BY 1""")
def endpoint_split(spark, folder):
    split = endpoints.split_by_endpoint(a.event_flows(spark, folder), "10.1.0.7")
    return split.groupBy("is_match").agg(F.count(F.lit(1)).alias("n"), F.sum("FlowBytesSent").alias("sent"))


# ---- metrics

@query("confusion_matrix", f"""WITH {q.LABELS} SELECT t.truth, p.pred, count(v.label) AS n FROM (VALUES (0), (1)) t(truth)
 CROSS JOIN (VALUES (0), (1)) p(pred) LEFT JOIN verdicts v ON v.label = t.truth AND v.pred = p.pred GROUP BY ALL""")
def confusion_matrix(spark, folder):
    return metrics.confusion(a.document_labels(spark, folder))


REPORT_SQL = """c AS (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
 count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) AS n FROM verdicts),
k AS (SELECT 'Benign' AS name, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, tn + fp AS support, n FROM c
 UNION ALL SELECT 'Malicious', tp / (tp + fp), tp / (tp + fn), tp + fn, n FROM c),
kf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM k),
rep AS (SELECT name, precision, recall, f1, support FROM kf
 UNION ALL SELECT 'accuracy', NULL, NULL, (tn + tp) / n, n FROM c
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM kf
 UNION ALL SELECT 'weighted avg', sum(precision * support) / max(n), sum(recall * support) / max(n), sum(f1 * support) / max(n), max(n) FROM kf)"""
REPORT_COLUMNS = ("precision", "recall", "f1")


@query("classification_report", f"WITH {q.LABELS}, {REPORT_SQL} SELECT {shown_sql('name', 'support', rounded=REPORT_COLUMNS)} FROM rep")
def classification_report(spark, folder):
    return shown(metrics.classification_report(a.document_labels(spark, folder)), "name", "support", rounded=REPORT_COLUMNS)


RULE_VERDICTS_SQL = "verdicts AS (SELECT CASE Label WHEN 'Malicious' THEN 1 ELSE 0 END AS label, CASE WHEN " + FLAG + " THEN 1 ELSE 0 END AS pred FROM f3)"


@query("rule_evaluation_report", f"WITH {q.ORDER_FLOWS}, {STAT_SQL.format(t='labelled')}, {RULE_VERDICTS_SQL}, {REPORT_SQL} SELECT {shown_sql('name', 'support', rounded=REPORT_COLUMNS)} FROM rep")
def rule_evaluation_report(spark, folder):
    flows = rules.threshold_flag(rules.stat_features(clean.known_labels(a.order_flows(spark, folder))))
    verdicts = flows.withColumn("pred", F.col("flagged").cast("int"))
    return shown(metrics.classification_report(verdicts), "name", "support", rounded=REPORT_COLUMNS)


@query("false_positives", f"WITH {q.LABELS} SELECT doc_id, label, pred FROM verdicts WHERE label = 0 AND pred = 1")
def false_positives(spark, folder):
    return metrics.errors(a.document_labels(spark, folder), "fp")


@query("error_counts", f"""WITH {q.LABELS} SELECT count(*) FILTER (WHERE label = 0 AND pred = 1) AS false_positives,
 count(*) FILTER (WHERE label = 1 AND pred = 0) AS false_negatives FROM verdicts""")
def error_counts(spark, folder):
    return metrics.error_counts(a.document_labels(spark, folder))


@query("false_negatives_top5", f"WITH {q.LABELS} SELECT doc_id, label, pred FROM verdicts WHERE label = 1 AND pred = 0 ORDER BY doc_id LIMIT 5")
def false_negatives_top5(spark, folder):
    return metrics.sample_errors(a.document_labels(spark, folder), "fn", "doc_id")


@query("roc_points", f"WITH {q.SCORES}, {q.ROC} SELECT CASE WHEN isinf(threshold) THEN NULL ELSE threshold END AS threshold, round(fpr, 4) + 0.0 AS fpr, round(tpr, 4) + 0.0 AS tpr, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp FROM roc")
def roc_points(spark, folder):
    curve = metrics.roc_curve(a.embedding_scores(spark, folder))
    finite = F.when(F.col("threshold") != float("inf"), F.col("threshold"))
    return shown(curve.withColumn("threshold", finite), "threshold", "fp", "tp", rounded=("fpr", "tpr"))


@query("auc_exact", f"""WITH {q.SCORES}, {q.ROC} SELECT round(sum(neg * (tp - pos / 2)) / (max(np) * max(nn)), 6) AS auc FROM cum""")
def auc_exact(spark, folder):
    return metrics.auc(a.embedding_scores(spark, folder)).select(F.round("auc", 6).alias("auc"))


@query("auc_per_model", f"""WITH {q.MODELS}, sc AS (SELECT model, p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM preds GROUP BY ALL),
 cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp FROM sc)
 SELECT model, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM cum GROUP BY model""")
def auc_per_model(spark, folder):
    return metrics.auc(model_predictions(spark, folder), keys=["model"]).select("model", F.round("auc", 6).alias("auc"))


@query("threshold_at_fpr", f"""WITH {q.SCORES}, {q.ROC} SELECT t.target, arg_min(threshold, row(abs(fpr - t.target), -threshold)) AS threshold
 FROM roc, (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) t(target) GROUP BY t.target""")
def threshold_at_fpr(spark, folder):
    scores = a.embedding_scores(spark, folder)
    return metrics.threshold_at_fpr(scores, [0.05, 0.1, 0.5])


@query("accuracy_at_threshold", f"""WITH {q.SCORES} SELECT t.threshold, round(avg(CASE WHEN (p >= t.threshold) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
 FROM scores, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.0 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) t(threshold) GROUP BY t.threshold""")
def accuracy_at_threshold(spark, folder):
    found = metrics.accuracy_at(a.embedding_scores(spark, folder), [0.5, 0.0, 0.1])
    return found.select("threshold", F.round("accuracy", 6).alias("accuracy"))


# ---- decisions over several models

MODEL_THRESHOLDS = {"random_forest": 0.52, "logistic_regression": 0.48}


def model_predictions(spark, folder) -> DataFrame:
    return decide.stack_models(a.embedding_models(spark, folder), ["random_forest", "logistic_regression", "rules"], ["flow_id", "label"])


def threshold_table(spark) -> DataFrame:
    rows = [f"('{model}', {value}D)" for model, value in MODEL_THRESHOLDS.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(model, threshold)")


@query("threshold_lookup_default", f"WITH {q.MODELS} SELECT flow_id, model, {SIG_SQL.format(c='p')} AS p, threshold, pred, {SIG_SQL.format(c='confidence')} AS confidence FROM decided")
def threshold_lookup_default(spark, folder):
    decided = decide.decide(model_predictions(spark, folder), threshold_table(spark))
    return shown(decided, "flow_id", "model", "threshold", "pred", close=("p", "confidence"))


@query("prediction_summary", f"""WITH {q.MODELS} SELECT model, count(*) FILTER (WHERE pred = 0) AS benign, count(*) FILTER (WHERE pred = 1) AS malicious,
 count(*) AS total, max(threshold) AS threshold, round(avg(confidence), 6) AS confidence FROM decided GROUP BY model""")
def prediction_summary(spark, folder):
    summary = decide.summarize(decide.decide(model_predictions(spark, folder), MODEL_THRESHOLDS))
    return summary.withColumn("confidence", F.round("confidence", 6))


@query("consensus_verdict", f"WITH {q.MODELS} SELECT flow_id, CASE WHEN avg(pred) >= 0.5 THEN 1 ELSE 0 END AS pred, round(avg(confidence), 6) AS confidence FROM decided GROUP BY flow_id")
def consensus_verdict(spark, folder):
    return decide.consensus(decide.decide(model_predictions(spark, folder), MODEL_THRESHOLDS)).withColumn("confidence", F.round("confidence", 6))


@query("best_model_by_auc", f"""WITH {q.MODELS}, sc AS (SELECT model, p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM preds GROUP BY ALL),
 cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp FROM sc),
 aucs AS (SELECT model, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM cum GROUP BY model)
 SELECT model, round(auc, 6) AS test_auc FROM aucs ORDER BY auc DESC, model LIMIT 1""")
def best_model_by_auc(spark, folder):
    place = F.when(F.col("model") == "logistic_regression", 0).when(F.col("model") == "random_forest", 1).otherwise(2)
    results = metrics.auc(model_predictions(spark, folder), keys=["model"]).select("model", F.col("auc").alias("test_auc"), place.alias("position"))
    return decide.best_model(results).withColumn("test_auc", F.round("test_auc", 6))


# ---- queries, sessions and payloads

@query("suspicious_queries", f"WITH {q.ALL_QUERIES} SELECT us, src_ip, qname FROM queries WHERE regexp_matches(lower(qname), 'exfill|data|leak')")
def suspicious_queries(spark, folder):
    found = reassembly.suspicious(dns.dns_events(a.all_queries(spark, folder)))
    return found.select(F.unix_micros("ts").alias("us"), "src_ip", "qname")


@query("chunk_parse", f"WITH {q.DOCUMENT_QUERIES}, {q.chunks('dns')} SELECT src_ip, us, session_id, idx, total, chunk FROM chunk_rows")
def chunk_parse(spark, folder):
    parsed = reassembly.parse_chunks(a.all_queries(spark, folder))
    return parsed.select("src_ip", F.unix_micros("ts").alias("us"), "session_id", "idx", "total", "chunk")


@query("malformed_chunks", "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY user_id")
def malformed_chunks(spark, folder):
    """Events as suspicious names: clicks have a well-formed chunk label, the rest lack a part."""
    events = a.table(spark, folder, "events")
    label = F.when(F.col("event_type") == "click", "1-0-1-x").otherwise(F.concat(F.lit("0-"), F.col("event_type")))
    names = events.select("ts", F.col("user_id").cast("string").alias("src_ip"), F.concat(label, F.lit(".a1b2c.exfill.local.")).alias("qname"))
    bad = reassembly.malformed(dns.dns_events(names))
    return bad.groupBy(F.col("src_ip").cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("session_progress", f"""WITH {q.DAMAGED_QUERIES}, {q.chunks('dns')}, {q.SESSIONS} SELECT src_ip, session_id, received, total, arrivals,
 total - expected_received AS missing, received = total AND max_idx = total - 1 AS complete FROM sess""")
def session_progress(spark, folder):
    return reassembly.progress(a.damaged_queries(spark, folder))


@query("session_missing_chunks", f"""WITH {q.DAMAGED_QUERIES}, {q.chunks('dns')}, {q.SESSIONS}, want AS (SELECT src_ip, session_id, unnest(range(0, total)) AS idx FROM firsts)
 SELECT src_ip, session_id, count(*) AS missing, min(idx) AS first_missing FROM want ANTI JOIN latest USING (src_ip, session_id, idx) GROUP BY ALL""")
def session_missing_chunks(spark, folder):
    ranges = reassembly.missing_ranges(a.damaged_queries(spark, folder))
    return ranges.groupBy("src_ip", "session_id").agg(F.sum("n_missing").alias("missing"), F.min("first_missing").alias("first_missing"))


@query("session_transfer_stats", f"""WITH {q.DAMAGED_QUERIES}, {q.chunks('dns')}, {q.SESSIONS} SELECT src_ip, session_id, received AS chunks, bytes, arrivals - received AS repeats,
 round((last_us - first_us) / 1e6, 6) AS duration, round(100.0 * received / total, 4) AS success_rate,
 round(CASE WHEN last_us > first_us THEN bytes / ((last_us - first_us) / 1e6) ELSE 0 END, 4) AS throughput FROM sess""")
def session_transfer_stats(spark, folder):
    stats = reassembly.transfer_stats(a.damaged_queries(spark, folder))
    return stats.select(
        "src_ip", "session_id", "chunks", "bytes", "repeats", F.round("duration", 6).alias("duration"),
        F.round("success_rate", 4).alias("success_rate"), F.round("throughput", 4).alias("throughput"),
    )


@query("reassemble_sha", """SELECT '10.2.0.' || lang AS src_ip, CAST(doc_id AS VARCHAR) AS session_id, strlen(text) AS size, sha256(text) AS payload_id
 FROM documents WHERE strlen(text) > 0""")
def reassemble_sha(spark, folder):
    """Payloads put together from chunk names equal the documents they came from."""
    return reassembly.identify(reassembly.reassemble(a.all_queries(spark, folder))).select("src_ip", "session_id", "size", "payload_id")


@query("reassemble_pieces", """SELECT '10.2.0.' || lang AS src_ip, CAST(doc_id AS VARCHAR) AS session_id, strlen(text) AS size,
 greatest(1, ceil(ceil(strlen(text) * 8 / 6) / 4096)) ::BIGINT AS pieces FROM documents WHERE strlen(text) > 0""")
def reassemble_pieces(spark, folder):
    """As reassemble_sha with payloads cut into short pieces, which are whole in number and size."""
    pieces = reassembly.reassemble(a.document_queries(spark, folder), piece_chars=4096)
    return pieces.groupBy("src_ip", "session_id").agg(F.sum(F.length("payload").cast("bigint")).alias("size"), F.count(F.lit(1)).alias("pieces"))


@query("payload_identity_long", """SELECT '10.2.0.' || lang AS src_ip, lang AS session, sum(strlen(text)) ::BIGINT AS size,
 sha256(string_agg(text, '' ORDER BY doc_id)) AS payload_id FROM documents WHERE strlen(text) > 0 GROUP BY lang""")
def payload_identity_long(spark, folder):
    """All documents of a language as one transfer, far longer than a piece; the identity is that of the whole payload."""
    found = reassembly.identify(reassembly.reassemble(a.joined_queries(spark, folder)))
    return found.select("src_ip", F.substring("src_ip", 8, 10).alias("session"), "size", "payload_id")


@query("reassemble_repeated_sessions", """SELECT '10.2.0.' || lang AS src_ip, CAST(doc_id AS VARCHAR) AS session_id, n AS transfer,
 sha256(CASE n WHEN 0 THEN text ELSE reverse(text) END) AS payload_id FROM documents, range(2) r(n) WHERE strlen(text) > 0""")
def reassemble_repeated_sessions(spark, folder):
    """Each session id used for two transfers, one after the other."""
    found = reassembly.identify(reassembly.reassemble(a.repeated_queries(spark, folder)))
    return found.select("src_ip", "session_id", F.col("transfer").cast("bigint").alias("transfer"), "payload_id")


@query("reassemble_last_write_wins", f"""WITH RECURSIVE {q.DAMAGED_QUERIES}, {q.chunks('dns')}, {q.TRANSFERS}
 SELECT src_ip, session_id, md5(array_to_string(parts, '')) AS text_md5, length(array_to_string(parts, '')) AS chars FROM transfers""")
def reassemble_last_write_wins(spark, folder):
    texts = reassembly.session_texts(a.damaged_queries(spark, folder), piece_chars=None)
    return texts.select("src_ip", "session_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query("reassemble_by_session_id", f"""WITH RECURSIVE {q.DAMAGED_QUERIES}, {q.chunks('dns')}, {q.TRANSFERS}
 SELECT session_id, n AS chunks, first_us AS started_us FROM transfers""")
def reassemble_by_session_id(spark, folder):
    found = reassembly.reassemble(a.damaged_queries(spark, folder), key="session", decode_mode="cascade")
    return found.select("session_id", "chunks", "started_us")


@query("payload_type", f"""WITH t AS (SELECT doc_id, lang, hex(encode(text))[1:16] AS head FROM documents WHERE strlen(text) > 0)
 SELECT {q.file_type_case('head')} AS type, count(*) AS n FROM t GROUP BY 1""")
def payload_type(spark, folder):
    found = reassembly.identify(reassembly.reassemble(a.document_queries(spark, folder)))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("payload_dedup", """SELECT sha256(text) AS payload_id, count(*) AS sessions, min(strlen(text)) AS size FROM documents WHERE strlen(text) > 0 GROUP BY 1""")
def payload_dedup(spark, folder):
    found = reassembly.identify(reassembly.reassemble(a.document_queries(spark, folder)))
    return reassembly.distinct_payloads(found).select("payload_id", "sessions", "size")


@query("decode_by_alphabet", f"""SELECT '10.2.0.' || lang AS src_ip, CAST(doc_id AS VARCHAR) AS session_id,
 CASE WHEN lang = 'en' THEN 'hex' ELSE 'base64url' END AS encoding, sha256(text) AS payload_sha FROM documents WHERE strlen(text) > 0""")
def decode_by_alphabet(spark, folder):
    found = reassembly.reassemble(a.encoded_queries(spark, folder))
    return found.select("src_ip", "session_id", "encoding", F.sha2("payload", 256).alias("payload_sha"))


@query("decode_cascade", f"""WITH {q.ENCODED_QUERIES}, {q.chunks('dns')}, {q.SESSIONS}
 SELECT src_ip, session_id, 'base64url' AS encoding, sha256({q.base64_payload('txt')}) AS payload_sha FROM sess WHERE length(txt) % 4 <> 1""")
def decode_cascade(spark, folder):
    found = reassembly.reassemble(a.encoded_queries(spark, folder), decode_mode="cascade")
    return found.where(F.col("encoding") == "base64url").select("src_ip", "session_id", "encoding", F.sha2("payload", 256).alias("payload_sha"))


@query("doh_request_parse", f"""WITH {q.PAGE_REQUESTS} SELECT us, src_ip, regexp_extract(path, 'name=(.*)$', 1) AS qname FROM http
 WHERE regexp_matches(host, 'example[.]com|blog') AND regexp_extract(path, 'name=(.*)$', 1) <> ''""")
def doh_request_parse(spark, folder):
    events = dns.doh_events(a.page_requests(spark, folder), ["example.com", "blog"])
    return events.select(F.unix_micros("ts").alias("us"), "src_ip", "qname")


@query("watched_domains", f"WITH {q.PAGE_REQUESTS} SELECT contains(host, 'example.org') OR contains(host, 'blog') AS is_watched, count(*) AS n FROM http GROUP BY 1")
def watched_domains(spark, folder):
    requests = a.page_requests(spark, folder)
    return requests.groupBy(dns.watched(F.col("host"), ["example.org", "blog"]).alias("is_watched")).agg(F.count(F.lit(1)).alias("n"))


CAPTURED_SQL = f"""WITH {q.EVENT_PACKETS}, cap AS (SELECT us, outb, CASE WHEN sport = 53 THEN 'dns' WHEN outb AND sport IN (443, 8080) THEN 'http' ELSE 'other' END AS proto_class
 FROM pk WHERE sport IN (53, 443, 8080))"""


@query("proto_class", f"{CAPTURED_SQL} SELECT proto_class, count(*) AS n FROM cap GROUP BY 1")
def proto_class(spark, folder):
    return capture.classify_packets(a.event_packets(spark, folder)).groupBy("proto_class").agg(F.count(F.lit(1)).alias("n"))


@query("capture_counters", f"""{CAPTURED_SQL} SELECT count(*) AS total_packets, count(*) FILTER (WHERE proto_class = 'dns') AS dns_packets,
 count(*) FILTER (WHERE proto_class = 'http') AS http_packets, count(*) FILTER (WHERE outb) AS detected, round((max(us) - min(us)) / 1e6, 3) AS uptime,
 round(count(*) FILTER (WHERE outb) * 100.0 / greatest(count(*) FILTER (WHERE proto_class = 'dns'), 1), 4) AS detection_rate FROM cap""")
def capture_counters(spark, folder):
    outbound = F.col("dst_ip") == "192.0.2.1"
    packets = a.event_packets(spark, folder).withColumn("qname", F.when(outbound, "0001.leak.local"))
    return capture.counters(packets).withColumns({"uptime": F.round("uptime", 3), "detection_rate": F.round("detection_rate", 4)})


# ---- patterns

NAMED_SQL = f"""WITH {q.ALL_QUERIES}, nm AS (SELECT src_ip, us, qname, split_part(qname, '.', 1) AS label,
 array_to_string(string_split(qname, '.')[-2:], '.') AS parent, len(string_split(qname, '.')) AS depth FROM queries)"""


@query("label_structure", f"""{NAMED_SQL} SELECT src_ip, parent, count(*) AS queries, round(avg(length(label)), 6) AS mean_label_length, max(length(label)) AS max_label_length,
 round(count(DISTINCT label) / count(*), 6) AS distinct_share, round(avg(depth), 6) AS mean_depth,
 round(sum(length(regexp_replace(label, '[^0-9]', '', 'g'))) / sum(length(label)), 6) AS digit_share,
 round(avg(CASE WHEN length(label) BETWEEN 8 AND 100 THEN 1.0 ELSE 0.0 END), 6) AS chunk_sized_share FROM nm GROUP BY ALL""")
def label_structure(spark, folder):
    found = patterns.label_structure(a.all_queries(spark, folder))
    numbers = ["mean_label_length", "distinct_share", "mean_depth", "digit_share", "chunk_sized_share"]
    return found.withColumns({c: F.round(c, 6) for c in numbers}).withColumn("max_label_length", F.col("max_label_length").cast("bigint"))


@query("label_entropy", f"""{NAMED_SQL}, ch AS (SELECT src_ip, parent, unnest(string_split(label, '')) AS c FROM nm), cn AS (SELECT src_ip, parent, c, count(*) AS n FROM ch WHERE c <> '' GROUP BY ALL)
 SELECT src_ip, parent, CAST(sum(n) AS BIGINT) AS characters, count(*) AS alphabet_size, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM cn GROUP BY ALL""")
def label_entropy(spark, folder):
    return patterns.label_entropy(a.all_queries(spark, folder)).withColumn("entropy", F.round("entropy", 6))


@query("payload_alphabet", """WITH e AS (SELECT lang, strlen(text) AS bytes, CASE lang WHEN 'en' THEN 'hex' WHEN 'fr' THEN 'base32' ELSE 'base64url' END AS alphabet,
 CAST(CASE lang WHEN 'en' THEN strlen(text) * 2 WHEN 'fr' THEN ceil(strlen(text) * 8 / 5) ELSE ceil(strlen(text) * 4 / 3) END AS BIGINT) AS chars FROM documents WHERE strlen(text) > 0)
 SELECT '10.2.0.' || lang AS src_ip, alphabet, count(*) AS sessions, CAST(sum(ceil(chars / 30)) AS BIGINT) AS chunks, CAST(sum(chars) AS BIGINT) AS characters FROM e GROUP BY ALL""")
def payload_alphabet(spark, folder):
    """The alphabet found equals the one the session was sent in."""
    return patterns.payload_alphabet(reassembly.parse_chunks(a.three_encodings(spark, folder)))


@query("domain_rotation", """WITH nm AS (SELECT user_id, event_type || '.local' AS parent, epoch_us(ts) AS us FROM events)
 SELECT CAST(user_id AS VARCHAR) AS src_ip, us // 86400000000 AS day, count(*) AS queries, count(DISTINCT parent) AS domains, count(DISTINCT parent) >= 3 AS rotating FROM nm GROUP BY ALL""")
def domain_rotation(spark, folder):
    events = a.table(spark, folder, "events")
    names = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("src_ip"), F.concat(F.lit("x."), F.col("event_type"), F.lit(".local")).alias("qname"))
    found = patterns.domain_rotation(names, window="1 day")
    return found.select("src_ip", F.floor(F.unix_micros("window_start") / 86_400_000_000).alias("day"), "queries", "domains", "rotating")


@query("timing_class", """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
 s AS (SELECT user_id, count(gap) AS gaps, avg(gap) AS m, stddev_pop(gap) AS sd, min(gap) AS lo, max(gap) AS hi, count(*) FILTER (WHERE gap <= 0.05) / greatest(count(gap), 1) AS short FROM g GROUP BY 1)
 SELECT user_id, gaps, round(m, 3) AS mean_gap, round(CASE WHEN m > 0 THEN sd / m ELSE 0 END, 4) AS variation, CASE WHEN gaps < 2 THEN 'unknown' WHEN short >= 0.5 AND sd / m > 1 THEN 'burst'
 WHEN sd / m <= 0.1 THEN 'regular' WHEN hi / nullif(lo, 0) BETWEEN 1.9 AND 2.6 THEN 'stealth' ELSE 'random' END AS pattern FROM s""")
def timing_class(spark, folder):
    events = a.table(spark, folder, "events").withColumnRenamed("event_id", "seq")
    found = patterns.timing_class(events, ["user_id"], 12 * 3600.0)
    return found.select("user_id", "gaps", F.round("mean_gap", 3).alias("mean_gap"), F.round("variation", 4).alias("variation"), "pattern")


@query("timing_class_known", """SELECT user_id, count(*) - 1 AS gaps, ['regular', 'random', 'burst', 'stealth'][user_id % 4 + 1] AS pattern
 FROM events GROUP BY user_id HAVING count(*) > 40""")
def timing_class_known(spark, folder):
    """The pattern found equals the one that the events were sent with, at every speed."""
    found = patterns.timing_class(a.paced_events(spark, folder), ["user_id"], 60.0)
    return found.where("gaps >= 40").select("user_id", "gaps", "pattern")


def _event_sources(spark, folder) -> DataFrame:
    events = a.table(spark, folder, "events")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"))


@query("query_volume_tumbling", "SELECT user_id AS src, (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, count(*) AS n FROM events GROUP BY ALL")
def query_volume_tumbling(spark, folder):
    volume = patterns.query_volume(_event_sources(spark, folder), "1 hour", keys=["src"])
    return volume.select("src", F.unix_micros("window_start").alias("start_us"), "n")


@query("query_volume_sliding", """SELECT user_id AS src, ((epoch_us(ts) // 1800000000) - k.i) * 1800000000 AS start_us, count(*) AS n
 FROM events, (VALUES (0), (1)) k(i) GROUP BY ALL""")
def query_volume_sliding(spark, folder):
    volume = patterns.query_volume(_event_sources(spark, folder), "1 hour", "30 minutes", keys=["src"])
    return volume.select("src", F.unix_micros("window_start").alias("start_us"), "n")


# ---- campaign reports

@query("log_verdicts", f"WITH {q.LOGS} SELECT path, run, scenario, model, benign, malicious FROM log_verdicts")
def log_verdicts(spark, folder):
    return campaign.parse_verdicts(a.conversation_logs(spark, folder))


TOTALS_SQL = """CAST(sum(benign) AS BIGINT) AS benign, CAST(sum(malicious) AS BIGINT) AS malicious, CAST(sum(benign + malicious) AS BIGINT) AS total,
 CASE WHEN sum(benign + malicious) > 0 THEN round(sum(malicious) * 100.0 / sum(benign + malicious), 2) END AS detection_rate"""


@query("model_totals", f"WITH {q.LOGS} SELECT model, {TOTALS_SQL} FROM log_verdicts GROUP BY model")
def model_totals(spark, folder):
    return campaign.model_totals(campaign.parse_verdicts(a.conversation_logs(spark, folder)))


@query("scenario_rates", f"WITH {q.SCENARIO_SUMS} SELECT scenario, model, benign, malicious, total, round(rate, 6) AS rate FROM chosen")
def scenario_rates(spark, folder):
    return campaign.scenario_rates(a.supplier_summaries(spark, folder)).withColumn("rate", F.round("rate", 6))


@query("coverage_ranking", f"WITH {q.SCENARIO_SUMS} SELECT scenario, model, round(rate, 6) AS rate, rank() OVER (ORDER BY rate) AS rank FROM chosen")
def coverage_ranking(spark, folder):
    ranked = campaign.coverage_ranking(campaign.scenario_rates(a.supplier_summaries(spark, folder)))
    return ranked.select("scenario", "model", F.round("rate", 6).alias("rate"), "rank")


@query("weakest_coverage", f"WITH {q.SCENARIO_SUMS} SELECT scenario, model, round(rate, 6) AS rate FROM chosen ORDER BY chosen.rate, scenario LIMIT 1")
def weakest_coverage(spark, folder):
    found = campaign.weakest_scenario(campaign.scenario_rates(a.supplier_summaries(spark, folder)))
    return found.withColumn("rate", F.round("rate", 6))


@query("latest_log_files", "SELECT CAST(o_custkey AS VARCHAR) AS scenario, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS path FROM orders GROUP BY 1")
def latest_log_files(spark, folder):
    orders = a.table(spark, folder, "orders")
    files = orders.select(F.col("o_custkey").cast("string").alias("scenario"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("path"))
    return campaign.latest_files(files, ["scenario"])


@query("scenario_defaults", f"""WITH {q.SCENARIO_SETTINGS} SELECT s_name AS scenario, coalesce(doh_server, 'https://doh.local/dns-query') AS doh_server, target_domain,
 coalesce(chunk_size, 30) AS chunk_size, coalesce(encoding, 'base64') AS encoding, coalesce(timing_pattern, 'regular') AS timing_pattern,
 CAST(coalesce(base_delay, 0.2) AS DOUBLE) AS base_delay, false AS compression, false AS encryption, CAST(NULL AS VARCHAR) AS encryption_key,
 CAST(0.1 AS DOUBLE) AS delay_variance, 5 AS burst_size, CAST(2.0 AS DOUBLE) AS burst_delay, false AS domain_rotation, '' AS backup_domains,
 true AS subdomain_randomization, false AS padding, 10 AS padding_size, 3 AS max_retries, CAST(1.0 AS DOUBLE) AS retry_delay,
 CAST(5.0 AS DOUBLE) AS timeout FROM conf""")
def scenario_defaults(spark, folder):
    """All twenty settings of each scenario, defaults filled in."""
    parsed = config.parse_scenarios(a.supplier_scenarios(spark, folder))
    values = {name: F.col(f"config.{name}") for name, _, _ in SCENARIO_FIELDS}
    values["backup_domains"] = F.array_join(values["backup_domains"], ",")
    return parsed.select("scenario", *[value.alias(name) for name, value in values.items()])


@query("scenario_violations", f"""WITH {q.SCENARIO_SETTINGS} SELECT s_name AS scenario, array_to_string([x FOR x IN [
 CASE WHEN doh_server IS NULL THEN 'missing doh_server' END, CASE WHEN chunk_size IS NULL THEN 'missing chunk_size' END,
 CASE WHEN encoding = 'base91' THEN 'invalid encoding' END, CASE WHEN timing_pattern = 'never' THEN 'invalid timing_pattern' END] IF x IS NOT NULL], '; ') AS violations FROM conf""")
def scenario_violations(spark, folder):
    checked = config.validate_scenarios(a.supplier_scenarios(spark, folder))
    return checked.select("scenario", F.array_join("violations", "; ").alias("violations"))


@query("scenario_report", f"""WITH {q.SCENARIO_SUMS} SELECT scenario, model, round(rate, 6) AS rate, n_nationkey AS chunk_size FROM chosen JOIN nation ON n_name = scenario""")
def scenario_report(spark, folder):
    nations = a.table(spark, folder, "nation")
    text = F.concat(F.lit('{"name": "n", "exfiltration_config": {"chunk_size": '), F.col("n_nationkey"), F.lit("}}"))
    files = nations.select(F.concat(F.lit("s/"), F.col("n_name"), F.lit(".json")).alias("path"), text.alias("value"))
    rates = campaign.scenario_rates(a.supplier_summaries(spark, folder))
    joined = campaign.with_scenarios(rates, config.parse_scenarios(files))
    return joined.select("scenario", "model", F.round("rate", 6).alias("rate"), "chunk_size")


# ---- sampling

ORDER_LABEL_SQL = """ol AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Malicious' ELSE 'Benign' END AS Label FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY Label) AS n FROM ol)"""


def order_labels(spark, folder) -> DataFrame:
    orders = a.table(spark, folder, "orders")
    return orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Malicious").otherwise("Benign").alias("Label"))


@query("stratified_cap", f"WITH {ORDER_LABEL_SQL} SELECT o_orderkey, Label FROM rk WHERE (SELECT count(*) FROM ol) <= 10000 OR r <= 10000 // 2")
def stratified_cap(spark, folder):
    return sampling.stratified_cap(order_labels(spark, folder), "Label", ["o_orderkey"])


@query("stratified_split", f"""WITH {ORDER_LABEL_SQL}, b AS (SELECT *, ceil(n * 0.2::DOUBLE) AS nt, ceil((n - ceil(n * 0.2::DOUBLE)) * 0.25::DOUBLE) AS nv FROM rk)
 SELECT o_orderkey, Label, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + nv THEN 'validation' ELSE 'train' END AS split FROM b""")
def stratified_split(spark, folder):
    return sampling.stratified_split(order_labels(spark, folder), "Label", ["o_orderkey"])


@query("plain_split", "SELECT o_orderkey, CASE WHEN CAST('0x' || md5('42|' || o_orderkey)[1:8] AS BIGINT) / 4294967296.0 < 0.3::DOUBLE THEN 'test' ELSE 'train' END AS split FROM orders")
def plain_split(spark, folder):
    return sampling.plain_split(order_labels(spark, folder), ["o_orderkey"]).select("o_orderkey", "split")


@query("undersample", f"WITH {ORDER_LABEL_SQL} SELECT o_orderkey, Label FROM rk WHERE r <= 2 * (SELECT min(n) FROM rk)")
def undersample(spark, folder):
    return sampling.undersample(order_labels(spark, folder), "Label", ["o_orderkey"])


@query("class_weights", f"WITH {ORDER_LABEL_SQL} SELECT Label, count(*) AS n, round((SELECT count(*) FROM ol) / (2.0 * count(*)), 6) AS weight FROM ol GROUP BY Label")
def class_weights(spark, folder):
    return sampling.class_weights(order_labels(spark, folder), "Label").withColumn("weight", F.round("weight", 6))
