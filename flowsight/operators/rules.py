"""Rule-based detection: threshold flags and weighted rules, as column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from flowsight.functions.numeric import is_true, ratio_or

# Limits on payload bytes per packet, packets per second and bytes per second.
PAYLOAD_LIMIT, FREQUENCY_LIMIT, VOLUME_LIMIT = 200, 100, 7500

OPERATORS = {
    ">": lambda value, limit: is_true(value > limit),
    "<": lambda value, limit: is_true(value < limit),
    ">=": lambda value, limit: is_true(value >= limit),
    "<=": lambda value, limit: is_true(value <= limit),
    "==": lambda value, limit: is_true(value == limit),
    # A missing value differs from every limit.
    "!=": lambda value, limit: F.coalesce(value != limit, F.lit(True)),
}


@dataclass(frozen=True)
class Rule:
    feature: str
    op: str
    value: float
    weight: float = 1.0


@dataclass(frozen=True)
class RuleModel:
    rules: list[Rule] = field(default_factory=list)
    aggregation: str = "sum"
    clip: tuple[float, float] = (0.0, 1.0)
    bias: float = 0.0
    name: str = "rules"

    @classmethod
    def from_json(cls, text: str) -> "RuleModel":
        config = json.loads(text)
        rules = [
            Rule(r["feature"], r["op"], float(r["value"]), float(r.get("weight", 1.0)))
            for r in config.get("rules", [])
        ]
        low, high = config.get("clip", (0.0, 1.0))
        return cls(
            rules, config.get("aggregation", "sum").lower(), (float(low), float(high)),
            float(config.get("bias", 0.0)),
        )

    def to_json(self) -> str:
        rules = [{"feature": r.feature, "op": r.op, "value": r.value, "weight": r.weight} for r in self.rules]
        return json.dumps({"rules": rules, "aggregation": self.aggregation, "clip": list(self.clip), "bias": self.bias})

    def on(self, prefix: str) -> "RuleModel":
        """The same model over columns with a prefix."""
        moved = [Rule(prefix + r.feature, r.op, r.value, r.weight) for r in self.rules]
        return RuleModel(moved, self.aggregation, self.clip, self.bias, self.name)

    def missing_features(self, df: DataFrame) -> list[str]:
        return sorted({r.feature for r in self.rules} - set(df.columns))

    def score(self) -> Column:
        total = F.lit(0.0)
        for rule in self.rules:
            test = OPERATORS.get(rule.op)
            if test is not None:
                hit = test(F.col(rule.feature), F.lit(rule.value))
                total = total + F.when(hit, F.lit(rule.weight)).otherwise(F.lit(0.0))
        if self.aggregation == "mean" and self.rules:
            total = total / F.lit(float(len(self.rules)))
        low, high = self.clip
        return F.greatest(F.lit(low), F.least(F.lit(high), total + F.lit(self.bias)))


    def predict(self, df: DataFrame, identity: str = "flow_id") -> DataFrame:
        """(identity, model, p) under the model's name, as every detector gives it."""
        return rule_score(df, self).select(identity, F.lit(self.name).alias("model"), "p")


# The standard rule model.
STANDARD_RULES = RuleModel([
    Rule("PacketLengthMean", ">", 400.0, 0.6),
    Rule("PacketTimeVariance", "<", 0.001, 0.5),
    Rule("FlowReceivedRate", ">", 20000.0, 0.4),
])


def rule_score(df: DataFrame, model: RuleModel = STANDARD_RULES, name: str = "p") -> DataFrame:
    missing = model.missing_features(df)
    if missing:
        raise ValueError(f"rule features not in the table: {', '.join(missing)}")
    return df.withColumn(name, model.score())


def rate_features(flows: DataFrame) -> DataFrame:
    """Three features from flow records: sent bytes per second and per median packet time, and the sent rate."""
    return flows.withColumns({
        "avg_packet_size": F.try_divide(F.col("FlowBytesSent").cast("double"), F.col("Duration")),
        "frequency": F.try_divide(F.col("FlowBytesSent").cast("double"), F.col("PacketTimeMedian")),
        "volume_rate": F.col("FlowSentRate"),
    })


def stat_features(flows: DataFrame) -> DataFrame:
    """Three features from flow records: mean length, estimated packets per second, bytes per second."""
    size, sent, duration = F.col("PacketLengthMean"), F.col("FlowBytesSent").cast("double"), F.col("Duration")
    return flows.withColumns({
        "avg_packet_size": size,
        "frequency": ratio_or(ratio_or(sent, size, 0.0), duration, 0.0),
        "volume_rate": ratio_or(sent, duration, 0.0),
    })


def sequence_features(sequences: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Three features per packet sequence (pos, ts, size); first and last packet are by position."""
    span = F.max_by("ts", "pos") - F.min_by("ts", "pos")
    grouped = sequences.groupBy(*keys).agg(
        F.count("pos").alias("packets"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("bytes"), span.alias("span"),
    )
    duration = F.when(F.col("span") > 0, F.col("span")).otherwise(F.lit(1.0))
    return grouped.select(
        *keys, "packets", "bytes",
        ratio_or(F.col("bytes"), F.col("packets"), 0.0).alias("avg_packet_size"),
        (F.col("packets") / duration).alias("frequency"),
        (F.col("bytes") / duration).alias("volume_rate"),
    )


def exceeded(payload: float, frequency: float, volume: float) -> dict[str, Column]:
    return {
        "avg_packet_size": is_true(F.col("avg_packet_size") > payload),
        "frequency": is_true(F.col("frequency") > frequency),
        "volume_rate": is_true(F.col("volume_rate") > volume),
    }


def threshold_flag(
    df: DataFrame,
    payload: float = PAYLOAD_LIMIT,
    frequency: float = FREQUENCY_LIMIT,
    volume: float = VOLUME_LIMIT,
    name: str = "flagged",
) -> DataFrame:
    """Flag rows where any of the three features exceeds its limit."""
    size, rate, bytes_rate = exceeded(payload, frequency, volume).values()
    return df.withColumn(name, size | rate | bytes_rate)


def explain(
    df: DataFrame,
    payload: float = PAYLOAD_LIMIT,
    frequency: float = FREQUENCY_LIMIT,
    volume: float = VOLUME_LIMIT,
) -> DataFrame:
    """Add the names of the limits each row exceeds, comma-separated."""
    hits = exceeded(payload, frequency, volume)
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]))
    return df.withColumn("exceeded", F.array_join(reasons, ","))


def false_positives(
    df: DataFrame,
    payload: float = PAYLOAD_LIMIT,
    frequency: float = FREQUENCY_LIMIT,
    volume: float = VOLUME_LIMIT,
) -> DataFrame:
    """Benign rows (label 0) the limits flag, with the reasons."""
    flagged = threshold_flag(df, payload, frequency, volume).where((F.col("label") == 0) & F.col("flagged"))
    return explain(flagged, payload, frequency, volume)


def sequence_report(sequences: DataFrame) -> DataFrame:
    """One row per file of packet sequences: features rounded to two digits, and whether it is suspicious.

    The verdict uses unrounded features. A file without a sequence keeps its error and has no features.
    """
    keys = ("file", "src_ip", "dst_ip", "error")
    flagged = threshold_flag(sequence_features(sequences, keys), name="suspicious")
    readable = F.col("error").isNull()
    shown = lambda column, name: F.when(readable, F.round(column, 2)).alias(name)
    return flagged.select(
        "file", F.when(readable, F.col("src_ip")).alias("src_ip"), F.when(readable, F.col("dst_ip")).alias("dst_ip"),
        shown("avg_packet_size", "avg_payload"), shown("frequency", "freq_pps"), shown("volume_rate", "volume_bps"),
        F.when(readable, F.col("suspicious")).alias("suspicious"), "error",
    )
