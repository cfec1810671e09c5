"""Column names and Spark types of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The statistics every measured quantity of a flow carries, in table order.
STATISTICS = [
    "Variance", "StandardDeviation", "Mean", "Median", "Mode",
    "SkewFromMedian", "SkewFromMode", "CoefficientofVariation",
]
MEASURES = ["PacketLength", "PacketTime", "ResponseTimeTime"]

ENDPOINT_COLUMNS = ["SourceIP", "DestinationIP"]
PORT_COLUMNS = ["SourcePort", "DestinationPort"]
VOLUME_COLUMNS = ["Duration", "FlowBytesSent", "FlowSentRate", "FlowBytesReceived", "FlowReceivedRate"]
STATISTIC_COLUMNS = [measure + statistic for measure in MEASURES for statistic in STATISTICS]

FEATURES = PORT_COLUMNS + VOLUME_COLUMNS + STATISTIC_COLUMNS
FLOW_COLUMNS = ENDPOINT_COLUMNS + PORT_COLUMNS + ["TimeStamp"] + VOLUME_COLUMNS + STATISTIC_COLUMNS + ["DoH"]
LABEL = "Label"

PACKETS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("length", T.LongType()),
    T.StructField("seq", T.LongType()),
])

DNS_QUERIES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("qname", T.StringType()),
    T.StructField("seq", T.LongType()),
])

DOH_REQUESTS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
])

# The fields of a scenario's configuration with the default of each.
SCENARIO_FIELDS = [
    ("doh_server", "string", "https://doh.local/dns-query"),
    ("target_domain", "string", "exfill.local"),
    ("chunk_size", "int", 30),
    ("encoding", "string", "base64"),
    ("compression", "boolean", False),
    ("encryption", "boolean", False),
    ("encryption_key", "string", None),
    ("timing_pattern", "string", "regular"),
    ("base_delay", "double", 0.2),
    ("delay_variance", "double", 0.1),
    ("burst_size", "int", 5),
    ("burst_delay", "double", 2.0),
    ("domain_rotation", "boolean", False),
    ("backup_domains", "array<string>", []),
    ("subdomain_randomization", "boolean", True),
    ("padding", "boolean", False),
    ("padding_size", "int", 10),
    ("max_retries", "int", 3),
    ("retry_delay", "double", 1.0),
    ("timeout", "double", 5.0),
]
SCENARIO_CONFIG_DDL = "struct<" + ",".join(f"{name}:{kind}" for name, kind, _ in SCENARIO_FIELDS) + ">"
SCENARIO_DDL = (
    "name string, description string, notes string, test_files array<string>, "
    f"exfiltration_config {SCENARIO_CONFIG_DDL}"
)
