"""Which packets are of interest, and counters over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowsight.functions.names import KEYWORDS, is_suspicious

# Captured ports, and the destination ports read as HTTP.
CAPTURE_PORTS = (53, 443, 8080)
HTTP_PORTS = (443, 8080)
DNS_PORT = 53


def captured(src_port: str = "src_port", dst_port: str = "dst_port") -> Column:
    return F.col(src_port).isin(*CAPTURE_PORTS) | F.col(dst_port).isin(*CAPTURE_PORTS)


def protocol_class(src_port: str = "src_port", dst_port: str = "dst_port", protocol: str | None = None) -> Column:
    """dns, http or other; DNS wins. HTTP runs over TCP, DNS over UDP or TCP, as far as a column names the protocol."""
    dns = (F.col(src_port) == DNS_PORT) | (F.col(dst_port) == DNS_PORT)
    http = F.col(dst_port).isin(*HTTP_PORTS)
    if protocol is not None:
        name = F.upper(F.trim(protocol))
        dns, http = dns & F.coalesce(name.isin("UDP", "TCP"), F.lit(True)), http & F.coalesce(name == "TCP", F.lit(True))
    return F.when(dns, "dns").when(http, "http").otherwise("other")


def classify_packets(packets: DataFrame) -> DataFrame:
    """Captured packets with proto_class; a column protocol (UDP, TCP, ...; NULL: not known) is heeded if there is one."""
    protocol = "protocol" if "protocol" in packets.columns else None
    return packets.where(captured()).withColumn("proto_class", protocol_class(protocol=protocol))


def counters(packets: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Total, DNS and HTTP packets, suspicious names among them (a qname column, if there), and uptime."""
    seen = F.lit(0).cast("bigint")
    if "qname" in packets.columns:
        seen = F.count_if(F.coalesce(is_suspicious(F.col("qname"), KEYWORDS), F.lit(False)))
    counts = classify_packets(packets).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.count_if(F.col("proto_class") == "dns").alias("dns_packets"),
        F.count_if(F.col("proto_class") == "http").alias("http_packets"),
        seen.alias("detected"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6))
        .alias("uptime"),
    )
    rate = F.col("detected") / F.greatest(F.col("dns_packets"), F.lit(1)) * F.lit(100.0)
    return counts.withColumn("detection_rate", rate)
