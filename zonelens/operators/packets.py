"""Decoded-packet operators: DNS predicate, protocol and service names, class
(http / dns / other), HTTP first-line fields, header length, ISO time, fan-out.

Input is a decoded packet table (epoch, src_ip, dst_ip, proto, ihl,
packet_size, src_port, dst_port, tcp_flags, payload); byte-level decoding of
captures is out of scope. Everything is a narrow projection except the service
lookup, a left broadcast join against a bounded (port, proto) dimension, and
the per-class counts, a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.config import IP_PROTOCOL_NAMES
from zonelens.functions.timefmt import epoch_to_iso
from zonelens.operators.joins import bounded_broadcast

MAX_SERVICE_ROWS = 200_000
DNS_PORT = 53


def protocol_name(proto: Column) -> Column:
    """IANA protocol number -> name; unknown numbers print as the number."""
    expr = None
    for num, name in IP_PROTOCOL_NAMES.items():
        expr = F.when(proto == num, F.lit(name)) if expr is None else expr.when(proto == num, F.lit(name))
    return expr.otherwise(proto.cast("string"))


def is_dns_packet(proto_name: Column, sport: Column, dport: Column, include_tcp: bool = False) -> Column:
    """UDP (and TCP when asked) with source or destination port 53."""
    protos = ["UDP", "TCP"] if include_tcp else ["UDP"]
    return F.coalesce(proto_name.isin(*protos) & ((sport == DNS_PORT) | (dport == DNS_PORT)), F.lit(False))


def lenient_text(data: Column) -> Column:
    """Bytes as text; those that are not UTF-8 are left out (with any replacement characters)."""
    return F.translate(F.make_valid_utf8(data.cast("string")), "\ufffd", "")


def _starts(payload: Column, prefix: bytes) -> Column:
    return F.substring(payload, 1, len(prefix)) == F.lit(bytearray(prefix))


def add_services(df: DataFrame, services: DataFrame) -> DataFrame:
    """P5: src_service / dst_service for TCP and UDP ports 1..1023 from the services dimension."""
    # Beyond the bound the lookup is an ordinary (shuffle) join.
    dim, _ = bounded_broadcast(services.select("proto", "port", "service"), MAX_SERVICE_ROWS)
    proto_l = F.lower(F.col("ip_protocol"))
    out = df
    for side in ("src", "dst"):
        d = dim.select(
            F.col("proto").alias(f"__{side}_p"), F.col("port").alias(f"__{side}_port"), F.col("service").alias(f"{side}_service")
        )
        port = F.col(f"{side}_port")
        cond = (
            (proto_l == d[f"__{side}_p"]) & (port == d[f"__{side}_port"]) & (port > 0) & (port <= 1023)
        )
        out = out.join(d, cond, "left").drop(f"__{side}_p", f"__{side}_port")
    return out


def classify_packets(packets: DataFrame, services: DataFrame) -> DataFrame:
    """One row per IP packet with names, class and HTTP fields.

    packet_class: ``dns`` (TCP or UDP on port 53) wins, then ``http`` (TCP with
    a payload starting GET, POST or HTTP), else ``other``; ``type`` is
    request/response for http and "other" for the rest. Non-IP rows (NULL
    protocol) are left out.
    """
    p = packets.where(F.col("proto").isNotNull())
    name = protocol_name(F.col("proto"))
    tcp, udp = name == "TCP", name == "UDP"
    payload = F.col("payload")
    is_req = _starts(payload, b"GET") | _starts(payload, b"POST")
    is_resp = _starts(payload, b"HTTP")
    dns = is_dns_packet(name, F.col("src_port"), F.col("dst_port"), include_tcp=True)
    http = tcp & F.coalesce(is_req | is_resp, F.lit(False))
    # Only the text up to the second blank is read: the first line's method or version, and path or status.
    words = F.split(lenient_text(F.substring_index(payload.cast("string"), " ", 2)), " ")
    out = p.select(
        epoch_to_iso(F.col("epoch")).alias("timestamp"),
        "src_ip",
        "dst_ip",
        name.alias("ip_protocol"),
        (F.col("ihl") * 4).alias("ip_header_length"),
        "packet_size",
        F.when(tcp | udp, F.col("src_port")).alias("src_port"),
        F.when(tcp | udp, F.col("dst_port")).alias("dst_port"),
        F.when(tcp, F.col("tcp_flags")).alias("tcp_flags"),
        F.when(dns, F.lit("dns")).when(http, F.lit("http")).otherwise(F.lit("other")).alias("packet_class"),
        F.when(~dns & http, F.when(is_req, F.lit("request")).otherwise(F.lit("response")))
        .otherwise(F.lit("other"))
        .alias("type"),
        F.when(~dns & http & is_req, F.try_element_at(words, F.lit(1))).alias("method"),
        F.when(~dns & http & is_req, F.try_element_at(words, F.lit(2))).alias("path"),
        F.when(~dns & http & ~is_req & is_resp, F.try_element_at(words, F.lit(2))).alias("status_code"),
    )
    return add_services(out, services)


def class_counts(classified: DataFrame) -> DataFrame:
    """P10: packets per class."""
    return classified.groupBy("packet_class").agg(F.count(F.lit(1)).alias("packets"))


def write_by_class(classified: DataFrame, path: str, fmt: str = "parquet") -> None:
    """P10: one output per class, appended run after run (partitioned files, never one JSON array)."""
    classified.write.mode("append").partitionBy("packet_class").format(fmt).save(path)


def render_rdata(rtype: Column, rdata: Column, txt_chunks: Column | None = None) -> Column:
    """Answer data as text by record type.

    A (1) / AAAA (28): the address as is; NS (2) / CNAME (5) / PTR (12): the
    name as UTF-8; TXT (16): the character-strings joined, then read; any other
    type: the data as text. ``rdata`` may be binary or text; bytes that are not
    UTF-8 are left out.
    """
    as_text = lenient_text(rdata.cast("binary"))
    if txt_chunks is None:
        return as_text
    joined = F.aggregate(txt_chunks, F.lit(bytearray(b"")), lambda acc, x: F.concat(acc, x))
    # Addresses and names are already text; only TXT joins its chunks first.
    return F.when((rtype == 16) & txt_chunks.isNotNull(), lenient_text(joined)).otherwise(as_text)
