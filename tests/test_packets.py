"""Decoded-packet classification on hand-made packets."""

from pyspark.sql import functions as F

from zonelens.operators import packets as P
from zonelens.sources.dims import services

SCHEMA = ("epoch double, src_ip string, dst_ip string, proto int, ihl int, packet_size int, "
          "src_port int, dst_port int, tcp_flags string, payload binary")


def pk(proto, sport, dport, payload=b"", flags=None):
    return (1767225600.0, "10.0.0.1", "10.0.0.2", proto, 5, 60, sport, dport, flags, bytearray(payload))


def test_classification(spark):
    rows = [
        pk(17, 5353, 53, b"dnsq"),  # DNS over UDP
        pk(6, 40000, 53, b"GET / HTTP/1.1", "PA"),  # DNS over TCP wins over HTTP
        pk(6, 40000, 80, b"GET /index.html HTTP/1.1", "PA"),
        pk(6, 80, 40000, b"HTTP/1.1 200 OK", "PA"),
        pk(6, 40000, 443, b"\x16\x03\x01", "PA"),  # other TCP
        pk(47, None, None, b""),  # unknown protocol number
        pk(6, 0, 1024, b"", "S"),  # ports 0 and 1024: no service
        pk(None, None, None, b""),  # not IP: left out
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = P.classify_packets(df, services(spark)).collect()
    assert len(out) == 7
    by = [(r.ip_protocol, r.src_port, r.dst_port, r.packet_class, r.type, r.method, r.path, r.status_code,
           r.src_service, r.dst_service, r.ip_header_length) for r in out]
    assert ("UDP", 5353, 53, "dns", "other", None, None, None, None, "domain", 20) in by
    assert ("TCP", 40000, 53, "dns", "other", None, None, None, None, "domain", 20) in by
    assert ("TCP", 40000, 80, "http", "request", "GET", "/index.html", None, None, "http", 20) in by
    assert ("TCP", 80, 40000, "http", "response", None, None, "200", "http", None, 20) in by
    assert ("TCP", 40000, 443, "other", "other", None, None, None, None, "https", 20) in by
    assert ("47", None, None, "other", "other", None, None, None, None, None, 20) in by
    assert ("TCP", 0, 1024, "other", "other", None, None, None, None, None, 20) in by
    assert {r.timestamp for r in out} == {"2026-01-01T00:00:00"}
    counts = {r.packet_class: r.packets for r in P.class_counts(P.classify_packets(df, services(spark))).collect()}
    assert counts == {"dns": 2, "http": 2, "other": 3}


def test_write_by_class_appends(spark, tmp_dir):
    rows = [pk(17, 5353, 53), pk(6, 40000, 80, b"GET / HTTP/1.1", "PA"), pk(1, None, None)]
    classified = P.classify_packets(spark.createDataFrame(rows, SCHEMA), services(spark))
    out = f"{tmp_dir}/by_class"
    P.write_by_class(classified, out)
    P.write_by_class(classified, out)  # a second run appends; files stay valid
    back = spark.read.parquet(out)
    assert {r.packet_class: r.n for r in back.groupBy("packet_class").count().withColumnRenamed("count", "n").collect()} == {
        "dns": 2, "http": 2, "other": 2}


def test_services_from_text(spark, tmp_dir):
    from zonelens.sources.dims import services_from_text

    path = f"{tmp_dir}/services"
    with open(path, "w") as fh:
        fh.write("# comment\nhttp 80/tcp www # web\nhttp-alt 80/tcp\ndomain 53/udp\n\nbad line\n")
    got = {(r.proto, r.port): r.service for r in services_from_text(spark, path).collect()}
    assert got == {("tcp", 80): "http", ("udp", 53): "domain"}


def test_bytes_that_are_no_text(spark):
    """Binary bodies and names do not fail the job; bytes that are no UTF-8 are left out."""
    rows = [
        pk(6, 80, 50000, b"HTTP/1.1 200 OK\r\n\r\n\xff\xd8\xff\xe0\x00\x10"),
        pk(6, 50000, 80, b"GET /a\xffb HTTP/1.1\r\n\r\n\xff"),
        pk(6, 50000, 443, b"\x16\x03\x01\xff\xfe"),
    ]
    got = P.classify_packets(spark.createDataFrame(rows, SCHEMA), services(spark)).collect()
    assert [(r.type, r.method, r.path, r.status_code) for r in got] == [
        ("response", None, None, "200"), ("request", "GET", "/ab", None), ("other", None, None, None),
    ]
    data = spark.createDataFrame([(16, bytearray(b"v=\xffspf1")), (5, bytearray(b"\xc3\xa9.com")), (1, None)], "rtype int, rdata binary")
    assert [r.t for r in data.select(P.render_rdata(F.col("rtype"), F.col("rdata")).alias("t")).collect()] == ["v=spf1", "é.com", None]
