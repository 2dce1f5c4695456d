"""Tables derived from the driver's ``events`` for operators whose natural input
is not in the test data: decoded packets (P*) and capture object keys (S7).

Every row comes from one ``events`` row, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.sources.tables import read_table


def _not_utf8() -> Column:
    return F.unhex(F.lit("FFD8FF"))


def derived_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded packets: UDP/TCP/ICMP/unknown protocols, DNS, HTTP request and response
    payloads, ports 0 and 1024, and some non-IP rows (NULL protocol)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid, et = F.col("event_id"), F.col("event_type")
    proto = (
        F.when(eid % 41 == 0, F.lit(None).cast("int"))
        .when(et == "click", 17)
        .when(et.isin("view", "signup"), 6)
        .when(et == "purchase", 1)
        .when(eid % 2 == 0, 47)
        .otherwise(89)
    )
    eph = (F.lit(1024) + eid % 50000).cast("int")
    udp_s = F.when(eid % 3 == 0, eph).when(eid % 3 == 1, F.lit(53)).otherwise(F.lit(5353))
    udp_d = F.when(eid % 3 == 0, F.lit(53)).when(eid % 3 == 1, eph).otherwise(F.lit(123))
    tcp_s = F.when(eid % 37 == 0, F.lit(0)).when(eid % 4 == 1, F.lit(80)).otherwise(eph)
    tcp_d = (
        F.when(eid % 4 == 0, F.lit(80))
        .when(eid % 4 == 1, eph)
        .when(eid % 4 == 2, F.lit(53))
        .when(eid % 5 == 0, F.lit(1024))
        .otherwise(F.lit(443))
    )
    path = F.concat(F.lit("/p/"), (eid % 1000).cast("string"))
    tcp_payload = (
        F.when((eid % 4 == 0) & (eid % 8 == 0), F.concat(F.lit("POST "), path, F.lit(" HTTP/1.1")))
        .when(eid % 4 == 0, F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1")))
        .when((eid % 4 == 1) & (eid % 3 == 0), F.lit("HTTP/1.1 404 Not Found"))
        .when(eid % 4 == 1, F.lit("HTTP/1.1 200 OK"))
        .otherwise(F.concat(F.lit("\u0016\u0003\u0001 tls "), eid.cast("string")))
    )
    with_proto = ev.withColumn("proto", proto)
    p = F.col("proto")
    return with_proto.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("epoch"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.1."), (eid % 256).cast("string")).alias("dst_ip"),
        p.alias("proto"),
        (F.lit(5) + eid % 3).cast("int").alias("ihl"),
        (F.lit(40) + F.floor(F.abs(F.col("value"))).cast("int") % 1400).cast("int").alias("packet_size"),
        F.when(p == 17, udp_s).when(p == 6, tcp_s).cast("int").alias("src_port"),
        F.when(p == 17, udp_d).when(p == 6, tcp_d).cast("int").alias("dst_port"),
        F.when(p == 6, F.when(eid % 2 == 0, F.lit("PA")).otherwise(F.lit("S"))).alias("tcp_flags"),
        # Bodies and some paths hold bytes that are no UTF-8 (0xFF), as images and handshakes do.
        F.concat(
            F.encode(F.when(p == 6, F.when(eid % 12 == 0, F.lit("GET /")).otherwise(F.lit(""))).otherwise(F.lit("")), "UTF-8"),
            F.when((p == 6) & (eid % 12 == 0), _not_utf8()).otherwise(F.lit(bytearray(b""))),
            F.encode(
                F.when(p == 6, F.when(eid % 12 == 0, F.substring(path, 2, 9)).otherwise(tcp_payload))
                .when(p == 17, F.concat(F.lit("dns-"), eid.cast("string")))
                .otherwise(F.lit("")),
                "UTF-8",
            ),
            F.when((p == 6) & (eid % 12 == 0), F.encode(F.lit(" HTTP/1.1"), "UTF-8")).otherwise(F.lit(bytearray(b""))),
            F.when(p == 6, F.concat(F.encode(F.lit("\r\n\r\n"), "UTF-8"), _not_utf8())).otherwise(F.lit(bytearray(b""))),
        ).alias("payload"),
    )


def derived_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture object keys: plain, upper-case extension, no known ending, URL-encoded,
    stray percent sign, leading slash, and tenant-only keys (to be rejected)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    eid = F.col("event_id")
    tenant = F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string"))
    e = eid.cast("string")
    name = (
        F.when(eid % 6 == 0, F.concat(F.lit("capture+"), e, F.lit(".pcap")))
        .when(eid % 6 == 1, F.concat(F.lit("cap%20"), e, F.lit(".PCAPNG")))
        .when(eid % 12 == 2, F.concat(F.lit("100%/file"), e))
        .when(eid % 6 == 2, F.concat(F.lit("file"), e))
        .when(eid % 6 == 3, F.concat(F.lit("f"), e, F.lit(".pcap.bak")))
        .when(eid % 6 == 4, F.concat(F.lit("x_"), e, F.lit(".Pcap")))
        .otherwise(F.concat(F.lit("a%2Fb"), e, F.lit(".pcapng")))
    )
    lead = F.when(eid % 10 == 0, F.lit("/")).otherwise(F.lit(""))
    full = F.concat(lead, tenant, F.lit("/pcaps/"), F.col("ts").cast("date").cast("string"), F.lit("/"), name)
    key = F.when(eid % 53 == 0, F.concat(tenant, F.lit("/"))).otherwise(full)
    return ev.select(key.alias("object_key"))


def derived_answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded answer records (rtype, rdata bytes, TXT chunks) for every ``events`` row:
    A, AAAA, CNAME, PTR, TXT (two chunks) and MX (an unrendered type)."""
    from zonelens.sources.tables import dns_standin

    s = dns_standin(spark, sf_dir, extra_event_cols=("event_id",))
    eid = F.col("event_id")
    k = eid % 6
    rtype = F.when(k == 0, 1).when(k == 1, 28).when(k == 2, 5).when(k == 3, 12).when(k == 4, 16).otherwise(15)
    text = (
        F.when(k == 0, F.concat(F.lit("192.0.2."), (eid % 256).cast("string")))
        .when(k == 1, F.concat(F.lit("2001:db8::"), F.lower(F.hex(eid % 65536))))
        .when(k.isin(2, 3), F.concat(F.lit("alias."), F.col("qname")))
        .when(k == 5, F.concat(F.lit("10 mail."), F.col("qname")))
    )
    chunks = F.when(
        k == 4, F.array(F.encode(F.lit("v=spf1 "), "UTF-8"), F.encode(F.concat(F.lit("include:"), F.col("qname")), "UTF-8"))
    )
    return s.select(
        "tenant",
        "id",
        F.col("qname").alias("rrname"),
        rtype.cast("int").alias("rtype"),
        # A quarter of the data holds a byte that is no UTF-8.
        F.concat(F.encode(text, "UTF-8"), F.when(eid % 4 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit(bytearray(b"")))).alias("rdata"),
        chunks.alias("txt_chunks"),
    )
