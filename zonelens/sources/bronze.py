"""Bronze DNS messages: explicit schema, JSON-lines reader/writer, and a bronze
table derived from the driver's tables for the registered queries.

The derived bronze is one message per ``events`` row (names from the DNS
stand-in): timestamps as ISO text or Unix-seconds text (some junk), queries
without questions, two-question messages, responses with 0-2 answers, replies
to a third of the queries, and a second copy of every message (some differing only in case and spacing), which
deduplication must remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelens.sources.tables import dns_standin

QUESTION = T.StructType(
    [
        T.StructField("qname", T.StringType()),
        T.StructField("qtype", T.IntegerType()),
        T.StructField("qclass", T.IntegerType()),
    ]
)
ANSWER = T.StructType(
    [
        T.StructField("rrname", T.StringType()),
        T.StructField("rtype", T.IntegerType()),
        T.StructField("rclass", T.IntegerType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("rdata", T.StringType()),
    ]
)
BRONZE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("qr", T.IntegerType()),
        T.StructField("opcode", T.IntegerType()),
        T.StructField("rcode", T.IntegerType()),
        T.StructField("qdcount", T.IntegerType()),
        T.StructField("ancount", T.IntegerType()),
        T.StructField("questions", T.ArrayType(QUESTION)),
        T.StructField("answers", T.ArrayType(ANSWER)),
    ]
)
CORRUPT_COL = "_corrupt_record"


def read_bronze(spark: SparkSession, path: str | list[str], keep_corrupt: bool = True) -> DataFrame:
    """Gzip JSON lines with the explicit schema (no inference pass).

    PERMISSIVE mode: a malformed line becomes a row with NULL fields and its
    text in ``_corrupt_record`` instead of failing the job. The source file is
    kept in ``source_file`` (tenant can be derived from it with S7).
    """
    schema = T.StructType(BRONZE_SCHEMA.fields + ([T.StructField(CORRUPT_COL, T.StringType())] if keep_corrupt else []))
    # Objects sit under arbitrary key paths (tenant/prefix/date/file), not partition folders.
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COL)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_bronze_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S1 for Parquet bronze: the same columns, cast to the bronze schema (nested types included)."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in BRONZE_SCHEMA.fields
    ]
    return df.select(*cols, F.col("_metadata.file_path").alias("source_file"))


def write_bronze(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write messages as gzip JSON lines (the parser's output format)."""
    df.select(*BRONZE_SCHEMA.fieldNames()).write.mode(mode).option("compression", "gzip").json(path)


def derived_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze messages (+ ``tenant``) derived from the DNS stand-in; see module docstring."""
    s = dns_standin(spark, sf_dir, extra_event_cols=("event_id",))
    # Every message arrives twice; some second copies differ in case and spacing only.
    eid_mod = F.col("event_id") % 11 == 0
    copies = s.withColumn("qname", F.when(eid_mod, F.concat(F.upper("qname"), F.lit(" "))).otherwise(F.col("qname")))
    # A third of the queries get a reply: from the server, one second later or (too late to count) ten.
    delay = F.when(F.col("event_id") % 9 == 0, 10).otherwise(1)
    replies = s.where((F.col("qr") == 0) & (F.col("event_id") % 3 == 0))
    replies = replies.withColumn("event_ts", F.timestamp_micros(F.unix_micros("event_ts") + delay * 1_000_000))
    none, yes = F.lit(False).alias("reply"), F.lit(True).alias("reply")
    s = s.select("*", none).unionByName(copies.select("*", none)).unionByName(replies.select("*", yes))
    eid, reply = F.col("event_id"), F.col("reply")
    micros = F.unix_micros("event_ts")
    epoch_text = F.concat(
        (micros / 1_000_000).cast("long").cast("string"),
        F.lit("."),
        F.lpad((micros % 1_000_000).cast("string"), 6, "0"),
    )
    ts_text = (
        F.when(eid % 499 == 0, F.lit("junk"))
        .when(eid % 5 == 0, epoch_text)
        .otherwise(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )
    q1 = F.struct(F.col("qname").alias("qname"), F.col("qtype").alias("qtype"), F.lit(1).alias("qclass"))
    q2 = F.struct(F.concat(F.lit("www."), F.col("qname")).alias("qname"), F.lit(1).alias("qtype"), F.lit(1).alias("qclass"))
    questions = (
        F.when(reply, F.array(q1))
        .when((F.col("qr") == 0) & (eid % 17 == 0), F.array().cast(T.ArrayType(QUESTION)))
        .when(eid % 23 == 0, F.array(q1, q2))
        .otherwise(F.array(q1))
    )

    def answer(k: int):
        return F.struct(
            F.col("qname").alias("rrname"),
            F.lit(1 if k == 1 else 5).alias("rtype"),
            F.lit(1).alias("rclass"),
            F.lit(300 * k).cast("long").alias("ttl"),
            (
                F.concat(F.lit("192.0.2."), (eid % 256).cast("string"))
                if k == 1
                else F.concat(F.lit("alias."), F.col("qname"))
            ).alias("rdata"),
        )

    n_answers = F.when(reply, F.lit(1)).when(F.col("qr") == 1, (eid % 3).cast("int")).otherwise(F.lit(0))
    server = F.concat(F.lit("10.0.1."), (eid % 4).cast("string"))
    answers = F.when(n_answers > 0, F.slice(F.array(answer(1), answer(2)), 1, n_answers)).otherwise(
        F.array().cast(T.ArrayType(ANSWER))
    )
    out = s.select(
        "tenant",
        ts_text.alias("timestamp"),
        F.when(reply, server).otherwise(F.col("src_ip")).alias("src_ip"),
        F.when(reply, F.col("src_ip")).otherwise(server).alias("dst_ip"),
        (F.lit(1024) + eid % 60000).cast("int").alias("src_port"),
        F.lit(53).alias("dst_port"),
        ((eid - F.col("qr")) % 65536).cast("int").alias("id"),
        F.when(reply, F.lit(1)).otherwise(F.col("qr")).alias("qr"),
        F.lit(0).alias("opcode"),
        "rcode",
        questions.alias("questions"),
        answers.alias("answers"),
    )
    return out.withColumns(
        {"qdcount": F.size("questions").cast("int"), "ancount": F.size("answers").cast("int")}
    ).select("tenant", *BRONZE_SCHEMA.fieldNames())
