"""Silver and gold Parquet layout: partitioned writes and pruned reads.

Layout: ``<root>/tenant=<t>/event_date=<d>[/<type>=<x>]/part-*.parquet``
(snappy). Silver is appended; gold overwrites only the partitions a run
produces (dynamic partition overwrite), so one tenant's rerun never deletes
another tenant's days.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.session import staged

PARTITION_KEYS = ("tenant", "event_date")
# Stands for a missing day in comparisons.
_NO_DAY = "0001-01-01"


def write_silver(df: DataFrame, path: str) -> None:
    """S3: append silver rows partitioned by (tenant, event_date).

    The rows are rebalanced by the keys first: small days share a task, and adaptive execution splits large
    ones, so no task holds a whole large tenant-day, yet a day gets as many files as its
    bytes ask for, not one from every task. Each task sorts its rows by the keys so it keeps one open file at a time.
    """
    (
        df.hint("rebalance", *map(F.col, PARTITION_KEYS))
        .sortWithinPartitions(*PARTITION_KEYS)
        .write.mode("append")
        .option("compression", "snappy")
        .partitionBy(*PARTITION_KEYS)
        .parquet(path)
    )


def _stored_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """(tenant, event_date, key) of the rows stored under ``path``; None where nothing is stored yet."""
    try:
        stored = spark.read.parquet(path).select(*PARTITION_KEYS, key)
    except Exception as exc:  # noqa: BLE001 - a missing table means nothing is stored yet
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise
    return stored.withColumn("event_date", F.col("event_date").cast("date"))


def without_existing(spark: SparkSession, new: DataFrame, path: str, key: str = "silver_dedupe_hash") -> DataFrame:
    """Rows of ``new`` whose (tenant, event_date, key) is not yet stored under ``path``.

    The days of the new rows (few, broadcast) are joined first, so dynamic
    partition pruning reads only the stored partitions that they touch, and only three
    columns of them; the content hash makes the keys unique (no skew) and comes first in the
    join, where sorts compare it first. ``new`` is read twice: see ``append_new``.
    """
    stored = _stored_keys(spark, path, key)
    if stored is None:
        return new
    # Pruning asks for a filter on the side that prunes; rows without a key equal no stored one.
    days = new.where(F.length(key) >= 0).select(*PARTITION_KEYS).distinct()
    already = stored.join(F.broadcast(days), same_partition(stored, days), "left_semi")
    return new.join(already, (new[key] == already[key]) & same_partition(new, already), "left_anti")


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str = "silver_dedupe_hash") -> None:
    """Append the rows of ``new`` that are not yet stored under ``path``; ``new`` is computed once."""
    if _stored_keys(spark, path, key) is None:
        write_silver(new, path)
        return
    with staged(new) as rows:
        write_silver(without_existing(spark, rows, path, key), path)


def write_gold(df: DataFrame, path: str, type_col: str | None = None) -> None:
    """S4 + S5: overwrite the produced (tenant, event_date[, type]) partitions only."""
    keys = [*PARTITION_KEYS, *([type_col] if type_col else [])]
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_partitioned(
    spark: SparkSession,
    path: str,
    tenant: str | None = None,
    start: str | _dt.date | None = None,
    end: str | _dt.date | None = None,
) -> DataFrame:
    """Read a partitioned table; tenant and date bounds become partition filters (pruned at listing)."""
    df = spark.read.option("basePath", path).parquet(path)
    if tenant is not None:
        df = df.where(F.col("tenant") == F.lit(tenant))
    if start is not None:
        df = df.where(F.col("event_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col("event_date") <= F.lit(str(end)).cast("date"))
    return df


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects under ``path`` (any depth): object, bytes, modified. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("object"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


LEDGER_SCHEMA = "object string, bytes long, modified timestamp"


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Objects that have been taken in, as they were then; none where the ledger is not there yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    except Exception as exc:  # noqa: BLE001 - a missing ledger means nothing has been taken in
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], LEDGER_SCHEMA)
        raise


def new_objects(spark: SparkSession, path: str, ledger_path: str) -> DataFrame:
    """Objects under ``path`` that the ledger does not hold with the same size and time."""
    return list_objects(spark, path).join(read_ledger(spark, ledger_path), ["object", "bytes", "modified"], "left_anti")


def partition_marks(spark: SparkSession, path: str) -> DataFrame:
    """What each (tenant, event_date) partition holds, from the listing alone: files, bytes, newest."""
    files = spark.read.format("binaryFile").option("basePath", path).load(path)
    size, newest = F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    marks = files.groupBy("tenant", F.col("event_date").cast("date").alias("event_date")).agg(F.count("*").alias("files"), size, newest)
    return marks.withColumn("tenant", F.col("tenant").cast("string"))


MARK_COLUMNS = ("files", "bytes", "newest")


def same_partition(a: DataFrame, b: DataFrame):
    """Same tenant and day; missing ones match each other. Plain equalities, so that partitions are pruned."""
    tenant = F.coalesce(a["tenant"], F.lit("")) == F.coalesce(b["tenant"], F.lit(""))
    return tenant & (F.coalesce(a["event_date"], F.lit(_NO_DAY).cast("date")) == F.coalesce(b["event_date"], F.lit(_NO_DAY).cast("date")))


def touched_partitions(spark: SparkSession, path: str, marks_path: str) -> DataFrame:
    """Partitions under ``path`` whose marks differ from those stored under ``marks_path`` (all, where none are
    stored): tenant, event_date and the present marks."""
    now = partition_marks(spark, path)
    try:
        schema = "files long, bytes long, newest timestamp, tenant string, event_date date"
        before = spark.read.schema(schema).parquet(marks_path)
    except Exception as exc:  # noqa: BLE001 - no marks yet
        if "PATH_NOT_FOUND" in str(exc):
            return now
        raise
    alike = [now[c] == before[c] for c in MARK_COLUMNS]
    return now.join(before, same_partition(now, before) & alike[0] & alike[1] & alike[2], "left_anti")


def read_gold_record(spark: SparkSession, path: str, tenant: str, event_date: str | _dt.date) -> DataFrame:
    """The gold record of one tenant-day, both partition keys filtered."""
    return read_partitioned(spark, path, tenant, event_date, event_date)
