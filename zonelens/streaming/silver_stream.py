"""Incremental bronze -> silver with Structured Streaming.

Each micro-batch of arrived objects goes through the batch path: tenant, event
time, flattening, deduplication, then an append of the rows that the silver table
does not hold yet (same tenant, day and content hash), and of the rejects. So
objects may arrive in any order, late or twice, and rows without a readable
time are kept (without a day), as in the batch path: nothing is dropped and
no state is kept between batches. The stream's progress is a checkpoint under the
shared ``spark.checkpoint.dir``; a batch that is run again appends nothing new.
With ``answered_path`` each batch also appends which stored questions it answers, or
finds answered (``jobs.append_answered``): the stored tables are the state, so a reply may come
before its question, or days later. ``jobs.read_answered`` reads both tables.
``availableNow`` processes what has arrived and stops, which suits per-object
arrival; a processing-time trigger keeps it running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from zonelens.plans import jobs
from zonelens.session import cut_lineage, ensure_checkpoint_dir
from zonelens.sources import lake
from zonelens.sources.bronze import BRONZE_SCHEMA, CORRUPT_COL


def bronze_stream(spark: SparkSession, bronze_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Bronze lines as they arrive, from nested object keys too, with ``source_file`` and the text of malformed lines."""
    stream = (
        spark.readStream.schema(T.StructType([*BRONZE_SCHEMA.fields, T.StructField(CORRUPT_COL, T.StringType())]))
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", "true")
        .option("columnNameOfCorruptRecord", CORRUPT_COL)
        .json(bronze_dir)
    )
    return stream.withColumn("source_file", F.col("_metadata.file_path"))


def start_silver_stream(
    spark: SparkSession,
    bronze_dir: str,
    silver_path: str,
    query_name: str = "silver",
    tenant: str | None = None,
    available_now: bool = True,
    processing_time: str = "1 minute",
    max_files_per_trigger: int = 1000,
    reject_path: str | None = None,
    answered_path: str | None = None,
    answer_seconds: float = jobs.ANSWER_SECONDS,
    **key_opts,
) -> StreamingQuery:
    """Append arriving messages to the partitioned silver table; without ``tenant`` it comes from the object keys."""
    checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{query_name}"
    rejected = reject_path or f"{silver_path.rstrip('/')}_rejects"

    def append(batch: DataFrame, _: int) -> None:
        jobs.split_rejects(batch)[1].write.mode("append").json(rejected)
        silver = jobs.bronze_to_silver(batch, tenant, **key_opts)
        if answered_path:
            silver = cut_lineage(silver)
        lake.append_new(batch.sparkSession, silver, silver_path)
        if answered_path:
            jobs.append_answered(batch.sparkSession, silver, silver_path, answered_path, answer_seconds)

    writer = bronze_stream(spark, bronze_dir, max_files_per_trigger).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
