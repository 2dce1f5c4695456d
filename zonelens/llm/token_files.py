"""Token ids as ORC files in ascending ``doc_id`` order, and reading them back.

Rows are dealt by ranges of ``doc_id`` and sorted inside a range, as text (a
third of the bytes of ids); ids are made after the shuffle and written at once. ORC
stores the ids with integer run-length encoding in stripes, each with row
indexes and a Bloom filter on ``doc_id``: readers take stripes in parallel and
skip those without a wanted document. ``part_start`` counts the ids before a
row in its own file, so positions in the whole need the files' totals only.

Defined results: a NULL or empty text has only the end id; rows with the same
or no ``doc_id`` are all written (NULL first, ties in any order); an empty
table gives files without rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, id_and_text
from zonelens.llm.tokens import token_bytes

FILES = "doc_id long, part_start long, n_tokens long, ids array<int>"
_FILES = pa.schema([("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 10_000
BLOOM_FALSE_POSITIVES = 0.01


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write each document's ids, with ``end_id`` after them, to ORC files under ``path``."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = token_bytes(tokenizer_path), 0
        for doc_ids, texts in column_chunks(batches):
            tokens = [t + end for t in encoder.encode(texts.to_pylist())]
            lengths = np.array([len(t) // 4 for t in tokens], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = pa.array(np.frombuffer(b"".join(tokens), "<i4"))
            columns = [doc_ids, pa.array(before + offsets[:-1]), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)]
            yield pa.RecordBatch.from_arrays(columns, schema=_FILES)
            before += int(offsets[-1])

    # The row number breaks ties, so that one much-used id cannot fill a range.
    rows = id_and_text(docs).withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        rows.mapInArrow(encode, FILES)
        .write.mode("overwrite")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FALSE_POSITIVES))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows as written, and ``part``, the number of a row's file in ``doc_id`` order."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.schema(FILES).orc(path).select("*", part.alias("part"))


def find(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's rows: stripes and row groups without it are skipped by their statistics and Bloom filters."""
    return read(spark, path).where(F.col("doc_id") == doc_id)


def _check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, part, start, ids = batch.columns
        offsets = ids.offsets.to_numpy()
        values = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = [doc_id, part, start, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ids of all documents before it, its ids, their CRC-32."""
    rows = read(spark, path)
    checked = rows.select("doc_id", "part", "part_start", "ids").mapInArrow(_check, "doc_id long, part long, part_start long, n_tokens long, ids_crc32 long")
    # One row per file: few, and read from two narrow columns.
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return checked.join(totals, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
