"""A corpus from raw documents to packed token sequences, in five stages.

Each stage is a function of ``(spark, docs, sf_dir)`` that calls one operator
of ``zonelens.llm`` on all documents that the stage before kept. ``run`` writes each
stage's result as Parquet under the shared folder of ``spark.checkpoint.dir``
and reads it again, so a lost executor costs the current stage only. What the stages before have left
in the driver goes first.

1. ``quality_rules``: documents that the base rule or the quality model rejects go.
2. ``toxicity``: documents from the toxic score on go.
3. ``near_dup``: one document of each near-duplicate class (similarity 0.80 or more) stays.
4. ``secrets``: secrets in the texts are replaced (and ``n_chars`` counted anew).
5. ``packing``: the texts' token ids are packed; returns the pieces.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonelens.llm import near_dup, packing, quality, secrets_forest, toxicity
from zonelens.llm.common import ensure_checkpoint_dir, free_unused, read_table
from zonelens.llm.queries import PACK_END_ID, held_out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_unused(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), allowed=lambda doc_id: ~held_out(doc_id))
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_unused(spark)
    return near_dup.keep_one(docs, near_dup.STAGE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_unused(spark)
    return secrets_forest.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_unused(spark)
    # Workers that ran the stages before hold memory already: remember less.
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), PACK_END_ID, memory=250_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_dup", near_duplicates),
    ("secrets", secrets),
    ("packing", packed),
]

#: No stage can be stated in SQL: models, tokens and reachability decide. ``tests/llm`` has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``packing`` after all stages, from the table ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
