"""The registered queries ``opN_<name>``: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelens.llm import bpe_transducer, divergence, fingerprints, html_text, near_dup, ngram_join, packing, pii, quality, resampling, secrets_forest, token_files, toxicity
from zonelens.llm.common import ensure_checkpoint_dir, read_table
from zonelens.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "held_out"]

#: Ids that end a document.
PACK_END_ID = 1
FILE_END_ID = 2


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.sanitise(read_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_transducer.round_trip_digests(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), PACK_END_ID)


def held_out(doc_id: str) -> Column:
    """Rows whose labels toxicity must not learn from; a NULL id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), allowed=lambda doc_id: ~held_out(doc_id))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op7_secrets_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets_forest.scan(read_table(spark, sf_dir, "documents"))
    places = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.array_join(places, ",").alias("spans"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), FILE_END_ID)
    return token_files.summary(spark, path)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))
    names = ("fingerprint", "edited_fingerprint", "near_edited", "near_next")
    # Recovered digests by side: paragraphs that the other text lacks, and those that only it has.
    counts = [
        F.expr(f"size(filter(differing_{c}, d -> d.side = {side}))").cast("long").alias(f"{c}_{name}")
        for c in ("edited", "next")
        for side, name in ((1, "removed"), (-1, "added"))
    ]
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *names, *counts)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe_transducer": op3_bpe_transducer,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_secrets_forest": op7_secrets_forest,
    "op8_near_dup": op8_near_dup,
    "op9_token_files": op9_token_files,
    "op10_fingerprints": op10_fingerprints,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_ngram_join": op12_ngram_join,
    "op13_source_divergence": op13_source_divergence,
}
