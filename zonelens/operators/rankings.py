"""Top-N rankings per (tenant, event_date).

Ranking is ``row_number`` over a window partitioned by the day keys followed by
a ``rank <= n`` filter, which Spark plans as a ``WindowGroupLimit``: each map
task keeps only its top n per key before the shuffle, so a day with millions of
names sends n rows per task, not all of them. Packing into an ordered array
happens on at most n rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelens.config import TOP_N

KEYS = ("tenant", "event_date")


def _count_col(df: DataFrame) -> Column:
    """Weight of a row: ``query_count`` on a rollup, 1 on raw rows."""
    return F.col("query_count") if "query_count" in df.columns else F.lit(1)


def top_n_flat(
    df: DataFrame,
    col: str,
    n: int = TOP_N,
    topn_type: str | None = None,
    keys=KEYS,
) -> DataFrame:
    """N1 (flat): per (keys, col) count; rank by count desc then value asc; keep rank <= n.

    Columns: keys, [topN_type], rank, name, query_count, entropy (NULL).
    """
    counts = df.groupBy(*keys, col).agg(F.sum(_count_col(df)).cast("long").alias("query_count"))
    w = Window.partitionBy(*keys).orderBy(F.desc("query_count"), F.asc(col))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    out = ranked.select(
        *keys,
        *([F.lit(topn_type).alias("topN_type")] if topn_type else []),
        F.col("rank").cast("int").alias("rank"),
        F.col(col).cast("string").alias("name"),
        "query_count",
        F.lit(None).cast("double").alias("entropy"),
    )
    return out


def _entropy_order(entropy: Column) -> Column:
    """Descending to nine places: names whose letters are rearranged tie, whatever the last bit of their sums."""
    return F.round(entropy, 9).desc_nulls_last()


def high_entropy_flat(
    df: DataFrame,
    n: int = TOP_N,
    keys=KEYS,
    name_col: str = "qname",
    flag_col: str = "is_high_entropy",
) -> DataFrame:
    """N4 (flat): flagged names, per name count and max entropy, ranked by entropy desc (to nine places, NULLs last), name asc.

    The flag is applied after the per-name aggregation: a filter on a feature
    of the grouping key would otherwise be pushed below the name rollup and
    evaluated on every raw row.
    """
    w = _count_col(df)
    per_name = (
        df.groupBy(*keys, name_col)
        .agg(
            F.sum(F.when(F.col(flag_col), w).otherwise(F.lit(0))).cast("long").alias("query_count"),
            F.max(F.when(F.col(flag_col), F.col("qname_entropy"))).alias("entropy"),
            F.max(F.col(flag_col).cast("int")).alias("__flagged"),
        )
        .where(F.col("__flagged") == 1)
    )
    order = Window.partitionBy(*keys).orderBy(_entropy_order(F.col("entropy")), F.asc(name_col))
    ranked = per_name.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(
        *keys,
        F.lit("high_entropy").alias("topN_type"),
        F.col("rank").cast("int").alias("rank"),
        F.col(name_col).cast("string").alias("name"),
        "query_count",
        F.col("entropy").cast("double").alias("entropy"),
    )


def high_entropy_from_rows(
    rows: DataFrame,
    threshold: float,
    n: int = TOP_N,
    keys=KEYS,
    name_col: str = "qname",
) -> DataFrame:
    """The high-entropy ranking rebuilt from raw enriched rows (one count per row).

    Equals N4 by construction: rows at or above ``threshold`` are counted, not
    a per-name total repeated on every row.
    """
    flagged = rows.withColumn("__flag", F.col("qname_entropy") >= F.lit(threshold))
    return high_entropy_flat(flagged, n=n, keys=keys, name_col=name_col, flag_col="__flag")


def pack_top_n(flat: DataFrame, keys=KEYS, target_col: str = "topN") -> DataFrame:
    """Pack flat ranked rows (<= n per key) into an ordered array<struct<rank,name,query_count,entropy>>."""
    type_cols = ["topN_type"] if "topN_type" in flat.columns else []
    return flat.groupBy(*keys, *type_cols).agg(
        F.sort_array(F.collect_list(F.struct("rank", "name", "query_count", "entropy"))).alias(target_col)
    ).select(*keys, target_col, *type_cols)


def _rank(per_key: DataFrame, keys, order: list, n: int, topn_type: str, name_col: str, entropy: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = per_key.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select(
        *keys,
        F.lit(topn_type).alias("topN_type"),
        F.col("rank").cast("int").alias("rank"),
        F.col(name_col).cast("string").alias("name"),
        "query_count",
        entropy.cast("double").alias("entropy"),
    )


def build_topn(enriched: DataFrame, n: int = TOP_N, keys=KEYS) -> DataFrame:
    """Gold ``topn`` table: top qnames, top root domains and high-entropy names (long form, flat).

    The two name rankings share one aggregation by (keys, qname): all rows
    counted for the top qnames, flagged rows counted (and their max entropy)
    for the high-entropy ranking. Same results as ``top_n_flat`` and
    ``high_entropy_flat`` one by one.
    """
    w = _count_col(enriched)
    flag = F.col("is_high_entropy")
    per_name = enriched.groupBy(*keys, "qname").agg(
        F.sum(w).cast("long").alias("__all"),
        F.sum(F.when(flag, w).otherwise(F.lit(0))).cast("long").alias("__flagged_count"),
        F.max(F.when(flag, F.col("qname_entropy"))).alias("__flagged_entropy"),
        F.max(flag.cast("int")).alias("__flagged"),
    )
    top_qnames = _rank(
        per_name.withColumn("query_count", F.col("__all")),
        keys, [F.desc("query_count"), F.asc("qname")], n, "top_qnames", "qname", F.lit(None),
    )
    high = _rank(
        per_name.where(F.col("__flagged") == 1).withColumn("query_count", F.col("__flagged_count")),
        keys, [_entropy_order(F.col("__flagged_entropy")), F.asc("qname")], n, "high_entropy", "qname",
        F.col("__flagged_entropy"),
    )
    return top_qnames.unionByName(top_n_flat(enriched, "root_domain", n, "top_root_domains", keys)).unionByName(high)


def top_qnames_pairs(enriched: DataFrame, n: int = TOP_N, keys=KEYS) -> DataFrame:
    """N2 (wide gold): ordered array<struct<qname,count>> of the n most queried names."""
    flat = top_n_flat(enriched, "qname", n, None, keys)
    return flat.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "name", "query_count"))),
            lambda x: F.struct(x["name"].alias("qname"), x["query_count"].alias("count")),
        ).alias("top_qnames")
    )
