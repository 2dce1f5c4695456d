"""Histograms, breakdowns and the dashboard's derived views.

Zero-filled histograms need no keys x bins join: every bin is a conditional
count in one partial aggregation per key, and the ordered array is built from
those counts, so each bin appears even when its count is zero. Equal-width
histograms count the different values per key once, and take range and bins from
these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.config import ENTROPY_BINS, HIGH_ENTROPY_BIN_FLOOR
from zonelens.session import cut_lineage


KEYS = ("tenant", "event_date")


def _weight(df: DataFrame) -> Column:
    return F.col("query_count") if "query_count" in df.columns else F.lit(1)


def _count_where(df: DataFrame, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, _weight(df)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def bins_frame(spark, bins=ENTROPY_BINS) -> DataFrame:
    """H1: the bin dimension as rows (ord, bin, lower)."""
    return spark.range(1).select(F.inline(Z.bins_literal(bins))).select("ord", "bin", "lower")


def _hist_array(prefix: str, bins=ENTROPY_BINS) -> Column:
    return F.array(*[F.struct(F.lit(label).alias("bin"), F.col(f"{prefix}{i}").alias("count")) for i, (label, _, _) in enumerate(bins)])


def histogram_measures(enriched: DataFrame, bins=ENTROPY_BINS) -> dict[str, Column]:
    """Per-key bin counts of both entropy histograms, by (internal) name."""
    qb, sb = F.col("qname_entropy_bin"), F.col("subdomain_entropy_bin")
    not_apex = ~F.col("is_apex")
    out: dict[str, Column] = {}
    for i, (label, _, _) in enumerate(bins):
        out[f"__q{i}"] = _count_where(enriched, qb == F.lit(label))
        out[f"__s{i}"] = _count_where(enriched, not_apex & (sb == F.lit(label)))
    return out


def entropy_histograms_wide(enriched: DataFrame, keys=KEYS, bins=ENTROPY_BINS, summary: DataFrame | None = None) -> DataFrame:
    """H4: per key, zero-filled ordered qname and subdomain (apex left out) entropy histograms."""
    if summary is not None:
        counts = summary
    else:
        counts = enriched.groupBy(*keys).agg(*[c.alias(n) for n, c in histogram_measures(enriched, bins).items()])
    return counts.select(
        *keys,
        _hist_array("__q", bins).alias("qname_entropy_histogram"),
        _hist_array("__s", bins).alias("subdomain_entropy_histogram"),
    )


def entropy_histograms(enriched: DataFrame, keys=KEYS, bins=ENTROPY_BINS, summary: DataFrame | None = None) -> DataFrame:
    """H2 + H3: long form (keys, histogram, entropy_type) with entropy_type in {qname, subdomain}."""
    wide = entropy_histograms_wide(enriched, keys, bins, summary)
    both = F.array(
        F.struct(F.col("qname_entropy_histogram").alias("histogram"), F.lit("qname").alias("entropy_type")),
        F.struct(F.col("subdomain_entropy_histogram").alias("histogram"), F.lit("subdomain").alias("entropy_type")),
    )
    return wide.select(*keys, F.inline(both))


def histogram_flat(hist: DataFrame, keys=KEYS, bins=ENTROPY_BINS) -> DataFrame:
    """Flat twin of a long histogram: keys, entropy_type, bin_ord, bin, lower, count."""
    lowers = F.array(*[F.lit(float(lo)) for _, lo, _ in bins])
    return hist.select(*keys, "entropy_type", F.posexplode("histogram").alias("bin_ord", "h")).select(
        *keys,
        "entropy_type",
        F.col("bin_ord").cast("int").alias("bin_ord"),
        F.col("h.bin").alias("bin"),
        F.element_at(lowers, F.col("bin_ord") + 1).alias("lower"),
        F.col("h.count").alias("count"),
    )


def breakdowns_flat(rows: DataFrame, keys=KEYS, weight: str | None = None) -> DataFrame:
    """H5 (flat): rcode counts over responses (qr=1) and qtype counts over queries (qr=0).

    One scan and one partial aggregation: each row contributes to exactly one
    breakdown, chosen by its direction. ``weight`` names a column with the
    messages that a row stands for.
    """
    qr = F.col("qr")
    typed = rows.where(qr.isin(0, 1)).select(
        *keys,
        F.when(qr == 1, F.lit("rcode_breakdown")).otherwise(F.lit("qtype_breakdown")).alias("breakdown_type"),
        F.when(qr == 1, F.col("rcode")).otherwise(F.col("qtype")).cast("int").alias("code"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"),
    )
    return typed.groupBy(*keys, "breakdown_type", "code").agg(F.sum("n").alias("count"))


def pack_breakdowns(flat: DataFrame, keys=KEYS) -> DataFrame:
    """H5 (gold): array<struct<code,count>> ordered by count desc, code asc (at most one entry per code)."""
    packed = flat.groupBy(*keys, "breakdown_type").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col("code"), F.col("count")))).alias("b")
    )
    return packed.select(
        *keys,
        F.transform("b", lambda x: F.struct(x["code"].alias("code"), x["count"].alias("count"))).alias("breakdown"),
        "breakdown_type",
    )


# ---------------------------------------------------------------------------
# Dashboard computations
# ---------------------------------------------------------------------------


def equal_width_histogram(df: DataFrame, value_col: str, k: int = 10, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """K equal-width bins between the per-key min and max of ``value_col``, last bin closed.

    Output per key and bin (zero-filled): bin_index, lower, upper, midpoint,
    label "lo - hi" (2 decimals), count. A constant column gives bin 0 all rows.
    """
    # Rows collapse to different values first, and these are checkpointed: their range and
    # their bins both read them, so the input plan runs once. NULL values fall out of min/max and
    # of the conditional sums; keys whose values are all NULL are dropped after the
    # aggregation (no filter that could be pushed below the grouping of a feature's rows).
    values = cut_lineage(df.groupBy(*keys, F.col(value_col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
    stats = values.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    # One stats row per key: adaptive execution broadcasts them once their size is
    # known, or else splits the partition of a hot key.
    binned = values.join(stats, on=list(keys), how="inner").withColumn(
        "__idx", Z.equal_width_index(F.col("__v"), F.col("__lo"), F.col("__hi"), k)
    )
    counts = binned.groupBy(*keys, "__lo", "__hi").agg(
        *[F.sum(F.when(F.col("__idx") == i, F.col("__n")).otherwise(F.lit(0))).cast("long").alias(f"__c{i}") for i in range(k)]
    ).where(F.col("__lo").isNotNull())
    arr = F.array(*[F.col(f"__c{i}") for i in range(k)])
    exploded = counts.select(*keys, "__lo", "__hi", F.posexplode(arr).alias("bin_index", "count"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(k)
    lower = F.col("__lo") + F.col("bin_index") * width
    upper = lower + width
    return exploded.select(
        *keys,
        F.col("bin_index").cast("int").alias("bin_index"),
        lower.alias("lower"),
        upper.alias("upper"),
        ((lower + upper) / 2).alias("midpoint"),
        F.format_string("%.2f - %.2f", lower, upper).alias("label"),
        "count",
    )


def histogram_share(flat_hist: DataFrame, threshold: float = HIGH_ENTROPY_BIN_FLOOR, keys=KEYS) -> DataFrame:
    """D3: share of each bin in percent, and the first bin whose lower bound >= threshold.

    The window spans one histogram (at most the number of bins), never a table.
    """
    part = Window.partitionBy(*keys, "entropy_type")
    total = F.sum("count").over(part)
    return flat_hist.select(
        *keys,
        "entropy_type",
        "bin_ord",
        "bin",
        "count",
        F.when(total > 0, F.col("count") * 100.0 / total).otherwise(F.lit(0.0)).alias("share_pct"),
        F.min(F.when(F.col("lower") >= F.lit(threshold), F.col("bin_ord"))).over(part).alias("first_high_bin"),
    )


def high_entropy_percent(flat_hist: DataFrame, threshold: float = HIGH_ENTROPY_BIN_FLOOR, keys=KEYS) -> DataFrame:
    """Percent of histogram counts in bins from ``threshold`` up; 0 when the histogram is empty."""
    total = F.sum("count")
    high = F.sum(F.when(F.col("lower") >= F.lit(threshold), F.col("count")).otherwise(F.lit(0)))
    return flat_hist.groupBy(*keys, "entropy_type").agg(
        F.when(total > 0, high * 100.0 / total).otherwise(F.lit(0.0)).alias("high_entropy_pct")
    )


def breakdown_view(packed: DataFrame, keys=KEYS) -> DataFrame:
    """Breakdown entries normalised (NULL code -> -1, NULL count -> 0), positioned by count desc."""
    rows = packed.select(*keys, "breakdown_type", F.explode("breakdown").alias("b")).select(
        *keys,
        "breakdown_type",
        F.coalesce(F.col("b.code"), F.lit(-1)).alias("code"),
        F.coalesce(F.col("b.count"), F.lit(0)).cast("long").alias("count"),
    )
    w = Window.partitionBy(*keys, "breakdown_type").orderBy(F.desc("count"), F.asc("code"))
    return rows.withColumn("position", F.row_number().over(w))


def ranking_view(flat_topn: DataFrame, keys=KEYS) -> DataFrame:
    """Ranking normalised (NULL name -> "Unknown", NULL count -> 0) with min-max intensity in 0..1.

    The window spans one ranking (at most n rows).
    """
    c = F.coalesce(F.col("query_count"), F.lit(0)).cast("long")
    part = Window.partitionBy(*keys, "topN_type")
    base = flat_topn.select(
        *keys, "topN_type", "rank", F.coalesce(F.col("name"), F.lit("Unknown")).alias("name"), c.alias("query_count")
    )
    lo, hi = F.min("query_count").over(part), F.max("query_count").over(part)
    span = F.when(hi - lo == 0, F.lit(1)).otherwise(hi - lo)
    return base.withColumn("intensity", (F.col("query_count") - lo) / span)


def ranking_by_count(flat_topn: DataFrame, keys=KEYS) -> DataFrame:
    """A ranking re-sorted by query count (desc), original rank as tie-break."""
    w = Window.partitionBy(*keys, "topN_type").orderBy(F.desc("query_count"), F.asc("rank"))
    return flat_topn.withColumn("position", F.row_number().over(w))
