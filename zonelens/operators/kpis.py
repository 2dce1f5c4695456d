"""Daily KPIs per (tenant, event_date).

Scale design: the message rows are first rolled up to one row per
(tenant, event_date, qname, name) with a map-side partial aggregation, so a hot
name costs one row per map task instead of a skewed shuffle. Name features are
computed on that rollup (narrow), and every KPI is a weighted aggregate of it:
counts are ``sum(query_count)`` under a condition, averages are weighted sums
over the weights of non-null values. Only the distinct source-IP count needs
the rows again (one more partial aggregation that reads one column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.config import (
    HIGH_ENTROPY_ALERT,
    INTENT_THRESHOLDS,
    LONG_NAME_LENGTH,
    NXDOMAIN_ALERT,
    NXDOMAIN_RCODE,
)
from zonelens.operators.joins import join_records

KEYS = ("tenant", "event_date")


def _w() -> Column:
    return F.col("query_count")


def rollup_names(rows: DataFrame, keys=KEYS, name_col: str = "qname") -> DataFrame:
    """Rows with a non-NULL qname -> one row per (keys, qname), with its ``name``.

    Measures: query_count, nxdomain_count (rcode 3), response_count (qr 1) and,
    when the rows carry ``has_answer``, answered_count.
    """
    r = rows.where(F.col(name_col).isNotNull())
    measures = [
        F.count(F.lit(1)).alias("query_count"),
        F.count_if(F.col("rcode") == NXDOMAIN_RCODE).cast("long").alias("nxdomain_count"),
        F.count_if(F.col("qr") == 1).cast("long").alias("response_count"),
    ]
    if "has_answer" in r.columns:
        measures.append(F.sum(F.col("has_answer").cast("long")).alias("answered_count"))
    # ``name`` (trimmed, lower-cased qname) is a function of the key: derived after
    # the aggregation, so the shuffle carries the qname only.
    out = r.groupBy(*keys, name_col).agg(*measures)
    return out.select(*keys, name_col, Z.norm_name(name_col).alias("name"), *[m for m in out.columns if m not in (*keys, name_col)])


def _wsum(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, _w()).otherwise(F.lit(0))), F.lit(0)).cast("long")


def _wavg(c: Column) -> Column:
    return F.sum(c * _w()) / F.sum(F.when(c.isNotNull(), _w()))


def max_entropy_names(enriched: DataFrame, keys=KEYS, value_col: str = "qname_entropy", name_col: str = "qname") -> DataFrame:
    """A2: per key the name with the largest entropy (NULLs last), ties to the smallest name.

    A top-1 ``row_number`` (planned as ``WindowGroupLimit``: one row per key
    and map task crosses the shuffle) instead of a string-valued aggregate,
    which would force the whole KPI aggregation onto sort-based aggregation.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(value_col).desc_nulls_last(), F.asc(name_col))
    top = enriched.select(*keys, value_col, name_col).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
    return top.select(*keys, F.col(name_col).alias("max_entropy_qname"))


def src_ip_counts(rows: DataFrame, keys=KEYS, name_col: str = "qname", approx: bool = False, rsd: float = 0.01) -> DataFrame:
    return (
        rows.where(F.col(name_col).isNotNull())
        .groupBy(*keys)
        .agg(_distinct("src_ip", approx, rsd).alias("unique_src_ips"))
    )


def rollup_traffic(silver: DataFrame, keys=KEYS, name_col: str = "qname") -> DataFrame:
    """Messages by key, client, direction and codes, with whether they have a name: what the source-IP
    counts and the breakdowns need, in one partial aggregation."""
    named = F.col(name_col).isNotNull().alias("has_name")
    return silver.groupBy(*keys, "src_ip", "qr", "qtype", "rcode", named).agg(F.count(F.lit(1)).alias("messages"))


def _distinct(col: str, approx: bool, rsd: float) -> Column:
    """Exact distinct count, or HyperLogLog++ (no ``Expand`` of the input) when ``approx``."""
    return (F.approx_count_distinct(col, rsd=rsd) if approx else F.countDistinct(col)).cast("long")


def _aggregate(enriched: DataFrame, keys, measures: dict[str, Column]) -> DataFrame:
    return enriched.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def base_measures(approx: bool = False, rsd: float = 0.01) -> dict[str, Column]:
    """Per-key aggregates of the base KPIs (A1), by output name."""
    e, se, lc = F.col("qname_entropy"), F.col("subdomain_entropy"), F.col("subdomain_label_count")
    return {
        "total_queries": F.sum(_w()).cast("long"),
        "unique_queries": _distinct("name", approx, rsd),
        "unique_root_domains": _distinct("root_domain", approx, rsd),
        "unique_subdomains": _distinct("subdomain", approx, rsd),
        "avg_qname_entropy": _wavg(e),
        "max_qname_entropy": F.max(e),
        "avg_subdomain_entropy": _wavg(se),
        "max_subdomain_entropy": F.max(se),
        "avg_subdomain_count": _wavg(lc.cast("double")),
        "max_subdomain_count": F.max(lc).cast("int"),
    }


def build_base_kpis(
    enriched: DataFrame,
    rows: DataFrame,
    keys=KEYS,
    approx: bool = False,
    rsd: float = 0.01,
    summary: DataFrame | None = None,
    max_names: DataFrame | None = None,
    src_ips: DataFrame | None = None,
) -> DataFrame:
    """A1 + A2: volume, distinct counts, entropy and label-count stats, max-entropy name.

    Exact distinct counts over several columns make Spark expand the input
    once per distinct column; ``approx=True`` uses HyperLogLog++ sketches
    (relative error ``rsd``) that merge map-side instead. A precomputed
    ``summary`` (see ``daily_summary``) replaces the aggregation, and ``max_names``
    and ``src_ips`` the other two parts.
    """
    base = summary if summary is not None else _aggregate(enriched, keys, base_measures(approx, rsd))
    # Three one-row-per-key results joined on the keys (small; AQE broadcasts them).
    out = join_records(base, max_entropy_names(enriched, keys) if max_names is None else max_names, keys)
    out = join_records(out, src_ip_counts(rows, keys, approx=approx, rsd=rsd) if src_ips is None else src_ips, keys)
    return out.select(
        *keys,
        "total_queries",
        "unique_queries",
        "unique_root_domains",
        "unique_subdomains",
        F.coalesce("unique_src_ips", F.lit(0)).cast("long").alias("unique_src_ips"),
        "avg_qname_entropy",
        "max_qname_entropy",
        "avg_subdomain_entropy",
        "max_subdomain_entropy",
        "avg_subdomain_count",
        "max_subdomain_count",
        "max_entropy_qname",
    )


def add_intents(df: DataFrame, thresholds: dict[str, tuple[float, float]] = INTENT_THRESHOLDS) -> DataFrame:
    """A4: one ``<measure>_intent`` column per threshold pair."""
    return df.withColumns({f"{m}_intent": Z.intent(F.col(m), w, a) for m, (w, a) in thresholds.items()})


def risk_measures(long_name_length: int = LONG_NAME_LENGTH, approx: bool = False, rsd: float = 0.01) -> dict[str, Column]:
    """Per-key aggregates of the risk KPIs (A3), by output name."""
    return {
        "high_entropy_query_count": _wsum(F.col("is_high_entropy")),
        "apex_count": _wsum(F.col("is_apex")),
        "invalid_char_count": _wsum(F.col("has_invalid_chars") == 1),
        "nxdomain_count": F.coalesce(F.sum("nxdomain_count"), F.lit(0)).cast("long"),
        "unique_queries": _distinct("name", approx, rsd),
        "avg_query_length": _wavg(F.col("qname_length").cast("double")),
        "max_query_length": F.max("qname_length").cast("int"),
        "long_query_count": _wsum(F.col("qname_length") > long_name_length),
        "max_qname_entropy": F.max("qname_entropy"),
        "total_count": F.sum(_w()).cast("long"),
        "response_count": F.sum("response_count").cast("long"),
    }


def build_risk_kpis(
    enriched: DataFrame,
    keys=KEYS,
    long_name_length: int = LONG_NAME_LENGTH,
    thresholds: dict[str, tuple[float, float]] = INTENT_THRESHOLDS,
    responses_only_nxdomain: bool = False,
    approx: bool = False,
    rsd: float = 0.01,
    summary: DataFrame | None = None,
) -> DataFrame:
    """A3 + A4: risk counts, ratios to the row count, and intent labels.

    With ``responses_only_nxdomain`` the NXDOMAIN ratio divides by responses
    instead of all rows (the published KPI mixes both, kept as default).
    """
    total = F.col("total_count")
    agg = summary if summary is not None else _aggregate(enriched, keys, risk_measures(long_name_length, approx, rsd))
    nx_den = F.col("response_count") if responses_only_nxdomain else total
    out = agg.withColumns(
        {
            "high_entropy_query_ratio": F.col("high_entropy_query_count") / total,
            "apex_ratio": F.col("apex_count") / total,
            "invalid_char_ratio": F.col("invalid_char_count") / total,
            "nxdomain_ratio": F.when(nx_den > 0, F.col("nxdomain_count") / nx_den),
            "unique_query_ratio": F.col("unique_queries") / total,
            "long_query_ratio": F.col("long_query_count") / total,
        }
    )
    out = add_intents(out, thresholds)
    return out.select(
        *keys,
        "high_entropy_query_count",
        "high_entropy_query_ratio",
        "apex_count",
        "invalid_char_count",
        "nxdomain_count",
        "avg_query_length",
        "max_query_length",
        "long_query_count",
        "max_qname_entropy",
        "total_count",
        "apex_ratio",
        "invalid_char_ratio",
        "nxdomain_ratio",
        "unique_query_ratio",
        "long_query_ratio",
        *[f"{m}_intent" for m in thresholds],
    )


def wide_measures(has_answered: bool) -> dict[str, Column]:
    """Per-key aggregates of the wide record (A5-A7), by output name."""
    e, se, lc = F.col("qname_entropy"), F.col("subdomain_entropy"), F.col("subdomain_label_count")
    answered = F.coalesce(F.sum("answered_count"), F.lit(0)) if has_answered else F.lit(0)
    return {
        "total_queries": F.sum(_w()).cast("long"),
        "unique_qnames": F.countDistinct("qname").cast("long"),
        "unique_root_domains": _distinct("root_domain", False, 0.01),
        "unique_subdomains": _distinct("subdomain", False, 0.01),
        "avg_qname_entropy": _wavg(e),
        "max_qname_entropy": F.max(e),
        "avg_subdomain_entropy": _wavg(se),
        "max_subdomain_entropy": F.max(se),
        "avg_subdomain_count": _wavg(lc.cast("double")),
        "max_subdomain_count": F.max(lc).cast("int"),
        "answered_queries": answered.cast("long"),
        "high_entropy_query_count": _wsum(F.col("is_high_entropy")),
        "nxdomain_count": F.coalesce(F.sum("nxdomain_count"), F.lit(0)).cast("long"),
    }


def build_gold_aggregates(
    enriched: DataFrame,
    rows: DataFrame,
    keys=KEYS,
    high_entropy_alert: float = HIGH_ENTROPY_ALERT,
    nxdomain_alert: float = NXDOMAIN_ALERT,
    summary: DataFrame | None = None,
    max_names: DataFrame | None = None,
    src_ips: DataFrame | None = None,
) -> DataFrame:
    """A5-A8 folded into one aggregation: base measures on qname, answered queries,
    high-entropy and NXDOMAIN counts and ratios, max-entropy name, alert flags."""
    measures = wide_measures("answered_count" in enriched.columns)
    agg = summary if summary is not None else _aggregate(enriched, keys, measures)
    agg = agg.select(*keys, *measures)
    total = F.col("total_queries")
    out = join_records(agg, max_entropy_names(enriched, keys) if max_names is None else max_names, keys)
    out = join_records(out, src_ip_counts(rows, keys) if src_ips is None else src_ips, keys)
    out = out.withColumns(
        {
            "unique_src_ips": F.coalesce("unique_src_ips", F.lit(0)).cast("long"),
            "high_entropy_query_ratio": F.col("high_entropy_query_count") / total,
            "nxdomain_ratio": F.col("nxdomain_count") / total,
        }
    )
    return out.withColumns(
        {
            "alert_high_entropy": F.col("high_entropy_query_ratio") >= F.lit(high_entropy_alert),
            "alert_nxdomain": F.col("nxdomain_ratio") >= F.lit(nxdomain_alert),
        }
    )


def daily_summary(enriched: DataFrame, keys=KEYS, extra: dict[str, Column] | None = None) -> DataFrame:
    """Every per-key aggregate of the gold tables in one aggregation of the rollup.

    Base, risk and wide measures (and ``extra``, e.g. histogram bins) share
    one scan and one exchange; each table is then a projection of this small
    one-row-per-key frame. Same-named measures are the same expression.
    """
    measures: dict[str, Column] = {}
    for part in (base_measures(), risk_measures(), wide_measures("answered_count" in enriched.columns), extra or {}):
        for name, col in part.items():
            measures.setdefault(name, col)
    return _aggregate(enriched, keys, measures)


def build_wide_gold(
    enriched: DataFrame,
    rows: DataFrame,
    keys=KEYS,
    summary: DataFrame | None = None,
    max_names: DataFrame | None = None,
    src_ips: DataFrame | None = None,
) -> DataFrame:
    """One wide record per (tenant, event_date): A5-A8 measures, top qnames (N2) and the
    two entropy histograms (H4), with disjoint column names. All inputs are one row per key."""
    from zonelens.operators.distributions import entropy_histograms_wide
    from zonelens.operators.rankings import top_qnames_pairs

    out = build_gold_aggregates(enriched, rows, keys, summary=summary, max_names=max_names, src_ips=src_ips)
    out = join_records(out, top_qnames_pairs(enriched, keys=keys), keys)
    return join_records(out, entropy_histograms_wide(enriched, keys, summary=summary), keys)


def build_dashboard(
    base: DataFrame, risk: DataFrame, hist: DataFrame, topn: DataFrame, breakdowns: DataFrame, keys=KEYS
) -> DataFrame:
    """A10: the dashboard bundle, one nested record per (tenant, event_date).

    Each gold table is packed per key (at most 2 histograms, 3 rankings and 2
    breakdowns per day, each bounded by bins / n / distinct codes) and joined
    on the unique keys.
    """
    kcols = list(keys)
    b = base.select(*kcols, F.struct(*[c for c in base.columns if c not in kcols]).alias("base_kpis"))
    r = risk.select(*kcols, F.struct(*[c for c in risk.columns if c not in kcols]).alias("risk_kpis"))
    h = hist.groupBy(*kcols).agg(
        F.sort_array(F.collect_list(F.struct("entropy_type", "histogram"))).alias("histograms")
    )
    t = topn.groupBy(*kcols).agg(F.sort_array(F.collect_list(F.struct("topN_type", "topN"))).alias("rankings"))
    d = breakdowns.groupBy(*kcols).agg(
        F.sort_array(F.collect_list(F.struct("breakdown_type", "breakdown"))).alias("breakdowns")
    )
    for part in (r, h, t, d):
        b = join_records(b, part, kcols)
    return b
