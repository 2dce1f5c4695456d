"""Tenant-facing parameterised reports (the six named query templates).

Each is a function of (rows, tenant, limit) with bound values, never SQL text
built from user input. The tenant filter reaches the scan (partition pruning
on a tenant-partitioned silver table); each report is a partial aggregation
followed by an ordered top-k with a key tie-break, so a limit is deterministic.
The limit is the report's feature (default 50, 1..10 000).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.config import NXDOMAIN_RCODE, TEMPLATE_LIMIT_DEFAULT, TEMPLATE_LIMIT_MAX


def _check_limit(limit: int) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= TEMPLATE_LIMIT_MAX:
        raise ValueError(f"limit must be an integer in 1..{TEMPLATE_LIMIT_MAX}")
    return limit


def _for_tenant(rows: DataFrame, tenant: str | None) -> DataFrame:
    return rows if tenant is None else rows.where(F.col("tenant") == F.lit(tenant))


def avg_entropy(rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """Per qname average entropy and count, highest average first.

    Entropy is a function of the name, so it is computed once per distinct
    name after the count, not once per row.
    """
    counts = _for_tenant(rows, tenant).where(F.col("qname").isNotNull()).groupBy("qname").agg(
        F.count(F.lit(1)).alias("query_count")
    )
    out = counts.select("qname", Z.entropy_bits(F.col("qname")).alias("avg_entropy"), "query_count")
    return out.orderBy(F.col("avg_entropy").desc_nulls_last(), "qname").limit(_check_limit(limit))


def nx_domain(rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """NXDOMAIN responses per qname, most first."""
    nx = _for_tenant(rows, tenant).where(F.col("rcode") == NXDOMAIN_RCODE)
    out = nx.groupBy("qname").agg(F.count(F.lit(1)).alias("nxdomain_count"))
    return out.orderBy(F.desc("nxdomain_count"), "qname").limit(_check_limit(limit))


def qname_length(rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """Length per distinct qname, longest first."""
    names = _for_tenant(rows, tenant).where(F.col("qname").isNotNull()).select("qname").distinct()
    out = names.select("qname", F.length("qname").alias("qname_length"))
    return out.orderBy(F.desc("qname_length"), "qname").limit(_check_limit(limit))


def top_domains(rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """T4: most queried names."""
    out = _for_tenant(rows, tenant).groupBy("qname").agg(F.count(F.lit(1)).alias("query_count"))
    return out.orderBy(F.desc("query_count"), F.asc_nulls_last("qname")).limit(_check_limit(limit))


def top_query_types(rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """T5: most frequent query types."""
    out = _for_tenant(rows, tenant).groupBy("qtype").agg(F.count(F.lit(1)).alias("query_count"))
    return out.orderBy(F.desc("query_count"), F.asc_nulls_last("qtype")).limit(_check_limit(limit))


def topn_clients(rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """Most active client addresses."""
    out = _for_tenant(rows, tenant).groupBy(F.col("src_ip").alias("client_ip")).agg(
        F.count(F.lit(1)).alias("query_count")
    )
    return out.orderBy(F.desc("query_count"), F.asc_nulls_last("client_ip")).limit(_check_limit(limit))


def names_by_length(lengths: DataFrame) -> DataFrame:
    """A (qname, qname_length) report re-sorted by length ascending, with its position."""
    from pyspark.sql import Window

    # The input is a report of at most the template limit rows.
    w = Window.orderBy(F.asc("qname_length"), F.asc("qname"))
    return lengths.withColumn("position", F.row_number().over(w))


TEMPLATES = {
    "avg_entropy": avg_entropy,
    "nx_domain": nx_domain,
    "qname_length": qname_length,
    "top_domains": top_domains,
    "top_query_types": top_query_types,
    "topn_clients": topn_clients,
}


def run_template(name: str, rows: DataFrame, tenant: str | None, limit: int = TEMPLATE_LIMIT_DEFAULT) -> DataFrame:
    """Look up a report by name and run it with bound parameters."""
    if name not in TEMPLATES:
        raise KeyError(f"unknown template {name!r}; known: {sorted(TEMPLATES)}")
    return TEMPLATES[name](rows, tenant, limit)
