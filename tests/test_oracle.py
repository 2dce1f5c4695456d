"""Every registered query against its DuckDB twin on sf0.001 (order-insensitive rows)."""

import collections
import datetime
import math

import duckdb
import pytest

import __spark_entry__ as E
from zonelens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "high_entropy_query_ratio_intent" in df.columns


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(E.catalog.QUERIES)))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    srows = collections.Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    drows = collections.Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert srows == drows


def test_dashboard_holds_the_checked_parts(spark):
    """The nested record has no twin; its parts equal the tables that have one."""
    from zonelens.plans import catalog, jobs

    tables = catalog.gold_run(spark, SF)
    records = E.queries()["dashboard"](spark, SF).collect()
    risk = {(r.tenant, r.event_date): r for r in tables["risk_kpis"].collect()}
    assert len(records) == len(risk) > 0
    for r in records:
        assert r.risk_kpis.total_count == risk[r.tenant, r.event_date].total_count == r.base_kpis.total_queries
        assert {h.entropy_type for h in r.histograms} == {"qname", "subdomain"}
        assert len(r.rankings) >= 2 and 1 <= len(r.breakdowns) <= 2
    assert jobs.ANSWER_SECONDS == 5.0


def test_gold_counts_answers(spark):
    rows = E.queries()["gold_wide_scalars"](spark, SF).collect()
    assert sum(r.answered_queries for r in rows) > 50
