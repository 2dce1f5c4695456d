"""Rankings from sketches, candidates and buckets equal those from grouping every name."""

import random

import pytest
from pyspark.sql import functions as F

from zonelens.operators import heavy
from zonelens.operators import rankings as N

SCHEMA = "tenant string, event_date date, qname string"


def ranked(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows is one name of one tenant; long tails, ties, missing names and days."""
    rng = random.Random(4)
    rows = [("a", "2024-01-01", "hot.example.com")] * 3000
    rows += [("a", "2024-01-01", f"n{int(rng.paretovariate(0.6)) % 5000}.example.com") for _ in range(4000)]
    rows += [("b", None, f"tied{i % 400}.example.org") for i in range(1600)]
    rows += [("c", "2024-01-02", None)] * 30 + [(None, "2024-01-02", f"x{i}") for i in range(5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "tenant string, d string, qname string").select("tenant", F.col("d").cast("date").alias("event_date"), "qname")


@pytest.mark.parametrize(("tracked", "buckets"), [(1024, 16_384), (64, 128), (4, 3), (1, 1)])
@pytest.mark.parametrize("n", [1, 10])
def test_equals_grouping_all_names(skewed, tracked, buckets, n):
    got = heavy.top_n_from_rows(skewed, "qname", n, "top_qnames", tracked=tracked, buckets=buckets)
    want = N.top_n_flat(skewed, "qname", n, "top_qnames")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert ranked(got) == ranked(want)


def test_many_candidates_are_grouped_instead(skewed):
    got = heavy.top_n_from_rows(skewed, "qname", 3, max_broadcast=5)
    assert ranked(got) == ranked(N.top_n_flat(skewed, "qname", 3))


def test_no_rows(spark):
    assert heavy.top_n_from_rows(spark.createDataFrame([], SCHEMA), "qname").count() == 0


def test_other_types_rank_by_their_own_order(spark):
    rows = spark.createDataFrame([("a", i % 12) for i in range(60)], "tenant string, port int")
    got = heavy.top_n_from_rows(rows, "port", 5, keys=["tenant"], tracked=2, buckets=4)
    assert [r.name for r in got.orderBy("rank").collect()] == ["0", "1", "2", "3", "4"]


def test_names_that_cannot_rank_are_not_grouped(spark):
    """With a clear top and a long tail, no name of the tail passes an exchange."""
    tail = spark.range(200_000).select(F.lit("a").alias("tenant"), F.concat(F.lit("t"), F.col("id")).alias("qname"))
    top = spark.range(40_000).select(F.lit("a").alias("tenant"), F.concat(F.lit("top"), F.col("id") % 10).alias("qname"))
    got = heavy.top_n_from_rows(tail.union(top), "qname", 10, keys=["tenant"], tracked=256, buckets=1024)
    assert [r.query_count for r in got.collect()] == [4000] * 10
    final = got._jdf.queryExecution().executedPlan()
    written = []

    def walk(node):
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(final)
    assert sum(written) < 5000
