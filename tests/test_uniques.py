"""Mergeable distinct counts: sketches within bounds, bitmaps exact, both without expanding their input."""

import datetime

from pyspark.sql import functions as F

from zonelens.operators import features as G
from zonelens.operators import uniques as U

COLUMNS = ("name", "root_domain")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n=200_000):
    """Ten days of two tenants; a hot name on a third of the rows, NULL roots, a day that could not be read."""
    i = F.col("id")
    name = F.when(i % 3 == 0, F.lit("hot.example.com")).otherwise(F.concat(F.lit("n"), (F.xxhash64(i) % 20_000).cast("string")))
    day = F.when(i % 97 == 0, F.lit(None)).otherwise(F.date_add(F.lit(datetime.date(2024, 1, 1)), (i % 10).cast("int")))
    root = F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), (i % 1_234).cast("string")))
    return spark.range(n).select(F.concat(F.lit("t"), (i % 2).cast("string")).alias("tenant"), day.alias("event_date"),
                                 name.alias("name"), root.alias("root_domain"))


def _exact(rows, *keys):
    counts = [F.countDistinct(c).alias(f"unique_{c}") for c in COLUMNS]
    return sorted(map(str, rows.groupBy(*keys).agg(*counts).collect()))


def test_bitmaps_are_exact_over_any_days(spark):
    rows = _rows(spark)
    pairs = U.value_pairs(rows, COLUMNS)
    numbers = U.number_values(pairs).checkpoint()
    assert numbers.count() == numbers.select("number").distinct().count() == pairs.select("kind", "value").distinct().count()
    days = U.daily_bitmaps(pairs, numbers)
    assert "Expand" not in _plan(days) and "Expand" not in _plan(U.merge_bitmaps(days, ("tenant",), COLUMNS))
    days = days.checkpoint()
    for keys in (("tenant", "event_date"), ("tenant",)):
        assert sorted(map(str, U.merge_bitmaps(days, keys, COLUMNS).collect())) == _exact(rows, *keys)


def test_numbers_are_extended_not_changed(spark):
    rows = _rows(spark, 20_000)
    old, new = rows.where("event_date < '2024-01-06'"), rows.where("event_date >= '2024-01-06'")
    first = U.number_values(U.value_pairs(old, COLUMNS)).checkpoint()
    more = U.extend_numbers(first, U.value_pairs(new, COLUMNS)).checkpoint()
    numbers = first.unionByName(more)
    assert more.count() > 0 and numbers.count() == numbers.select("number").distinct().count()
    assert U.extend_numbers(numbers, U.value_pairs(new, COLUMNS)).count() == 0
    days = U.daily_bitmaps(U.value_pairs(old, COLUMNS), numbers).unionByName(U.daily_bitmaps(U.value_pairs(new, COLUMNS), numbers))
    assert sorted(map(str, U.merge_bitmaps(days, ("tenant",), COLUMNS).collect())) == _exact(rows.where("event_date is not null"), "tenant")
    nothing = U.number_values(U.value_pairs(rows.where("false"), COLUMNS))
    assert nothing.count() == 0 and U.extend_numbers(nothing, U.value_pairs(old, COLUMNS)).count() == first.count()


def test_new_values_of_a_day_stand_together(spark):
    rows = spark.range(200_000).select(F.lit("t").alias("tenant"), F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") % 4).cast("int")).alias("event_date"),
                                       F.col("id").cast("string").alias("name"))
    pairs = U.value_pairs(rows, ("name",))
    days = U.daily_bitmaps(pairs, U.number_values(pairs).checkpoint())
    # 50,000 values a day: two buckets if they stood in a row, and one more at each border of a partition.
    assert max(r["count"] for r in days.groupBy("event_date").count().collect()) <= 2 + 2 * 8


def test_sketches_are_within_bounds(spark):
    rows, error = _rows(spark), 0.02
    sketches = U.daily_sketches(rows, COLUMNS, max_error=error)
    assert "Expand" not in _plan(sketches)
    sketches = sketches.checkpoint()
    near = U.merge_sketches(sketches, ("tenant",), COLUMNS).withColumnsRenamed({f"unique_{c}": f"near_{c}" for c in COLUMNS})
    exact = rows.groupBy("tenant").agg(*[F.countDistinct(c).alias(f"unique_{c}") for c in COLUMNS])
    both = exact.join(near, "tenant")
    for c in COLUMNS:
        both = both.where(F.abs(F.col(f"near_{c}") - F.col(f"unique_{c}")) <= U.error_bound(F.col(f"unique_{c}"), error))
    assert both.count() == 2
    assert U.lg_k_for(0.02) == 12 and U.lg_k_for(1.0) == 4 and U.lg_k_for(1e-9) == 21


def test_windows_merge_the_days_sketches(spark):
    seconds = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") * 613) % (6 * 86_400))
    names = spark.range(60_000).select(seconds.alias("event_ts"), (F.col("id") % 3).cast("string").alias("root_domain"),
                                       F.concat(F.lit("S"), (F.col("id") % 3_000).cast("string"), F.lit(".x")).alias("subdomain"))
    sketches = G.subdomain_sketches(names, "1 day", max_error=0.05)
    near = G.counts_from_sketches(sketches, "3 days", "1 day").withColumnRenamed(G.WINDOW_COUNT, "near")
    exact = G.windowed_subdomain_counts(names, "3 days", "1 day")
    # The rows are not expanded; overlapping windows multiply the steps' sketches only.
    assert "Expand" not in _plan(sketches)
    both = exact.join(near, ["root_domain", "window"])
    assert both.count() == exact.count() == near.count() == 3 * 8
    assert both.where(F.abs(F.col("near") - F.col(G.WINDOW_COUNT)) > U.error_bound(F.col(G.WINDOW_COUNT), 0.05)).count() == 0


def test_equal_width_histogram_reads_its_input_once(spark, tmp_dir):
    from zonelens.operators import distributions as D

    spark.range(1000).select(F.lit("t").alias("tenant"), (F.col("id") % 50).alias("v")).write.parquet(f"{tmp_dir}/v")
    h = D.equal_width_histogram(spark.read.parquet(f"{tmp_dir}/v"), "v", 5)
    assert "FileScan" not in _plan(h)  # only the checkpointed values are left to read
    assert [r["count"] for r in h.orderBy("bin_index").collect()] == [200] * 5
    empty = spark.createDataFrame([("t", None)], "tenant string, v double")
    assert D.equal_width_histogram(empty, "v", 5).count() == 0
