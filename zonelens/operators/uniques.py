"""Distinct counts that can be stored per day and merged over any days.

A distinct count cannot be added up over days; recounting reads the rows of every
day again and expands them once per counted column. Two stored forms merge instead:

* sketches (``daily_sketches``): HyperLogLog columns, a few kilobytes a day,
  within ``error_bound`` of the exact count;
* bitmaps (``daily_bitmaps``): exact. Every value gets a number once
  (``number_values``, a stored table that ``extend_numbers`` appends to); a day is
  the bits of its values in buckets of 32,768 numbers, merged by OR.

Both take plain aggregates (no DISTINCT), so no plan expands its input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("tenant", "event_date")
UNIQUE_COLUMNS = ("name", "root_domain", "subdomain")
# Sizes a sketch may have (log2 of its registers).
MIN_LG_K, MAX_LG_K = 4, 21


def lg_k_for(max_error: float) -> int:
    """The smallest sketch whose relative standard error, also after merging, is at most ``max_error``."""
    registers = (1.04 / max_error) ** 2
    return min(MAX_LG_K, max(MIN_LG_K, math.ceil(math.log2(registers))))


def error_bound(exact: Column, max_error: float, deviations: float = 3.0) -> Column:
    """How far an estimate may be from ``exact``: ``deviations`` standard errors, one at least."""
    return F.greatest(F.lit(deviations * max_error) * exact, F.lit(1.0))


def daily_sketches(rows: DataFrame, columns: tuple[str, ...] = UNIQUE_COLUMNS, keys: tuple[str, ...] = KEYS, max_error: float = 0.02) -> DataFrame:
    """One row per key with a sketch of the different values of each column (NULL is no value)."""
    lg_k = lg_k_for(max_error)
    return rows.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"{c}_sketch") for c in columns])


def merge_sketches(sketches: DataFrame, keys: tuple[str | Column, ...], columns: tuple[str, ...] = UNIQUE_COLUMNS) -> DataFrame:
    """Estimated distinct counts (``unique_<column>``) of the union of the sketches of each key."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(f"unique_{c}") for c in columns]
    return sketches.groupBy(*keys).agg(*counts)


def value_pairs(rows: DataFrame, columns: tuple[str, ...] = UNIQUE_COLUMNS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Different (keys, kind, value) of all columns, in one partial aggregation; NULL is no value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def number_values(pairs: DataFrame, first: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A number from ``first`` on for each different (kind, value).

    Values are numbered in the order of the key they are first met in, so a day's new
    values stand next to each other and its bitmaps have few buckets. The numbers depend on
    the partitions: store the result (or checkpoint it) before it is read twice.
    """
    met = pairs.groupBy("kind", "value").agg(F.min(F.struct(*keys)).alias("met"))
    dealt = met.repartitionByRange("kind", "met", "value").sortWithinPartitions("kind", "met", "value")
    return dealt.select("kind", "value", (F.monotonically_increasing_id() + F.lit(first)).alias("number"))


def extend_numbers(numbers: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Numbers of the values of ``pairs`` that ``numbers`` does not have; to be appended to it."""
    last = numbers.agg(F.max("number")).first()[0]
    fresh = pairs.join(numbers.select("kind", "value"), ["kind", "value"], "left_anti")
    return number_values(fresh, 0 if last is None else last + 1, keys)


def daily_bitmaps(pairs: DataFrame, numbers: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows (keys, kind, bucket, bits): the numbered values of each key."""
    numbered = pairs.join(numbers, ["kind", "value"])
    return numbered.groupBy(*keys, "kind", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def merge_bitmaps(bitmaps: DataFrame, keys: tuple[str | Column, ...], columns: tuple[str, ...] = UNIQUE_COLUMNS) -> DataFrame:
    """Exact distinct counts (``unique_<column>``) of the union of the bitmaps of each key; 0 where a kind has none.

    A bucket is merged by itself, so no task holds more than one bucket of a key at a time.
    """
    merged = bitmaps.groupBy(*keys, "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    names = [c for c in merged.columns if c not in ("kind", "bucket", "n")]
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"unique_{c}") for c in columns]
    return merged.groupBy(*names).agg(*counts)
