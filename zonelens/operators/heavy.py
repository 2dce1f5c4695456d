"""Top-N rankings from raw rows without grouping all their names.

``rankings.top_n_flat`` groups by name first, which shuffles every different name of every key. Here each task
keeps a frequent-items sketch per key, and only names that the sketches hold (the candidates, at most
``tracked`` per key) are counted by name, in one more pass that counts all other rows by a hash bucket of their
name. A bucket's count bounds that of every name in it, so

* names of buckets that hold fewer rows than the n-th candidate cannot rank and are never grouped;
* names of the other buckets are counted too.

The ranking therefore is that of ``top_n_flat`` whatever the sketches have missed; they only decide how little
is shuffled: candidates and buckets per key, summed in the tasks first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelens.config import TOP_N
from zonelens.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast
from zonelens.operators.rankings import KEYS, top_n_flat
from zonelens.session import cut_lineage

# Names a sketch counts per key, and hash buckets of the other names per key.
TRACKED = 1024
BUCKETS = 16_384


def _beside(side: DataFrame, columns: Sequence[str]) -> DataFrame:
    return side.select(*[F.col(c).alias(f"__side_{c}") for c in columns])


def _same(columns: Sequence[str]) -> Column:
    """Equal in all columns; missing values equal each other."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"__side_{c}")) for c in columns])


def candidates(rows: DataFrame, col: str, keys: Sequence[str] = KEYS, tracked: int = TRACKED) -> DataFrame:
    """(keys, col) of the frequent values, at most ``tracked`` per key, from sketches merged per key."""
    sketches = rows.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate(`{col}`, {int(tracked)})").alias("__sketch"))
    items = F.explode(F.expr(f"approx_top_k_estimate(__sketch, {int(tracked)})"))
    return sketches.select(*keys, items.alias("__item")).select(*keys, F.col("__item.item").alias(col))


def top_n_from_rows(
    rows: DataFrame,
    col: str,
    n: int = TOP_N,
    topn_type: str | None = None,
    keys: Sequence[str] = KEYS,
    tracked: int = TRACKED,
    buckets: int = BUCKETS,
    max_broadcast: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """N1 on raw rows (one count per row): the rows of ``top_n_flat``.

    Where the candidates of all keys are more than ``max_broadcast`` rows, names are grouped
    as there: joining rows to them would shuffle the rows. An empty input gives no rows.
    """
    keys, ends = list(keys), [*keys, col]
    narrow = rows.select(*ends)
    side, small = bounded_broadcast(cut_lineage(candidates(narrow, col, keys, tracked)), max_broadcast)
    if not small:
        return top_n_flat(narrow, col, n, topn_type, keys)
    side = _beside(side, ends)
    bucket = F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")
    known = F.col("__known").isNotNull()
    marked = narrow.join(F.broadcast(side.withColumn("__known", F.lit(True))), _same(ends), "left")
    marked = marked.select(*keys, F.when(known, F.col(col)).alias(col), F.when(~known, bucket).alias("__bucket"))
    # At most ``tracked`` + ``buckets`` rows per key.
    counted = cut_lineage(marked.groupBy(*ends, "__bucket").agg(F.count(F.lit(1)).alias("query_count")))

    of_names = counted.where("__bucket IS NULL").select(*ends, "query_count")
    place = Window.partitionBy(*keys).orderBy(F.desc("query_count"), F.asc(col))
    least = of_names.withColumn("__place", F.row_number().over(place)).where(F.col("__place") == n)
    least = least.select(*[F.col(k).alias(f"__side_{k}") for k in keys], F.col("query_count").alias("__least"))
    suspects = counted.where("__bucket IS NOT NULL").join(least, _same(keys), "left")
    suspects = suspects.where(F.col("query_count") >= F.coalesce("__least", F.lit(0)))
    suspects = _beside(suspects, [*keys, "__bucket"])

    rest = narrow.withColumn("__bucket", bucket).join(suspects, _same([*keys, "__bucket"]), "left_semi")
    rest = rest.join(F.broadcast(side), _same(ends), "left_anti")
    rest = rest.groupBy(*ends).agg(F.count(F.lit(1)).alias("query_count"))
    # Every name is on one side only, so its count is whole.
    return top_n_flat(of_names.unionByName(rest), col, n, topn_type, keys)
