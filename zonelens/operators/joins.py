"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bound on rows of a dimension that may be broadcast.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


# Row counts already checked in this application, by (app, plan hash, input files).
_CHECKED: dict[tuple, int] = {}


def _check_key(df: DataFrame) -> tuple | None:
    """Key under which a size check may be reused, or None.

    Only plans whose leaves are files (immutable once written; the listing is
    part of the key) or literal rows qualify; plans over RDDs or cached data
    are counted every time.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(tag in plan for tag in ("ExistingRDD", "LogicalRDD", "InMemoryRelation", "Streaming")):
        return None
    app = df.sparkSession.sparkContext.applicationId
    return (app, df.semanticHash(), tuple(sorted(df.inputFiles())))


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` when it holds at most ``max_rows`` rows, else leave it for a shuffle join.

    The check counts a dimension (never a fact table) where its rows are; its
    result is reused within the application for the same plan over the same files. Returns the DataFrame to
    join with and whether it was broadcast.
    """
    key = _check_key(df)
    n = _CHECKED.get(key) if key is not None else None
    if n is None:
        n = df.count()
        if key is not None:
            _CHECKED[key] = n
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def join_back(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "left") -> DataFrame:
    """Join per-key results (``right``: at most one row per key) back onto ``left``.

    No action runs while the plan is built and nothing is cached: adaptive
    execution broadcasts ``right`` if it turns out small, and otherwise splits
    the partitions of ``left`` that a hot key fills (skew join), leaving the
    others as they are.
    """
    return left.join(right, on=list(keys), how=how)


def join_records(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "left") -> DataFrame:
    """Join two tables with at most one row per key, where a missing key (a day that could not be read) meets itself."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(and_, [left[k].eqNullSafe(named[f"__right_{k}"]) for k in keys])
    return left.join(named, same, how).drop(*[f"__right_{k}" for k in keys])
