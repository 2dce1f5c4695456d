"""Object-key parsing: tenant and bronze output key from a capture's object key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CAPTURE_EXT = r"(?i)\.(pcap|pcapng)$"


# A ``%`` that starts no escape is kept as it is.
_STRAY_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def normalize_key(key: Column) -> Column:
    """URL-decode ('+' is a space, a stray '%' stays) and strip leading slashes; bytes that are no text become NULL."""
    escaped = F.regexp_replace(F.coalesce(key, F.lit("")), _STRAY_PERCENT, "%25")
    return F.regexp_replace(F.try_url_decode(escaped), r"^/+", "")


def with_key_parts(df: DataFrame, key_col: str, segment_index: int = 0, output_prefix: str = "") -> DataFrame:
    """Add ``tenant``, ``rest``, ``bronze_key`` and ``reject_reason`` for a raw object key.

    A key without a tenant at ``segment_index`` or without a path after it is
    rejected (``reject_reason`` set, other columns NULL) rather than failing
    the job. Decoding and splitting are columns of their own, computed once.
    """
    prefix = output_prefix.strip("/")
    out = df.withColumn("__key", normalize_key(F.col(key_col)))
    out = out.withColumn("__parts", F.filter(F.split("__key", "/"), lambda p: p != ""))
    rest = F.array_join(F.slice("__parts", segment_index + 2, F.greatest(F.size("__parts"), F.lit(1))), "/")
    out = out.withColumns({"__tenant": F.get("__parts", segment_index), "__rest": F.nullif(rest, F.lit(""))})
    reason = (
        F.when(F.col("__key").isNull(), F.lit("undecodable key"))
        .when(F.col("__tenant").isNull(), F.lit("no tenant segment"))
        .when(F.col("__rest").isNull(), F.lit("no file path after tenant"))
    )
    out = out.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    file = F.concat(F.regexp_replace("__rest", _CAPTURE_EXT, ""), F.lit(".jsonl.gz"))
    bronze_key = F.concat_ws("/", "__tenant", *([F.lit(prefix)] if prefix else []), file)
    parts = {"tenant": F.when(ok, F.col("__tenant")), "rest": F.when(ok, F.col("__rest")), "bronze_key": F.when(ok, bronze_key)}
    return out.withColumns(parts).drop("__key", "__parts", "__tenant", "__rest")
