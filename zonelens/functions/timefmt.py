"""Time normalisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 without zone; the fraction is optional (the writer leaves it out at whole seconds).
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
# Unix time as text: by size it is in seconds, milliseconds or microseconds. Fixed values:
# below 1e11 seconds (year 5138), below 1e14 milliseconds, below 1e17 microseconds.
EPOCH_UNITS = ((1e11, 1_000_000), (1e14, 1_000), (1e17, 1))


def parse_event_ts(c: Column) -> Column:
    """ISO-8601 text (micros optional), else Unix time as text (see ``EPOCH_UNITS``; fraction kept), else NULL."""
    # Text without the pattern's T cannot match it: a failed parse costs an exception a row.
    iso = F.when(F.contains(F.upper(c), F.lit("T")), F.try_to_timestamp(c, F.lit(ISO_PATTERN)))
    number = c.try_cast("double")
    micros = F.coalesce(*[F.when(F.abs(number) < F.lit(limit), F.round(number * factor)) for limit, factor in EPOCH_UNITS])
    return F.coalesce(iso, F.timestamp_micros(micros.cast("long")))


def epoch_to_iso(epoch_seconds: Column) -> Column:
    """Unix seconds (double) -> ISO-8601 UTC text; micros left out at whole seconds."""
    micros = F.round(epoch_seconds * 1_000_000).cast("long")
    ts = F.timestamp_micros(micros)
    whole = (micros % F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
