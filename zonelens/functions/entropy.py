"""Shannon entropy of a string as a native Catalyst expression (no Python UDF).

For a string ``s`` of length ``n`` the entropy in bits per character is
``-sum(p * log2(p))`` over its distinct characters, with ``p = count / n``.
The count of a character is ``n - length(replace(s, ch, ''))``: a literal
(not regex) replace, so any character is safe.  Distinct characters keep their
sorted order, so names with the same character counts get bit-identical sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonelens.config import HOST_ENTROPY_MAX
from zonelens.functions.names import clean_host


def _entropy_nonempty(s: Column) -> Column:
    """Entropy of a string that is known to be non-null and non-empty.

    Null in, null out (every piece propagates null).
    """
    n = F.length(s)
    chars = F.filter(F.array_sort(F.array_distinct(F.split(s, ""))), lambda ch: ch != F.lit(""))

    def step(acc: Column, ch: Column) -> Column:
        p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.aggregate(chars, F.lit(0.0).cast("double"), step)


def entropy_of_clean(clean: Column) -> Column:
    """Entropy of an already cleaned component (see ``clean_host``); NULL stays NULL."""
    return _entropy_nonempty(clean)


def entropy_bits(c: Column) -> Column:
    """Entropy in bits/char over the cleaned host component; NULL if nothing is left."""
    return _entropy_nonempty(clean_host(c))


def entropy_norm(c: Column) -> Column:
    """Entropy divided by log2(37), the maximum for the cleaned alphabet."""
    return entropy_bits(c) / F.lit(HOST_ENTROPY_MAX)


def entropy_raw(c: Column) -> Column:
    """Entropy over the string as is: 0.0 for NULL or empty (the legacy variant)."""
    nonempty = F.when(F.length(c) > 0, c)
    return F.coalesce(_entropy_nonempty(nonempty), F.lit(0.0))


def entropy_stripped(c: Column, digits: int = 6) -> Column:
    """Entropy of the whitespace-stripped string rounded to ``digits``: NULL for NULL, 0.0 for blank."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    value = F.coalesce(_entropy_nonempty(F.when(F.length(t) > 0, t)), F.lit(0.0))
    return F.when(c.isNotNull(), F.round(value, digits))
