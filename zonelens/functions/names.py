"""Per-name scalar features as native Column expressions.

Every function maps Column -> Column, performs no action and holds no state,
so the expressions stay inside whole-stage codegen and can be used on a batch
or a streaming DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonelens.config import HIGH_ENTROPY_THRESHOLD


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_name(c: Column | str) -> Column:
    """Trimmed, lower-cased name (the dedupe / distinct-count key)."""
    return F.trim(F.lower(col_of(c)))


def silver_name(qname: Column | str = "qname", rrname: Column | str = "rrname") -> Column:
    """qname, else rrname; each trimmed and lower-cased."""
    return F.coalesce(norm_name(qname), norm_name(rrname))


def clean_host(c: Column | str) -> Column:
    """Lower-case, keep only [a-z0-9-] (dots go too); empty becomes NULL."""
    return F.nullif(F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9-]", ""), F.lit(""))


def has_invalid_chars(c: Column | str) -> Column:
    """True when the lower-cased name holds a character outside [a-z0-9.-]; NULL is False."""
    return F.coalesce(F.lower(col_of(c)).rlike("[^a-z0-9.-]"), F.lit(False))


def is_idn(c: Column | str) -> Column:
    """True when the name holds a punycode label marker ``xn--``; NULL is False."""
    return F.coalesce(F.lower(col_of(c)).contains("xn--"), F.lit(False))


def strip_trailing_dot(c: Column | str) -> Column:
    """Remove one trailing dot."""
    return F.regexp_replace(col_of(c), r"\.$", "")


def name_length(c: Column | str) -> Column:
    """Length after removing one trailing dot."""
    return F.length(strip_trailing_dot(c))


def label_lengths(c: Column | str) -> Column:
    """Lengths of the non-empty dot-separated labels."""
    return F.array_compact(F.transform(F.split(col_of(c), r"\."), lambda x: F.nullif(F.length(x), F.lit(0))))


def label_length_stats(c: Column | str) -> dict[str, Column]:
    """Label lengths, their extremes and mean (NULL without labels): array functions over one array.

    The labels' lengths add up to the name's length without its dots.
    """
    lengths = label_lengths(c)
    letters = F.length(F.translate(col_of(c), ".", ""))
    return {
        "qname_label_lengths": lengths,
        "qname_label_len_max": F.array_max(lengths),
        "qname_label_len_min": F.array_min(lengths),
        "qname_label_len_mean": letters / F.nullif(F.size(lengths), F.lit(0)),
    }


def domain_suffix_stats(domain: Column | str, suffix: Column | str) -> dict[str, Column]:
    """Mean, largest (0 without any) and smallest length of those of domain and suffix that are there."""
    parts = [col_of(domain), col_of(suffix)]
    lengths = F.array_compact(F.array(*[F.nullif(F.length(p), F.lit(0)) for p in parts]))
    return {
        "domain_suffix_len_mean": F.length(F.concat_ws("", *parts)) / F.nullif(F.size(lengths), F.lit(0)),
        "domain_suffix_len_max": F.coalesce(F.array_max(lengths), F.lit(0)),
        "domain_suffix_len_min": F.array_min(lengths),
    }


def subdomain_label_count(sub: Column | str, remove_wildcards: bool = False) -> Column:
    """Labels of a subdomain, counted as runs between dots; NULL, blank and the text "null" have none.

    With ``remove_wildcards`` labels that are a lone ``*`` do not count.
    """
    text = F.nullif(F.lower(col_of(sub)), F.lit("null"))
    count = F.regexp_count(F.trim(text), F.lit("[^.]+"))
    if remove_wildcards:
        count = count - F.regexp_count(F.trim(text), F.lit(r"(?<![^.])\*(?![^.])"))
    return F.coalesce(count, F.lit(0))


def is_high_entropy(entropy: Column | str, threshold: float = HIGH_ENTROPY_THRESHOLD) -> Column:
    return col_of(entropy) >= F.lit(threshold)


def hour_of_day(ts: Column | str) -> Column:
    return F.hour(col_of(ts))


def day_of_week(ts: Column | str) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(col_of(ts))
