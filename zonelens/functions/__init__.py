"""Column -> Column building blocks (all native Catalyst expressions)."""

from zonelens.functions.bins import bins_literal, entropy_bin, equal_width_index, intent
from zonelens.functions.entropy import entropy_bits, entropy_norm, entropy_of_clean, entropy_raw, entropy_stripped
from zonelens.functions.names import (
    clean_host,
    day_of_week,
    domain_suffix_stats,
    has_invalid_chars,
    hour_of_day,
    is_high_entropy,
    is_idn,
    label_length_stats,
    label_lengths,
    name_length,
    norm_name,
    silver_name,
    strip_trailing_dot,
    subdomain_label_count,
)
from zonelens.functions.timefmt import epoch_to_iso, parse_event_ts

__all__ = [
    "bins_literal",
    "clean_host",
    "day_of_week",
    "domain_suffix_stats",
    "entropy_bin",
    "entropy_bits",
    "entropy_norm",
    "entropy_of_clean",
    "entropy_raw",
    "entropy_stripped",
    "epoch_to_iso",
    "equal_width_index",
    "has_invalid_chars",
    "hour_of_day",
    "intent",
    "is_high_entropy",
    "is_idn",
    "label_length_stats",
    "label_lengths",
    "name_length",
    "norm_name",
    "parse_event_ts",
    "silver_name",
    "strip_trailing_dot",
    "subdomain_label_count",
]
