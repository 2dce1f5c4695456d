"""Parameters and fixed values shared by all operators.

Everything here is plain data; operators take these as defaults and accept
overrides, so no threshold is buried inside an expression.
"""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for matching results.
# ---------------------------------------------------------------------------

# Alphabet of a cleaned host name component (RFC 1035 letters, digits, hyphen).
HOST_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-"
# Maximum entropy of a cleaned component: log2(37).
HOST_ENTROPY_MAX = math.log2(len(HOST_ALPHABET))

# Gold-job parameters.
HIGH_ENTROPY_THRESHOLD = 3.5
HIGH_ENTROPY_ALERT = 0.10
NXDOMAIN_ALERT = 0.15
NXDOMAIN_RCODE = 3
LONG_NAME_LENGTH = 80
TOP_N = 10

# Intent thresholds, (warn, alert) per measure, in the reference's order.
INTENT_THRESHOLDS: dict[str, tuple[float, float]] = {
    "high_entropy_query_ratio": (0.15, 0.25),
    "max_qname_entropy": (3.8, 4.2),
    "nxdomain_ratio": (0.20, 0.40),
    "unique_query_ratio": (0.60, 0.80),
    "long_query_ratio": (0.15, 0.30),
    "invalid_char_ratio": (0.05, 0.10),
    "apex_ratio": (0.50, 0.70),
    "avg_query_length": (35, 45),
}

# Entropy bins in bits: (label, lower inclusive, upper exclusive).
ENTROPY_BINS: list[tuple[str, float, float]] = [
    ("0.0–0.5", 0.0, 0.5),
    ("0.5–1.0", 0.5, 1.0),
    ("1.0–1.5", 1.0, 1.5),
    ("1.5–2.0", 1.5, 2.0),
    ("2.0–2.5", 2.0, 2.5),
    ("2.5–3.0", 2.5, 3.0),
    ("3.0–4.0", 3.0, 4.0),
    ("4.0–5.0", 4.0, 5.0),
    ("5.0+", 5.0, math.inf),
]
# Dashboard: lower bound from which a bin counts as "high entropy".
HIGH_ENTROPY_BIN_FLOOR = 3.0

# IANA protocol numbers named by the packet classifier; others print as the number.
IP_PROTOCOL_NAMES: dict[int, str] = {
    1: "ICMP",
    2: "IGMP",
    6: "TCP",
    17: "UDP",
    41: "IPv6",
    89: "OSPF",
}

# Template row limits.
TEMPLATE_LIMIT_DEFAULT = 50
TEMPLATE_LIMIT_MAX = 10_000

# Placeholder written into missing fields by explode-and-normalise.
MISSING_PLACEHOLDER = "-"

# Labels of the long-form gold tables.
