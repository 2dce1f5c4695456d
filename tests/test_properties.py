"""Property tests: random names against independent Python implementations."""

import math

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.operators.suffix import add_domain_parts
from zonelens.sources.dims import SEED_SUFFIX_RULES, parse_suffix_rule, suffix_rules

RULES = [parse_suffix_rule(r) for r in SEED_SUFFIX_RULES.split()]
EXACT = {s for s, w, e in RULES if not w and not e}
WILD = {s for s, w, e in RULES if w}
EXC = {s for s, w, e in RULES if e}

LABELS = st.sampled_from(["com", "co", "uk", "org", "jp", "ck", "www", "mail", "a", "b1", "x-y", "example", "kawasaki", ""])
NAMES = st.lists(LABELS, min_size=1, max_size=6).map(".".join)


def py_parts(name):
    """Plain longest-match public-suffix split (independent of the Spark code)."""
    h = name.lower().strip()
    if h.endswith("."):
        h = h[:-1]  # exactly one trailing dot is removed
    if not h:
        return (None, None, None, None, 0)
    labels = h.split(".")
    n = len(labels)
    best = 0
    exc = None
    for j in range(1, n + 1):
        cand = ".".join(labels[n - j:])
        if cand in EXC:
            exc = j - 1 if exc is None else max(exc, j - 1)
        if cand in EXACT:
            best = max(best, j)
        if cand in WILD and n > j:
            best = max(best, j + 1)
    slen = exc if exc is not None else best
    suffix = ".".join(labels[n - slen:]) if slen > 0 else None
    d = n - slen
    domain = (labels[d - 1] or None) if d >= 1 else None
    sub = (".".join(labels[: d - 1]) or None) if d >= 2 else None
    root = f"{domain}.{suffix}" if domain and suffix else None
    return (sub, domain, suffix, root, len(sub.split(".")) if sub else 0)


def py_entropy(s):
    c = "".join(ch for ch in (s or "").lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789-")
    if not c:
        return None
    return -sum((c.count(x) / len(c)) * math.log2(c.count(x) / len(c)) for x in set(c))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(NAMES, min_size=50, max_size=80))
def test_domain_parts_match_python(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    out = add_domain_parts(df, suffix_rules(spark), max_depth=2).collect()
    for r in out:
        assert (r.subdomain, r.domain, r.suffix, r.root_domain, r.subdomain_label_count) == py_parts(r.qname), r.qname


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(st.text(alphabet="abcxyz019-._AZ", min_size=0, max_size=40), min_size=50, max_size=80))
def test_entropy_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", Z.entropy_bits(F.col("s")).alias("e")).collect():
        expect = py_entropy(r.s)
        assert (r.e is None) == (expect is None)
        if expect is not None:
            assert abs(r.e - expect) < 1e-12
