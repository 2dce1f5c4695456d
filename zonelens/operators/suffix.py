"""Domain parts by public-suffix rules (subdomain, domain, suffix, root domain).

Spark-first form of a suffix-list lookup: a rule dimension (bounded, size
checked, broadcast) and, per name, one left broadcast-hash join for each
candidate suffix length 1..K (K = deepest rule + 1 for wildcards). Each join is
a narrow probe of the same broadcast table, so the whole lookup is a single
pipelined stage: no shuffle, no explode and no re-aggregation, and the input's
partitioning is kept for whatever follows.

Rules (list semantics): the longest matching rule wins; ``*.x`` matches one
extra label in front of ``x``; an exception ``!a.x`` wins over everything and
makes ``x`` the suffix. A name with no matching rule has a NULL suffix, its
last label as domain and the rest as subdomain; a dotted-quad IPv4 address is
its own domain. A rule in another script also holds in its ``xn--`` form, the one that
names have on the wire: the rules (a few thousand) are converted, not the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.functions.idna import ascii_name
from zonelens.operators.joins import bounded_broadcast

# Bound on rule rows that may be broadcast (a full public-suffix list is ~10k rules).
MAX_RULES = 200_000

IPV4_RE = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"

PART_COLUMNS = ("subdomain", "domain", "suffix", "root_domain", "subdomain_label_count")


def host_of(name: Column) -> Column:
    """Lower-cased host of a name or URL: scheme, user info, path, port and one trailing dot removed."""
    h = F.lower(F.trim(name))
    h = F.regexp_replace(h, r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_extract(h, r"^([^/?#]*)", 1)
    h = F.regexp_replace(h, r"^[^@]*@", "")
    h = F.regexp_replace(h, r":[0-9]*$", "")
    return F.regexp_replace(h, r"\.$", "")


def rule_lookup(rules: DataFrame) -> DataFrame:
    """One row per rule text, and per ``xn--`` form of one, with its kinds: exact, wildcard parent, exception."""
    rule = F.lower("suffix")
    forms = rules.withColumn("rule", F.explode(F.array_distinct(F.array(rule, ascii_name(rule)))))
    return forms.groupBy("rule").agg(
        F.bool_or(~F.col("is_wildcard") & ~F.col("is_exception")).alias("exact"),
        F.bool_or("is_wildcard").alias("wild"),
        F.bool_or("is_exception").alias("exc"),
    )


def rule_depth(rules: DataFrame) -> int:
    """Deepest rule in labels (one scalar from the small rule dimension)."""
    depth = rules.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0]
    return int(depth or 1)


def add_domain_parts(
    df: DataFrame,
    rules: DataFrame,
    name_col: str = "qname",
    max_depth: int | None = None,
    prefix: str = "",
) -> DataFrame:
    """Add subdomain, domain, suffix, root_domain, subdomain_label_count for ``name_col``.

    ``max_depth`` (labels of the deepest rule) may be given to skip reading it
    from ``rules``. ``prefix`` is put in front of the output column names.
    """
    depth = (max_depth or rule_depth(rules)) + 1
    # Beyond the bound the probes are ordinary (shuffle) joins.
    lookup, _ = bounded_broadcast(rule_lookup(rules), MAX_RULES)

    tmp = "__dp_"
    h = F.col(f"{tmp}h")
    labels = F.col(f"{tmp}labels")
    n = F.size(labels)

    out = df.withColumn(f"{tmp}h", F.nullif(host_of(F.col(name_col)), F.lit(""))).withColumn(
        f"{tmp}labels", F.split(h, r"\.")
    )
    out = out.withColumns(
        {f"{tmp}c{j}": F.when(n >= j, F.array_join(F.slice(labels, -j, j), ".")) for j in range(1, depth + 1)}
    )
    for j in range(1, depth + 1):
        # The same broadcast lookup for every length (one exchange, reused);
        # its columns are renamed after the join.
        lk = lookup.alias(f"{tmp}l{j}")
        out = out.join(lk, out[f"{tmp}c{j}"] == F.col(f"{tmp}l{j}.rule"), "left").select(
            *[F.col(c) for c in out.columns],
            F.col(f"{tmp}l{j}.exact").alias(f"{tmp}e{j}"),
            F.col(f"{tmp}l{j}.wild").alias(f"{tmp}w{j}"),
            F.col(f"{tmp}l{j}.exc").alias(f"{tmp}x{j}"),
        )

    exc_len = F.greatest(*[F.when(F.col(f"{tmp}x{j}"), F.lit(j - 1)) for j in range(1, depth + 1)], F.lit(None).cast("int"))
    rule_len = F.greatest(
        *[F.when(F.col(f"{tmp}e{j}"), F.lit(j)) for j in range(1, depth + 1)],
        *[F.when(F.col(f"{tmp}w{j}") & (n > j), F.lit(j + 1)) for j in range(1, depth + 1)],
    )
    out = out.withColumn(f"{tmp}slen", F.coalesce(exc_len, rule_len, F.lit(0)))
    slen = F.col(f"{tmp}slen")
    is_ip = F.coalesce(h.rlike(IPV4_RE), F.lit(False))
    dom_idx = n - slen  # 1-based position of the domain label
    suffix = F.when(~is_ip & (slen > 0), F.array_join(F.slice(labels, -slen, slen), "."))
    domain = F.when(is_ip, h).when(h.isNotNull() & (dom_idx >= 1), F.nullif(F.element_at(labels, dom_idx), F.lit("")))
    subdomain = F.when(
        ~is_ip & h.isNotNull() & (dom_idx >= 2),
        F.nullif(F.array_join(F.slice(labels, 1, dom_idx - 1), "."), F.lit("")),
    )
    out = out.withColumns({f"{prefix}subdomain": subdomain, f"{prefix}domain": domain, f"{prefix}suffix": suffix})
    sub, dom, suf = F.col(f"{prefix}subdomain"), F.col(f"{prefix}domain"), F.col(f"{prefix}suffix")
    out = out.withColumns(
        {
            f"{prefix}root_domain": F.when(dom.isNotNull() & suf.isNotNull(), F.concat(dom, F.lit("."), suf)),
            f"{prefix}subdomain_label_count": F.when(sub.isNotNull(), F.size(F.split(sub, r"\."))).otherwise(F.lit(0)),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(tmp)])
