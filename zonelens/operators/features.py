"""Name features on a DataFrame, and the grouped features joined back to rows.

Scalar features are native expressions (entropy, length, flags, bins); domain
parts come from the broadcast suffix lookup. Grouped features (G1-G5) are a
partial aggregation followed by a join back on the group key; the grouped side
is unique per key, so the join never multiplies rows, and AQE turns it into a
broadcast join when the measured side is small or splits a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.config import HIGH_ENTROPY_THRESHOLD, HOST_ENTROPY_MAX
from zonelens.operators.joins import join_back
from zonelens.operators.suffix import add_domain_parts
from zonelens.operators.uniques import lg_k_for
from zonelens.session import cut_lineage

KEYS = ("tenant", "event_date")


def add_name_features(
    df: DataFrame,
    rules: DataFrame,
    name_col: str = "qname",
    high_entropy_threshold: float = HIGH_ENTROPY_THRESHOLD,
    max_depth: int | None = None,
) -> DataFrame:
    """All per-name features used by the gold tables.

    Removes one trailing dot from ``name_col`` (as the gold job does), then
    adds qname_length, domain parts, qname/subdomain entropy (bits and norm),
    is_apex, has_invalid_chars (0/1), is_high_entropy and the two entropy bins.
    """
    q = F.col(name_col)
    out = df.withColumn(name_col, Z.strip_trailing_dot(q)).withColumn("qname_length", F.length(q))
    out = add_domain_parts(out, rules, name_col=name_col, max_depth=max_depth)
    sub = F.col("subdomain")
    # Cleaned components are materialised once; the entropy lambdas read them.
    out = out.withColumns({"__cq": Z.clean_host(q), "__cs": Z.clean_host(sub)})
    out = out.withColumns(
        {
            "qname_entropy": Z.entropy_of_clean(F.col("__cq")),
            "subdomain_entropy": Z.entropy_of_clean(F.col("__cs")),
            "is_apex": sub.isNull() | (sub == F.lit("")),
            "has_invalid_chars": Z.has_invalid_chars(q).cast("int"),
        }
    )
    e, se = F.col("qname_entropy"), F.col("subdomain_entropy")
    return out.withColumns(
        {
            "qname_entropy_norm": e / F.lit(HOST_ENTROPY_MAX),
            "subdomain_entropy_norm": se / F.lit(HOST_ENTROPY_MAX),
            "is_high_entropy": Z.is_high_entropy(e, high_entropy_threshold),
            "qname_entropy_bin": Z.entropy_bin(e),
            "subdomain_entropy_bin": Z.entropy_bin(se),
        }
    ).drop("__cq", "__cs")


def add_label_features(df: DataFrame, name_col: str = "qname") -> DataFrame:
    """Label length array and stats (F9), domain/suffix stats (F10), cleaned subdomain count (F12), IDN flag."""
    out = df.withColumns(Z.label_length_stats(F.col(name_col)))
    if "domain" in df.columns and "suffix" in df.columns:
        out = out.withColumns(Z.domain_suffix_stats("domain", "suffix"))
    if "subdomain" in df.columns:
        out = out.withColumn("subdomain_label_count_clean", Z.subdomain_label_count("subdomain"))
    return out.withColumn("is_idn", Z.is_idn(F.col(name_col)))


def root_domain_cardinality(df: DataFrame, root_col: str = "root_domain", sub_col: str = "subdomain") -> DataFrame:
    """G1: distinct subdomains per root domain, joined back; NULL root keeps NULL."""
    card = df.groupBy(root_col).agg(F.countDistinct(sub_col).alias("root_domain_cardinality"))
    return join_back(df, card, [root_col])


def add_time_features(
    df: DataFrame,
    name_col: str = "qname",
    ts_col: str = "event_ts",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """G2/G3 + F13: hour, weekday, and per-name distinct ids and source IPs, joined back.

    ``keys`` narrows the per-name counts to e.g. (tenant, event_date); the
    default counts over the whole frame, as the reference does.
    """
    ts = F.col(ts_col)
    out = df.withColumns({"hour_of_day": Z.hour_of_day(ts), "day_of_week": Z.day_of_week(ts)})
    group = [*keys, name_col]
    per_name = df.groupBy(*group).agg(
        F.countDistinct("id").alias("query_frequency"),
        F.countDistinct("src_ip").alias("unique_src_ips"),
    )
    return join_back(out, per_name, group)


WINDOW_COUNT = "root_subdomain_cardinality_window"


def _with_subdomain(df: DataFrame, root_col: str, sub_col: str, min_length: int, wildcards: bool) -> DataFrame:
    """Rows with a root and a subdomain, the latter cleaned in ``__sub``: lower-cased, without empty labels."""
    labels = F.regexp_extract_all(F.lower(sub_col), F.lit("[^.]+"), F.lit(0))
    labels = labels if wildcards else F.array_remove(labels, "*")
    rows = df.where(F.col(root_col).isNotNull()).withColumn("__sub", F.array_join(labels, "."))
    return rows.where(F.length("__sub") >= min_length)


def windowed_subdomain_counts(
    df: DataFrame,
    width: str = "1 day",
    step: str | None = None,
    by: tuple[str, ...] = (),
    time_col: str = "event_ts",
    root_col: str = "root_domain",
    sub_col: str = "subdomain",
    max_error: float | None = None,
    min_length: int = 1,
    wildcards: bool = True,
) -> DataFrame:
    """Different subdomains per (``by``, root, time window), one row per window.

    First the different subdomains of each ``step`` of time are found (raw rows
    are read once, however many windows overlap), then they are put into the windows of ``width`` (a multiple of ``step``) that cover
    the step. Subdomains are lower-cased without empty labels (``wildcards=False``:
    without lone ``*``); rows without a root or with a subdomain shorter than
    ``min_length`` are left out. ``max_error`` (a relative standard error) asks for
    approximate counts, from the sketches of the steps.
    """
    group = [*by, root_col]
    if max_error is not None:
        scope = {"root_col": root_col, "sub_col": sub_col, "min_length": min_length, "wildcards": wildcards}
        return counts_from_sketches(subdomain_sketches(df, step or width, by, time_col, max_error, **scope), width, step, by, root_col)
    rows = _with_subdomain(df, root_col, sub_col, min_length, wildcards)
    seen = rows.select(*group, F.window(time_col, step or width).getField("start").alias("__step"), "__sub").distinct()
    covering = F.window("__step", width, step or width)
    return seen.groupBy(*group, covering.alias("window")).agg(F.countDistinct("__sub").alias(WINDOW_COUNT))


def subdomain_sketches(
    df: DataFrame,
    step: str = "1 day",
    by: tuple[str, ...] = (),
    time_col: str = "event_ts",
    max_error: float = 0.05,
    root_col: str = "root_domain",
    sub_col: str = "subdomain",
    min_length: int = 1,
    wildcards: bool = True,
) -> DataFrame:
    """G4 to be stored: a sketch of the different subdomains per (``by``, root, ``step`` of time).

    Rows (by, root, step, subdomains). Days are appended as they come; windows, weeks and
    reruns merge the sketches (``counts_from_sketches``) and never read the rows again.
    """
    rows = _with_subdomain(df, root_col, sub_col, min_length, wildcards)
    start = F.window(time_col, step).getField("start").alias("step")
    return rows.groupBy(*by, root_col, start).agg(F.hll_sketch_agg("__sub", lg_k_for(max_error)).alias("subdomains"))


def counts_from_sketches(
    sketches: DataFrame, width: str = "1 day", step: str | None = None, by: tuple[str, ...] = (), root_col: str = "root_domain"
) -> DataFrame:
    """G4 from stored sketches of ``step``: approximate counts per (``by``, root, window of ``width``)."""
    covering = F.window("step", width, step or width).alias("window")
    return sketches.groupBy(*by, root_col, covering).agg(F.hll_sketch_estimate(F.hll_union_agg("subdomains")).alias(WINDOW_COUNT))


def names_by_step(rows: DataFrame, rules: DataFrame, by: tuple[str, ...] = (), step: str = "1 day", name_col: str = "qname",
                  time_col: str = "event_ts", max_depth: int | None = None) -> DataFrame:
    """What G4 reads, from raw rows: the different names of each (``by``, ``step`` of time) with their domain parts.

    Rows collapse to names before the suffix lookup, so a hot name is looked up once per step.
    ``time_col`` holds the step's start.
    """
    named = rows.where(F.col(name_col).isNotNull())
    start = F.window(time_col, step).getField("start").alias(time_col)
    names = named.select(*by, start, Z.strip_trailing_dot(F.col(name_col)).alias(name_col)).distinct()
    return add_domain_parts(names, rules, name_col=name_col, max_depth=max_depth)


def add_root_cardinality(rows: DataFrame, rules: DataFrame, name_col: str = "qname", max_depth: int | None = None) -> DataFrame:
    """G1 on raw rows with a name: their root domain and its distinct subdomains (NULL for a NULL root).

    Both depend on the name only: they are found for the different names, and the rows join once, on the name.
    """
    named = rows.where(F.col(name_col).isNotNull()).withColumn(name_col, Z.strip_trailing_dot(F.col(name_col)))
    names = add_domain_parts(named.select(name_col).distinct(), rules, name_col=name_col, max_depth=max_depth)
    names = names.select(name_col, "root_domain", "subdomain")
    counted = root_domain_cardinality(names).select(name_col, "root_domain", "root_domain_cardinality")
    return join_back(named, counted, [name_col])


def add_windowed_subdomain_counts(
    df: DataFrame, width: str = "1 day", step: str | None = None, by: tuple[str, ...] = (), time_col: str = "event_ts",
    root_col: str = "root_domain", sub_col: str = "subdomain", min_length: int = 1, wildcards: bool = True, **options,
) -> DataFrame:
    """G4 on rows: each row that G4 counts, once per window that covers it, with the window's count."""
    scope = {"root_col": root_col, "sub_col": sub_col, "min_length": min_length, "wildcards": wildcards}
    counts = windowed_subdomain_counts(df, width, step, by, time_col, **scope, **options)
    rows = _with_subdomain(df, **scope).drop("__sub").withColumn("window", F.window(time_col, width, step or width))
    return join_back(rows, counts, [*by, root_col, "window"])


def subdomain_map(df: DataFrame, root_col: str = "root_domain", sub_col: str = "subdomain") -> DataFrame:
    """Root domain -> its distinct subdomains, one row per pair (NULL roots left out).

    The mapping stays distributed: a root with millions of subdomains is many
    rows, never one collected list or one window partition. ``subdomain_count``
    (the list's size) comes from a partial aggregation joined back on the root.
    """
    # Checkpointed: the pairs and their sizes read them.
    pairs = cut_lineage(
        df.where(F.col(root_col).isNotNull() & F.col(sub_col).isNotNull() & (F.col(sub_col) != ""))
        .select(F.col(root_col).alias("root_domain"), F.col(sub_col).alias("subdomain"))
        .distinct()
    )
    sizes = pairs.groupBy("root_domain").agg(F.count(F.lit(1)).alias("subdomain_count"))
    return join_back(pairs, sizes, ["root_domain"], "inner")
