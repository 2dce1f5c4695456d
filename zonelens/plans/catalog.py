"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (the DNS stand-in derived from
``events`` x ``pages``, or other data Spark derives from them) over whole
tables. Doubles are rounded to 6 places so results compare across engines.
Nested gold outputs have a flat twin; the nested form is registered too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonelens import functions as Z
from zonelens.config import HIGH_ENTROPY_THRESHOLD
from zonelens.functions.keys import with_key_parts
from zonelens.operators import distributions as D
from zonelens.operators import features as G
from zonelens.operators import heavy as H
from zonelens.operators import kpis as K
from zonelens.operators import packets as P
from zonelens.operators import rankings as N
from zonelens.operators import silver as S
from zonelens.operators import templates as TPL
from zonelens.operators import uniques as U
from zonelens.plans import jobs
from zonelens.session import cut_lineage, ensure_checkpoint_dir
from zonelens.sources import lake
from zonelens.sources.bronze import derived_bronze, write_bronze
from zonelens.sources.derived import derived_answer_records, derived_object_keys, derived_packets
from zonelens.sources.dims import rule_text_depth, services, suffix_rules
from zonelens.sources.tables import dns_standin

QueryFn = Callable[[SparkSession, str], DataFrame]

SEED_DEPTH = rule_text_depth()
TEMPLATE_TENANT = "tenant-1"
TEMPLATE_LIMIT = 50


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dns_standin(spark, sf_dir)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-day rollup of the stand-in with every gold name feature."""
    return G.add_name_features(K.rollup_names(rows(spark, sf_dir)), suffix_rules(spark), max_depth=SEED_DEPTH)


def enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level enrichment (for operators whose output is per row)."""
    r = rows(spark, sf_dir).where(F.col("qname").isNotNull())
    return G.add_name_features(r, suffix_rules(spark), max_depth=SEED_DEPTH)


# --- KPIs -----------------------------------------------------------------


def q_risk_kpis(spark, sf_dir):
    return round_doubles(K.build_risk_kpis(enriched(spark, sf_dir)))


def q_base_kpis(spark, sf_dir):
    # Two branches read the rollup (the aggregation and the max-entropy name):
    # checkpoint it so the message rows are scanned and rolled up once.
    return round_doubles(K.build_base_kpis(cut_lineage(enriched(spark, sf_dir)), rows(spark, sf_dir)))


# --- name features ----------------------------------------------------------


def _distinct_names(spark, sf_dir):
    return rows(spark, sf_dir).where(F.col("qname").isNotNull()).select("qname").distinct()


def q_name_features(spark, sf_dir):
    df = G.add_name_features(_distinct_names(spark, sf_dir), suffix_rules(spark))
    return round_doubles(
        df.select(
            "qname",
            "qname_length",
            "qname_entropy",
            "qname_entropy_norm",
            "subdomain_entropy",
            "subdomain_entropy_norm",
            "is_apex",
            "has_invalid_chars",
            "is_high_entropy",
            "qname_entropy_bin",
            "subdomain_entropy_bin",
        ).distinct()
    )


def q_domain_parts(spark, sf_dir):
    from zonelens.operators.suffix import add_domain_parts

    df = add_domain_parts(_distinct_names(spark, sf_dir), suffix_rules(spark))
    return df.select("qname", "subdomain", "domain", "suffix", "root_domain", "subdomain_label_count")


# --- histograms, rankings, breakdowns -----------------------------------------


def q_hist_entropy_flat(spark, sf_dir):
    hist = D.entropy_histograms(enriched(spark, sf_dir))
    return round_doubles(D.histogram_flat(hist))


def q_topn_qnames(spark, sf_dir):
    return round_doubles(N.top_n_flat(enriched(spark, sf_dir), "qname", topn_type="top_qnames"))


def q_topn_qnames_rows(spark, sf_dir):
    # As in gold, the root's dot at the end is no part of a name.
    named = rows(spark, sf_dir).where(F.col("qname").isNotNull())
    named = named.withColumn("qname", Z.strip_trailing_dot(F.col("qname")))
    return H.top_n_from_rows(named, "qname", topn_type="top_qnames")


def q_topn_clients_rows(spark, sf_dir):
    return H.top_n_from_rows(rows(spark, sf_dir), "src_ip", topn_type="top_clients")


def q_topn_root_domains(spark, sf_dir):
    return round_doubles(N.top_n_flat(enriched(spark, sf_dir), "root_domain", topn_type="top_root_domains"))


def q_topn_high_entropy(spark, sf_dir):
    return round_doubles(N.high_entropy_flat(enriched(spark, sf_dir)))


def q_breakdowns_flat(spark, sf_dir):
    return D.breakdowns_flat(rows(spark, sf_dir))


# --- templates -----------------------------------------------------------------


def _template(name):
    def run(spark, sf_dir):
        return round_doubles(TPL.run_template(name, rows(spark, sf_dir), TEMPLATE_TENANT, TEMPLATE_LIMIT))

    return run


QUERIES: dict[str, QueryFn] = {
    "risk_kpis": q_risk_kpis,
    "base_kpis": q_base_kpis,
    "name_features": q_name_features,
    "domain_parts": q_domain_parts,
    "hist_entropy_flat": q_hist_entropy_flat,
    "topn_qnames": q_topn_qnames,
    "topn_qnames_rows": q_topn_qnames_rows,
    "topn_clients_rows": q_topn_clients_rows,
    "topn_root_domains": q_topn_root_domains,
    "topn_high_entropy": q_topn_high_entropy,
    "breakdowns_flat": q_breakdowns_flat,
    **{f"tpl_{n}": _template(n) for n in TPL.TEMPLATES},
}



def oracle_sql() -> dict[str, str]:
    from zonelens.plans import oracle as O

    sql = {
        "risk_kpis": O.risk_kpis_sql(),
        "base_kpis": O.base_kpis_sql(),
        "name_features": O.name_features_sql(),
        "domain_parts": O.domain_parts_sql(),
        "hist_entropy_flat": O.hist_flat_sql(),
        "topn_qnames": O.topn_sql("t_q"),
        "topn_qnames_rows": O.topn_sql("t_q"),
        "topn_clients_rows": O.topn_clients_sql(),
        "topn_root_domains": O.topn_sql("t_r"),
        "topn_high_entropy": O.topn_sql("t_h"),
        "breakdowns_flat": O.breakdowns_sql(),
    }
    for n in TPL.TEMPLATES:
        sql[f"tpl_{n}"] = O.template_sql(n, TEMPLATE_TENANT, TEMPLATE_LIMIT)
    sql.update(_oracle_batch2())
    sql.update(O.silver_sql())
    sql.update(O.packets_sql())
    sql["object_keys"] = O.object_keys_sql()
    sql["gold_wide"] = O.gold_wide_sql()
    sql["job_silver"] = sql["silver"]
    sql["job_gold"] = O.enr_query("SELECT * FROM hflat", O.hist_flat_ctes(), O.gold_enr_ctes())
    sql["job_gold_new"] = sql["gold_wide"]
    sql["gold_record_written"] = O.gold_record_written_sql(GOLD_RECORD_TENANT, GOLD_RECORD_DATE)
    sql["dashboard_parts"] = O.dashboard_parts_sql()
    sql["bins_measured"] = O.bins_measured_sql()
    sql["has_answer_within"] = O.has_answer_within_sql()
    sql["bronze_messages"] = O.bronze_messages_sql()
    sql["window_cardinality_approx"] = O.window_cardinality_approx_sql()
    sql["render_rdata"] = O.render_rdata_sql()
    sql["window_cardinality_rows"] = O.window_cardinality_rows_sql()
    return sql


# --- wide gold, dashboard, gold record ------------------------------------------

# Fixed value: the wide record's columns.
WIDE_SCALARS = [
    "tenant", "event_date", "total_queries", "unique_qnames", "unique_root_domains", "unique_subdomains",
    "unique_src_ips", "avg_qname_entropy", "max_qname_entropy", "avg_subdomain_entropy", "max_subdomain_entropy",
    "avg_subdomain_count", "max_subdomain_count", "answered_queries", "high_entropy_query_count",
    "high_entropy_query_ratio", "max_entropy_qname", "nxdomain_count", "nxdomain_ratio", "alert_high_entropy",
    "alert_nxdomain",
]


def answered_silver(spark, sf_dir):
    """The bronze-to-silver job's rows with ``has_answer``: id, and what gold reads; checkpointed, as every gold table reads them."""
    return cut_lineage(S.mark_answers_by_window(_silver(spark, sf_dir), jobs.ANSWER_SECONDS).select("id", *jobs.GOLD_COLUMNS))


def gold_run(spark, sf_dir):
    """Bronze -> silver -> gold: every gold table of the derived messages."""
    return jobs.gold_tables(answered_silver(spark, sf_dir), suffix_rules(spark), max_depth=SEED_DEPTH)


def q_gold_wide_scalars(spark, sf_dir):
    return round_doubles(gold_run(spark, sf_dir)["daily_aggregates"].select(*WIDE_SCALARS))


def _pairs_text(column: str, name: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws("=", x[name], x["count"].cast("string"))), ",")


def q_gold_wide(spark, sf_dir):
    """The wide record, its lists as text."""
    return _wide_text(gold_run(spark, sf_dir)["daily_aggregates"])


def _wide_text(wide: DataFrame) -> DataFrame:
    return round_doubles(wide).select(
        *WIDE_SCALARS,
        _pairs_text("top_qnames", "qname").alias("top_qnames"),
        _pairs_text("qname_entropy_histogram", "bin").alias("qname_histogram"),
        _pairs_text("subdomain_entropy_histogram", "bin").alias("subdomain_histogram"),
    )


def q_gold_top_qnames_flat(spark, sf_dir):
    wide = N.top_qnames_pairs(enriched(spark, sf_dir))
    return wide.select("tenant", "event_date", F.posexplode("top_qnames").alias("pos", "t")).select(
        "tenant", "event_date", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.qname").alias("qname"),
        F.col("t.count").alias("query_count"),
    )


def q_hist_wide_flat(spark, sf_dir):
    wide = D.entropy_histograms_wide(enriched(spark, sf_dir))
    z = F.arrays_zip(F.col("qname_entropy_histogram").alias("q"), F.col("subdomain_entropy_histogram").alias("s"))
    return wide.select("tenant", "event_date", F.posexplode(z).alias("bin_ord", "z")).select(
        "tenant", "event_date", F.col("bin_ord").cast("int").alias("bin_ord"), F.col("z.q.bin").alias("bin"),
        F.col("z.q.count").alias("qname_count"), F.col("z.s.count").alias("subdomain_count"),
    )


def q_dashboard(spark, sf_dir):
    g = gold_run(spark, sf_dir)
    return K.build_dashboard(g["base_kpis"], g["risk_kpis"], g["histograms"], g["topn"], g["breakdowns"])


GOLD_RECORD_TENANT, GOLD_RECORD_DATE = "tenant-1", "2024-01-15"


def q_gold_record(spark, sf_dir):
    """One tenant-day record, both keys filtered (never "the first row")."""
    risk = K.build_risk_kpis(enriched(spark, sf_dir))
    return round_doubles(
        risk.where((F.col("tenant") == GOLD_RECORD_TENANT) & (F.col("event_date") == F.lit(GOLD_RECORD_DATE).cast("date")))
    )


# --- rankings rebuilt / dashboard views ----------------------------------------------


def q_topn_high_entropy_rows(spark, sf_dir):
    return round_doubles(N.high_entropy_from_rows(enriched_rows(spark, sf_dir), HIGH_ENTROPY_THRESHOLD))


def _hist_flat(spark, sf_dir):
    return D.histogram_flat(D.entropy_histograms(enriched(spark, sf_dir)))


def q_hist_share(spark, sf_dir):
    return round_doubles(D.histogram_share(_hist_flat(spark, sf_dir)))


def q_high_entropy_pct(spark, sf_dir):
    return round_doubles(D.high_entropy_percent(_hist_flat(spark, sf_dir)))


def q_breakdown_view(spark, sf_dir):
    return D.breakdown_view(D.pack_breakdowns(D.breakdowns_flat(rows(spark, sf_dir))))


def q_ranking_view(spark, sf_dir):
    return round_doubles(D.ranking_view(N.build_topn(enriched(spark, sf_dir))))


def q_ranking_by_count(spark, sf_dir):
    return round_doubles(D.ranking_by_count(N.high_entropy_flat(enriched(spark, sf_dir))))


def q_names_by_length(spark, sf_dir):
    return TPL.names_by_length(TPL.qname_length(rows(spark, sf_dir), TEMPLATE_TENANT, TEMPLATE_LIMIT))


def _per_tenant_name_entropy(spark, sf_dir):
    from zonelens import functions as Z

    counts = rows(spark, sf_dir).where(F.col("qname").isNotNull()).groupBy("tenant", "qname").count()
    return counts.withColumn("avg_entropy", Z.entropy_bits(F.col("qname")))


def q_avg_entropy_histogram(spark, sf_dir):
    h = D.equal_width_histogram(_per_tenant_name_entropy(spark, sf_dir), "avg_entropy", k=10, keys=("tenant",))
    return round_doubles(h.drop("label"))


def q_name_length_histogram(spark, sf_dir):
    names = rows(spark, sf_dir).where(F.col("qname").isNotNull()).select("tenant", "qname").distinct()
    names = names.withColumn("qname_length", F.length("qname"))
    h = D.equal_width_histogram(names, "qname_length", k=20, keys=("tenant",))
    return round_doubles(h.drop("label"))


# --- grouped features -----------------------------------------------------------------


def q_root_cardinality(spark, sf_dir):
    df = G.add_root_cardinality(rows(spark, sf_dir), suffix_rules(spark), max_depth=SEED_DEPTH)
    return df.select("tenant", "event_date", "id", "qname", "root_domain", "root_domain_cardinality")


def q_time_features(spark, sf_dir):
    df = G.add_time_features(rows(spark, sf_dir).where(F.col("qname").isNotNull()))
    return df.select("tenant", "id", "qname", "hour_of_day", "day_of_week", "query_frequency", "unique_src_ips")


def daily_names(spark, sf_dir, by=("tenant",)):
    """The different names of each (``by``, day) with their domain parts."""
    return G.names_by_step(rows(spark, sf_dir), suffix_rules(spark), by, max_depth=SEED_DEPTH)


def q_window_cardinality(spark, sf_dir):
    agg = G.windowed_subdomain_counts(daily_names(spark, sf_dir), by=("tenant",))
    return agg.select(
        "tenant", "root_domain", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "root_subdomain_cardinality_window",
    )


def q_window_cardinality_sliding(spark, sf_dir):
    agg = G.windowed_subdomain_counts(daily_names(spark, sf_dir, ()), width="2 days", step="1 day")
    return agg.select(
        "root_domain", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "root_subdomain_cardinality_window",
    )


def q_window_cardinality_approx(spark, sf_dir):
    """Approximate counts beside the exact ones, and whether they are within three standard errors (and one) of them."""
    names, keys, rsd = cut_lineage(daily_names(spark, sf_dir)), ["tenant", "root_domain", "window"], 0.05
    near = G.windowed_subdomain_counts(names, by=("tenant",), max_error=rsd).withColumnRenamed(G.WINDOW_COUNT, "near")
    both = G.windowed_subdomain_counts(names, by=("tenant",)).join(near, keys)
    within = F.abs(F.col("near") - F.col(G.WINDOW_COUNT)) <= U.error_bound(F.col(G.WINDOW_COUNT), rsd)
    return both.select("tenant", "root_domain", F.col("window.start").alias("window_start"), G.WINDOW_COUNT, within.alias("within_bound"))


def q_window_cardinality_stored(spark, sf_dir):
    """G4 from stored sketches of the days, merged to sliding windows: exact counts, and whether the estimates are within bounds."""
    names, keys, rsd = cut_lineage(daily_names(spark, sf_dir, ())), ["root_domain", "window"], 0.05
    stored = cut_lineage(G.subdomain_sketches(names, "1 day", max_error=rsd))
    near = G.counts_from_sketches(stored, "2 days", "1 day").withColumnRenamed(G.WINDOW_COUNT, "near")
    both = G.windowed_subdomain_counts(names, "2 days", "1 day").join(near, keys)
    within = F.abs(F.col("near") - F.col(G.WINDOW_COUNT)) <= U.error_bound(F.col(G.WINDOW_COUNT), rsd)
    return both.select("root_domain", F.col("window.start").alias("window_start"), G.WINDOW_COUNT, within.alias("within_bound"))


def q_weekly_uniques(spark, sf_dir):
    """A1/A5 over weeks: exact distinct counts from the days' bitmaps, and whether those from the days' sketches are within bounds."""
    names, rsd = cut_lineage(enriched(spark, sf_dir).select(*K.KEYS, *U.UNIQUE_COLUMNS)), 0.02
    pairs = cut_lineage(U.value_pairs(names))
    days = cut_lineage(U.daily_bitmaps(pairs, cut_lineage(U.number_values(pairs))))
    week = F.trunc("event_date", "week").alias("week")
    exact = U.merge_bitmaps(days, ("tenant", week))
    near = U.merge_sketches(cut_lineage(U.daily_sketches(names, max_error=rsd)), ("tenant", week))
    both = K.join_records(exact, near.withColumnsRenamed({f"unique_{c}": f"near_{c}" for c in U.UNIQUE_COLUMNS}), ("tenant", "week"))
    within = [F.abs(F.col(f"near_{c}") - F.col(f"unique_{c}")) <= U.error_bound(F.col(f"unique_{c}"), rsd) for c in U.UNIQUE_COLUMNS]
    return both.select("tenant", "week", *[f"unique_{c}" for c in U.UNIQUE_COLUMNS], (within[0] & within[1] & within[2]).alias("within_bound"))


def q_subdomain_map(spark, sf_dir):
    # The map depends on names only: domain parts of the distinct (stripped) names suffice.
    from zonelens import functions as Z
    from zonelens.operators.suffix import add_domain_parts

    names = rows(spark, sf_dir).where(F.col("qname").isNotNull()).select(Z.strip_trailing_dot("qname").alias("qname")).distinct()
    return G.subdomain_map(add_domain_parts(names, suffix_rules(spark), max_depth=SEED_DEPTH))


# --- more scalar features ---------------------------------------------------------


def q_entropy_variants(spark, sf_dir):
    from zonelens import functions as Z

    names = _distinct_names(spark, sf_dir)
    return round_doubles(
        names.select(
            "qname",
            Z.entropy_raw(F.col("qname")).alias("entropy_raw"),
            Z.entropy_stripped(F.col("qname")).alias("entropy_stripped"),
            Z.entropy_bits(F.col("qname")).alias("entropy_bits"),
            Z.clean_host(F.col("qname")).alias("clean_host"),
        )
    )


def q_label_features(spark, sf_dir):
    from zonelens.operators.suffix import add_domain_parts

    df = G.add_label_features(add_domain_parts(_distinct_names(spark, sf_dir), suffix_rules(spark)))
    return round_doubles(
        df.select(
            "qname",
            F.array_join(F.transform("qname_label_lengths", lambda x: x.cast("string")), ",").alias("label_lengths"),
            "qname_label_len_max", "qname_label_len_min", "qname_label_len_mean",
            "domain_suffix_len_mean", "domain_suffix_len_max", "domain_suffix_len_min",
            "subdomain_label_count_clean", "is_idn",
        )
    )


QUERIES.update(
    {
        "gold_wide_scalars": q_gold_wide_scalars,
        "gold_wide": q_gold_wide,
        "gold_top_qnames_flat": q_gold_top_qnames_flat,
        "hist_wide_flat": q_hist_wide_flat,
        "dashboard": q_dashboard,
        "gold_record": q_gold_record,
        "topn_high_entropy_rows": q_topn_high_entropy_rows,
        "hist_share": q_hist_share,
        "high_entropy_pct": q_high_entropy_pct,
        "breakdown_view": q_breakdown_view,
        "ranking_view": q_ranking_view,
        "ranking_by_count": q_ranking_by_count,
        "names_by_length": q_names_by_length,
        "avg_entropy_histogram": q_avg_entropy_histogram,
        "name_length_histogram": q_name_length_histogram,
        "root_cardinality": q_root_cardinality,
        "time_features": q_time_features,
        "window_cardinality": q_window_cardinality,
        "window_cardinality_sliding": q_window_cardinality_sliding,
        "window_cardinality_approx": q_window_cardinality_approx,
        "window_cardinality_stored": q_window_cardinality_stored,
        "weekly_uniques": q_weekly_uniques,
        "subdomain_map": q_subdomain_map,
        "entropy_variants": q_entropy_variants,
        "label_features": q_label_features,
    }
)


def _oracle_batch2() -> dict[str, str]:
    from zonelens.plans import oracle as O

    return {
        "gold_wide_scalars": O.gold_wide_scalars_sql(),
        "gold_top_qnames_flat": O.enr_query(
            "SELECT tenant, event_date, rank, name AS qname, query_count FROM t_q", O.topn_ctes()
        ),
        "hist_wide_flat": O.hist_wide_flat_sql(),
        "gold_record": O.gold_record_sql(GOLD_RECORD_TENANT, GOLD_RECORD_DATE),
        "topn_high_entropy_rows": O.topn_sql("t_h"),
        "hist_share": O.hist_share_sql(),
        "high_entropy_pct": O.high_entropy_pct_sql(),
        "breakdown_view": O.breakdown_view_sql(),
        "ranking_view": O.ranking_view_sql(),
        "ranking_by_count": O.ranking_by_count_sql(),
        "names_by_length": O.names_by_length_sql(TEMPLATE_TENANT, TEMPLATE_LIMIT),
        "avg_entropy_histogram": O.avg_entropy_histogram_sql(),
        "name_length_histogram": O.name_length_histogram_sql(),
        "root_cardinality": O.root_cardinality_sql(),
        "time_features": O.time_features_sql(),
        "window_cardinality": O.window_cardinality_sql(),
        "window_cardinality_sliding": O.window_cardinality_sliding_sql(),
        "window_cardinality_stored": O.window_cardinality_stored_sql(),
        "weekly_uniques": O.weekly_uniques_sql(),
        "subdomain_map": O.subdomain_map_sql(),
        "entropy_variants": O.entropy_variants_sql(),
        "label_features": O.label_features_sql(),
    }


# --- bronze -> silver ----------------------------------------------------------------



def _flat(spark, sf_dir):
    return S.flatten_messages(S.add_event_date(derived_bronze(spark, sf_dir)))


def _silver(spark, sf_dir):
    return jobs.bronze_to_silver(derived_bronze(spark, sf_dir))


def _fields_text(column: str, names: tuple[str, ...]) -> Column:
    part = lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])
    return F.array_join(F.transform(column, lambda x: part(x)), "|")


def q_bronze_messages(spark, sf_dir):
    """Bronze messages, their questions and answers as text."""
    df = derived_bronze(spark, sf_dir)
    questions = _fields_text("questions", ("qname", "qtype", "qclass"))
    return df.withColumns({"questions": questions, "answers": _fields_text("answers", ("rrname", "rtype", "rclass", "ttl", "rdata"))})


def q_event_time(spark, sf_dir):
    return S.add_event_date(derived_bronze(spark, sf_dir)).select("tenant", "id", "qr", "event_ts", "event_date")


def q_drop_empty_queries(spark, sf_dir):
    return S.drop_empty_queries(derived_bronze(spark, sf_dir)).select("tenant", "id", "qr", "qdcount", "ancount")


def q_flatten_questions(spark, sf_dir):
    df = S.flatten_questions(S.add_event_date(derived_bronze(spark, sf_dir)))
    return df.select("tenant", "event_ts", "id", "qr", "rcode", "src_ip", "qname", "qtype", "qclass")


def q_flatten_answers(spark, sf_dir):
    df = S.flatten_answers(S.add_event_date(derived_bronze(spark, sf_dir)))
    return df.select("tenant", "event_ts", "id", "qr", "rrname", "rdata", "rtype", "rclass", "ttl")


def q_flatten_messages(spark, sf_dir):
    return _flat(spark, sf_dir).select(
        "tenant", "event_ts", "id", "qr", "qname", "qtype", "rrname", "rtype", "rdata", "ttl",
        "is_valid_question", "is_valid_answer",
    )


def q_explode_normalise(spark, sf_dir):
    df = S.elements_as_text(derived_bronze(spark, sf_dir), "answers", ["rrname", "rtype", "rdata", "ttl"], key="rrname")
    return df.select("tenant", "id", "qr", "rrname", "rtype", "rdata", "ttl")


def q_standardize_schema(spark, sf_dir):
    df = S.cast_columns(
        derived_bronze(spark, sf_dir),
        {"timestamp": "timestamp", "src_port": "string", "id": "bigint", "qdcount": "double", "absent": "int"},
        patterns={"timestamp": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    )
    return df.select("tenant", "timestamp", "src_port", "id", "qdcount")


def _split(i):
    def run(spark, sf_dir):
        return S.split_dataset(_flat(spark, sf_dir))[i].select("tenant", "event_ts", "id", "qname", "rrname")

    return run


def q_dedupe_hash(spark, sf_dir):
    return _silver(spark, sf_dir).select("silver_dedupe_hash", "name", "event_ts", "id", "qr")


def q_silver(spark, sf_dir):
    return _silver(spark, sf_dir).select(*S.SILVER_COLUMNS, "name")


def q_has_answer(spark, sf_dir):
    # Questions and answers both come from the deduplicated silver: checkpoint it once.
    silver = cut_lineage(_silver(spark, sf_dir))
    questions, answers = S.split_dataset(silver)
    marked = S.mark_answered(S.drop_null_qname(questions), answers, keys=("tenant", "id"))
    return marked.select("tenant", "event_date", "id", "qname", F.col("has_answer").cast("int").alias("has_answer"))


def q_has_answer_within(spark, sf_dir):
    marked = answered_silver(spark, sf_dir).where("qr = 0 AND qname IS NOT NULL")
    return marked.select("tenant", "event_date", "id", "qname", F.col("has_answer").cast("int").alias("has_answer"))


def q_silver_questions(spark, sf_dir):
    return S.drop_null_qname(_silver(spark, sf_dir)).select(*S.SILVER_COLUMNS, "name")


QUERIES.update(
    {
        "bronze_messages": q_bronze_messages,
        "event_time": q_event_time,
        "drop_empty_queries": q_drop_empty_queries,
        "flatten_questions": q_flatten_questions,
        "flatten_answers": q_flatten_answers,
        "flatten_messages": q_flatten_messages,
        "explode_normalise": q_explode_normalise,
        "standardize_schema": q_standardize_schema,
        "split_questions": _split(0),
        "split_answers": _split(1),
        "dedupe_hash": q_dedupe_hash,
        "silver": q_silver,
        "has_answer": q_has_answer,
        "has_answer_within": q_has_answer_within,
        "silver_questions": q_silver_questions,
    }
)


# --- decoded packets and object keys ----------------------------------------------------



def q_packets_classified(spark, sf_dir):
    return P.classify_packets(derived_packets(spark, sf_dir), services(spark))


def q_packet_class_counts(spark, sf_dir):
    return P.class_counts(q_packets_classified(spark, sf_dir))


def q_dns_packets(spark, sf_dir):
    from zonelens.functions.timefmt import epoch_to_iso

    p = derived_packets(spark, sf_dir).where(F.col("proto").isNotNull())
    name = P.protocol_name(F.col("proto"))
    return p.where(P.is_dns_packet(name, F.col("src_port"), F.col("dst_port"))).select(
        epoch_to_iso(F.col("epoch")).alias("timestamp"), "src_ip", "dst_ip", "src_port", "dst_port"
    )


def q_object_keys(spark, sf_dir):
    keys = derived_object_keys(spark, sf_dir)
    return with_key_parts(keys, "object_key").select("object_key", "tenant", "rest", "bronze_key", "reject_reason")


QUERIES.update(
    {
        "packets_classified": q_packets_classified,
        "packet_class_counts": q_packet_class_counts,
        "dns_packets": q_dns_packets,
        "object_keys": q_object_keys,
    }
)


def q_render_rdata(spark, sf_dir):
    r = derived_answer_records(spark, sf_dir)
    return r.select("tenant", "id", "rrname", "rtype", P.render_rdata(F.col("rtype"), F.col("rdata"), F.col("txt_chunks")).alias("rdata"))


QUERIES["render_rdata"] = q_render_rdata


# --- jobs on files ---------------------------------------------------------------------


def _messages_by(spark: SparkSession, bronze: DataFrame, folder: str, *by: str) -> DataFrame:
    """The messages, derived once, in partitions by tenant (and ``by``): each object is written from its own."""
    bronze.write.partitionBy("tenant", *by).parquet(f"{folder}/messages")
    return spark.read.schema(bronze.schema).parquet(f"{folder}/messages")


def _written_silver(spark, sf_dir) -> str:
    """Bronze JSON objects by tenant -> the silver job, run twice; returns the table's path."""
    folder = f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    # One object folder per tenant, as captures arrive: <tenant>/pcaps/<object>.
    bronze = _messages_by(spark, derived_bronze(spark, sf_dir), folder)
    for tenant in [f"tenant-{i}" for i in range(3)]:
        write_bronze(bronze.where(F.col("tenant") == tenant), f"{folder}/bronze/{tenant}/pcaps")
    root = folder if "://" in folder else f"file:{folder}" if not folder.startswith("file:") else folder
    for _ in range(2):
        jobs.run_silver(spark, f"{folder}/bronze", f"{folder}/silver", key_root=f"{root.replace('file://', 'file:')}/bronze/")
    return f"{folder}/silver"


def q_job_silver(spark, sf_dir):
    """The silver table as written by the job and read back."""
    silver = lake.read_partitioned(spark, _written_silver(spark, sf_dir))
    return silver.withColumn("event_date", F.col("event_date").cast("date")).select(*S.SILVER_COLUMNS, "name")


def q_job_gold(spark, sf_dir):
    """The gold job on the written silver, one tenant again (S4), and the typed histogram partitions read back."""
    silver = _written_silver(spark, sf_dir)
    gold = silver.removesuffix("silver") + "gold"
    for tenant in (None, "tenant-1"):
        paths = jobs.run_gold(spark, silver, gold, suffix_rules(spark), tenant)
    written = lake.read_partitioned(spark, paths["histograms"]).withColumn("event_date", F.col("event_date").cast("date"))
    return round_doubles(D.histogram_flat(written))


def _written_gold(spark, sf_dir) -> dict[str, str]:
    """S1-S5 as objects arrive: silver from new objects, gold of changed days, then a late object and both
    again, and once more without anything new; returns table -> path, and the gold folder as ``""``."""
    folder = f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    bronze, rules = derived_bronze(spark, sf_dir), suffix_rules(spark)
    # Replies of one tenant's day come late.
    late = (F.col("tenant") == "tenant-1") & F.col("timestamp").startswith("2024-01-15") & (F.col("qr") == 1)
    bronze = _messages_by(spark, bronze.withColumn("late", F.coalesce(late, F.lit(False))), folder, "late")
    root = folder if "://" in folder else f"file:{folder}" if not folder.startswith("file:") else folder
    paths = {}
    for delivery in (False, True, None):
        if delivery is not None:
            for tenant in [f"tenant-{i}" for i in range(3)]:
                part = bronze.where((F.col("tenant") == tenant) & (F.col("late") == delivery))
                write_bronze(part, f"{folder}/bronze/{tenant}/pcaps")
        jobs.run_silver_new(spark, f"{folder}/bronze", f"{folder}/silver", key_root=f"{root.replace('file://', 'file:')}/bronze/")
        paths.update(jobs.run_gold_new(spark, f"{folder}/silver", f"{folder}/gold", rules))
    return {**paths, "": f"{folder}/gold"}


def q_job_gold_new(spark, sf_dir):
    """The wide record as written by runs over changed days only; equal to that of all rows at once."""
    written = lake.read_partitioned(spark, _written_gold(spark, sf_dir)["daily_aggregates"])
    return _wide_text(written.withColumn("event_date", F.col("event_date").cast("date")))


def q_gold_record_written(spark, sf_dir):
    """One tenant-day of the written risk KPIs, both partition keys filtered at the scan."""
    record = lake.read_gold_record(spark, _written_gold(spark, sf_dir)["risk_kpis"], GOLD_RECORD_TENANT, GOLD_RECORD_DATE)
    return round_doubles(record.withColumn("event_date", F.col("event_date").cast("date")))


def q_dashboard_parts(spark, sf_dir):
    """All dashboard records read from the five written gold tables, a row for each number they hold."""
    records = jobs.read_dashboard(spark, _written_gold(spark, sf_dir)[""])

    def rows_of(column: str, kind: str, entries: str, position: str | None, item: str, count: str) -> DataFrame:
        lists = records.select(*K.KEYS, F.explode(column).alias("x")).select(*K.KEYS, f"x.{kind}", F.posexplode(f"x.{entries}").alias("i", "e"))
        place = F.col(f"e.{position}") if position else F.col("i")
        value = F.col(f"e.{count}").cast("double").alias("value")
        return lists.select(*K.KEYS, F.col(kind).alias("part"), place.cast("int").alias("position"), F.col(f"e.{item}").cast("string").alias("item"), value)

    def numbers_of(column: str) -> DataFrame:
        fields = [f for f in records.schema[column].dataType.fields if not isinstance(f.dataType, T.StringType)]
        pairs = F.array(*[F.struct(F.lit(f.name).alias("item"), F.col(f"{column}.{f.name}").cast("double").alias("value")) for f in fields])
        one = records.select(*K.KEYS, F.lit(column).alias("part"), F.lit(0).alias("position"), F.inline(pairs))
        return one.where(F.col("value").isNotNull())

    def text_of(column: str) -> DataFrame:
        fields = [f.name for f in records.schema[column].dataType.fields if isinstance(f.dataType, T.StringType)]
        pairs = F.array(*[F.concat(F.lit(f"{n}="), F.col(f"{column}.{n}")) for n in fields])
        one = records.select(*K.KEYS, F.lit(column).alias("part"), F.lit(0).alias("position"), F.explode(pairs).alias("item"))
        return one.select("*", F.lit(0.0).alias("value")).where(F.col("item").isNotNull())

    parts = [
        rows_of("histograms", "entropy_type", "histogram", None, "bin", "count"),
        rows_of("rankings", "topN_type", "topN", "rank", "name", "query_count"),
        rows_of("breakdowns", "breakdown_type", "breakdown", None, "code", "count").withColumn("position", F.lit(0)),
        *[f(c) for c in ("base_kpis", "risk_kpis") for f in (numbers_of, text_of)],
    ]
    return round_doubles(reduce(DataFrame.unionByName, parts))


def q_bins_measured(spark, sf_dir):
    """H1: the bin dimension, and how many different names of the stand-in are in each bin."""
    names = G.add_name_features(_distinct_names(spark, sf_dir), suffix_rules(spark), max_depth=SEED_DEPTH).groupBy(F.col("qname_entropy_bin").alias("__bin"))
    # Null-safe: a plain join would have the bin's "is not null" evaluated on every raw row.
    same = F.col("bin").eqNullSafe(F.col("__bin"))
    bins = D.bins_frame(spark).join(names.agg(F.countDistinct("qname").alias("names")), same, "left")
    return bins.select(F.col("ord").cast("int").alias("ord"), "bin", F.col("lower").cast("double").alias("lower"), F.coalesce("names", F.lit(0)).cast("long").alias("names"))


QUERIES["job_gold_new"] = q_job_gold_new
QUERIES["gold_record_written"] = q_gold_record_written
QUERIES["dashboard_parts"] = q_dashboard_parts
QUERIES["bins_measured"] = q_bins_measured
QUERIES["job_silver"] = q_job_silver
QUERIES["job_gold"] = q_job_gold


# --- contract wrapper ------------------------------------------------------------------


def _in_utc(fn: QueryFn) -> QueryFn:
    """Run a registered query with session time zone UTC (dates and windows are UTC days)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


QUERIES = {name: _in_utc(fn) for name, fn in QUERIES.items()}


def q_window_cardinality_rows(spark, sf_dir):
    """G4 joined back: every row with a root and subdomain gets its (tenant, root, day) count."""
    df = G.add_windowed_subdomain_counts(enriched_rows(spark, sf_dir), by=("tenant",))
    return df.select("tenant", "id", "qname", "root_domain", "root_subdomain_cardinality_window")


QUERIES["window_cardinality_rows"] = _in_utc(q_window_cardinality_rows)
