"""End-to-end runs: bronze -> silver, silver -> the five gold tables (+ wide record).

Gold plan (the scale design in one place):

1. silver rows (tenant / date partitions pruned) -> one partial aggregation to
   (tenant, event_date, qname, name) with counts: the only wide shuffle of the
   fact rows, skew-safe because hot names collapse map-side;
2. name features on that rollup: native expressions plus broadcast probes of
   the bounded suffix-rule table (narrow, keeps the rollup's partitioning);
3. a reliable checkpoint of the enriched rollup into ``spark.checkpoint.dir``
   (it feeds five outputs and must survive lost executors);
4. one aggregation of the checkpoint per (tenant, event_date) computes every
   per-day measure (KPIs, wide record, histogram bins); the tables are
   projections of it, plus the top-N windows and the max-entropy name; source
   IPs and breakdowns are partial aggregations over narrow column sets of the
   silver rows; writes overwrite only the partitions they produce.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.functions.keys import with_key_parts
from zonelens.operators import distributions as D
from zonelens.operators import features as G
from zonelens.operators import kpis as K
from zonelens.operators import rankings as N
from zonelens.operators import silver as S
from zonelens.session import cut_lineage
from zonelens.sources import lake
from zonelens.sources.bronze import read_bronze

GOLD_TABLES = ("base_kpis", "risk_kpis", "histograms", "topn", "breakdowns")
TYPE_COLUMNS = {"histograms": "entropy_type", "topn": "topN_type", "breakdowns": "breakdown_type"}


# Answered silver columns that the gold tables are made from.
GOLD_COLUMNS = ("tenant", "event_date", "qname", "src_ip", "qr", "qtype", "rcode", "has_answer")

# A reply within this time answers its query.
ANSWER_SECONDS = 5.0


def append_answered(spark: SparkSession, arrived: DataFrame, silver_path: str, answered_path: str, answer_seconds: float = ANSWER_SECONDS) -> None:
    """B11 as messages arrive: append the (tenant, event_date, hash) of stored questions that are answered now.

    ``arrived``: silver rows that have just been stored. Only stored rows that share tenant,
    id, client, server and name with one of them, of the days up to one day around them, are looked
    at, so questions and replies may arrive in any order and any number of batches apart; a
    question is appended once.
    """
    client, server = S.client_and_server()
    ends = ["tenant", "id", "__client", "__server", "qname"]
    arrived = cut_lineage(arrived.withColumns({"__client": client, "__server": server}).select(*ends, "event_date").distinct())
    days = arrived.select("tenant", F.explode(F.array(*[F.date_add("event_date", n) for n in (-1, 0, 1)])).alias("event_date")).distinct()
    columns = [*lake.PARTITION_KEYS, "silver_dedupe_hash", "id", "qr", "src_ip", "dst_ip", "qname", "rrname", "event_ts"]
    stored = lake.read_partitioned(spark, silver_path).select(*columns).join(days, list(lake.PARTITION_KEYS), "left_semi")
    stored = stored.withColumns({"__client": client, "__server": server}).join(arrived.select(*ends).distinct(), ends, "left_semi")
    answered = S.mark_answers_by_window(stored, answer_seconds).where("has_answer = 1").select(*lake.PARTITION_KEYS, "silver_dedupe_hash")
    lake.append_new(spark, answered, answered_path)


def read_answered(spark: SparkSession, silver_path: str, answered_path: str) -> DataFrame:
    """Stored silver rows with ``has_answer`` as ``append_answered`` has found it."""
    keys = [*lake.PARTITION_KEYS, "silver_dedupe_hash"]
    answered = spark.read.schema("silver_dedupe_hash string, tenant string, event_date date").parquet(answered_path)
    marked = lake.read_partitioned(spark, silver_path).join(answered.select(*keys).withColumn("has_answer", F.lit(1)), keys, "left")
    return marked.withColumn("has_answer", F.coalesce("has_answer", F.lit(0)))


def with_tenant(bronze: DataFrame, tenant: str | None = None, segment_index: int = 0, key_root: str = "") -> DataFrame:
    """Bronze with ``tenant``: the given one, or (unless it is there) that of each file's object key (S7);
    rows of rejected keys have none."""
    if tenant is not None:
        return bronze.withColumn("tenant", F.lit(tenant))
    if "tenant" in bronze.columns:
        return bronze
    root = "^" + re.escape(key_root) if key_root else r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+[^/]*/"
    keyed = bronze.withColumn("__object", F.regexp_replace("source_file", root, ""))
    return with_key_parts(keyed, "__object", segment_index).drop("__object", "rest", "bronze_key", "reject_reason")


def bronze_to_silver(bronze: DataFrame, tenant: str | None = None, segment_index: int = 0, key_root: str = "") -> DataFrame:
    """Well-formed bronze messages -> silver rows (queries without a question are left out)."""
    good, _ = S.split_corrupt(bronze)
    messages = S.drop_empty_queries(with_tenant(good, tenant, segment_index, key_root))
    return S.convert_to_silver(S.flatten_messages(messages))


_UNREAD = "__unread"


def _with_unread(bronze: DataFrame) -> DataFrame:
    """Marks well-formed messages with a time that cannot be read."""
    unread = F.col("_corrupt_record").isNull() & F.col("timestamp").isNotNull() & Z.parse_event_ts(F.col("timestamp")).isNull()
    return bronze.withColumn(_UNREAD, unread)


def _rejects(marked: DataFrame) -> DataFrame:
    """Rejects of ``_with_unread`` rows, by one pass over them."""
    malformed = F.col("_corrupt_record").isNotNull()
    reason = F.when(malformed, "malformed line").otherwise("unreadable time, kept without a day")
    columns = [c for c in marked.columns if c not in ("_corrupt_record", _UNREAD)]
    return marked.where(malformed | F.col(_UNREAD)).select(*columns, "_corrupt_record", reason.alias("reject_reason"))


def split_rejects(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed messages, rejects): malformed lines, lines with a badly typed field, and unreadable times."""
    return S.split_corrupt(bronze)[0], _rejects(_with_unread(bronze))


def run_silver(
    spark: SparkSession,
    bronze_path: str | list[str],
    silver_path: str,
    tenant: str | None = None,
    reject_path: str | None = None,
    idempotent: bool = True,
    **key_opts,
) -> dict[str, int]:
    """Bronze folder (or objects) -> appended silver, and rejects as JSON under ``reject_path``
    (``<silver_path>_rejects`` unless given). Returns how many lines were read,
    malformed, well-formed and without a readable time: malformed + messages = lines.

    With ``idempotent`` rows already stored (same tenant, day and content
    hash) are not appended again, so re-running an object adds nothing.
    """
    bronze = read_bronze(spark, bronze_path)
    # All fields are read for the rejects, so a line is malformed by any of them; the same pass counts.
    lines, counts = _counted(_with_unread(bronze))
    _rejects(lines).write.mode("append").json(reject_path or f"{silver_path.rstrip('/')}_rejects")
    silver = bronze_to_silver(bronze, tenant, **key_opts)
    if idempotent:
        lake.append_new(spark, silver, silver_path)
    else:
        lake.write_silver(silver, silver_path)
    return _line_counts(counts)


# Objects taken in at a time: bounds what the driver is told of a listing.
OBJECTS_AT_ONCE = 10_000


def run_silver_new(
    spark: SparkSession,
    bronze_path: str,
    silver_path: str,
    tenant: str | None = None,
    reject_path: str | None = None,
    ledger_path: str | None = None,
    objects_at_once: int = OBJECTS_AT_ONCE,
    **key_opts,
) -> dict[str, int]:
    """``run_silver`` of the objects that have not been taken in yet, so known ones are not opened again.

    The ledger (``<silver_path>_ledger`` unless given) holds path, size and time of each object taken
    in; it is written after the rows, so a run that fails in between reads its objects again
    and, rows being compared by their hash, adds nothing twice. An object that has
    changed is taken in again. Objects are read in lots of ``objects_at_once``. Rejected lines
    of a lot that failed may be written twice. Returns the objects and ``run_silver``'s counts.
    """
    ledger = ledger_path or f"{silver_path.rstrip('/')}_ledger"
    waiting = cut_lineage(lake.new_objects(spark, bronze_path, ledger))
    totals = {"objects": 0, "lines": 0, "malformed": 0, "messages": 0, "without_time": 0}
    after = ""
    while True:
        lot = waiting.where(F.col("object") > after).orderBy("object").limit(objects_at_once).collect()
        if not lot:
            return totals
        after = lot[-1]["object"]
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", row["object"]) for row in lot]
        counts = run_silver(spark, paths, silver_path, tenant, reject_path, **key_opts)
        taken = waiting.where((F.col("object") >= lot[0]["object"]) & (F.col("object") <= after))
        taken.coalesce(1).write.mode("append").parquet(ledger)
        totals = {k: totals[k] + {"objects": len(lot), **counts}[k] for k in totals}


def _counted(marked: DataFrame) -> tuple[DataFrame, Observation]:
    """``_with_unread`` rows that are counted by outcome in whatever pass reads them."""
    counts = Observation()
    malformed = F.col("_corrupt_record").isNotNull()
    lines, bad, unread = F.count(F.lit(1)), F.count_if(malformed), F.count_if(F.col(_UNREAD))
    return marked.observe(counts, lines.alias("lines"), bad.alias("malformed"), unread.alias("without_time")), counts


def _line_counts(counts: Observation) -> dict[str, int]:
    """Lines by outcome, of a pass that is done."""
    row = {n: counts.get.get(n) or 0 for n in ("lines", "malformed", "without_time")}
    return {"lines": row["lines"], "malformed": row["malformed"], "messages": row["lines"] - row["malformed"], "without_time": row["without_time"]}


def run_silver_split(spark: SparkSession, bronze_path: str, silver_base: str, tenant: str) -> dict[str, str]:
    """The job's two-table silver layout: ``questions`` (B2) and ``answers`` (B3), event time
    parsed once (B1), tenant tagged (B10); rejects beside them. The well-formed messages are
    checkpointed, so the files are read once."""
    base = silver_base.rstrip("/")
    bronze = cut_lineage(read_bronze(spark, bronze_path))
    good, rejects = split_rejects(bronze)
    rejects.write.mode("append").json(f"{base}/rejects")
    messages = S.add_event_date(S.drop_empty_queries(with_tenant(good, tenant)))
    out = {}
    for name, fn in (("questions", S.flatten_questions), ("answers", S.flatten_answers)):
        out[name] = f"{base}/{name}"
        lake.write_silver(fn(messages), out[name])
    return out


def gold_tables(
    silver: DataFrame,
    rules: DataFrame,
    checkpoint: bool = True,
    answer_seconds: float = ANSWER_SECONDS,
    max_depth: int | None = None,
) -> dict[str, DataFrame]:
    """The five gold tables and the wide record from silver rows (not yet written).

    A message with k answers is k silver rows and counts k times, as rows are
    what the published measures count. Breakdowns count all rows, also those
    without a name. Silver that already has ``has_answer`` keeps it.
    """
    marked = silver if "has_answer" in silver.columns else S.mark_answers_by_window(silver, answer_seconds)
    rows = S.drop_null_qname(silver)
    cut = cut_lineage if checkpoint else lambda df: df
    # The two scans of silver: names, and traffic by client and code.
    enriched = cut(G.add_name_features(K.rollup_names(marked), rules, max_depth=max_depth))
    traffic = cut(K.rollup_traffic(silver))
    clients = traffic.where("has_name").groupBy(*K.KEYS).agg(F.countDistinct("src_ip").alias("unique_src_ips"))
    parts = {"max_names": cut(K.max_entropy_names(enriched)), "src_ips": cut(clients)}
    # One aggregation of the rollup for every per-day measure (one row per
    # tenant-day, checkpointed); each table is a projection of it.
    summary = cut(K.daily_summary(enriched, extra=D.histogram_measures(enriched)))
    topn_flat = N.build_topn(enriched)
    return {
        "base_kpis": K.build_base_kpis(enriched, rows, summary=summary, **parts),
        "risk_kpis": K.build_risk_kpis(enriched, summary=summary),
        "histograms": D.entropy_histograms(enriched, summary=summary),
        "topn": N.pack_top_n(topn_flat),
        "breakdowns": D.pack_breakdowns(D.breakdowns_flat(traffic, weight="messages")),
        "daily_aggregates": K.build_wide_gold(enriched, rows, summary=summary, **parts),
    }


def run_gold(
    spark: SparkSession,
    silver_path: str,
    gold_path: str,
    rules: DataFrame,
    tenant: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> dict[str, str]:
    """Read silver (pruned), build and write every gold table; returns table -> path.

    ``rules`` are the public suffixes in force (names below unlisted ones have
    no root domain); the built-in seed is for tests.
    """
    silver = lake.read_partitioned(spark, silver_path, tenant, start, end)
    out = {}
    for name, df in gold_tables(silver, rules).items():
        out[name] = f"{gold_path.rstrip('/')}/{name}"
        lake.write_gold(df, out[name], TYPE_COLUMNS.get(name))
    return out


def run_gold_new(
    spark: SparkSession,
    silver_path: str,
    gold_path: str,
    rules: DataFrame,
    answer_seconds: float = ANSWER_SECONDS,
) -> dict[str, str]:
    """``run_gold`` of the days that have changed since the last run; the others are neither read nor written.

    Changed are (tenant, day) partitions whose files, bytes or newest file differ from the marks
    stored under ``<gold_path>/marks``, and the days before and after them, as a reply may fall on the other side
    of midnight from its question. Their neighbours are read for such replies only. Marks are taken
    before the rows are read and stored after the tables, so what arrives in between, or a run that
    fails, is worked on next time. Returns table -> path; empty where nothing has changed.
    """
    if answer_seconds > 86_400:
        raise ValueError("answer_seconds must not exceed a day")
    root = gold_path.rstrip("/")
    touched = cut_lineage(lake.touched_partitions(spark, silver_path, f"{root}/marks"))
    if touched.isEmpty():
        return {}

    def around(days: DataFrame) -> DataFrame:
        near = F.explode(F.array(*[F.date_add("event_date", n) for n in (-1, 0, 1)]))
        return cut_lineage(days.select("tenant", near.alias("event_date")).distinct())

    def only(rows: DataFrame, days: DataFrame) -> DataFrame:
        return rows.join(days, lake.same_partition(rows, days), "left_semi")

    changed = around(touched)
    silver = lake.read_partitioned(spark, silver_path).withColumn("event_date", F.col("event_date").cast("date"))
    rows = only(S.mark_answers_by_window(only(silver, around(changed)), answer_seconds), changed)
    out = {}
    for name, df in gold_tables(cut_lineage(rows.select(*GOLD_COLUMNS)), rules).items():
        out[name] = f"{root}/{name}"
        lake.write_gold(df, out[name], TYPE_COLUMNS.get(name))
    lake.write_gold(touched, f"{root}/marks")
    return out


def read_dashboard(spark: SparkSession, gold_path: str, tenant: str | None = None, event_date: str | None = None) -> DataFrame:
    """A10 read path: the dashboard record of one tenant-day (or of all) from the written gold tables.

    Every table is read with the given partition keys filtered (pruned at listing),
    never "the first row" of a directory.
    """
    root = gold_path.rstrip("/")
    t = {name: lake.read_partitioned(spark, f"{root}/{name}", tenant, event_date, event_date) for name in GOLD_TABLES}
    # Partition columns come back last and typed by inference; put the keys first, as written.
    t = {n: df.select("tenant", F.col("event_date").cast("date").alias("event_date"),
                      *[c for c in df.columns if c not in ("tenant", "event_date")]) for n, df in t.items()}
    return K.build_dashboard(t["base_kpis"], t["risk_kpis"], t["histograms"], t["topn"], t["breakdowns"])


def run_report(spark: SparkSession, silver_path: str, name: str, tenant: str, limit: int = 50,
               start: str | None = None, end: str | None = None) -> DataFrame:
    """A named report (T1-T6) over the silver table, tenant and dates pruned at the scan."""
    from zonelens.operators.templates import run_template

    return run_template(name, lake.read_partitioned(spark, silver_path, tenant, start, end), tenant, limit)
