"""End to end on files: bronze JSON -> silver parquet -> gold tables; dynamic overwrite; streaming."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from zonelens.operators import silver as S
from zonelens.plans import jobs
from zonelens.sources import lake
from zonelens.sources.bronze import derived_bronze, read_bronze, write_bronze
from zonelens.sources.dims import SEED_SUFFIX_RULES, suffix_rules
from zonelens.streaming.silver_stream import start_silver_stream

SF = "/root/testdata/sf0.001"


def _write_bronze_by_tenant(spark, root):
    b = derived_bronze(spark, SF)
    for t in [r.tenant for r in b.select("tenant").distinct().collect()]:
        write_bronze(b.where(F.col("tenant") == t), f"{root}/{t}/pcaps/batch1")
    return b


def test_bronze_silver_gold(spark, tmp_dir):
    bronze_root, silver, gold = f"{tmp_dir}/bronze", f"{tmp_dir}/silver", f"{tmp_dir}/gold"
    b = _write_bronze_by_tenant(spark, bronze_root)
    # tenant from the object key (segment 0 below the bronze root)
    df = read_bronze(spark, bronze_root)
    assert df.where(F.col("_corrupt_record").isNotNull() | F.col("qr").isNull()).count() == 0
    silver_df = jobs.bronze_to_silver(df.drop("_corrupt_record"), key_root="file:" + bronze_root + "/")
    lake.write_silver(silver_df, silver)
    s = spark.read.parquet(silver)
    assert s.where(F.col("tenant").isNull()).count() == 0
    assert {r.tenant for r in s.select("tenant").distinct().collect()} == {r.tenant for r in b.select("tenant").distinct().collect()}
    paths = jobs.run_gold(spark, silver, gold, suffix_rules(spark))
    risk = spark.read.parquet(paths["risk_kpis"])
    n_before = risk.count()
    assert n_before > 0
    one = lake.read_gold_record(spark, paths["risk_kpis"], "tenant-1", "2024-01-15").collect()
    assert len(one) == 1
    topn = spark.read.parquet(paths["topn"])
    assert {r.topN_type for r in topn.select("topN_type").distinct().collect()} == {"top_qnames", "top_root_domains", "high_entropy"}
    dash = jobs.read_dashboard(spark, gold, "tenant-1", "2024-01-15").collect()
    assert len(dash) == 1 and dash[0].risk_kpis.total_count == one[0].total_count
    assert len(dash[0].histograms) == 2 and len(dash[0].rankings) == 3 and len(dash[0].breakdowns) == 2
    report = jobs.run_report(spark, silver, "top_domains", "tenant-1", 5).collect()
    assert len(report) == 5 and report[0].query_count >= report[-1].query_count
    # rerun for one tenant only keeps the other tenants' partitions (dynamic overwrite)
    answered = spark.read.parquet(paths["daily_aggregates"]).agg(F.sum("answered_queries")).first()[0]
    assert answered == S.mark_answers_by_window(s).where("qname is not null").agg(F.sum("has_answer")).first()[0] > 0
    jobs.run_gold(spark, silver, gold, suffix_rules(spark), tenant="tenant-0")
    assert spark.read.parquet(paths["risk_kpis"]).select("tenant").distinct().count() == 3
    assert spark.read.parquet(paths["risk_kpis"]).count() == n_before


def test_partition_pruning(spark, tmp_dir):
    silver = f"{tmp_dir}/silver"
    df = jobs.bronze_to_silver(derived_bronze(spark, SF))
    lake.write_silver(df, silver)
    pruned = lake.read_partitioned(spark, silver, "tenant-2", "2024-01-03", "2024-01-05")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tenant" in plan
    assert {r.tenant for r in pruned.select("tenant").distinct().collect()} == {"tenant-2"}


def test_streaming_silver_matches_batch(spark, tmp_dir):
    bronze_dir, silver = f"{tmp_dir}/bronze_stream", f"{tmp_dir}/silver_stream"
    b = derived_bronze(spark, SF)
    write_bronze(b.where(F.col("tenant") == "tenant-1"), bronze_dir)
    q = start_silver_stream(spark, bronze_dir, silver, query_name=os.path.basename(tmp_dir), tenant="tenant-1")
    q.awaitTermination(300)
    streamed = spark.read.parquet(silver)
    batch = jobs.bronze_to_silver(read_bronze(spark, bronze_dir).drop("_corrupt_record"), tenant="tenant-1")
    assert streamed.where("event_ts is null").count() == batch.where("event_ts is null").count() > 0
    assert streamed.count() == batch.count()
    assert streamed.select("silver_dedupe_hash").distinct().count() == streamed.count()


def test_silver_split_and_observe(spark, tmp_dir):
    from zonelens.operators.silver import observe_counts

    bronze_dir = f"{tmp_dir}/bronze_split"
    write_bronze(derived_bronze(spark, SF).where(F.col("tenant") == "tenant-2"), bronze_dir)
    paths = jobs.run_silver_split(spark, bronze_dir, f"{tmp_dir}/silver_ab", "tenant-2")
    q = spark.read.parquet(paths["questions"])
    a = spark.read.parquet(paths["answers"])
    assert "rclass" in a.columns and "qname" in q.columns
    assert q.count() >= a.select("id").distinct().count() > 0
    df, obs = observe_counts(read_bronze(spark, bronze_dir), "bronze_rows")
    n = df.count()
    assert obs.get["rows"] == n


def test_command_line(spark, tmp_dir, capsys):
    from zonelens.__main__ import main

    bronze_dir, silver, gold = f"{tmp_dir}/b", f"{tmp_dir}/s", f"{tmp_dir}/g"
    write_bronze(derived_bronze(spark, SF).where(F.col("tenant") == "tenant-0"), f"{bronze_dir}/tenant-0/pcaps")
    assert main(["silver", "--bronze", bronze_dir, "--silver", silver, "--key-root", "file:" + bronze_dir + "/",
                 "--rejects", f"{tmp_dir}/rej"]) == 0
    with open(f"{tmp_dir}/rules.txt", "w") as f:
        f.write("// rules\n" + "\n".join(SEED_SUFFIX_RULES.split()))
    assert main(["gold", "--silver", silver, "--gold", gold, "--tenant", "tenant-0", "--suffix-list", f"{tmp_dir}/rules.txt"]) == 0
    capsys.readouterr()
    assert main(["report", "top_query_types", "--silver", silver, "--tenant", "tenant-0", "--limit", "3"]) == 0
    out = [line for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert 1 <= len(out) <= 3
    assert main(["dashboard", "--gold", gold, "--tenant", "tenant-0", "--date", "2024-01-10"]) == 0
    dash = [line for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert len(dash) == 1 and "risk_kpis" in dash[0]


def test_streaming_redelivery_is_idempotent(spark, tmp_dir):
    bronze_dir, silver = f"{tmp_dir}/bronze_inc", f"{tmp_dir}/silver_inc"
    b = derived_bronze(spark, SF).where(F.col("tenant") == "tenant-2")
    write_bronze(b, bronze_dir)
    name = "inc_" + os.path.basename(tmp_dir)
    start_silver_stream(spark, bronze_dir, silver, query_name=name, tenant="tenant-2").awaitTermination(300)
    first = spark.read.parquet(silver).count()
    assert first > 0
    write_bronze(b, bronze_dir)  # the same objects delivered again
    start_silver_stream(spark, bronze_dir, silver, query_name=name, tenant="tenant-2").awaitTermination(300)
    assert spark.read.parquet(silver).count() == first


def test_run_silver_is_idempotent(spark, tmp_dir):
    bronze_dir, silver = f"{tmp_dir}/bronze_rerun", f"{tmp_dir}/silver_rerun"
    write_bronze(derived_bronze(spark, SF).where(F.col("tenant") == "tenant-1"), bronze_dir)
    with open(f"{bronze_dir}/more.json", "w") as f:
        f.write('not json\n{"timestamp": "no time", "id": 7, "qr": 0, "questions": [{"qname": "a.example.com", "qtype": 1}]}\n{"id": "seven"}\n')
    lines = spark.read.text(bronze_dir).count()
    got = jobs.run_silver(spark, bronze_dir, silver, tenant="tenant-1")
    assert got["lines"] == lines == got["malformed"] + got["messages"] and got["malformed"] == 2
    rejects = spark.read.json(f"{silver}_rejects")
    assert rejects.where("reject_reason = 'malformed line'").count() == 2
    assert rejects.count() == 2 + got["without_time"]
    assert spark.read.parquet(silver).where("event_date is null").count() > 0
    first = spark.read.parquet(silver).count()
    jobs.run_silver(spark, bronze_dir, silver, tenant="tenant-1")  # the same objects again
    assert spark.read.parquet(silver).count() == first
    jobs.run_silver(spark, bronze_dir, silver, tenant="tenant-1", idempotent=False)
    assert spark.read.parquet(silver).count() == 2 * first


def test_gold_tables_from_summary_equal_standalone(spark):
    from zonelens.operators import distributions as D
    from zonelens.operators import kpis as K
    from zonelens.operators import features as G
    from zonelens.plans import catalog

    silver = catalog.answered_silver(spark, SF)
    rows = silver.where("qname is not null")
    enriched = G.add_name_features(K.rollup_names(rows), catalog.suffix_rules(spark), max_depth=catalog.SEED_DEPTH)
    tables = jobs.gold_tables(silver, catalog.suffix_rules(spark), checkpoint=False, max_depth=catalog.SEED_DEPTH)
    standalone = {
        "base_kpis": K.build_base_kpis(enriched, rows),
        "risk_kpis": K.build_risk_kpis(enriched),
        "histograms": D.entropy_histograms(enriched),
        "daily_aggregates": K.build_wide_gold(enriched, rows),
    }
    for name, df in standalone.items():
        got = tables[name]
        assert got.columns == df.columns, name
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect())), name


def test_streams_take_objects_in_any_order(spark, tmp_dir):
    """Older objects delivered second, several tenants by nested object keys, malformed lines: nothing is lost."""
    bronze_dir, silver = f"{tmp_dir}/b", f"{tmp_dir}/s"
    b = derived_bronze(spark, SF)
    newest_first = [b.where("timestamp >= '2024-01-15'"), b.where("timestamp < '2024-01-15'")]
    name, options = "order_" + os.path.basename(tmp_dir), {"key_root": "file:" + bronze_dir + "/"}
    for i, part in enumerate(newest_first):
        for t in ("tenant-0", "tenant-1", "tenant-2"):
            write_bronze(part.where(F.col("tenant") == t), f"{bronze_dir}/{t}/pcaps/{i}")
        with open(f"{bronze_dir}/tenant-0/pcaps/{i}/bad.json", "w") as f:
            f.write("not json\n")
        start_silver_stream(spark, bronze_dir, silver, query_name=name, **options).awaitTermination(300)
    batch = jobs.bronze_to_silver(read_bronze(spark, bronze_dir), **options)
    streamed = spark.read.parquet(silver)
    assert streamed.count() == batch.count() > 0
    assert streamed.select("tenant").distinct().count() == 3
    assert spark.read.json(f"{silver}_rejects").where("reject_reason = 'malformed line'").count() == 2


def test_split_run_has_no_junk_rows(spark, tmp_dir):
    bronze_dir = f"{tmp_dir}/b"
    write_bronze(derived_bronze(spark, SF).where(F.col("tenant") == "tenant-2"), bronze_dir)
    n = read_bronze(spark, bronze_dir).count()
    with open(f"{bronze_dir}/bad.json", "w") as f:
        f.write("not json\n")
    paths = jobs.run_silver_split(spark, bronze_dir, f"{tmp_dir}/s", "tenant-2")
    for path in paths.values():
        rows = spark.read.parquet(path)
        assert rows.where("id is null and qr is null").count() == 0 and 0 < rows.count() <= 3 * n
    assert spark.read.json(f"{tmp_dir}/s/rejects").where("reject_reason = 'malformed line'").count() == 1


def test_private_suffixes_are_left_out(spark, tmp_dir):
    from zonelens.sources.dims import suffix_rules_from_text

    with open(f"{tmp_dir}/list.dat", "w") as f:
        f.write("// ===BEGIN ICANN DOMAINS===\ncom\n*.ck\n!www.ck\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n// ===END PRIVATE DOMAINS===\n")
    rules = {(r.suffix, r.is_wildcard, r.is_exception) for r in suffix_rules_from_text(spark, f"{tmp_dir}/list.dat").collect()}
    assert rules == {("com", False, False), ("ck", True, False), ("www.ck", False, True)}


def test_streamed_answers_equal_the_batch_in_any_order(spark, tmp_dir):
    """Replies before their questions, days apart, objects one by one and twice: the flags are those of the batch."""
    b = derived_bronze(spark, SF).where(F.col("tenant") == "tenant-1")
    for n, parts in enumerate(("qr desc, timestamp", "qr, timestamp desc")):
        bronze_dir, silver, answered = f"{tmp_dir}/b{n}", f"{tmp_dir}/s{n}", f"{tmp_dir}/a{n}"
        name = f"answers_{n}_" + os.path.basename(tmp_dir)
        piece = F.ntile(3).over(Window.orderBy(*[F.expr(p.split()[0]).desc() if "desc" in p else F.expr(p) for p in parts.split(", ")]))
        cut = b.withColumn("piece", piece)
        for i in (1, 2, 3, 1):
            write_bronze(cut.where(F.col("piece") == i).drop("piece"), bronze_dir)
            start_silver_stream(spark, bronze_dir, silver, query_name=name, tenant="tenant-1", answered_path=answered).awaitTermination(300)
        got = {r.silver_dedupe_hash: r.has_answer for r in jobs.read_answered(spark, silver, answered).collect()}
        batch = S.mark_answers_by_window(jobs.bronze_to_silver(read_bronze(spark, bronze_dir), tenant="tenant-1"))
        want = {r.silver_dedupe_hash: r.has_answer for r in batch.collect()}
        assert got == want and sum(want.values()) > 0
        assert spark.read.parquet(answered).count() == sum(want.values())


def test_silver_days_are_not_written_by_every_task(spark, tmp_dir):
    from zonelens.sources import lake

    rows = spark.range(400, numPartitions=8).selectExpr("id", "concat('t', id % 2) as tenant", "date'2024-01-01' + cast(id % 3 as int) as event_date")
    path = f"{tmp_dir}/rebalanced"
    lake.write_silver(rows, path)
    files = lake.list_objects(spark, path)
    assert files.count() == 6
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(400))


def test_appended_rows_are_computed_once(spark, tmp_dir):
    from zonelens.sources import lake

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def rows(first, last):
        made = spark.range(first, last).selectExpr("if(id % 5 = 0, null, 't') as tenant", "if(id % 7 = 0, null, date'2024-01-01') as event_date", "concat('h', id) as silver_dedupe_hash")
        return made.mapInArrow(run, made.schema)

    path = f"{tmp_dir}/appended"
    lake.append_new(spark, rows(0, 40), path)
    assert seen.value == 40
    lake.append_new(spark, rows(30, 60), path)
    assert seen.value == 70
    assert sorted(int(r[0][1:]) for r in spark.read.parquet(path).select("silver_dedupe_hash").collect()) == list(range(60))


def test_lines_are_counted_in_the_pass_of_the_rejects(spark, tmp_dir):
    import json
    import os

    from zonelens.plans import jobs

    os.makedirs(f"{tmp_dir}/counted")
    lines = [json.dumps({"timestamp": t, "qr": 1, "id": 1}) for t in ("2024-01-01T00:00:00", "1704067200.5", "junk", None)]
    with open(f"{tmp_dir}/counted/a.json", "w") as f:
        f.write("\n".join([*lines, '{"qr": "x"}', "{broken"]))
    counts = jobs.run_silver(spark, f"{tmp_dir}/counted", f"{tmp_dir}/counted-silver", "t")
    assert counts == {"lines": 6, "malformed": 2, "messages": 4, "without_time": 1}
    reasons = [r.reject_reason for r in spark.read.json(f"{tmp_dir}/counted-silver_rejects").collect()]
    assert sorted(reasons) == ["malformed line"] * 2 + ["unreadable time, kept without a day"]
    _, rejects = jobs.split_rejects(jobs.read_bronze(spark, f"{tmp_dir}/counted"))
    assert rejects._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
