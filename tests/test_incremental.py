"""Runs that take in only what is new: the ledger of objects, and the days of gold that changed."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from zonelens.plans import jobs
from zonelens.sources import lake
from zonelens.sources.bronze import derived_bronze, write_bronze
from zonelens.sources.dims import suffix_rules

SF = "/root/testdata/sf0.001"


def _files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def _rows(spark, path):
    return sorted(map(str, lake.read_partitioned(spark, path).collect()))


def test_known_objects_are_not_opened_again(spark, tmp_dir):
    bronze, silver = f"{tmp_dir}/b", f"{tmp_dir}/s"
    b = derived_bronze(spark, SF).where(F.col("tenant") == "tenant-1")
    write_bronze(b.where("timestamp < '2024-01-15'").repartition(5), f"{bronze}/first")
    got = jobs.run_silver_new(spark, bronze, silver, "tenant-1", objects_at_once=2)
    assert got["objects"] == 5 and got["lines"] == b.where("timestamp < '2024-01-15'").count() == got["messages"]
    before = _rows(spark, silver)
    # Were a known object read, its rows would be missed: a line that cannot be read, at the same size and time.
    known = glob.glob(f"{bronze}/first/*.gz")[0]
    stat = os.stat(known)
    content = open(known, "rb").read()
    with open(known, "wb") as f:
        f.write(b"\0" * len(content))
    os.utime(known, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert jobs.run_silver_new(spark, bronze, silver, "tenant-1") == dict.fromkeys(got, 0)
    assert _rows(spark, silver) == before
    # A new object, one with a glob character in its name, and one that has changed are taken in.
    with open(known, "wb") as f:
        f.write(content)
    os.utime(known)
    write_bronze(b.where("timestamp >= '2024-01-15'").coalesce(1), f"{bronze}/second[1]")
    got = jobs.run_silver_new(spark, bronze, silver, "tenant-1")
    assert got["objects"] == 2
    jobs.run_silver(spark, bronze, f"{tmp_dir}/whole", "tenant-1")
    assert spark.read.parquet(silver).count() == spark.read.parquet(f"{tmp_dir}/whole").count() > len(before)
    assert lake.read_ledger(spark, f"{silver}_ledger").count() == 7
    assert lake.new_objects(spark, bronze, f"{silver}_ledger").count() == 0


def test_objects_after_a_failed_run_are_read_again(spark, tmp_dir, monkeypatch):
    bronze, silver = f"{tmp_dir}/b", f"{tmp_dir}/s"
    write_bronze(derived_bronze(spark, SF).where(F.col("tenant") == "tenant-2").coalesce(2), bronze)
    run = jobs.run_silver

    def lost(*args, **options):
        run(*args, **options)
        raise RuntimeError("lost before the ledger was written")

    monkeypatch.setattr(jobs, "run_silver", lost)
    with pytest.raises(RuntimeError):
        jobs.run_silver_new(spark, bronze, silver, "tenant-2", objects_at_once=1)
    monkeypatch.setattr(jobs, "run_silver", run)
    assert jobs.run_silver_new(spark, bronze, silver, "tenant-2")["objects"] == 2
    stored = spark.read.parquet(silver)
    assert stored.count() == stored.select("silver_dedupe_hash", "event_date").distinct().count() > 0


def test_gold_of_changed_days_equals_the_full_run(spark, tmp_dir):
    bronze, silver, gold = f"{tmp_dir}/b", f"{tmp_dir}/s", f"{tmp_dir}/g"
    b, rules = derived_bronze(spark, SF), suffix_rules(spark)
    late = (F.col("tenant") == "tenant-1") & F.col("timestamp").startswith("2024-01-15") & (F.col("qr") == 1)
    for t in ("tenant-0", "tenant-1"):
        write_bronze(b.where(~late & (F.col("tenant") == t)), f"{bronze}/{t}/x")
    key_root = "file:" + bronze + "/"
    jobs.run_silver_new(spark, bronze, silver, key_root=key_root)
    assert set(jobs.run_gold_new(spark, silver, gold, rules)) == {*jobs.GOLD_TABLES, "daily_aggregates"}
    assert jobs.run_gold_new(spark, silver, gold, rules) == {}
    before = _files(f"{gold}/risk_kpis")
    write_bronze(b.where(late), f"{bronze}/tenant-1/late")
    assert jobs.run_silver_new(spark, bronze, silver, key_root=key_root)["messages"] > 0
    paths = jobs.run_gold_new(spark, silver, gold, rules)
    after = _files(f"{gold}/risk_kpis")
    # Only the late object's day and its neighbours are written again.
    new = {p.split("risk_kpis/")[1].rsplit("/", 1)[0] for p in after if before.get(p) != after[p]}
    assert new and all(p.startswith("tenant=tenant-1/event_date=2024-01-1") for p in new) and len(new) <= 3
    full = jobs.run_gold(spark, silver, f"{tmp_dir}/full", rules)
    for name, path in full.items():
        assert _rows(spark, paths[name]) == _rows(spark, path), name


def test_only_changed_days_are_read(spark, tmp_dir):
    silver, marks = f"{tmp_dir}/s", f"{tmp_dir}/marks"
    lake.write_silver(jobs.bronze_to_silver(derived_bronze(spark, SF)), silver)
    every = lake.touched_partitions(spark, silver, marks).checkpoint()
    partitions = spark.read.parquet(silver).select("tenant", "event_date").distinct().count()
    assert every.count() == partitions
    lake.write_gold(every, marks)
    assert lake.touched_partitions(spark, silver, marks).count() == 0
    one = spark.read.parquet(silver).where("event_date is null").limit(1).checkpoint()
    tenant = one.first().tenant
    lake.write_silver(one, silver)
    touched = lake.touched_partitions(spark, silver, marks).collect()
    assert [(r.tenant, r.event_date) for r in touched] == [(tenant, None)]
