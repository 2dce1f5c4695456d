"""Stage and task times of the full gold run, read from Spark's event log.

Runs the gold tables (rollup -> checkpoint -> five tables + wide record) at
``sf_dir`` with the event log in a fresh scratch folder, then reports per stage
the task count, median and max task time and shuffle bytes; a max far above the
median is the sign of a skewed key. Appends the table to PLANS.md.

Usage: python tools/stage_times.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from zonelens.plans import catalog  # noqa: E402
from zonelens.plans.jobs import gold_tables  # noqa: E402
from zonelens.session import RECOMMENDED_CONF, ensure_checkpoint_dir  # noqa: E402
from zonelens.sources.dims import suffix_rules  # noqa: E402


def _read_lines(path: str):
    """Lines of an event-log file (plain or zstd-compressed)."""
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="zonelens-events-", dir="/tmp")
    b = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
    )
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    tables = gold_tables(catalog.rows(spark, sf_dir), suffix_rules(spark), max_depth=catalog.SEED_DEPTH)
    for name, df in tables.items():
        spark.sparkContext.setJobDescription(name)
        df.write.format("noop").mode("overwrite").save()
    spark.stop()

    stages: dict[int, dict] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True):
        for line in _read_lines(path):
            ev = json.loads(line)
            if ev.get("Event") != "SparkListenerTaskEnd":
                continue
            ti, tm = ev["Task Info"], ev.get("Task Metrics") or {}
            st = stages.setdefault(ev["Stage ID"], {"tasks": []})
            read = tm.get("Shuffle Read Metrics") or {}
            write = tm.get("Shuffle Write Metrics") or {}
            st["tasks"].append(
                (
                    ti["Finish Time"] - ti["Launch Time"],
                    read.get("Remote Bytes Read", 0) + read.get("Local Bytes Read", 0),
                    write.get("Shuffle Bytes Written", 0),
                )
            )
    lines = [
        "",
        "## Stage times of the full gold run (event log)",
        "",
        f"`{sf_dir}`, local[8]; task times in ms; skew = max / median task time. At this scale each "
        "source is one Parquet file, so scans run as one task and AQE coalesces shuffles to one "
        "partition: the table shows the method; the skew column speaks on multi-file inputs.",
        "",
        "| stage | tasks | median ms | max ms | skew | shuffle read KB | shuffle write KB |",
        "| --- | --- | --- | --- | --- | --- | --- |",
    ]
    for sid in sorted(stages):
        t = stages[sid]["tasks"]
        if not t:
            continue
        durs = [d for d, _, _ in t]
        med = statistics.median(durs)
        lines.append(
            f"| {sid} | {len(t)} | {med:.0f} | {max(durs)} | {max(durs) / med if med else 0:.1f} | "
            f"{sum(r for _, r, _ in t) // 1024} | {sum(w for _, _, w in t) // 1024} |"
        )
    text = "\n".join(lines)
    print(text)
    plans = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(plans, "a") as fh:
        fh.write("\n" + text + "\n")


if __name__ == "__main__":
    main()
