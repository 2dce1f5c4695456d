"""Command line for the batch jobs: ``python -m zonelens ...``, or ``spark-submit`` of a
script that calls ``zonelens.__main__.main``. The session (master, resources)
comes from the launcher; nothing here sets a master.

  python -m zonelens silver --bronze PATH --silver PATH [--tenant T] [--rejects PATH] [--new]
  python -m zonelens silver-split --bronze PATH --silver PATH --tenant T
  python -m zonelens gold --silver PATH --gold PATH --suffix-list FILE [--tenant T] [--start D] [--end D]
  python -m zonelens gold --silver PATH --gold PATH --suffix-list FILE --new
  python -m zonelens report NAME --silver PATH --tenant T [--limit N] [--out PATH]
  python -m zonelens dashboard --gold PATH --tenant T --date D [--out PATH]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from zonelens.plans import jobs
from zonelens.session import RECOMMENDED_CONF, ensure_checkpoint_dir
from zonelens.sources.dims import suffix_rules_from_text


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("zonelens").getOrCreate()
    for k, v in RECOMMENDED_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="zonelens")
    sub = p.add_subparsers(dest="cmd", required=True)

    s = sub.add_parser("silver", help="bronze JSON lines -> appended silver table")
    s.add_argument("--bronze", required=True)
    s.add_argument("--silver", required=True)
    s.add_argument("--tenant")
    s.add_argument("--rejects")
    s.add_argument("--segment-index", type=int, default=0)
    s.add_argument("--key-root", default="")

    s.add_argument("--new", action="store_true", help="only objects that the ledger does not hold")

    ss = sub.add_parser("silver-split", help="bronze -> questions and answers tables")
    ss.add_argument("--bronze", required=True)
    ss.add_argument("--silver", required=True)
    ss.add_argument("--tenant", required=True)

    g = sub.add_parser("gold", help="silver -> the gold tables (dynamic partition overwrite)")
    g.add_argument("--silver", required=True)
    g.add_argument("--gold", required=True)
    g.add_argument("--tenant")
    g.add_argument("--start")
    g.add_argument("--end")
    g.add_argument("--new", action="store_true", help="only days that have changed since the last such run")
    g.add_argument("--suffix-list", required=True, help="public-suffix list file")

    r = sub.add_parser("report", help="one of the six reports for a tenant")
    r.add_argument("name")
    r.add_argument("--silver", required=True)
    r.add_argument("--tenant", required=True)
    r.add_argument("--limit", type=int, default=50)
    r.add_argument("--out", help="write JSON lines here instead of printing")

    d = sub.add_parser("dashboard", help="the dashboard record of one tenant-day")
    d.add_argument("--gold", required=True)
    d.add_argument("--tenant", required=True)
    d.add_argument("--date", required=True)
    d.add_argument("--out")

    a = p.parse_args(argv)
    spark = _session()
    if a.cmd == "silver":
        run = jobs.run_silver_new if a.new else jobs.run_silver
        print(json.dumps(run(spark, a.bronze, a.silver, a.tenant, reject_path=a.rejects,
                             segment_index=a.segment_index, key_root=a.key_root)))
    elif a.cmd == "silver-split":
        print(json.dumps(jobs.run_silver_split(spark, a.bronze, a.silver, a.tenant)))
    elif a.cmd == "gold":
        rules = suffix_rules_from_text(spark, a.suffix_list)
        if a.new and (a.tenant or a.start or a.end):
            p.error("--new works on all changed days: without --tenant, --start and --end")
        out = jobs.run_gold_new(spark, a.silver, a.gold, rules) if a.new else jobs.run_gold(spark, a.silver, a.gold, rules, a.tenant, a.start, a.end)
        print(json.dumps(out))
    else:
        df = (
            jobs.run_report(spark, a.silver, a.name, a.tenant, a.limit)
            if a.cmd == "report"
            else jobs.read_dashboard(spark, a.gold, a.tenant, a.date)
        )
        if a.out:
            df.write.mode("overwrite").json(a.out)
        else:
            # A report is at most the template limit (<= 10 000 rows); a dashboard is one record.
            for row in df.toJSON().collect():
                print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
