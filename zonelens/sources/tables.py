"""Readers for the driver's parquet tables and the DNS stand-in derived from them.

The test data holds no DNS table, so a DNS message stream is derived from
``events`` joined to ``pages``: one row per event, tenant from the user, name
from the page's host. Its DuckDB twin (``STANDIN_SQL``) is the same text with
``varchar`` for ``string``; both were checked to give identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

HOST_RE = r"https?://([^/]+)"
APEX_RE = r"https?://(?:[^/.]+[.])*([^/.]+[.][a-z]+)/"

# DuckDB form of the stand-in view (fixed text, see module docstring).
STANDIN_SQL = r"""
select concat('tenant-', cast(e.user_id % 3 as varchar)) as tenant,
       cast(e.ts as date) as event_date, e.ts as event_ts,
       cast(e.event_id % 65536 as int) as id, cast(e.event_id % 2 as int) as qr,
       cast(case when e.event_type='error' and e.event_id % 2 = 1 then 3 else 0 end as int) as rcode,
       cast(case e.event_type when 'click' then 1 when 'view' then 28 when 'signup' then 16
                              when 'purchase' then 5 else 1 end as int) as qtype,
       concat('10.0.0.', cast(e.user_id % 256 as varchar)) as src_ip,
       case when e.event_id % 101 = 0 then concat('xn--bcher-', e.event_id % 7, '.', p.host)
            when e.event_id % 103 = 0 then concat(p.host, '.')
            when e.event_id % 107 = 0 then concat(repeat('a', 45), '.', repeat('b', 45), '.', p.host)
            when e.event_id % 109 = 0 then concat('10.0.0.', e.event_id % 256)
            when e.event_id % 113 = 0 then concat('w', e.event_id % 7, '.shop', e.event_id % 50, '.co.uk')
            when e.event_id % 127 = 0 then concat('a.b', e.event_id % 20, '.c', e.event_id % 3, '.ck')
            when e.event_id % 131 = 0 then concat('x', e.event_id % 5, '.www.ck')
            when e.event_id % 137 = 0 then concat('h', e.event_id % 9, '.unlisted')
            when e.event_id % 139 = 0 then null
            when e.event_id % 149 = 0 then concat('www.shop', e.event_id % 9, '.xn--55qx5d.cn')
            when e.event_id % 151 = 0 then concat('a.b', e.event_id % 20, '.xn--p1ai')
            when e.event_id % 157 = 0 then concat('m', e.event_id % 5, '.公司.香港')
            when e.event_id % 163 = 0 then concat('a.b.c', e.event_id % 7, '.xn--zckzah')
            when e.event_id % 167 = 0 then concat('n', e.event_id % 3, '.xn--r8jz45g.xn--zckzah')
            when e.value > 200 then concat(substr(md5(cast(e.event_id as varchar)),1,28), '.', p.host)
            when e.event_id % 97 = 0 then concat('_x.', p.host)
            when e.event_id % 13 = 0 then p.apex
            else p.host end as qname
from events e join (
  select page_id, regexp_extract(url,'https?://([^/]+)',1) as host,
         regexp_extract(url,'https?://(?:[^/.]+[.])*([^/.]+[.][a-z]+)/',1) as apex,
         count(*) over () as n_pages
  from pages) p on p.page_id = e.event_id % p.n_pages
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dns_standin(spark: SparkSession, sf_dir: str, extra_event_cols: tuple[str, ...] = ()) -> DataFrame:
    """DNS messages (one question each) derived from ``events`` x ``pages``.

    Columns: tenant, event_date, event_ts, id, qr, rcode, qtype, src_ip, qname
    (+ ``extra_event_cols`` of ``events`` on request). Page ids are dense, so
    the remainder of the event id by the number of pages meets every page; the
    join is left to the planner. Most names are a page's host; some are
    internationalised, end with a dot, are very long, addresses, below
    two-label, wildcard, exception and unlisted suffixes, below rules of other scripts, or NULL.
    """
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", *[c for c in extra_event_cols if c != "event_id"]
    )
    pages = read_table(spark, sf_dir, "pages")
    n_pages = max(1, pages.count())
    pg = pages.select(
        "page_id",
        F.regexp_extract("url", HOST_RE, 1).alias("host"),
        F.regexp_extract("url", APEX_RE, 1).alias("apex"),
    )
    eid, host = F.col("event_id"), F.col("host")

    def rest(n: int) -> Column:
        return (eid % n).cast("string")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    qname = (
        F.when(eid % 101 == 0, text("xn--bcher-", rest(7), ".", host))
        .when(eid % 103 == 0, text(host, "."))
        .when(eid % 107 == 0, text("a" * 45 + "." + "b" * 45 + ".", host))
        .when(eid % 109 == 0, text("10.0.0.", rest(256)))
        .when(eid % 113 == 0, text("w", rest(7), ".shop", rest(50), ".co.uk"))
        .when(eid % 127 == 0, text("a.b", rest(20), ".c", rest(3), ".ck"))
        .when(eid % 131 == 0, text("x", rest(5), ".www.ck"))
        .when(eid % 137 == 0, text("h", rest(9), ".unlisted"))
        .when(eid % 139 == 0, F.lit(None))
        .when(eid % 149 == 0, text("www.shop", rest(9), ".xn--55qx5d.cn"))
        .when(eid % 151 == 0, text("a.b", rest(20), ".xn--p1ai"))
        .when(eid % 157 == 0, text("m", rest(5), ".公司.香港"))
        .when(eid % 163 == 0, text("a.b.c", rest(7), ".xn--zckzah"))
        .when(eid % 167 == 0, text("n", rest(3), ".xn--r8jz45g.xn--zckzah"))
        .when(F.col("value") > 200, text(F.substring(F.md5(eid.cast("string")), 1, 28), ".", host))
        .when(eid % 97 == 0, text("_x.", host))
        .when(eid % 13 == 0, F.col("apex"))
        .otherwise(host)
    )
    et = F.col("event_type")
    qtype = (
        F.when(et == "click", 1)
        .when(et == "view", 28)
        .when(et == "signup", 16)
        .when(et == "purchase", 5)
        .otherwise(1)
    )
    joined = ev.join(pg, pg["page_id"] == (eid % n_pages), "inner")
    return joined.select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant"),
        F.col("ts").cast("date").alias("event_date"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        (eid % 65536).cast("int").alias("id"),
        (eid % 2).cast("int").alias("qr"),
        F.when((et == "error") & (eid % 2 == 1), 3).otherwise(0).cast("int").alias("rcode"),
        qtype.cast("int").alias("qtype"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        qname.alias("qname"),
        *[F.col(c) for c in extra_event_cols],
    )
