"""Dimension tables: public-suffix rules and port services.

Both are small inputs the caller may replace with a complete list read from a
file (``suffix_rules_from_text``, ``services_from_text``); the seeds below are
the built-in defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIX_RULES_SCHEMA = T.StructType(
    [
        T.StructField("suffix", T.StringType(), False),
        T.StructField("is_wildcard", T.BooleanType(), False),
        T.StructField("is_exception", T.BooleanType(), False),
    ]
)

# Seed of public-suffix rules in list syntax ("*." wildcard, "!" exception).
# Generic and country TLDs, common second-level registries, one wildcard/exception pair, and rules in other scripts.
SEED_SUFFIX_RULES = """
com net org edu gov mil int info biz name pro mobi asia tel travel jobs aero coop museum
io co ai app dev me tv cc ws xyz online site tech store cloud shop blog club live news top
us uk de fr es it nl be ch at se no dk fi ie pt pl cz sk hu ro bg gr ru ua by kz tr il
cn jp kr tw hk sg my th vn id ph in pk bd lk np au nz za ng ke eg ma br ar cl mx pe ve ca eu
co.uk org.uk ac.uk gov.uk ltd.uk plc.uk me.uk net.uk sch.uk nhs.uk
com.au net.au org.au edu.au gov.au asn.au id.au
co.jp ne.jp or.jp ac.jp go.jp ad.jp ed.jp gr.jp lg.jp
com.br net.br org.br gov.br edu.br
com.cn net.cn org.cn gov.cn edu.cn ac.cn
co.nz net.nz org.nz govt.nz ac.nz
co.za org.za gov.za ac.za net.za
co.in net.in org.in gen.in firm.in ind.in ac.in gov.in
com.mx org.mx gob.mx edu.mx net.mx
com.ar gob.ar net.ar org.ar
com.tr org.tr net.tr gov.tr edu.tr
co.kr or.kr ne.kr go.kr ac.kr
com.sg org.sg edu.sg gov.sg net.sg
com.hk org.hk edu.hk gov.hk net.hk
com.tw org.tw edu.tw gov.tw net.tw
co.il org.il ac.il gov.il net.il
com.ua org.ua net.ua gov.ua
*.ck !www.ck
рф 公司.cn 网络.cn 香港 公司.香港 *.テスト !例え.テスト
"""

SERVICES_SCHEMA = T.StructType(
    [
        T.StructField("proto", T.StringType(), False),
        T.StructField("port", T.IntegerType(), False),
        T.StructField("service", T.StringType(), False),
    ]
)

# Well-known service names by (port, protocol), system services-file spelling.
SEED_SERVICES = """
20 tcp ftp-data
21 tcp ftp
22 tcp ssh
23 tcp telnet
25 tcp smtp
53 tcp domain
53 udp domain
67 udp bootps
68 udp bootpc
69 udp tftp
80 tcp http
88 tcp kerberos
88 udp kerberos
110 tcp pop3
119 tcp nntp
123 udp ntp
135 tcp epmap
137 udp netbios-ns
138 udp netbios-dgm
139 tcp netbios-ssn
143 tcp imap2
161 udp snmp
162 udp snmp-trap
179 tcp bgp
389 tcp ldap
443 tcp https
443 udp https
445 tcp microsoft-ds
465 tcp submissions
514 udp syslog
514 tcp shell
587 tcp submission
631 tcp ipp
636 tcp ldaps
853 tcp domain-s
853 udp domain-s
993 tcp imaps
995 tcp pop3s
"""


def rule_text_depth(text: str = SEED_SUFFIX_RULES) -> int:
    """Labels in the deepest rule of a list-syntax text (no Spark job needed)."""
    return max(len(parse_suffix_rule(r)[0].split(".")) for r in text.split() if r and not r.startswith("//"))


def parse_suffix_rule(rule: str) -> tuple[str, bool, bool]:
    rule = rule.strip().lower()
    if rule.startswith("!"):
        return rule[1:], False, True
    if rule.startswith("*."):
        return rule[2:], True, False
    return rule, False, False


_LITERAL_FRAMES: dict[tuple, DataFrame] = {}


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small fixed table as a ``VALUES`` relation: one statement, a stable literal plan
    (no RDD behind it), built once per application and text."""
    key = (spark.sparkContext.applicationId, tuple(rows), schema.simpleString())
    if key not in _LITERAL_FRAMES:
        values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
        names = ", ".join(schema.fieldNames())
        df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
        _LITERAL_FRAMES[key] = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return _LITERAL_FRAMES[key]


def suffix_rules(spark: SparkSession, text: str = SEED_SUFFIX_RULES) -> DataFrame:
    """Suffix rule dimension (suffix, is_wildcard, is_exception) from list-syntax text."""
    rows = [parse_suffix_rule(r) for r in text.split() if r and not r.startswith("//")]
    return _literal_frame(spark, rows, SUFFIX_RULES_SCHEMA)


def suffix_rules_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Read a public-suffix list file (one rule per line, ``//`` comments) as the rule dimension.

    Rules between the ``BEGIN PRIVATE`` and ``END PRIVATE`` markers (registries of
    companies, like ``github.io``) are no public suffixes and are left out. The
    file is read as one row: a list is a few hundred KB.
    """
    whole = spark.read.text(path, wholetext=True)
    public = F.regexp_replace("value", r"(?s)===BEGIN PRIVATE.*?(===END PRIVATE|\z)", "")
    lines = whole.select(F.explode(F.split(public, r"\R")).alias("value"))
    lines = lines.select(F.trim(F.lower(F.split("value", r"\s+")[0])).alias("r"))
    lines = lines.where((F.length("r") > 0) & ~F.col("r").startswith("//"))
    return lines.select(
        F.regexp_replace("r", r"^(\*\.|!)", "").alias("suffix"),
        F.col("r").startswith("*.").alias("is_wildcard"),
        F.col("r").startswith("!").alias("is_exception"),
    )


def services(spark: SparkSession, text: str = SEED_SERVICES) -> DataFrame:
    rows = []
    for line in text.strip().splitlines():
        port, proto, name = line.split()
        rows.append((proto, int(port), name))
    return _literal_frame(spark, rows, SERVICES_SCHEMA)


def services_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Read a services file (``name port/proto [aliases]``) as the (proto, port, service) dimension."""
    raw = spark.read.text(path).select(
        F.regexp_replace("value", "#.*$", "").alias("v"), F.monotonically_increasing_id().alias("line")
    )
    m = F.regexp_extract("v", r"^\s*(\S+)\s+(\d+)/(\w+)", 0)
    parts = raw.where(m != "").select(
        F.regexp_extract("v", r"^\s*(\S+)\s+(\d+)/(\w+)", 3).alias("proto"),
        F.regexp_extract("v", r"^\s*(\S+)\s+(\d+)/(\w+)", 2).cast("int").alias("port"),
        F.regexp_extract("v", r"^\s*(\S+)\s+(\d+)/(\w+)", 1).alias("service"),
        "line",
    )
    # First entry per (proto, port) in file order wins, as a services lookup does.
    return parts.groupBy("proto", "port").agg(F.min_by("service", "line").alias("service"))
