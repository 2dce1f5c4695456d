"""Scalar expressions on hand-made fixtures (names, entropy, bins, intents, time, keys)."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from zonelens import functions as Z
from zonelens.config import HOST_ENTROPY_MAX, INTENT_THRESHOLDS
from zonelens.functions.idna import ascii_name
from zonelens.functions.keys import with_key_parts
from zonelens.operators.suffix import add_domain_parts
from zonelens.sources.dims import suffix_rules, suffix_rules_from_text

LONG = "a" * 30 + "." + "b" * 30 + "." + "c" * 30 + ".example.com"

# name -> (subdomain, domain, suffix, root_domain, subdomain_label_count)
DOMAIN_CASES = {
    None: (None, None, None, None, 0),
    "": (None, None, None, None, 0),
    ".": (None, None, None, None, 0),
    "example.com": (None, "example", "com", "example.com", 0),
    "example.com.": (None, "example", "com", "example.com", 0),
    "WWW.Example.COM": ("www", "example", "com", "example.com", 1),
    "a..b.com": ("a.", "b", "com", "b.com", 2),
    "_dmarc.example.org": ("_dmarc", "example", "org", "example.org", 1),
    "xn--bcher-kva.example": ("xn--bcher-kva", "example", None, None, 1),
    "a.b.example.co.uk": ("a.b", "example", "co.uk", "example.co.uk", 2),
    "localhost": (None, "localhost", None, None, 0),
    "co.uk": (None, None, "co.uk", None, 0),
    "10.0.0.1": (None, "10.0.0.1", None, None, 0),
    LONG: ("a" * 30 + "." + "b" * 30 + "." + "c" * 30, "example", "com", "example.com", 3),
    "foo.ck": (None, None, "foo.ck", None, 0),
    "a.foo.ck": (None, "a", "foo.ck", "a.foo.ck", 0),
    "www.ck": (None, "www", "ck", "www.ck", 0),
    "https://user@Mail.Example.co.uk:8443/path?q=1": ("mail", "example", "co.uk", "example.co.uk", 1),
}


def test_domain_parts(spark):
    df = spark.createDataFrame([(k,) for k in DOMAIN_CASES], "qname string")
    out = add_domain_parts(df, suffix_rules(spark))
    got = {r.qname: (r.subdomain, r.domain, r.suffix, r.root_domain, r.subdomain_label_count) for r in out.collect()}
    assert got == DOMAIN_CASES


SCRIPT_RULES = "рф 公司.cn cn 香港 公司.香港 *.テスト !例え.テスト straße.de de"
SCRIPT_CASES = {
    "www.shop.xn--55qx5d.cn": ("www", "shop", "xn--55qx5d.cn", "shop.xn--55qx5d.cn", 1),
    "www.shop.公司.cn": ("www", "shop", "公司.cn", "shop.公司.cn", 1),
    "WWW.Shop.XN--55QX5D.CN.": ("www", "shop", "xn--55qx5d.cn", "shop.xn--55qx5d.cn", 1),
    "a.b.xn--p1ai": ("a", "b", "xn--p1ai", "b.xn--p1ai", 1),
    "a.b.рф": ("a", "b", "рф", "b.рф", 1),
    "m.公司.香港": (None, "m", "公司.香港", "m.公司.香港", 0),
    "m.xn--55qx5d.xn--j6w193g": (None, "m", "xn--55qx5d.xn--j6w193g", "m.xn--55qx5d.xn--j6w193g", 0),
    "a.b.c.xn--zckzah": ("a", "b", "c.xn--zckzah", "b.c.xn--zckzah", 1),
    "n.xn--r8jz45g.xn--zckzah": ("n", "xn--r8jz45g", "xn--zckzah", "xn--r8jz45g.xn--zckzah", 1),
    "x.xn--strae-oqa.de": (None, "x", "xn--strae-oqa.de", "x.xn--strae-oqa.de", 0),
}


def test_rules_of_other_scripts_hold_for_names_on_the_wire(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("\n".join(SCRIPT_RULES.split()), encoding="utf-8")
    df = spark.createDataFrame([(k,) for k in SCRIPT_CASES], "qname string")
    for rules in (suffix_rules(spark, SCRIPT_RULES), suffix_rules_from_text(spark, str(path))):
        out = add_domain_parts(df, rules)
        got = {r.qname: (r.subdomain, r.domain, r.suffix, r.root_domain, r.subdomain_label_count) for r in out.collect()}
        assert got == SCRIPT_CASES


def test_ascii_names_equal_the_codec(spark):
    rng = random.Random(36)
    letters = "abcxyz019-éßäøñçžрфцяאבג中文网络公司日本語テスト한국어𝄞😀ا"
    names = [".".join("".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    names += ["", "plain.example.com", "。", "a。b．c", "🙂" * 30, "é" * 59, "a" * 50 + "ü"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ascii_name(F.col("n")).alias("a")).collect()
    for r in rows:
        dotted = r.n.translate(str.maketrans("。．｡", "...")) if not r.n.isascii() else r.n
        assert r.a == ".".join(x if x.isascii() else "xn--" + x.lower().encode("punycode").decode() for x in dotted.split(".")), r.n


def test_domain_parts_is_narrow(spark):
    df = spark.range(100).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.com")).alias("qname"))
    plan = add_domain_parts(df, suffix_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "ShuffleExchange" not in plan.replace("BroadcastExchange", "")


@pytest.mark.parametrize(
    "text,bits",
    [("aabb", 1.0), ("abcd", 2.0), ("aaaa", 0.0), ("_", None), ("", None), (None, None), ("A.a-B", 1.5)],
)
def test_entropy_bits(spark, text, bits):
    row = spark.createDataFrame([(text,)], "s string").select(
        Z.entropy_bits(F.col("s")).alias("b"), Z.entropy_norm(F.col("s")).alias("n")
    ).first()
    if bits is None:
        assert row.b is None and row.n is None
    else:
        assert row.b == pytest.approx(bits, abs=1e-12)
        assert row.n == pytest.approx(bits / HOST_ENTROPY_MAX, abs=1e-12)


def test_entropy_matches_formula(spark):
    names = ["x7f3k2q9.example.com", "mail.google.com", "a1b2c3d4e5f6", "--__--", "zzzzzzzzzy"]

    def formula(s):
        c = "".join(ch for ch in s.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789-")
        if not c:
            return None
        return -sum((c.count(x) / len(c)) * math.log2(c.count(x) / len(c)) for x in set(c))

    rows = spark.createDataFrame([(n,) for n in names], "s string").select("s", Z.entropy_bits(F.col("s")).alias("e"))
    for r in rows.collect():
        expect = formula(r.s)
        assert (r.e is None) == (expect is None)
        if expect is not None:
            assert r.e == pytest.approx(expect, abs=3e-15)


def test_entropy_legacy_variants(spark):
    df = spark.createDataFrame([("aabb",), ("",), (None,), ("  ab  ",), ("a.b",)], "s string")
    got = {r.s: (r.raw, r.strip) for r in df.select("s", Z.entropy_raw(F.col("s")).alias("raw"),
                                                    Z.entropy_stripped(F.col("s")).alias("strip")).collect()}
    assert got["aabb"] == (1.0, 1.0)
    assert got[""] == (0.0, 0.0)
    assert got[None] == (0.0, None)
    assert got["  ab  "][1] == 1.0
    assert got["a.b"][0] == pytest.approx(math.log2(3), abs=1e-12)


@pytest.mark.parametrize(
    "value,label",
    [(0.0, "0.0–0.5"), (0.4999, "0.0–0.5"), (0.5, "0.5–1.0"), (3.0, "3.0–4.0"), (4.0, "4.0–5.0"), (5.0, "5.0+"), (None, None)],
)
def test_entropy_bins(spark, value, label):
    row = spark.createDataFrame([(value,)], "e double").select(Z.entropy_bin(F.col("e")).alias("b")).first()
    assert row.b == label


def test_intents_borders(spark):
    for measure, (warn, alert) in INTENT_THRESHOLDS.items():
        vals = [(float(alert),), (alert - 1e-9,), (float(warn),), (warn - 1e-9,), (None,)]
        got = [r.i for r in spark.createDataFrame(vals, "v double").select(Z.intent(F.col("v"), warn, alert).alias("i")).collect()]
        assert got == ["alert", "warn", "warn", "neutral", "neutral"], measure


def test_name_flags_and_lengths(spark):
    df = spark.createDataFrame([("Ex_ample.COM.",), ("xn--abc.de",), (None,), ("a..b",)], "s string")
    rows = df.select(
        "s",
        Z.has_invalid_chars("s").alias("bad"),
        Z.is_idn("s").alias("idn"),
        Z.name_length("s").alias("len"),
        Z.label_length_stats("s")["qname_label_len_max"].alias("mx"),
        Z.label_length_stats("s")["qname_label_len_mean"].alias("mean"),
    ).collect()
    got = {r.s: (r.bad, r.idn, r.len, r.mx, r.mean) for r in rows}
    assert got["Ex_ample.COM."] == (True, False, 12, 8, 5.5)
    assert got["xn--abc.de"] == (False, True, 10, 7, 4.5)
    assert got[None] == (False, False, None, None, None)
    assert got["a..b"] == (False, False, 4, 1, 1.0)


def test_subdomain_label_count_clean(spark):
    df = spark.createDataFrame([(None,), ("",), ("null",), ("A..b.",), ("*.x",)], "s string")
    got = [r.c for r in df.select(Z.subdomain_label_count("s").alias("c")).collect()]
    assert got == [0, 0, 0, 2, 2]
    got2 = [r.c for r in df.select(Z.subdomain_label_count("s", remove_wildcards=True).alias("c")).collect()]
    assert got2[-1] == 1


def test_event_time_parsing(spark):
    texts = ["2026-01-01T00:00:00.123456", "2026-01-01T00:00:00", "1767225600.5", "junk", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "s string").select(Z.parse_event_ts(F.col("s")).alias("t")).collect()]
    assert got == [
        dt.datetime(2026, 1, 1, 0, 0, 0, 123456),
        dt.datetime(2026, 1, 1, 0, 0, 0),
        dt.datetime(2026, 1, 1, 0, 0, 0, 500000),
        None,
        None,
    ]


def test_epoch_to_iso(spark):
    got = [r.s for r in spark.createDataFrame([(1767225600.0,), (1767225600.25,)], "e double").select(
        Z.epoch_to_iso(F.col("e")).alias("s")).collect()]
    assert got == ["2026-01-01T00:00:00", "2026-01-01T00:00:00.250000"]


def test_object_keys(spark):
    keys = [
        "acme/pcaps/2026-01-22/file.pcap",
        "acme/x/CAP.PCAPNG",
        "acme/x/file",
        "acme/x/my%20file+2.pcap",
        "/acme/x/f.pcap",
        "acme",
        "acme/",
        "acme/100%/f.pcap",
    ]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: (r.tenant, r.bronze_key, r.reject_reason) for r in with_key_parts(df, "k").collect()}
    assert got["acme/pcaps/2026-01-22/file.pcap"] == ("acme", "acme/pcaps/2026-01-22/file.jsonl.gz", None)
    assert got["acme/x/CAP.PCAPNG"][1] == "acme/x/CAP.jsonl.gz"
    assert got["acme/x/file"][1] == "acme/x/file.jsonl.gz"
    assert got["acme/x/my%20file+2.pcap"][1] == "acme/x/my file 2.jsonl.gz"
    assert got["/acme/x/f.pcap"][1] == "acme/x/f.jsonl.gz"
    assert got["acme"] == (None, None, "no file path after tenant")
    assert got["acme/"][2] == "no file path after tenant"
    assert got["acme/100%/f.pcap"][:2] == ("acme", "acme/100%/f.jsonl.gz")
    prefixed = with_key_parts(df, "k", output_prefix="bronze/pcap").where("k = 'acme/pcaps/2026-01-22/file.pcap'").first().bronze_key
    assert prefixed == "acme/bronze/pcap/pcaps/2026-01-22/file.jsonl.gz"


def test_suffix_rules_from_file(spark, tmp_dir):
    from zonelens.sources.dims import suffix_rules_from_text

    path = f"{tmp_dir}/psl.dat"
    with open(path, "w") as fh:
        fh.write("// comment\ncom\n\nco.uk\nuk\n*.kawasaki.jp\n!city.kawasaki.jp\njp\n")
    rules = suffix_rules_from_text(spark, path)
    df = spark.createDataFrame([("a.b.kawasaki.jp",), ("www.city.kawasaki.jp",), ("x.co.uk",), ("y.com",)], "qname string")
    got = {r.qname: (r.domain, r.suffix) for r in add_domain_parts(df, rules).collect()}
    assert got == {
        "a.b.kawasaki.jp": ("a", "b.kawasaki.jp"),
        "www.city.kawasaki.jp": ("city", "kawasaki.jp"),
        "x.co.uk": ("x", "co.uk"),
        "y.com": ("y", "com"),
    }
