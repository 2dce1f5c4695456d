"""Resampling, the n-gram join and the divergence audit against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from zonelens.llm import divergence, ngram_join, queries, resampling

from .conftest import AWKWARD, SF
from .test_near_dup import family

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_source_divergence"])
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    wanted = con.sql(queries.ORACLE_SQL[name])
    rows = sorted((tuple(r[c] for c in wanted.columns) for r in got.collect()), key=str)
    assert set(got.columns) == set(wanted.columns)
    assert rows == sorted(wanted.fetchall(), key=str)


# --- resampling


def brute_resample(rows, target, most=1, least=20, percent=10, buckets=10_000):
    def cut(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    docs = [(d, *cut(t)) for d, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in cut(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for d, words, found in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = len(able) * percent // 100
    return Counter([(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r, None) for r in out if r[1] < least])


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_brute_force(spark, make, most):
    rng = random.Random(most)
    words = ["Alpha", "beta", "GAMMA", "d3lta", "é", "汉字", "Ünder", "x"]
    texts = [rng.choice([" ", "-", "\x00", "\n"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 19, 20, 40, 90]))) for _ in range(150)] + [None, "", "ÀÉ"]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 4
    target = ["alpha é alpha", "", None, "gamma 汉字 d3lta x x"]
    wanted = brute_resample(rows, target, most, percent=30)
    given = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resampling.resample(make([(d, t, "en", "s", 0) for d, t in rows]), given, percent=30, most=most)
    assert Counter(map(tuple, got.collect())) == wanted


def test_pieces_change_no_feature(monkeypatch):
    text = "One two-three  fourfive " * 50 + "é" * 100
    whole = {n: list(resampling.features(text, n)) for n in (1, 2, 4)}
    monkeypatch.setattr(resampling, "pieces", lambda t, size=7, cut=resampling.pieces: cut(t, size))
    for n, found in whole.items():
        assert Counter(resampling.features(text, n)) == Counter(found)
        for k in (0, 1, 3, len(found)):
            assert resampling._words_of(sum(max(0, k - i) for i in range(n)), n) == k


def test_resampling_awkward_rows(spark, awkward, nothing):
    target = spark.createDataFrame([("text",)], "text string")
    rows = resampling.resample(awkward, target).collect()
    assert Counter(map(tuple, rows)) == brute_resample([(r[0], r[1]) for r in AWKWARD], ["text"])
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(awkward, target.limit(0)).count() == len(AWKWARD)


# --- divergence


def brute_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    cut = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for *_, t in rows]
    out = Counter()
    for lang in {r[0] for r in rows}:
        held = Counter(t for r, c in zip(rows, cut, strict=True) if r[0] == lang for t in set(c))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = {r[1] for r in rows if r[0] == lang}
        counts = {s: Counter(t for r, c in zip(rows, cut, strict=True) if r[:2] == (lang, s) for t in c if t in set(kept)) for s in sources}
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out.update((lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs))
            over = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t])
            out.update((lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over[:top]))
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(9)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "Zwölf", "汉字", "THE"]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice([None, "a", "b", "src9", "src10", "é"])
        rows.append((lang, source, rng.choice([" ", "--", "1"]).join(rng.choices(words, [1 + len(source or "") * (i % 3) for i in range(len(words))], k=rng.randrange(30)))))
    return rows + [("xx", "only", "rare words"), ("xx", None, None), ("yy", "one", "")]


def test_audit_equals_brute_force(make, sourced):
    docs = make([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(sourced)])
    assert Counter(map(tuple, divergence.audit(docs, least=12, top=7).collect())) == brute_audit(sourced, 12, 7)


def test_shards_blocks_and_merges_change_nothing(make, sourced, monkeypatch):
    for name, value in (("SHARD", 3), ("BLOCK", 2), ("MERGE", 10)):
        monkeypatch.setattr(divergence, name, value)
    docs = make([(i, t, lang, source, 0) for i, (lang, source, t) in enumerate(sourced)])
    assert Counter(map(tuple, divergence.audit(docs, least=12, top=7).collect())) == brute_audit(sourced, 12, 7)


def test_shares_are_exact_beyond_64_bits():
    n, total = np.array([2 * 10**10, 7]), np.array([3 * 10**15, 3 * 10**15])
    assert divergence._shares(n, total, 9).tolist() == [1 + 10**9 * (x + 5) // (3 * 10**15 + 45) for x in n.tolist()]


def test_audit_awkward_rows(awkward, nothing):
    assert Counter(map(tuple, divergence.audit(awkward, least=2).collect())) == brute_audit([(r[2], r[3], r[1]) for r in AWKWARD], 2, 50)
    assert divergence.audit(nothing).count() == 0


# --- n-gram join


def shingle_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_join(texts, percent=85):
    found = {d: shingle_set(t) for d, t in texts.items()}
    classes = {d: d for d in texts}
    holders = {}
    for d, s in found.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared = Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[:i])
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(found[a]) + len(found[b]) - both) and classes[a] != classes[b]:
            low, high = sorted((classes[a], classes[b]))
            classes = {d: low if c == high else c for d, c in classes.items()}
    return Counter((d, len(found[d]), classes[d]) for d in texts)


def test_op12_rows(spark, texts):
    assert Counter(map(tuple, queries.QUERIES["op12_ngram_join"](spark, SF).collect())) == brute_join(texts)


@pytest.fixture(scope="module")
def clouds():
    """Edited copies around the threshold, chains of them, short and repeated texts."""
    rng = random.Random(4)
    made = [t for n in (4, 5, 9, 20, 60, 200, 200, 500) for t in family(rng, n, 25, max(1, n // 25))]
    for n in (50, 150):
        text = [f"c{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(30):
            text[rng.randrange(n)] = f"d{rng.randrange(10**6)}"
            made.append(" ".join(text))
    made += ["one two", "One TWO", "one two three", "", " \n"] + made[:10] + list(family(rng, 150, 120, 8))
    rng.shuffle(made)
    return dict(enumerate(made))


@pytest.mark.parametrize("percent", [85, 60])
def test_join_equals_all_pairs(make, clouds, percent):
    rows = ngram_join.join(make([(d, t, "en", "s", 0) for d, t in clouds.items()]), percent=percent).collect()
    assert Counter(map(tuple, rows)) == brute_join(clouds, percent)


def test_join_in_small_blocks(make, clouds, monkeypatch):
    for name, value in (("BLOCK", 5), ("BLOCK_ELEMENTS", 900), ("MEMORY", 3), ("EMIT", 50), ("KEY_BLOCK", 4), ("PAIRS", 3), ("_SMALL", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = ngram_join.join(make([(d, t, "en", "s", 0) for d, t in clouds.items()])).collect()
    assert Counter(map(tuple, rows)) == brute_join(clouds)


def test_hamming_distance_bounds_the_symmetric_difference():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    for edits in (0, 1, 10, 60, 400):
        other = np.unique(np.append(rng.permutation(base)[: len(base) - edits], rng.integers(0, 2**64, edits, dtype=np.uint64)))
        apart = len(np.setxor1d(base, other))
        for words in (64, 16, 4):
            a, b = (ngram_join.folded(ngram_join.sketch(x, 64)[None, :], words)[0] for x in (base, other))
            assert (a == ngram_join.sketch(base, words)).all()
            near = int(np.bitwise_count(a ^ b).sum())
            assert near <= apart and (apart - near) % 2 == 0


@pytest.mark.parametrize("size", [1, 2, 6, 7, 13, 30, 31, 99, 300, 2000])
def test_sets_at_the_threshold_share_a_key(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        other = int(rng.integers(size, 100 * size // 85 + 1))
        # The smallest intersection that links: every smaller set, every split of the difference.
        both = next(x for x in range(size + 1) if 100 * x >= 85 * (size + other - x))
        b = np.unique(np.append(rng.permutation(a)[:both], rng.integers(0, 2**64, other - both, dtype=np.uint64)))
        assert ngram_join.links(a, b)
        assert len(a) + len(b) - 2 * both <= ngram_join.most_apart(size)
        assert np.intersect1d(ngram_join.segment_keys(a), ngram_join.segment_keys(b)).size


def test_shared_keys_over_any_batches(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(12)) for _ in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = ngram_join.shared_keys(spark.createDataFrame(rows, "key long, node long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for k, n in rows:
        held.setdefault(k, set()).add(n)
    assert Counter(map(tuple, got)) == Counter((k, n, min(ns)) for k, ns in held.items() if len(ns) > 1 for n in ns)


def test_join_awkward_rows(make, awkward, nothing):
    rows = ngram_join.join(awkward).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 10
    assert [by_id[i].component_id for i in (2, 3, 5, 6, 7, 8)] == [2, 3, 5, 5, 7, 8]
    assert by_id[None].component_id is None and by_id[2].n_shingles == by_id[7].n_shingles == 0
    assert ngram_join.join(nothing).count() == 0
    twins = ngram_join.join(make([(None, "the same four words", "", "", 0), (4, "the SAME four words", "", "", 0)])).collect()
    assert {(r.doc_id, r.component_id) for r in twins} == {(None, 4), (4, 4)}


def test_near_pairs_are_a_forest_of_the_task():
    rng = np.random.default_rng(5)
    words = ngram_join.sketch(np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64)), 4).tobytes()
    keys, nodes = 6, 30
    columns = {"key": np.repeat(np.arange(keys), nodes), "node": np.tile(np.arange(nodes), keys)}
    columns |= {c: np.zeros(keys * nodes, np.int64) for c in ("low", "high", "block")}
    columns |= {"cluster": columns["node"], "size": np.full(keys * nodes, 40)}
    table = pa.table({**columns, "sketch": pa.array([words] * (keys * nodes), pa.binary())})
    # The keys of two batches, and a pair of nodes that meets in a small unit again.
    cut = [(columns["key"][: 3 * nodes], table.slice(0, 3 * nodes)), (columns["key"][3 * nodes :], table.slice(3 * nodes)), (np.zeros(2, np.int64), table.slice(0, 2))]
    batches = list(ngram_join._candidates(iter(cut)))
    assert sum(b.num_rows for b in batches) == nodes - 1
    reached = {0}
    for _ in range(nodes):
        reached |= {y for b in batches for e in zip(*(c.to_pylist() for c in b.columns), strict=True) if reached & set(e) for y in e}
    assert reached == set(range(nodes))


def test_joined_pairs_connect_as_all_do():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 60, (2, 200))
    for limit in (5, 1000):
        new = ngram_join.Joined(limit).new(a, b)
        whole, kept = ngram_join.Joined(1000), ngram_join.Joined(1000)
        whole.new(a, b), kept.new(a[new], b[new])
        pairs = [(x, y) for x in range(60) for y in range(60)]
        assert [whole.root(x) == whole.root(y) for x, y in pairs] == [kept.root(x) == kept.root(y) for x, y in pairs]
        assert new.sum() < 60 or limit == 5
