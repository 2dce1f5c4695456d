"""Near-duplicate classes against all pairs, and components against a plain union."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from zonelens.llm import near_dup, queries
from zonelens.llm.components import connected_components

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_force(texts):
    """Class of each id by all pairs."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def check(rows, texts):
    classes, sizes = brute_force(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (classes[r.doc_id], sizes[r.doc_id], classes[r.doc_id] == r.doc_id)


def test_op8_rows(spark, texts):
    check(queries.QUERIES["op8_near_dup"](spark, SF).collect(), texts)


def family(rng, words, copies, edits):
    base = [rng.choice("abcdefghij") * rng.randint(1, 9) + str(rng.randrange(999)) for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        yield " ".join(text)


@pytest.fixture(scope="module")
def families():
    """Chains and clouds of edited copies around the threshold, with short and repeated texts."""
    rng = random.Random(3)
    made = [t for n in (5, 6, 20, 60, 200, 200, 400) for t in family(rng, n, 25, max(1, n // 25))]
    made += ["one two", "One TWO", "one two three", "", " \n"] + made[:10] + list(family(rng, 150, 120, 8))
    rng.shuffle(made)
    return dict(enumerate(made))


def test_families_equal_all_pairs(make, families):
    check(near_dup.classes(make([(d, t, "en", "s", 0) for d, t in families.items()])).collect(), families)


def test_blocks_change_nothing(make, families, monkeypatch):
    for name, value in (("BUCKET_BLOCK", 7), ("FAMILY_BLOCK", 5), ("FAMILY_SHINGLES", 900)):
        monkeypatch.setattr(near_dup, name, value)
    check(near_dup.classes(make([(d, t, "en", "s", 0) for d, t in families.items()])).collect(), families)


def test_awkward_rows(make, awkward, nothing):
    rows = near_dup.classes(awkward).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 10
    assert by_id[2].n_shingles == by_id[3].n_shingles == by_id[7].n_shingles == 0 and by_id[2].kept and by_id[3].kept
    assert (by_id[5].kept, by_id[6].kept, by_id[6].component_id) == (True, False, 5)
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_dup.classes(nothing).count() == 0
    twins = near_dup.classes(make([(None, "the same five words here", "", "", 0), (4, "the same five words here", "", "", 0)])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in twins} == {(None, 4, False), (4, 4, True)}


def test_keep_one_keeps_columns(awkward, nothing):
    kept = near_dup.keep_one(awkward)
    assert kept.schema == awkward.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert near_dup.keep_one(nothing).count() == 0


def test_class_without_ids_keeps_one(make):
    words = [f"w{i}" for i in range(100)]
    near = [" ".join([*words, f"end{i}"]) for i in range(3)]
    kept = near_dup.keep_one(make([(None, t, "", "", 0) for t in [*near, near[0], "something else with five words"]])).collect()
    assert len(kept) == 2 and len({r.text for r in kept} & set(near)) == 1


def test_stage_equals_all_pairs_at_80(spark, make, families):
    rows = make([(d, t, "en", "s", 0) for d, t in families.items()])
    sets = {d: shingle_set(t) for d, t in families.items()}
    classes = {d: d for d in sets}
    for a in sorted(sets):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and classes[a] != classes[b]:
                low, high = sorted((classes[a], classes[b]))
                classes = {d: low if c == high else c for d, c in classes.items()}
    assert classes != brute_force(families)[0]
    # Of texts without words each stays.
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect()}
    assert kept == {d for d, c in classes.items() if c == d}


def test_components_of_a_path_a_star_and_noise(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in linked}


def test_forest_spans_what_is_linked():
    linked = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        linked[a, b] = linked[b, a] = True
    assert len(near_dup.forest(linked)) == 3


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(20)]
    got = near_dup.shared_counts(sets, columns=7)
    for i in range(20):
        for j in range(20):
            assert i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j]))
