"""Quality and toxicity: exact statistics, properties of the models, held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonelens.llm import quality, queries, toxicity

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_statistics(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_op2_rows(spark, texts):
    rows = queries.QUERIES["op2_quality_rules"](spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        want = plain_statistics(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_statistics_of_awkward_texts():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n\t\x0b\x85\xa0#|é"), rng.integers(0, 80)))
        assert quality.measure(text)[0] == plain_statistics(text)
    assert quality.repeated_words("a b c d e f g h a b c d e f g h i".split()) == 16


def test_quality_awkward(spark, awkward, nothing, labels):
    model = quality.train(awkward, labels)  # no label of use: everything is kept but what the base rule rejects
    rows = quality.judge(awkward, model).collect()
    assert len(rows) == 10 and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    kept = quality.keep_good(awkward, model)
    assert kept.schema == awkward.schema and kept.count() == sum(r.kept for r in rows)
    assert quality.judge(nothing, model).count() == quality.keep_good(nothing, model).count() == 0


@pytest.fixture(scope="module")
def measured(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id", "text").join(labels, "doc_id").orderBy("doc_id").toPandas()


def test_quality_held_out_and_monotone(measured):
    base, x = (np.array(v, float) for v in zip(*map(quality.measure, measured["text"])))
    usable = ~quality.base_failed(base[:, 0], base[:, 4])
    x, y = x[usable], measured["quality"].to_numpy()[usable]
    half = np.arange(len(y)) % 2 == 0
    model = quality.fit(x[half], y[half].astype(float))
    kept = model.probability(x[~half]) >= quality.KEEP_FROM
    assert kept[y[~half] == 1].mean() > 0.995 and kept[y[~half] == 0].mean() < 0.05
    for name in quality.FALLING:
        f, raised = quality.FEATURES.index(name), x[~half].copy()
        for step in (0.01, 0.1, 1.0, 5.0):
            raised[:, f] = x[~half][:, f] + step
            assert (model.score(raised) <= model.score(x[~half]) + 1e-9).all()


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 1] + x[:, 5] ** 2 > 0.5).astype(float)
    model = quality.fit(x, y, rounds=30)
    for row in x[:50]:
        total = model.bias
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if row[feature[node]] <= threshold[node] else 2)
            total += value[node - len(feature)]
        assert abs(total - model.score(row[None])[0]) < 1e-9
    assert ((model.score(x) > 0) == (y == 1)).mean() > 0.9


def test_toxicity_held_out(measured):
    bags = [toxicity.bag(t, toxicity.BAG if m else 64) for t, m in zip(measured["text"], measured["toxic"])]
    toxic, rest = measured["toxic"].to_numpy() == 1, np.array([zlib.crc32(str(d).encode()) % 3 for d in measured["doc_id"]])
    usable = np.array([len(b) > 0 for b in bags])
    learn = np.flatnonzero((rest != 1) & usable)
    model = toxicity.fit_and_calibrate([bags[i] for i in learn], toxic[learn], learn % 4 == 0)
    test = np.flatnonzero(rest == 1)
    scores = np.array(model.score([measured["text"][i] for i in test]))
    order = scores.argsort().argsort()
    n = toxic[test].sum()
    auc = (order[toxic[test]].sum() - n * (n - 1) / 2) / (n * (len(test) - n))
    # Some labelled texts hold no toxic word at all.
    assert auc > 0.92
    assert (scores[toxic[test]] >= 0.7).mean() > 0.75 and (scores[~toxic[test]] >= 0.7).mean() < 0.04
    # A misspelling shares its n-grams with the word.
    model._learn({"idiot", "idiott", "table"})
    assert model.known["idiott"] > model.known["table"] and model.known["idiot"] > model.known["table"]


def test_toxicity_calibrates_on_whole_texts(spark):
    """Held-out clean texts of 1500 words with one rough word each: wherever it stands, it counts."""
    rng = np.random.default_rng(4)
    ids = spark.range(160).withColumn("held", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(4)) == 0).collect()
    rows, long = [], {}
    for d, held in ids:
        toxic = d % 4 == 0
        words = [f"word{i}" for i in rng.integers(0, 300, 1500 if held and not toxic else 60)]
        if toxic:
            words[rng.integers(len(words))] = "moron"
        elif held:
            words[1001] = "moron"  # in two of 749 windows
            long[d] = " ".join(words)
        rows.append((d, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    scores = np.array(model.score(list(long.values())))
    assert len(scores) > 20 and (scores >= toxicity.TOXIC_FROM + 1e-6).mean() <= 1 / len(scores)


def test_word_scores_are_means_of_their_buckets():
    words = ["Moron,", "a", "", "naïve", "+++", "𝄞𝄞"]
    buckets, owners = toxicity.gram_buckets(words)
    weight = np.random.default_rng(0).normal(size=toxicity.BUCKETS)
    model = toxicity.Model(weight, 0.0)
    model._learn(set(words))
    for i, word in enumerate(words):
        own = buckets[owners == i]
        marked = f"<{toxicity.normalised(word)}>"
        assert len(own) == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.GRAMS)
        assert abs(model.known[word] - weight[own].mean()) < 1e-12
    one = toxicity.gram_buckets(["naïve"])[0]
    assert sorted(one) == sorted(buckets[owners == 3])


def test_window_maximum():
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS), -0.5)
    for n in (1, 2, 3, 4, 5, 6, 11):
        words = [f"word{i}" for i in range(n)]
        model._learn(set(words))
        starts = sorted({*range(0, max(n - 4, 0) + 1, 2), max(n - 4, 0)})
        odds = model.bias + max(np.mean([model.known[w] for w in words[s : s + 4]]) for s in starts)
        assert abs(model.score([" ".join(words)])[0] - 1 / (1 + np.exp(-odds))) < 1e-9


def test_op5_rows(spark, texts):
    rows = queries.QUERIES["op5_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_awkward(awkward, nothing, labels, documents):
    model = toxicity.train(documents, labels)
    rows = toxicity.score(awkward, model).collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == 10 and by_id[2] == by_id[3] == by_id[7] and by_id[5] == by_id[6]
    assert toxicity.keep_clean(awkward, model).schema == awkward.schema
    assert toxicity.score(nothing, model).count() == toxicity.keep_clean(nothing, model).count() == 0
    assert {r.score for r in toxicity.score(awkward, toxicity.train(nothing, labels)).collect()} == {1 / (1 + np.exp(40.0))}
