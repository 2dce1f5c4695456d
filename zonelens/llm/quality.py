"""Quality rules: base statistics, and boosted trees over them.

Each text is measured in one pass (``measure``). The base rule rejects short
and repetitive texts; for the others a gradient-boosted model of the labelled
quality decides. Trees are grown on binned features with second-order gains;
on features of ``FALLING`` the score may only fall as the feature rises (a
split that would break this is not made, and both sides stay within bounds
that follow from their parent's split). The trees are complete and flattened
into node arrays of feature, threshold and value, so scoring walks all rows of
a batch through a tree level by level.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents,
those with the smallest hash of their id; only their statistics are collected.
Everything else covers all rows.

Defined results: a NULL or empty text has no words and fails the base rule;
repeated rows are judged alike; an empty table gives no rows; without labelled
rows of both kinds the model keeps everything; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, id_and_text, labelled_sample, rows_where

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A document is kept from this probability of good quality on.
KEEP_FROM = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bangs_per_word",
    "bars_per_word", "stops_per_word", "commas_per_word", "digits_share", "unique_share", "words_per_line",
]
#: Features on which the score may only fall.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "bangs_per_word", "bars_per_word")

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n]
        rolled ^= rolled >> np.uint64(31)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """Base statistics and model features of one text."""
    words = _WORD.findall(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line and _WORD.search(line)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    data, w, c = text.encode(), max(n, 1), max(word_chars, 1)
    features = [
        np.log1p(n),
        word_chars / w,
        symbols / w,
        dup / max(len(lines), 1),
        repeat / w,
        (len(data) - len(data.translate(None, _UPPER))) / c,
        text.count("!") / w,
        text.count("|") / w,
        text.count(".") / w,
        text.count(",") / w,
        (len(data) - len(data.translate(None, _DIGITS))) / c,
        len(set(words)) / w,
        np.log1p(n / max(len(lines), 1)),
    ]
    return [n, word_chars, symbols, dup, repeat], features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


@dataclass
class Trees:
    """Complete trees of one depth as node arrays: row ``t`` of each array is tree ``t``, children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        total = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Boosted trees of ``y`` in {0, 1} with the constraints of ``FALLING``."""
    inner, falls = 2**depth - 1, np.array([f in FALLING for f in FEATURES])
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 40.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin, features, thresholds, values = np.full(len(y), bias), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        bounds = [(-np.inf, np.inf)] * (2 * inner + 1)
        value, node = np.zeros(2 * inner + 1), np.zeros(len(y), np.int64)
        for i in range(inner):
            rows, (low, high) = np.flatnonzero(node == i), bounds[i]
            best, split = 1e-6, None
            for f in range(x.shape[1]) if len(rows) else ():
                k = len(cuts[f]) + 1
                gl, hl = (np.cumsum(np.bincount(binned[rows, f], v[rows], k))[:-1] for v in (g, h))
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = 2 * (gl * vl + gr * vr) - (hl + ridge) * vl**2 - (hr + ridge) * vr**2
                gain[(hl < least / 4) | (hr < least / 4) | (falls[f] & (vl < vr))] = -np.inf
                whole = np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high)
                gain -= 2 * g[rows].sum() * whole - (h[rows].sum() + ridge) * whole**2
                if len(gain) and gain.max() > best:
                    b = int(gain.argmax())
                    best, split = gain[b], (f, b, vl[b], vr[b])
            left, right = 2 * i + 1, 2 * i + 2
            if split is None:  # everything goes left, with the node's own value
                value[left] = value[right] = value[i]
                bounds[left] = bounds[right] = (low, high)
                node[rows] = left
                continue
            f, b, vl, vr = split
            feature[i], threshold[i] = f, cuts[f][b]
            middle = (vl + vr) / 2
            bounds[left] = (max(low, middle), high) if falls[f] else (low, high)
            bounds[right] = (low, min(high, middle)) if falls[f] else (low, high)
            value[left], value[right] = vl, vr
            node[rows] = np.where(binned[rows, f] <= b, left, right)
        leaves = rate * value[inner:]
        margin += leaves[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaves)
    return Trees(np.array(features), np.array(thresholds), np.array(values), bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """The model of ``labels.quality``, from at most ``sample`` documents; base failures are left to the base rule."""

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in column_chunks(batches):
            base, features = zip(*map(measure, texts.to_pylist()), strict=True)
            failed = base_failed(np.array([b[0] for b in base]), np.array([b[4] for b in base]))
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(failed), pa.array(features, pa.list_(pa.float64()))], names=["doc_id", "label", "failed", "features"])

    chosen = labelled_sample(docs, labels, "quality", sample).mapInArrow(measured, "doc_id long, label int, failed boolean, features array<double>")
    rows = chosen.where("not failed").groupBy("doc_id", "label").agg(F.min("features").alias("features")).toPandas().sort_values("doc_id")
    x = np.array(rows["features"].tolist()).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def verdicts(texts: list[str], model: Trees, keep_from: float = KEEP_FROM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, whether the base rule fails, the model's probability and whether the text is kept."""
    base, features = zip(*map(measure, texts), strict=True)
    base, p = np.array(base, np.int64), model.probability(np.array(features))
    failed = base_failed(base[:, 0], base[:, 4])
    return base, failed, p, ~failed & (p >= keep_from)


JUDGED = "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, quality double, kept boolean"


def judge(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """``JUDGED`` rows of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in column_chunks(batches):
            base, failed, p, kept = verdicts(texts.to_pylist(), model, keep_from)
            columns = [ids, *(pa.array(c) for c in base.T.copy()), pa.array(failed), pa.array(p), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "quality", "kept"])

    return id_and_text(docs).mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept."""
    return rows_where(docs, lambda texts: verdicts(texts, model, keep_from)[3])
