"""Toxicity: subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself (all
hashed into ``BUCKETS`` rows), a window the mean of its words, and a linear
softmax over the window's vector gives the toxic probability. A misspelling
shares most n-grams with its word, and so its vector.

Insults are few words of a long text, so a text scores as its most toxic
window, and training sees a toxic text as a bag of windows of which at least
one is toxic (noisy or); every window of another text is clean. Vectors and
softmax weights move together, by Adam on the whole sample. After training
the weights are folded into one number per bucket, so a text costs a look-up
per word.

The model is fitted on the driver on three quarters of at most ``SAMPLE`` labelled
documents, those with the smallest hash of their id, of each at most ``BAG`` windows
(toxic) or its share of ``CLEAN_WINDOWS`` (others), evenly spaced. The other quarter
calibrates: its whole texts are scored where they are, as scoring reads every
whole text, and only one number of each comes to the driver. What comes of the others is
laid out by the tasks as flat arrays (hashes of the windows' words, and once per
different word its n-grams' buckets), which the fit reads in place: no text, window or word
is a Python object on the driver.

Defined results: a NULL or empty text scores as the empty window, the model's
bias; repeated rows score alike; an empty table gives no rows; without
labelled rows of both kinds every score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, id_and_text, labelled_sample, rows_where

SAMPLE = 12_000
BAG = 1024
#: Windows of clean documents in all, shared evenly.
CLEAN_WINDOWS = 400_000
BUCKETS = 1 << 17
SIZE = 8
GRAMS = (3, 4, 5)
WINDOW = 4
STRIDE = 2
#: A document is toxic from this score on.
TOXIC_FROM = 0.7
#: Word scores that a worker remembers; beyond them it starts anew.
MEMORY = 250_000
_EDGES = ".,;:!?\"'()[]{}<>|*$%&#-_~`“”‘’«»…"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(word: str) -> str:
    return word.lower().strip(_EDGES)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and the number of the word that each belongs to."""
    marked = [f"<{normalised(w)}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    rolled = np.zeros(len(points), np.uint64)
    buckets, owners = [], []
    for n in range(1, max(GRAMS) + 1):
        # rolled[i] hashes the n points from i on
        rolled = (rolled[: len(points) - n + 1] ^ points[n - 1 :]) * _MIX
        rolled ^= rolled >> np.uint64(32)
        if n in GRAMS:
            at = np.arange(len(rolled))
            inside = at + n <= ends[owner[: len(rolled)]]
            buckets.append(rolled[inside])
            owners.append(owner[: len(rolled)][inside])
    # The whole word: a position-dependent sum of its points.
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    mixed = (points + (place.astype(np.uint64) << np.uint64(32))) * _MIX
    mixed ^= mixed >> np.uint64(29)
    starts = ends - lengths
    buckets.append(np.add.reduceat(mixed * _MIX, starts) if len(words) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(words)))
    return (np.concatenate(buckets) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def window_starts(n: int) -> np.ndarray:
    """Where the windows of ``n`` words start; the last one ends with the text."""
    last = max(n - WINDOW, 0)
    return np.unique(np.append(np.arange(0, last + 1, STRIDE), last))


@dataclass
class Model:
    """One weight per bucket (vectors folded with the softmax weights) and the bias, as log-odds."""

    weight: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "known": {}}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = words
        if new:
            ordered = list(new)
            buckets, owners = gram_buckets(ordered)
            total = np.bincount(owners, self.weight[buckets], len(ordered))
            self.known.update(zip(ordered, (total / np.bincount(owners, minlength=len(ordered))).tolist(), strict=True))

    def odds(self, windows: list[str]) -> float:
        """Log-odds of the most toxic of given windows."""
        cut = [w.split() for w in windows]
        self._learn(set().union(*cut))
        return self.bias + max(sum(map(self.known.__getitem__, words)) / len(words) for words in cut)

    def text_odds(self, texts: list[str]) -> list[float]:
        """Log-odds of each text: those of its most toxic window."""
        cut = [t.split() for t in texts]
        self._learn(set().union(*cut))
        get, out = self.known.__getitem__, []
        for words in cut:
            odds = self.bias
            if words:
                sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(get, words), float, len(words)))])
                starts = window_starts(len(words))
                ends = np.minimum(starts + WINDOW, len(words))
                odds += float(((sums[ends] - sums[starts]) / (ends - starts)).max())
            out.append(odds)
        return out

    def score(self, texts: list[str]) -> list[float]:
        """Toxic probability of each text: that of its most toxic window."""
        return [1 / (1 + np.exp(-max(min(odds, 40.0), -40.0))) for odds in self.text_odds(texts)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, joined."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Bags:
    """Bags of windows as flat arrays: each window's words (numbers in the vocabulary), and each word's n-gram buckets."""

    windows: np.ndarray  # of each bag
    sizes: np.ndarray  # words of each window
    words: np.ndarray
    grams: np.ndarray
    gram_counts: np.ndarray  # of each word of the vocabulary

    @classmethod
    def of(cls, bags: list[list[str]]) -> Bags:
        vocabulary: dict[str, int] = {}
        cut = [window.split() for bag in bags for window in bag]
        words = np.array([vocabulary.setdefault(w, len(vocabulary)) for words in cut for w in words], np.int32)
        grams, counts = word_grams(list(vocabulary))
        return cls(np.array(list(map(len, bags)), np.int32), np.array(list(map(len, cut)), np.int32), words, grams, counts)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of all words, word after word, and how many each has."""
    buckets, owners = gram_buckets(words)
    return buckets[np.argsort(owners, kind="stable")].astype(np.int32), np.bincount(owners, minlength=len(words)).astype(np.int32)


class _Part:
    """A share of the bags with its n-grams laid out for sums along sorted copies."""

    def __init__(self, bags: Bags, share: np.ndarray, weight: np.ndarray, toxic: np.ndarray) -> None:
        counts = bags.windows[share]
        windows = _ranges((np.cumsum(bags.windows) - bags.windows)[share], counts)
        sizes = bags.sizes[windows]
        used, flat = np.unique(bags.words[_ranges((np.cumsum(bags.sizes) - bags.sizes)[windows], sizes)], return_inverse=True)
        flat = flat.astype(np.int32)
        self.bag_of = np.repeat(np.arange(len(share), dtype=np.int32), counts)
        grams = bags.gram_counts[used]
        self.word_buckets = bags.grams[_ranges((np.cumsum(bags.gram_counts) - bags.gram_counts)[used], grams)]
        self.word_at = np.cumsum(grams) - grams
        owners = np.repeat(np.arange(len(used), dtype=np.int32), grams)
        by_bucket, by_place = (np.argsort(k, kind="stable") for k in (self.word_buckets, flat))
        self.flat, self.bucket_words = flat, owners[by_bucket]
        self.bucket_at, self.place_at = (np.flatnonzero(np.diff(k[i], prepend=-1)) for k, i in ((self.word_buckets, by_bucket), (flat, by_place)))
        self.buckets = self.word_buckets[by_bucket][self.bucket_at]
        self.window_at, self.word_windows = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_place]
        self.grams, self.lengths = grams.astype(np.float32), sizes.astype(np.float32)
        self.weight, self.clean = weight, ~toxic[self.bag_of]
        self.per_window = (weight / counts)[self.bag_of]

    def slopes(self, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slopes of the loss by bucket vectors (one row per dimension), softmax weights and biases."""
        words = [np.add.reduceat(v[self.word_buckets], self.word_at) / self.grams for v in vectors]
        windows = np.stack([np.add.reduceat(w[self.flat], self.window_at) / self.lengths for w in words])
        direction = softmax[1] - softmax[0]
        odds = direction @ windows + (bias[1] - bias[0])
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        # Noisy or: no window of a toxic text being toxic has probability exp(-sum of softplus).
        none = np.exp(-np.bincount(self.bag_of, np.logaddexp(0, odds), len(self.weight)))
        slope = np.where(self.clean, p * self.per_window, -p * (self.weight * none / np.maximum(1 - none, 1e-9))[self.bag_of])
        by_word = np.add.reduceat((slope.astype(np.float32) / self.lengths)[self.word_windows], self.place_at) / self.grams
        by_bucket = np.zeros(vectors.shape[1], np.float32)
        by_bucket[self.buckets] = np.add.reduceat(by_word[self.bucket_words], self.bucket_at)
        to_softmax, to_bias = windows @ slope, slope.sum()
        return direction[:, None] * by_bucket, np.stack([-to_softmax, to_softmax]), np.array([-to_bias, to_bias])


def fit(bags: Bags, toxic: np.ndarray, epochs: int | None = None, parts: int = 16, rate: float = 0.03, decay: float = 0.1, seed: int = 7) -> Model:
    """Train on texts given as bags of windows, and their labels."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS), -40.0)
    epochs = epochs or int(np.clip(180_000 // len(toxic), 20, 60))  # few bags are seen more often
    rng = np.random.default_rng(seed)
    weight = np.where(toxic, 1 / toxic.sum(), 1 / (~toxic).sum())
    shares = [x for x in np.array_split(rng.permutation(len(toxic)), min(parts, len(toxic))) if len(x)]
    laid = [_Part(bags, share, len(shares) * weight[share], toxic[share]) for share in shares]
    vectors = rng.normal(0, 0.1, (SIZE, BUCKETS)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (2, SIZE)), np.array([2.0, -2.0])
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)], 0
    for _ in range(epochs):
        for i in rng.permutation(len(laid)):
            step += 1
            for values, slope, (first, second) in zip((vectors, softmax, bias), laid[i].slopes(vectors, softmax, bias), moments, strict=True):
                first += 0.1 * (slope - first)
                second += 0.01 * (slope**2 - second)
                if values is vectors:
                    values *= 1 - rate * decay
                values -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    seen = np.zeros(BUCKETS, bool)
    for part in laid:
        seen[part.buckets] = True
    return Model(np.where(seen, (softmax[1] - softmax[0]) @ vectors, 0.0), float(bias[1] - bias[0]))


def bag(text: str, most: int) -> list[str]:
    """At most ``most`` evenly spaced windows of a text, each as its words joined by a space."""
    words = text.split()
    starts = window_starts(len(words)) if words else np.zeros(0, np.int64)
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(np.int64)]
    return [" ".join(words[s : s + WINDOW]) for s in starts.tolist()]


def calibrated(model: Model, odds: np.ndarray, toxic: np.ndarray, at: float = TOXIC_FROM) -> Model:
    """The model with its bias moved so that ``at`` is the score that tells held-out texts apart best.

    ``odds``: the model's log-odds of them. Best is by F1, with at most one clean text in a hundred above it.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all() or not model.weight.any():
        return model
    order = np.argsort(-odds)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + toxic.sum())
    best = int(f1.argmax())
    cut = (odds[order[best]] + odds[order[min(best + 1, len(odds) - 1)]]) / 2
    cut = max(cut, float(np.quantile(odds[~toxic], 0.99)))
    return Model(model.weight, float(model.bias + np.log(at / (1 - at)) - cut))


def fit_and_calibrate(bags: list[list[str]], toxic: np.ndarray, held: np.ndarray, **settings: float) -> Model:
    """Fit on the bags that are not ``held``, calibrate on those that are."""
    learn, test = np.flatnonzero(~held), np.flatnonzero(held)
    model = fit(Bags.of([bags[i] for i in learn]), toxic[learn], **settings)
    return calibrated(model, np.array([model.odds(bags[i]) for i in test]), toxic[test])


def _word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values, joined."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8)


def train(docs: DataFrame, labels: DataFrame, allowed: Callable[[str], Column] | None = None, sample: int = SAMPLE) -> Model:
    """The model of ``labels.toxic``; ``allowed`` restricts the labels that may be used, by ``doc_id``.

    A quarter of the sample, by hash of the id, calibrates the score: every
    window of its whole texts is scored, in Spark, whatever their label.
    """
    usable = labels if allowed is None else labels.where(allowed("doc_id"))
    share = int(np.clip(CLEAN_WINDOWS // max(1, min(sample, usable.count())), 1, BAG))
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    chosen = labelled_sample(docs, usable, "toxic", sample)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[list[str]]]]:
        for ids, texts, marks in column_chunks(batches):
            yield ids, marks, [bag(t, BAG if mark else share) for t, mark in zip(texts.to_pylist(), marks.to_pylist(), strict=True)]

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, found in cut(batches):
            windows = [[w.split() for w in windows] for windows in found]
            sizes = pa.array([bytes(map(len, b)) for b in windows], pa.binary())
            words = pa.array([np.array([_word_key(w) for window in b for w in window], np.int64).tobytes() for b in windows], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, marks, sizes, words], names=["doc_id", "label", "sizes", "words"])

    def vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, found in cut(batches):
            words = list({w for windows in found for window in windows for w in window.split()})
            grams, counts = word_grams(words)
            ends = np.cumsum(counts)
            own = [grams[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_word_key(w) for w in words], pa.int64()), pa.array(own, pa.binary())], names=["word", "grams"])

    learned = chosen.where(~held)
    rows = learned.mapInArrow(bags, "doc_id long, label int, sizes binary, words binary").groupBy("doc_id", "label")
    rows = rows.agg(F.min(F.struct("sizes", "words")).alias("bag")).where(F.length("bag.sizes") > 0).select("doc_id", "label", "bag.*")
    rows = rows.toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model(np.zeros(BUCKETS), -40.0)
    known = learned.mapInArrow(vocabulary, "word long, grams binary").groupBy("word").agg(F.min("grams").alias("grams"))
    known = known.toArrow().sort_by("word")
    sizes, grams = _flat(rows.column("sizes")), _flat(known.column("grams")).view(np.int32)
    laid = Bags(
        pc.binary_length(rows.column("sizes")).to_numpy(),
        sizes.astype(np.int32),
        np.searchsorted(known.column("word").to_numpy(), _flat(rows.column("words")).view(np.int64)).astype(np.int32),
        grams,
        pc.binary_length(known.column("grams")).to_numpy() // 4,
    )
    toxic = rows.column("label").to_numpy() == 1
    del rows, known
    model = fit(laid, toxic)
    del laid

    def odds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in column_chunks(batches):
            texts = texts.to_pylist()
            full = pa.array([bool(t.split()) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(model.text_odds(texts), pa.float64())], names=["doc_id", "label", "odds"]).filter(full)

    rows = chosen.where(held).mapInArrow(odds, "doc_id long, label int, odds double")
    rows = rows.groupBy("doc_id", "label").agg(F.max("odds").alias("odds")).toPandas()
    return calibrated(model, rows["odds"].to_numpy(float), rows["label"].to_numpy() == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in column_chunks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(texts.to_pylist()), pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``toxic_from``."""
    return rows_where(docs, lambda texts: [p < toxic_from for p in model.score(texts)])
