"""Importance resampling of documents towards a target distribution, by hashed n-gram features.

The ``tokenizers`` library cuts the ASCII-lowered text: an untrained ``Split`` with a
regular expression returns the words with their offsets. Windows of 1 to ``most``
consecutive offset pairs are the features; a feature's bucket is the CRC-32 of its
words, joined by one space, modulo ``BUCKETS``. Two histograms of buckets, of all
documents and of the target texts, give every bucket a gain (thousandths of the
natural log of the smoothed ratio of its shares); a document weighs the sum of its
features' gains, and a Gumbel number drawn from its id makes the highest scores a
sample without replacement.

One pass cuts the texts and leaves two bytes per feature (``encoded``, checkpointed);
the histogram and the weights are made from these. A histogram has ``BUCKETS`` numbers
at most, the only thing that tasks are sent. Ranks come from a range sort: places within
a range plus the sizes of the ranges before, so no task sees more than its range.

Defined results: NULL and empty texts have no features and weigh 0; a NULL
``doc_id`` draws the number of the empty id and loses ties; repeated rows score
alike and are ranked one after another; an empty table gives no rows, an empty
target makes every gain that of no target features; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from zonelens.llm.common import column_chunks, cut_lineage, id_and_text, ship_package, whole_text

BUCKETS = 10_000
#: Words of the longest feature.
MOST = 1
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters of a text that are cut at a time (a piece ends between words), and buckets that a worker remembers.
PIECE = 1 << 16
MEMORY = 250_000

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@lru_cache
def _splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that no word crosses."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def features(text: str, most: int = MOST) -> Iterator[str]:
    """All runs of 1 to ``most`` consecutive words of a text, each joined by one space."""
    before: list[str] = []
    for piece in pieces(text.translate(_LOWER)):
        cut = _splitter().pre_tokenize_str(piece)
        if most == 1:
            yield from (word for word, _ in cut)
            continue
        # Windows of offset pairs; the last words of the piece before go on in this one.
        words = before + [piece[a:b] for _, (a, b) in cut]
        for end in range(len(before) + 1, len(words) + 1):
            for n in range(1, min(most, end) + 1):
                yield " ".join(words[end - n : end])
        before = words[-(most - 1) :]


class Buckets:
    """Buckets of features; those of features met before are remembered."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets, self.known = buckets, {}

    def of(self, text: str, most: int = MOST) -> np.ndarray:
        found = list(features(text, most))
        new = set(found).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set(found)
        self.known.update((f, crc32(f.encode()) % self.buckets) for f in new)
        return np.fromiter(map(self.known.__getitem__, found), "<u2", len(found))


def encoded(docs: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` (two bytes per feature, in the order of the text) of every row."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket must fit into two bytes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets).of
        for ids, texts in column_chunks(batches):
            cut = [of(t, most) for t in texts.to_pylist()]
            n = np.fromiter(map(len, cut), np.int64, len(cut))
            # n features of runs up to ``most``: w words give w + (w - 1) + ... of them.
            words = n if most == 1 else np.array([_words_of(int(x), most) for x in n], np.int64)
            columns = [ids, pa.array(words), pa.array(n), pa.array([c.tobytes() for c in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _words_of(n: int, most: int) -> int:
    """How many words give ``n`` features."""
    short = most * (most + 1) // 2  # of ``most`` words
    return (n - short) // most + most if n >= short else (math.isqrt(8 * n + 1) - 1) // 2


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of ``encoded``; each task counts its own first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cut in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(cut, "<u2"), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    ratio = ((target + 1.0) * (s + n)) / ((source + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``encoded``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [int(gain[np.frombuffer(cut, "<u2")].sum()) for cut in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number drawn from the id, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... for the ``percent`` in a hundred of the long enough documents that score highest.

    Rows are dealt by ranges of (score, id, row number), so ties cannot fill one task.
    """
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    able = able.withColumn("row", F.monotonically_increasing_id())
    dealt = able.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # a number per partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(starts, "part long, before long")
    placed = dealt.join(F.broadcast(table), "part")  # one row per partition
    rank = F.col("before") + F.col("place") + 1
    placed = placed.withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "before", "place")
    short = rows.where(F.coalesce(F.col("n_words"), F.lit(0)) < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(short)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs`` against the texts of ``target``."""
    ship_package(docs.sparkSession)
    rows = cut_lineage(encoded(id_and_text(docs), most, buckets))
    wanted = encoded(target.select(F.lit(None).cast("long").alias("doc_id"), whole_text().alias("text")), most, buckets)
    gain = gains(histogram(rows, buckets), histogram(wanted, buckets))
    scored = weights(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(cut_lineage(scored), percent, least_words)
