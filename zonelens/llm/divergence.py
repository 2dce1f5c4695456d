"""Divergence between the sources of a language, from smoothed term shares.

Counting is an Arrow pipeline inside ``mapInArrow``: ``ascii_lower``,
``split_pattern_regex`` at everything that is no letter, ``dictionary_encode`` and hash
``group_by`` give partial counts of (language, source, term), merged in the task while
they are few. Spark adds them up. A language keeps the terms of at least ``least``
of its documents; a term's share is smoothed and scaled to whole numbers, so all sums
are exact.

Shares of all kept terms are needed, also of those that do not occur in a source. They
are not stored: kept terms are dealt into shards (about ``SHARD`` terms of a language),
a shard becomes a terms x sources matrix that starts with the share of a count of 0,
and gives each pair of sources its partial sum. More than ``BLOCK`` sources of a
language are dealt in blocks, a unit holds two of them; terms that a unit does not
meet add the difference of two constant shares each.

Defined results: NULL language, source and text are read as ''; empty texts and texts
without terms still make their group occur; a language without kept terms has pairs of
value 0 and no terms; equal values rank by the item's UTF-8 bytes; repeated rows count
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import column_chunks, cut_lineage, ship_package

#: What separates terms: everything in ASCII that is no letter (small ones; capitals are lowered before).
SEPARATORS = r"[\x00-\x60\x7B-\x7F]+"
LEAST = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of a shard, about; sources of a block, about; partial counts that a task merges.
SHARD = 4096
BLOCK = 512
MERGE = 200_000

_KEYS = ["lang", "source", "term"]


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """``lang, source, term, n, docs`` of some documents."""
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATORS)
    terms, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.greater(pc.binary_length(terms), 0)
    terms, owner = terms.filter(full).dictionary_encode(), owner.filter(full)
    groups = pa.table({"lang": lang, "source": source, "row": np.arange(len(lang))})
    of_row = groups.group_by(["lang", "source"], use_threads=False).aggregate([("row", "min")])
    place = groups.join(of_row, ["lang", "source"], use_threads=False).sort_by("row").column("row_min").combine_chunks()
    found = pa.table({"owner": owner, "term": terms.indices})
    found = found.group_by(["owner", "term"], use_threads=False).aggregate([([], "count_all")])
    found = found.append_column("group", place.take(found.column("owner").combine_chunks()))
    found = found.group_by(["group", "term"], use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
    first = found.column("group").combine_chunks()
    columns = [lang.take(first), source.take(first), terms.dictionary.take(found.column("term").combine_chunks())]
    return pa.table([*columns, found.column("count_all_sum").cast(pa.int64()), found.column("count_all_count").cast(pa.int64())], names=[*_KEYS, "n", "docs"])


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term.

    The tasks' partial counts are dealt by language and term, so what follows for a
    language's term over all sources needs no further exchange.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for columns in column_chunks(batches, text=2):
            held.append(_counted(*columns))
            if sum(t.num_rows for t in held) > 2 * MERGE:
                held = [_merged(held)]
                if held[0].num_rows > MERGE:
                    yield from held.pop().to_batches()
        if held:
            yield from _merged(held).to_batches()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.repartition("lang", "term").groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share as a whole number, exact."""
    over = (F.lit(SCALE) * (n + SMOOTH).cast("decimal(28,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (total + SMOOTH * terms).cast("decimal(38,0)")).cast("long") + 1


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    if len(n) and int(n.max()) > 2**63 // SCALE - SMOOTH - 1:
        return np.array([1 + SCALE * (int(x) + SMOOTH) // (int(y) + SMOOTH * terms) for x, y in zip(n, total, strict=True)], np.int64)
    return 1 + SCALE * (n + SMOOTH) // (total + SMOOTH * terms)


def _unit(table: pa.Table) -> pa.Table:
    """Partial sums of all pairs of sources of one shard: rows without a term are the sources."""
    marks = pc.is_null(table.column("term"))
    sources, counts = table.filter(marks), table.filter(pc.invert(marks))
    names, block = sources.column("source"), sources.column("block").to_numpy()
    total, terms = sources.column("n").to_numpy(), int(sources.column("terms")[0].as_py())
    low, high = int(table.column("low")[0].as_py()), int(table.column("high")[0].as_py())
    wanted = np.ones((len(names),) * 2, bool) if low == high else block[:, None] != block[None, :]
    np.fill_diagonal(wanted, False)
    sums, base = np.zeros((len(names),) * 2, np.int64), np.zeros((len(names),) * 2, np.int64)
    found = pc.unique(counts.column("term"))
    if terms:
        none = _shares(np.zeros(len(total), np.int64), total, terms)
        base = np.abs(none[:, None] - none[None, :])
        row = pc.index_in(counts.column("term"), found).to_numpy()
        column = pc.index_in(counts.column("source"), names).to_numpy()
        matrix = np.repeat(none[None, :], len(found), axis=0)
        matrix[row, column] = _shares(counts.column("n").to_numpy(), total[column], terms)
        for i in range(len(names)):
            sums[i] = np.abs(matrix - matrix[:, i : i + 1]).sum(axis=0)
    i, j = np.nonzero(wanted)
    k = len(i)
    langs = pa.array([table.column("lang")[0].as_py()] * k, pa.string())
    numbers = [sums[i, j], np.full(k, len(found)), base[i, j], np.full(k, terms)]
    columns = [langs, names.take(pa.array(i)), names.take(pa.array(j)), *(pa.array(x.astype(np.int64)) for x in numbers)]
    return pa.table([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns], names=["lang", "source", "item", "value", "met", "base", "terms"])


def _pairs(groups: DataFrame, counts: DataFrame, shards: int, blocks: int) -> DataFrame:
    """``lang, source, item, value`` of all ordered pairs of a language's sources."""
    block = F.pmod(F.xxhash64("source"), F.lit(blocks))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    heads = groups.select("lang", spread.alias("shard"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "terms")
    rows = counts.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "source", "term", "n", F.lit(0).cast("long").alias("terms"))
    rows = heads.unionByName(rows).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    sums = rows.groupBy("lang", "shard", "low", "high").applyInArrow(_unit, "lang string, source string, item string, value long, met long, base long, terms long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("met").alias("met"), F.max("base").alias("base"), F.max("terms").alias("terms"))
    return sums.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("met")) * F.col("base")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the language's other sources (``pair``), its most overused terms (``term``)."""
    term = Window.partitionBy("lang", "term")  # one row per source at most
    counted = term_counts(docs).withColumns({"lang_n": F.sum("n").over(term), "held": F.sum("docs").over(term)})
    counts = cut_lineage(counted.where(F.col("held") >= least).select(*_KEYS, "n", "lang_n"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")]))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
    most = sizes.agg(F.max("terms").alias("terms"), F.max("sources").alias("sources")).first()
    pairs = _pairs(groups, counts, -(-(most.terms or 1) // SHARD), -(-(most.sources or 1) // BLOCK))

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = counts.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(over.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
