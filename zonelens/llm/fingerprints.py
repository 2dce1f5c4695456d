"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs (lines; long ones are cut after sentence ends) become 64-bit digests; the
different ones form its set. A sketch has three tables of cells; each digest
is in one cell of each table, and a cell holds the count, the exclusive or of
its digests and that of their checks. Sketches subtract cell by cell, which
cancels what two versions share. Cells with one digest left give it up
(peeling), and it is taken out of its other cells, until all are empty: then
the differing digests are known, with the side they are on, and the likeness is

    (|A| + |B| - differing) / (|A| + |B| + differing)

which is the Jaccard similarity of the sets. A stored fingerprint (text) holds the sketch of
``BASE`` cells per table and the digests from which larger sketches are made, so
two of them can be compared at any later time (``compare``). Where the first sketch is too
small to peel, larger ones are tried: digests are dealt into parts of about ``PART`` by their
bits, each part has its own sketch, and a part that fails is tried again with larger
tables; a part that fails at the last size is compared digest by digest.

``compare_with_next`` walks documents by descending ``doc_id``. Ids are cut
into ranges by approximate quantiles; each range is one window, and a range's
first row is copied to the end of the range above, so no window sees more than
a range. The text is shuffled once.

Defined results: a NULL or empty text has the empty set; two empty sets are
alike (1.0); rows without ``doc_id`` come after all others; rows with the same
id follow each other by their text's hash, in one range; a table of one row is its
own next; an empty table gives no rows; other columns are not read. Only
native column functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelens.llm.common import id_and_text
from zonelens.llm.spans import let

#: Cells per table (powers of two): of a fingerprint, and of a part's sketch and its retries.
BASE = 4
SIZES = (4, 16, 64)
#: Digests of both sides in a part, about.
PART = 4
ROUNDS = 16
#: Digests in which two sets differ, with the side that has each (1: the first, -1: the second).
DIFFERING = "array<struct<digest:bigint,side:int>>"
#: Ranges per shuffle partition, and at most.
RANGES = 4
MOST_RANGES = 4000
#: A paragraph: part of a line up to the first sentence end from 80 code points on, 400 at most; or a line's rest.
PARAGRAPH = r"[^\n]{80,400}?(?:[.!?](?=\s)|(?=\n|\z))|[^\n]{1,400}"


def digests(text: Column) -> Column:
    """The text's different paragraphs as 64-bit digests."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _place(key: Column, table: int, size: int) -> Column:
    """A digest's cell in a table: bits of its own."""
    return F.shiftrightunsigned(key, 10 * table).bitwiseAND(F.lit(size - 1).cast("long"))


def _add(cell: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct((cell["n"] + n).alias("n"), cell["k"].bitwiseXOR(key).alias("k"), cell["h"].bitwiseXOR(check).alias("h"))


def _cells(size: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))


def _filled(cell: Column, keys: Column, table: int, size: int, at: Column, sign: int) -> Column:
    def take(state: Column, key: Column) -> Column:
        return F.when(_place(key, table, size) == at, _add(state, F.lit(sign), key, F.xxhash64(key))).otherwise(state)

    return F.aggregate(keys, cell, take)


def sketch(keys: Column, size: int, minus: Column | None = None) -> Column:
    """Cells of all three tables for ``keys``, less those of ``minus``."""

    def table_of(table: int) -> Column:
        def cell(at: Column) -> Column:
            empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
            own = _filled(empty, keys, table, size, at, 1)
            return own if minus is None else _filled(own, minus, table, size, at, -1)

        return F.transform(_cells(size), cell)

    return F.concat(*map(table_of, range(3)))


def subtracted(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: _add(a, -b["n"], b["k"], b["h"]))


def peeled(cells: Column, size: int) -> Column:
    """The digests in which two sets differ (``DIFFERING``), or NULL if the sketch is too small to tell."""

    def table_less(state: Column, pure: Column, table: int) -> Column:
        def less(cell: Column, at: Column) -> Column:
            own = F.filter(pure, lambda p: _place(p["k"], table, size) == at)
            return F.aggregate(own, cell, lambda c, p: _add(c, -p["n"], p["k"], p["h"]))

        return F.transform(F.slice(state["cells"], table * size + 1, size), less)

    def round_of(state: Column) -> Column:
        found = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == F.xxhash64(c["k"])))

        def take(pure: Column) -> Column:
            rest = F.concat(*(table_less(state, pure, t) for t in range(3)))
            signed = F.transform(pure, lambda p: F.struct(p["k"].alias("digest"), p["n"].alias("side")))
            more = F.struct(rest.alias("cells"), F.concat(state["found"], signed).alias("found"), F.lit(False).alias("stuck"))
            none = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("stuck"))
            return F.when(F.size(pure) == 0, none).otherwise(more)

        return let(F.array_distinct(found), take)

    def done(state: Column) -> Column:
        return F.when(~F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), state["found"])

    start = F.struct(cells.alias("cells"), F.array().cast(DIFFERING).alias("found"), F.lit(False).alias("stuck"))
    # A sketch that gives nothing more is not looked at again.
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, lambda state, _: F.when(state["stuck"], state).otherwise(round_of(state)), done)


def _on_side(keys: Column, side: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("digest"), F.lit(side).alias("side")))


def _part_differing(a: Column, b: Column) -> Column:
    tries = [peeled(sketch(a, size, minus=b), size) for size in SIZES]
    return F.coalesce(*tries, F.concat(_on_side(F.array_except(a, b), 1), _on_side(F.array_except(b, a), -1)))


def differing(a: Column, b: Column) -> Column:
    """The digests in which two sets differ (``DIFFERING``), by sketches of parts."""
    bits = F.ceil(F.log2(F.greatest((F.size(a) + F.size(b)) / PART, F.lit(1.0)))).cast("int")
    outer = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    inner = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")

    def dealt(x: Column, y: Column, count: Column, low_bit: int, then: Callable[[Column, Column], Column]) -> Column:
        def own(keys: Column, p: Column) -> Column:
            return F.filter(keys, lambda k: F.shiftrightunsigned(k, low_bit).bitwiseAND(count - 1) == p)

        def part(p: Column) -> Column:
            return let(F.struct(own(x, p).alias("x"), own(y, p).alias("y")), lambda s: then(s["x"], s["y"]))

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), part))

    return dealt(a, b, outer, 32, lambda x, y: dealt(x, y, inner, 48, _part_differing))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The digests in which two fingerprints differ: by their sketches, or by larger ones (see the module)."""
    return F.coalesce(peeled(subtracted(cells_a, cells_b), BASE), differing(a, b))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Likeness of two fingerprints that differ in the digests ``found``."""
    total, d = F.size(a) + F.size(b), F.size(found)
    return F.when(total == 0, 1.0).otherwise((total - d) / (total + d).cast("double"))


def encoded(cells: Column, keys: Column) -> Column:
    """A fingerprint as text: count, digests and checks of the cells, a colon, and the digests, in hexadecimal."""
    whole = lambda v, n: F.lpad(F.hex(v), n, "0")
    cell = lambda c: F.concat(whole(c["n"].cast("long"), 8), whole(c["k"], 16), whole(c["h"], 16))
    listed = F.array_join(F.transform(F.sort_array(keys), lambda k: whole(k, 16)), "")
    return F.concat(F.array_join(F.transform(cells, cell), ""), F.lit(":"), listed)


def decoded(fingerprint: Column) -> Column:
    """``cells, keys`` of a fingerprint's text."""
    number = lambda text, at, n: F.conv(F.substr(text, F.lit(at), F.lit(n)), 16, -10).cast("long")

    def cell(text: Column) -> Column:
        return F.struct(number(text, 1, 8).cast("int").alias("n"), number(text, 9, 16).alias("k"), number(text, 25, 16).alias("h"))

    halves = F.split(fingerprint, ":")
    cells = F.transform(F.regexp_extract_all(halves[0], F.lit("[0-9A-F]{40}"), F.lit(0)), cell)
    keys = F.transform(F.regexp_extract_all(halves[1], F.lit("[0-9A-F]{16}"), F.lit(0)), lambda text: number(text, 1, 16))
    return F.struct(cells.alias("cells"), keys.alias("keys"))


def compare(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Add to rows with two stored fingerprints their ``likeness`` and the digests in which they differ (``differing``).

    A NULL fingerprint gives NULL.
    """
    rows = pairs.withColumns({"__one": decoded(F.col(one)), "__other": decoded(F.col(other))})
    a, b = (F.col(f"{side}.keys") for side in ("__one", "__other"))
    rows = rows.withColumn("differing", difference(a, b, F.col("__one.cells"), F.col("__other.cells")))
    return rows.withColumn("likeness", likeness(a, b, F.col("differing"))).drop("__one", "__other")


def with_next(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add to ``doc_id, text, ...`` the next row's columns (new name to column), by descending ``doc_id``."""
    spark = rows.sparkSession
    n = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("bounds")).first()["bounds"] or []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<bigint>")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))))
    # A range's first row; one row per range, so the window over them is small.
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", (-F.col("tie").cast("decimal(20,0)")).alias("minus"))).alias("head"))
    above = Window.orderBy(F.desc("range"))
    target = F.coalesce(F.lag("range").over(above), F.min("range").over(Window.partitionBy()))
    heads = heads.select(F.col("range").alias("head_range"), F.col("head.doc_id").alias("head_id"), (-F.col("head.minus")).cast("long").alias("head_tie"), target.alias("target"))
    same = (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    guests = rows.join(F.broadcast(heads), same).withColumn("range", F.col("target")).select(*rows.columns, F.lit(True).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    nexts = {name: F.lead(column).over(order) for name, column in columns.items()}
    return both.select("*", *(c.alias(name) for name, c in nexts.items())).where(~F.col("guest")).drop("guest", "range", "tie")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has its last half (code points, rounded down) replaced by
    the first as many of the next document. ``differing_edited`` and ``differing_next`` are the
    recovered digests (``DIFFERING``).
    """
    rows = id_and_text(docs).withColumn("keys", digests(F.col("text")))
    rows = with_next(rows, {"next_text": "text", "next_keys": "keys"})
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "keys", "next_keys", digests(F.col("edited")).alias("edited_keys"))
    rows = rows.withColumns({f"{c}_cells": sketch(F.col(c), BASE) for c in ("keys", "edited_keys", "next_keys")})
    for c in ("edited", "next"):
        rows = rows.withColumn(f"differing_{c}", difference(F.col("keys"), F.col(f"{c}_keys"), F.col("keys_cells"), F.col(f"{c}_keys_cells")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        encoded(F.col("keys_cells"), F.col("keys")).alias("fingerprint"),
        encoded(F.col("edited_keys_cells"), F.col("edited_keys")).alias("edited_fingerprint"),
        *(likeness(F.col("keys"), F.col(f"{c}_keys"), F.col(f"differing_{c}")).alias(f"near_{c}") for c in ("edited", "next")),
        "differing_edited",
        "differing_next",
    )
