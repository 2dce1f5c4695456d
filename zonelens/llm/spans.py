"""Where a pattern matches in a text, with native column functions only.

Offsets count code points. A text is cut at its matches; the lengths of the
cuts and of the matches add up to the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element of a span array.
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), 0)


def running_sums(values: Column) -> Column:
    """Running sums of a non-empty array of integers.

    An array grows by copying, so it is cut into about as many blocks as a block
    has values: sums within blocks, then those of the blocks before.
    """

    def add(done: Column, value: Column) -> Column:
        return F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + value))

    def cut(v: Column) -> Column:
        length = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(1), F.size(v), length)
        return F.transform(starts, lambda s: F.aggregate(F.slice(v, s, length), F.array().cast("array<int>"), add))

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda done, b: add(done, F.get(b, F.size(b) - 1)))
        shifted = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o))
        return F.flatten(shifted)

    return let(values, lambda v: let(cut(v), joined))


def spans(text: Column, pattern: str | Column) -> Column:
    """The pattern's leftmost, non-overlapping matches as an array of ``SPAN``, in order.

    To filter on it, filter on ``rlike`` first: a filter on the array itself is moved to
    the scan and finds the matches a second time.
    """

    def located(found: Column) -> Column:
        def ends(gaps: Column) -> Column:
            return running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: g + F.length(v)))

        def cut(end: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                return F.struct((F.get(end, i) - F.length(v)).alias("start"), F.get(end, i).alias("end"), v.alias("value"))

            return F.transform(found, span)

        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        return F.when(F.size(found) > 0, let(gaps, lambda g: let(ends(g), cut))).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0)), located)


def rewritten(text: Column, spans: Column, replacement) -> Column:
    """The text with each span replaced by ``replacement(span)``; spans are sorted, and what overlaps is replaced once."""

    def step(state: Column, span: Column) -> Column:
        at, out = state["at"], state["out"]
        # The text between spans; nothing where the span starts inside the one before it.
        between = F.substr(text, at + 1, F.greatest(span["start"] - at, F.lit(0)))
        new = F.struct(F.greatest(span["end"], at).alias("at"), F.concat(out, F.array(between, replacement(span))).alias("out"))
        return F.when(span["start"] >= at, new).when(span["end"] > at, F.struct(span["end"].alias("at"), out.alias("out"))).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
