"""ASCII forms of internationalised domain names (``xn--`` labels) as native column expressions.

A label with characters beyond ASCII becomes ``xn--`` and its Punycode (RFC 3492): its ASCII
characters, then for each other character, by code point and place, how far the
decoder must count until it inserts that character. The count is written in base 36 with
thresholds that adapt to the counts before. Everything is a fold over arrays of a label's
length; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punycode's base, thresholds, skew, damping, and the first bias and code point.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits of the largest count, and divisions that its adaption takes, that 32 bits need.
STEPS = 8


def _div(a: Column, b: int | Column) -> Column:
    return F.floor(a / b).cast("long")


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _number(count: Column, bias: Column) -> Column:
    """A count as digits, the least first; a digit below its threshold is the last."""

    def digit(d: Column) -> Column:
        return F.substr(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))

    def step(state: Column, i: Column) -> Column:
        t = F.least(F.greatest(i * BASE - bias, F.lit(T_MIN)), F.lit(T_MAX)).cast("long")
        q = state["q"]
        last = F.struct(F.lit(-1).cast("long").alias("q"), F.concat(state["out"], digit(q)).alias("out"))
        more = F.struct(_div(q - t, BASE - t).alias("q"), F.concat(state["out"], digit(t + (q - t) % (BASE - t))).alias("out"))
        return F.when(q < 0, state).when(q < t, last).otherwise(more)

    start = F.struct(count.alias("q"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["out"])


def _adapted(count: Column, written: Column, first: Column) -> Column:
    """The bias after a count, with ``written`` characters in the output."""
    damped = F.when(first, _div(count, DAMP)).otherwise(_div(count, 2))

    def step(state: Column, _: Column) -> Column:
        more = F.struct(_div(state["d"], BASE - T_MIN).alias("d"), (state["k"] + BASE).alias("k"))
        return F.when(state["d"] > (BASE - T_MIN) * T_MAX // 2, more).otherwise(state)

    start = F.struct((damped + _div(damped, written)).alias("d"), F.lit(0).cast("long").alias("k"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return _once(done, lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW))


def _punycode(label: Column) -> Column:
    def encoded(points: Column) -> Column:
        plain = F.filter(points, lambda c: c < FIRST)
        places = F.filter(F.transform(points, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda p: p["c"] >= FIRST)

        def step(state: Column, p: Column) -> Column:
            # Where the character goes: after those before it that are written already.
            before = F.size(F.filter(F.slice(points, 1, p["i"]), lambda c: c <= p["c"])).cast("long")
            written = state["written"]
            count = (p["c"].cast("long") - state["c"]) * (written + 1) + before - state["at"]

            def after(n: Column) -> Column:
                return F.struct(
                    p["c"].cast("long").alias("c"),
                    (before + 1).alias("at"),
                    (written + 1).alias("written"),
                    _adapted(n, written + 1, state["first"]).alias("bias"),
                    F.lit(False).alias("first"),
                    F.concat(state["out"], _number(n, state["bias"])).alias("out"),
                )

            return _once(count, after)

        basic = F.array_join(F.transform(plain, lambda c: F.char(c)), "")
        start = F.struct(
            F.lit(FIRST).cast("long").alias("c"),
            F.lit(0).cast("long").alias("at"),
            F.size(plain).cast("long").alias("written"),
            F.lit(BIAS).cast("long").alias("bias"),
            F.lit(True).alias("first"),
            F.when(F.size(plain) > 0, F.concat(basic, F.lit("-"))).otherwise("").alias("out"),
        )
        return F.aggregate(F.array_sort(places), start, step, lambda s: s["out"])

    return _once(F.transform(F.split(label, ""), lambda c: F.ascii(c)), encoded)


def ascii_label(label: Column) -> Column:
    """A label's ASCII form; ASCII labels stay."""
    return F.when(label.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), _punycode(F.lower(label)))).otherwise(label)


def ascii_name(name: Column) -> Column:
    """A name's ASCII form, label by label (full stops of other scripts separate labels, too)."""
    labels = F.split(F.translate(name, "。．｡", "..."), r"\.")
    return F.when(name.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(labels, ascii_label), ".")).otherwise(name)
