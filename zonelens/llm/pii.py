"""Personal data: base patterns, and terms that disclose what they found.

Base findings (e-mail, IP, card, phone) are the protected entities. A term is a
word that stands alone; it co-occurs with an entity when it is within
``REACH`` code points of it. Over the whole corpus, with windows of that width,

    PMI(e; t) = log2( n(e,t) * W / (n(e) * n(t)) ),  IC(e) = log2( W / n(e) )

where n counts occurrences (n(e,t): those of t's near e) and W windows. The
term's disclosure PMI / IC is the share of the entity's information that the
term reveals: 1 + log2(n(e,t) / n(t)) / IC(e), 1 if the term occurs only near the entity. A few
occurrences show little of the share n(e,t) / n(t), so its lower confidence bound
(Wilson, ``Z`` deviations) stands for it, with the different contexts as the sample:
copies of a context add nothing. Most values occur once, so besides the value itself
its class is an entity, too: the mail domain, the network of 256 addresses, the number's first six
digits. In documents that hold the entity, terms from ``GENERALISE`` on are
generalised, from ``REMOVE`` on removed.

Copies of a text are worked on once. Counting is pre-aggregated; joins are on
a word or on a text's digest, so no group is gathered except a text's own spans.

Defined results: a NULL or empty text has no spans; repeated rows get equal
results; an empty table gives no rows; other columns are not read. Only native
column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import cut_lineage, id_and_text
from zonelens.llm.spans import rewritten, spans

#: Kinds in order. The patterns start only where the plain ones could (look-behinds) and do
#: not step back (possessive), so they find the same matches in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # 14 to 19 digits: other lengths fail anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Added kinds, after the base ones.
ADDED = ("generalised", "removed")

#: A term: a word of four letters or more that is no part of an address or a number.
_ALONE = (r"(?<![\p{L}\p{N}_%+@.-])", r"(?![\p{L}\p{N}_%+@-]|\.[\p{L}\p{N}])")
TERM = rf"{_ALONE[0]}\p{{L}}{{4,}}+{_ALONE[1]}"
REACH = 80
#: Deviations of the confidence bound (95 in a hundred, one-sided).
Z = 1.645
GENERALISE = 0.85
REMOVE = 0.95

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def weight(i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


_PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: _digits(v).between(10, 15),
}


def _passed(found: Column, rank: int, kind: str) -> Column:
    def span(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))

    return F.transform(F.filter(found, lambda s: _PASSES[kind](s["value"])), span)


def base_spans(text: Column) -> Column:
    """Base findings as an array of ``SPAN`` by start, then kind as listed."""
    return F.array_sort(F.concat(*(_passed(spans(text, PATTERNS[kind]), rank, kind) for rank, kind in enumerate(KINDS))))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entities(span: Column) -> Column:
    """The value that was found, and its class."""
    kind, value = span["kind"], F.lower(span["value"])
    part = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 3))
    part = part.otherwise(F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 6))
    return F.array(F.concat_ws(":", kind, value), F.concat_ws("~", kind, part))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _contexts(found: DataFrame) -> DataFrame:
    """``entity, context, n, terms``: each different context of an entity, how often it occurs, its terms."""
    rows = found.select("text", "copies", F.explode("spans").alias("span"))
    start, end = F.col("span.start"), F.col("span.end")
    first = F.greatest(start - REACH, F.lit(0))
    before, after = F.substr("text", first + 1, start - first), F.substr("text", end + 1, F.lit(REACH))
    # Words that the reach cuts are left out; a digit stands for the entity, so that words that touch it are no terms.
    before = F.when(first > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    after = F.when(F.length(after) == REACH, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
    rows = rows.select(F.explode(_entities(F.col("span"))).alias("entity"), F.concat(before, F.lit("0"), after).alias("around"), "copies")
    rows = rows.groupBy("entity", "around").agg(F.sum("copies").alias("n"))
    return rows.select("entity", "n", F.array_distinct(_terms(F.col("around"))).alias("terms"))


def lower_bound(share: Column, n: Column) -> Column:
    """Lower confidence bound of a share that ``n`` cases show (Wilson)."""
    spread = Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    return F.greatest((share + Z * Z / (2 * n) - spread) / (1 + Z * Z / n), F.lit(1e-12))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``entity, term, disclosure`` from ``GENERALISE`` on. ``found``: different texts with spans, and their copies."""
    contexts = cut_lineage(_contexts(found))
    entities = contexts.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    pairs = contexts.select("entity", "n", F.explode("terms").alias("term")).groupBy("entity", "term")
    pairs = pairs.agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))
    # Counts of all words of all documents.
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("word"))
    words = words.groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n_term"))
    size = docs.agg(F.sum(F.length("text").cast("long")).alias("size")).first()["size"] or 0
    windows = F.lit(max(size / (2 * REACH), 1.0))
    content = F.greatest(F.log2(windows / F.col("n_entity")), F.lit(1e-9))
    share = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))
    low = lower_bound(share, F.col("contexts") / share)
    rows = pairs.join(words, "term").join(entities, "entity").withColumn("disclosure", 1 + F.log2(low) / content)
    return rows.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def _added(text: Column, pattern: Column, told: Column) -> Column:
    """Spans of the told words, by how much they disclose."""

    def span(s: Column) -> Column:
        removed = F.element_at(told, F.lower(s["value"])) >= REMOVE
        rank = F.when(removed, len(KINDS) + 1).otherwise(len(KINDS))
        kind = F.when(removed, ADDED[1]).otherwise(ADDED[0])
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), kind.alias("kind"), s["value"].alias("value"))

    return F.transform(F.filter(spans(text, pattern), lambda s: F.map_contains_key(told, F.lower(s["value"]))), span)


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base, spans, sanitised`` of every row: base spans, all spans, and the rewritten text."""
    rows = id_and_text(docs)
    based = rows.withColumn("base", base_spans(F.col("text")))
    # Different texts first; then those without findings, which only looked like having some, go.
    found = based.where(F.col("text").rlike("|".join(PATTERNS.values()))).groupBy(F.sha2("text", 256).alias("key"))
    found = found.agg(F.first("text").alias("text"), F.first("base").alias("spans"), F.count("*").alias("copies"))
    # Dealt anew: these rows are few, but their texts are searched further.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(found.where(F.size("spans") > 0).repartition(partitions, "key"))
    disclosing = cut_lineage(disclosing_terms(rows, found))
    held = found.select("key", F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("entity"))
    words = found.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    told = words.join(disclosing, "term").join(held, ["key", "entity"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    told = told.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))  # of one text
    # Where the told words stand: only they are looked for.
    told = told.withColumn("pattern", F.concat(F.lit(f"{_ALONE[0]}(?iu:"), F.array_join(F.map_keys("told"), "|"), F.lit(f"){_ALONE[1]}")))
    added = found.select("key", "text").join(told, "key").select("key", _added(F.col("text"), F.col("pattern"), F.col("told")).alias("added"))
    # Rows without findings get keys of their own, so that they spread.
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    based = based.withColumn("key", F.when(F.size("base") > 0, F.sha2("text", 256)).otherwise(own))
    out = based.join(added, "key", "left")
    out = out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))))
    word = lambda s: F.when(s["kind"] == ADDED[1], "").when(s["kind"] == ADDED[0], "[word]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return out.select("doc_id", "text", "base", "spans", rewritten(F.col("text"), F.col("spans"), word).alias("sanitised"))
