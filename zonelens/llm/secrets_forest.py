"""Secret scanning: wide candidates, and a random forest that removes the false ones.

A candidate is a long run of token characters, or whatever is assigned to a key
word: the quoted or unbroken value after it, of any length and characters (see
``CANDIDATE``). For each the forest sees its length, how often it changes between
character classes, how much of it dictionary words cover, whether it is part of a path
or an address, and its neighbouring words and signs. It is Spark's random forest, trained
from labelled findings. The dictionary holds the words that stand outside candidates in at
least ``DICTIONARY_SHARE`` of the different texts (and ``DICTIONARY_TEXTS`` of them); texts are
counted by sketches of their hashes, so neither copies nor the corpus size move it.

Findings are labelled by the evidence of secrets and of ordinary strings
(``label_findings``) unless the caller brings labels of their own; those
without evidence are not learned from. At most ``SAMPLE`` of them train the
forest: the ones with the smallest hash, each different candidate once. All
candidates of all texts are scored.

Defined results: a NULL or empty text has no candidates; repeated rows get
equal results; an empty table gives no rows; without labelled findings of both
kinds the label itself decides; other columns are passed on by ``redact`` and
not read by ``scan``. Only native column functions and Spark's own
learner are used.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import cut_lineage, id_and_text, whole_text
from zonelens.llm.spans import rewritten, spans

# Words before a secret.
_KEY_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret|signing[_-]?key"

_TOKEN = "A-Za-z0-9+/_~.-"
_QUOTE = "\"'`"
#: The value that is assigned to a key word (the cheap look-behinds come first): quoted, or unbroken without the sign that ends a clause.
_ASSIGNED = (
    rf"(?<=[=: \t{_QUOTE}])(?<=[=:][ \t]{{0,3}}[{_QUOTE}]?)(?<=(?i:{_KEY_WORDS})[{_QUOTE}]?[ \t]{{0,3}}[=:]{{1,2}}[ \t]{{0,3}}[{_QUOTE}]?)"
    rf"(?:(?<=[{_QUOTE}])[^{_QUOTE}\n]+(?=[{_QUOTE}])|[^\s{_QUOTE}=:][^\s{_QUOTE}]*(?<![,;.)\]}}]))"
)
#: Assigned values; else runs of token characters, 12 or more with a digit, 16 or more without; then base64 padding.
CANDIDATE = rf"{_ASSIGNED}|(?<![{_TOKEN}])(?:(?=[A-Za-z+/_~.-]*+[0-9])[{_TOKEN}]{{12,}}+|[{_TOKEN}]{{16,}}+)={{0,2}}"
#: Code points on either side that neighbouring words are taken from.
REACH = 40
DICTIONARY_SHARE = 0.002
DICTIONARY_TEXTS = 3
SAMPLE = 20_000
TREES = 24
DEPTH = 6
SECRET_FROM = 0.5

# Shapes of well-known keys.
_SHAPES = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"
    r"|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,})=*$"
)

FEATURES = [
    "length", "class_changes", "distinct_share", "digit_share", "upper_share", "vowel_share", "is_hex", "dictionary_share",
    "slashes", "dots", "in_path", "in_address", "key_word", "assigned", "quoted", "known_shape",
]


def _share(value: Column, characters: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, f"[{characters}]", "")) / F.length(value)


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def candidates(text: Column) -> Column:
    """The candidates of a text with what stands before and after them."""

    def around(s: Column) -> Column:
        first = F.greatest(s["start"] - REACH, F.lit(0))
        before, after = F.substr(text, first + 1, s["start"] - first), F.substr(text, s["end"] + 1, F.lit(REACH))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), before.alias("before"), after.alias("after"))

    return F.transform(spans(text, CANDIDATE), around)


def _words(value: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.lower(w)))


def _dictionary_shares(values: DataFrame, texts: DataFrame) -> DataFrame:
    """``value, covered``: letters of each candidate in dictionary words. Each different text counts a word once."""
    pieces = values.select("value", F.explode(_words(F.col("value"))).alias("word"))
    plain = F.lower(F.regexp_replace("text", CANDIDATE, " "))
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![a-z])[a-z]{4,}+"), F.lit(0)))
    words = texts.select(F.xxhash64("text").alias("text_key"), F.explode(found).alias("word"))
    least = max(DICTIONARY_TEXTS, DICTIONARY_SHARE * texts.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0])
    words = words.groupBy("word").agg(F.approx_count_distinct("text_key", 0.1).alias("n")).where(F.col("n") >= least)
    hits = pieces.join(words.select("word"), "word")
    return hits.groupBy("value").agg(F.sum(F.length("word")).alias("covered"))


def _context_features(found: DataFrame) -> DataFrame:
    """All features but the dictionary's, from ``value, before, after``."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    near = F.lower(F.concat_ws(" ", before))
    runs = F.length(F.regexp_replace(v, r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "#"))
    letters = F.greatest(F.length(F.regexp_replace(v, "[^A-Za-z]", "")), F.lit(1))
    return found.withColumns(
        {
            "length": F.length(v).cast("double"),
            "class_changes": (runs - 1) / F.length(v),
            "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
            "digit_share": _share(v, "0-9"),
            "upper_share": _share(v, "A-Z"),
            "vowel_share": F.length(F.regexp_replace(v, "[^AEIOUaeiou]", "")) / letters,
            "is_hex": _flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "slashes": F.length(F.regexp_replace(v, "[^/]", "")).cast("double"),
            "dots": F.length(F.regexp_replace(v, "[^.]", "")).cast("double"),
            "in_path": _flag(near.rlike(r"(?:[a-z]+:/*|[/\\]|www\.)$") | v.rlike(r"^(?:\.{0,2}/)|[^/]/[^/]+/[^/]|\.[a-z]{2,4}$")),
            "in_address": _flag(before.endswith("@") | after.startswith("@")),
            "key_word": _flag(near.rlike(rf"(?:{_KEY_WORDS})[^a-z0-9]{{0,8}}$")),
            "assigned": _flag(before.rlike(r"[=:]\s*[\"'`]?$")),
            "quoted": _flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "known_shape": _flag(v.rlike(_SHAPES)),
        }
    )


def findings(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Different candidates of ``rows`` (``value, before, after``) with all ``FEATURES``; the dictionary is of ``texts``."""
    found = rows.select("value", "before", "after").distinct()
    covered = _dictionary_shares(found.select("value").distinct(), texts)
    found = _context_features(found).join(covered, "value", "left")
    return found.withColumn("dictionary_share", F.least(F.coalesce("covered", F.lit(0)) / F.length("value"), F.lit(1.0))).drop("covered")


def label_findings(found: DataFrame) -> DataFrame:
    """Add ``label``: 1.0 with evidence of a secret, 0.0 of an ordinary string, else NULL."""
    mixed = (F.col("digit_share") > 0) & (F.col("digit_share") < 1)
    named = (F.col("key_word") == 1) & (F.col("assigned") == 1) & mixed & (F.col("slashes") == 0)
    secret = named | (F.col("known_shape") == 1)
    plain = (F.col("digit_share") == 1) | (F.col("in_address") == 1) | (F.col("in_path") == 1) | (F.col("dictionary_share") >= 0.6)
    return found.withColumn("label", F.when(secret, 1.0).when(plain | (F.col("digit_share") == 0), 0.0))


def train(labelled: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """The forest, from at most ``sample`` findings with a ``label``; None without both kinds."""
    known = labelled.where("label is not null").orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(sample)
    known = cut_lineage(known.select("label", *FEATURES))
    if known.select("label").distinct().count() < 2:
        return None
    share = known.agg(F.avg("label").alias("share")).first()["share"]
    known = known.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=11)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(known)


def scored(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``value, before, after, score`` of all findings."""
    if model is None:
        score = F.coalesce("label", F.lit(0.0))
        return found.select("value", "before", "after", score.alias("score"))
    rows = model.transform(found)
    return rows.select("value", "before", "after", F.get(vector_to_array("probability"), 1).alias("score"))


def _secrets(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, secrets``: spans and scores of the secrets of each different text in ``rows`` (``key, found``)."""
    found = cut_lineage(rows.select("key", F.explode("found").alias("f")).select("key", "f.*"))
    labelled = cut_lineage(label_findings(findings(found, texts)))
    kept = scored(labelled, train(labelled)).where(F.col("score") >= SECRET_FROM)
    hits = found.join(kept, ["value", "before", "after"])
    span = F.struct("start", "end", "value", "score")
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("secrets"))  # of one text


def _with_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (with a never-NULL ``text``) and columns ``found`` and ``secrets``."""
    rows = docs.withColumn("found", candidates(F.col("text")))
    texts = rows.where(F.col("text").rlike(CANDIDATE)).groupBy(F.sha2("text", 256).alias("key")).agg(F.first("found").alias("found"))
    secrets = _secrets(texts, docs)
    # Rows without candidates get keys of their own, so that they spread.
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("key", F.when(F.size("found") > 0, F.sha2("text", 256)).otherwise(own))
    none = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    return rows.join(secrets, "key", "left").withColumn("secrets", F.coalesce("secrets", none)).drop("key")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_candidates, secrets`` (spans with score) of every row."""
    return _with_secrets(id_and_text(docs)).select("doc_id", F.size("found").cast("long").alias("n_candidates"), "secrets")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns, the secrets in ``text`` replaced by ``[SECRET]`` (and ``n_chars``, if there, counted anew)."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), whole_text().alias("text"))
    new = rewritten(F.col("text"), F.col("secrets"), lambda s: F.lit("[SECRET]"))
    rows = _with_secrets(packed).withColumn("new", F.when(F.size("secrets") > 0, new))
    changed = {"text": F.coalesce("new", F.col("row.text")), "n_chars": F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    types = dict(docs.dtypes)
    return rows.select(*[(changed[c].cast(types[c]) if c in changed else F.col(f"row.`{c}`")).alias(c) for c in columns])
