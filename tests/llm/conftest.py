import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Columns of ``documents`` and further ones with names that operators use.
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id",)]
    + [T.StructField(n, T.StringType()) for n in ("text", "lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("key", "node", "found", "score", "spans", "row", "secrets", "keys", "label", "base")]
)

LONG = "The whole of a very long text, line after line. " * 8000
AWKWARD = [
    (1, "A short text of no use.", "en", "s", 23),
    (2, None, "en", "s", None),
    (3, "", None, None, 0),
    (None, "A row without an id. It has two sentences.", "en", "s", 5),
    (5, LONG, "en", "s", len(LONG)),
    (6, LONG, "en", "s", len(LONG)),
    (7, " \t\n\x0b ", "en", "s", 5),
    (8, 'write to ann.lee@mail.example.org or +1 (212) 555-0199; token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "en", "s", 1),
    (8, 'write to ann.lee@mail.example.org or +1 (212) 555-0199; token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "en", "s", 1),
    (9, "naïve 𝄞 text — 汉字 é <|endoftext|> \x00 end", "xx", "s", 1),
]


@pytest.fixture(scope="session")
def make(spark):
    """Rows of ``documents`` with further columns, as a table."""

    def rows(values):
        return spark.createDataFrame([(*v, *["x"] * (len(SCHEMA) - 5)) for v in values], SCHEMA)

    return rows


@pytest.fixture(scope="session")
def awkward(make):
    return make(AWKWARD)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
