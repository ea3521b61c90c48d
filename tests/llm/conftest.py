import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 977} the" for k in range(30_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "One TWO three",
    "one two three",
    "the quick brown fox jumps over the lazy dog and then runs home again to sleep",
    "the quick brown fox jumps over the lazy dog and then runs home again to sleep",
    "The quick brown fox jumps over the lazy dog and then runs home again to rest",
    "<|endoftext|> special <|startoftext|> strings",
    "\u0130stanbul \u03a3\u0391\u03a3 \ufb01 e\u0301 \u65e5\u672c\u8a9e \U0001f600\u200d\x1c\x85 don't",
    "aaaa" * 2000,
    LONG,
    LONG + " end",
    "same line\nsame line\nother\nsame line",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward texts, a repeated row, and columns whose names clash with inner ones."""
    rows = [(k, text, "en", "src0", len(text or "")) for k, text in enumerate(TEXTS)]
    rows += [rows[4], (100, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = "size shard slot uid group key point leaf component least n_tokens keep kept score h1 h2 words".split()
    return df.select("*", *(F.lit("x").alias(name) for name in clashing)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 3 % 2, k % 2) for k in range(12)] + [(3, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS kept")


@pytest.fixture(scope="session")
def tables(spark):
    def read(name, sf="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")

    return read
