import pytest

#: Nulls, empty and blank texts, ties, repeated rows, a long text, and columns whose names operators use themselves.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "src0"),
    (2, "the quick brown fox  jumps over the lazy dog. " * 8, "en", "src0"),
    (3, "The quick brown fox jumps over the lazy dog. " * 8, "en", None),
    (4, None, None, "src1"),
    (5, "", "en", "src1"),
    (6, " \t\n ", "en", "src1"),
    (7, "one two", "en", "src2"),
    (7, "one two", "en", "src2"),
    (None, "no id here", "en", "src2"),
    (None, None, None, None),
    (9, "Zażółć gęślą jaźń, naïve café — 😀 <|endoftext|> x" + " y" * 40, "pl", "src2"),
    (10, "word " * 5000 + "tail.\n\n  end", "en", "src3"),
    (-11, "I'll say: don't, it's 3,5 or 4.", "en", "src3"),
]
CLASHES = ["n", "salt", "print", "tile", "rank", "size", "x", "key", "row", "start", "bucket", "label", "score", "word"]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
