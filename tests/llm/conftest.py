import pytest
from pyspark.sql import functions as F

# Documents with NULLs, empty and long texts, ties, repeated rows and columns with odd names.
LONG = "\n".join(f"line {i} of a rather long text that goes on and on {i % 7}" for i in range(4000))
SHARED = "this line is shared by many documents of the table"
PASSAGE = " ".join(f"word{i}x{i * 7 % 13}" for i in range(70))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \t ", None, None), (4, "one", "en", "a"), (5, "One two", "xx", "b"),
    (6, LONG, "en", "hot"), (7, LONG + " end", "en", "hot"), (8, PASSAGE + " tail of eight", "en", "b"), (9, "intro of nine\n" + PASSAGE, "de", "b"),
    (10, "no rank", "en", "a"), (10, "no rank", "en", "a"), (None, "null key text " + SHARED, "en", None), (None, None, None, None),
    *[(20 + i, f"{SHARED}\nown line {i}\n  {SHARED.upper()}  \n", "en", "hot") for i in range(6)],
    (30, "Straße ÄÖÜ \U0001f600 end\n\n\n", "de", "b"), (31, "Straße ÄÖÜ \U0001f600 end\n\n\n", "de", "b"),
    (32, "again and again and " * 60, "en", "a"), (33, "a\r\nb\x0bc\x0cd", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("bigint"))
    for name in ("key", "keys", "n", "count", "rate", "cdf", "_ld_keys", "_mx_n", "sequence_id", "slot", "cls", "kept"):
        docs = docs.withColumn(name, F.lit(name))
    return docs.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
