import pytest
from pyspark.sql import types as T

LONG = " ".join(f"wort{i % 977}x{i}" for i in range(30_000))

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {
        1: "The quick brown fox jumps over the lazy dog near the old river bank today",
        2: None,
        3: "",
        4: " \t\n\x0b\x0c\r ",
        5: LONG,
        6: "a " + passage + " b",
        7: "c d " + passage + "\n\ne",
        8: "one",
        9: "ONE",
        10: "Ärger über Öl \u00a0\u2003x \U0001f600 \x00 nul",
        11: "same text here for ties",
        12: "same text here for ties",
        13: "spam " * 50,
        14: "<|endoftext|> it's don't 12,345.67 $%&#|<>*",
        15: passage,
    }
    rows = [(i, t, None if i == 1 else "en", None if i == 6 else "s", None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[4], rows[10], (None, "a text without an id " + passage, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return spark.createDataFrame(hard_rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
