import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Extra columns with names that the operators use themselves.
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


def documents(spark, rows):
    """Rows are (doc_id, text) or (doc_id, text, lang)."""
    from creditgrain.llm.common import ship

    ship(spark)
    return spark.createDataFrame([(*r, None)[:3] + ("x", "y", "z") for r in rows], SCHEMA)


LONG = " ".join(f"word{i % 97} thing{i % 89}," for i in range(15_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. Then it sleeps.", "en"),
    (2, "The quick brown fox jumps over the lazy dog. Then it sleeps.", "en"),
    (2, "The quick brown fox jumps over the lazy dog. Then it sleeps.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "de"),
    (6, LONG, "de"),
    (7, LONG + " tail", "de"),
    (8, f"first words here {PASSAGE} and the end", "fr"),
    (9, f"other things come {PASSAGE} with another end", "fr"),
    (10, f"{PASSAGE} {PASSAGE}", "fr"),
    (None, "no number at all, no number", "en"),
    (11, "12345 !!", None),
    (12, "Été café naïve  \n\n  déjà\u00a0vu — 中文字符 😀's", "fr"),
    (13, "one two", "en"),
    (14, "ONE TWO", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def build(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD_ROWS
