import pytest
from pyspark.sql import types as T

from creditledger.llm.common import importable

COLUMNS = ("_text", "score", "n", "key", "sig", "bucket", "cuts", "label", "rejected", "_c0", "kept", "row")


@pytest.fixture(scope="session")
def table(spark):
    """Builds documents from (doc_id, text[, lang]) with further columns whose names clash."""

    def make(rows, partitions=3, text="text"):
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField(text, T.StringType()),
                T.StructField("lang", T.StringType()),
                T.StructField("source", T.StringType()),
                T.StructField("n_chars", T.LongType()),
                *(T.StructField(c, T.StringType()) for c in COLUMNS),
            ]
        )
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), *("x" for _ in COLUMNS)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


LONG = " ".join(f"word{i % 997} and{i % 89}" for i in range(30_000))
EDGES = [
    (1, "one two three four five six"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, LONG),
    (5, LONG),
    (6, " \t\n "),
    (None, "one two three four five six"),
    (7, "One  two three\nfour five six"),
    (8, "Größe 😀 naïve \x00   end"),
]


@pytest.fixture(scope="session")
def edges(table):
    return table(EDGES)


@pytest.fixture(scope="session")
def nothing(table):
    return table([]).filter("false")


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    importable(spark)
