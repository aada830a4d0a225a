import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Columns that clash with names the operators use inside or return.
ODD_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("row_hash", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("bin", T.StringType()),
    ]
)

LONG = "".join(f"word{i % 977} sentence {i}. " for i in range(60_000))

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (4, "one"),
    (4, "one"),
    (5, "one"),
    (None, "a row without an id, twice"),
    (None, "a row without an id, twice"),
    (6, LONG),
    (7, "12 34 !!! ???"),
    (8, "naïve café — 日本語 🙂 \x00 <|endoftext|> it's"),
    (9, "x" * 200_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i == 2 else "en", None, None, *["clash"] * 7) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
