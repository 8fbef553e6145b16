import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from text_cases import edge_rows  # noqa: E402

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("digest", T.StringType()), T.StructField("hi", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("of", T.StringType()), T.StructField("size", T.StringType()), T.StructField("found", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("good", T.StringType()),
])


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*r, len(r[1] or ""), *["clash"] * 9) for r in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
