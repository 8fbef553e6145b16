"""Sinks. Codecs follow the step: zstd for the extract, snappy for tables between steps, lz4_raw for design matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTRACT_CODEC = "zstd"
TABLE_CODEC = "snappy"
DESIGN_CODEC = "lz4_raw"


def write_parquet(df: DataFrame, path: str, codec: str = TABLE_CODEC, mode: str = "errorifexists") -> DataFrame:
    """Write and return the table as read back, so that later steps start from the files."""
    df.write.mode(mode).option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_group(
    df: DataFrame, path: str, group: str, codec: str = TABLE_CODEC, mode: str = "errorifexists"
) -> DataFrame:
    """One folder per group value.

    The rebalance hint shuffles by group, so a group gets few files, and lets AQE cut a hot group into several tasks.
    """
    balanced = df.hint("rebalance", F.col(group))
    balanced.write.mode(mode).partitionBy(group).option("compression", codec).parquet(path)
    return read_by_group(df.sparkSession, path, df.schema)


def read_by_group(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a partitioned table with its declared types: without them ``06`` comes back as the number 6."""
    return spark.read.schema(schema).parquet(path)


def write_group_values(df: DataFrame, path: str, group: str, mode: str = "errorifexists") -> DataFrame:
    """Group → value table as JSON lines sorted by group."""
    df.orderBy(group).write.mode(mode).json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
