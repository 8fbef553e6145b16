"""The shared folder of the cluster and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local session without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_folders:
        folder = tempfile.mkdtemp(prefix="surveyloom-")
        sc.setCheckpointDir(folder)
        _local_folders[sc.applicationId] = folder
    return _local_folders[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Small table of fixed values as a local relation: Catalyst knows its exact size and broadcasts it."""
    return spark.createDataFrame(pa.table(columns))


def written(df: DataFrame, name: str, partition_by: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives Catalyst the real size, so that its broadcast
    threshold decides the join strategy from what the table holds. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a table of few, small files one partition per core before iterative work; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
