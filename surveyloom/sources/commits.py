"""Versions of a table in shared storage, and small tables that several jobs append to.

A version is written aside, then one marker file is renamed into place, which fails if there is one already. Readers follow the
marker, so they see a whole version or none, whatever builders run or die. Hadoop's rename without overwriting is atomic on file
systems with a name service; on others two builders may both believe to be first, and the marker names one of their whole versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MARKER = "_committed"
EXISTS = "org.apache.hadoop.fs.FileAlreadyExistsException"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> str | None:
    """Path of the version that readers of a folder use, if one was published."""
    marker, fs = _hadoop(spark, f"{folder}/{MARKER}")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return f"{folder}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def _mark(spark: SparkSession, folder: str, version: str) -> bool:
    """Name the version in the marker; False if another builder was first."""
    jvm, (staged, fs) = spark._jvm, _hadoop(spark, f"{folder}/_{version}.marker")
    out = fs.create(staged, True)
    out.write(version.encode())
    out.close()
    marker, _ = _hadoop(spark, f"{folder}/{MARKER}")
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(staged, marker, no_overwrite)
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getName() != EXISTS:
            raise
        fs.delete(staged, False)
        return False


def publish(spark: SparkSession, folder: str, write: Callable[[str], object]) -> tuple[str, bool]:
    """Let ``write`` fill a new version and commit it. Returns the path that readers see, and whether it is this version.

    A builder that comes second removes its own version and takes the first one's; a failed write leaves no version.
    """
    version = f"v-{uuid.uuid4().hex}"
    path, fs = _hadoop(spark, f"{folder}/{version}")
    try:
        write(f"{folder}/{version}")
        won = _mark(spark, folder, version)
    except BaseException:
        fs.delete(path, True)
        raise
    if not won:
        fs.delete(path, True)
    return committed(spark, folder), won


def sweep(spark: SparkSession, folder: str, hours: float) -> int:
    """Remove what builders that were killed left behind: uncommitted versions last touched so many hours ago."""
    target, fs = _hadoop(spark, folder)
    kept, now = committed(spark, folder), spark._jvm.System.currentTimeMillis()
    old = [
        s.getPath() for s in fs.listStatus(target)
        if s.getPath().getName().lstrip("_").startswith("v-") and now - s.getModificationTime() >= hours * 3_600_000
        and f"{folder}/{s.getPath().getName()}" != kept
    ]
    return sum(bool(fs.delete(path, True)) for path in old)


def append_table(df: DataFrame, path: str) -> None:
    """Append to a small table from any number of jobs at once: each call writes a folder of its own.

    Jobs that append to one folder share its staging area, and the first to finish clears it for the others.
    """
    df.write.parquet(f"{path}/{uuid.uuid4().hex}")


def append_rows(spark: SparkSession, path: str, rows: Sequence[tuple], schema: str) -> DataFrame:
    record = spark.createDataFrame(list(rows), schema)
    append_table(record.coalesce(1), path)
    return record


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All appended rows, or an empty table where nothing was written yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
