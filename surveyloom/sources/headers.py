"""First lines of many files, read in tasks by a data source: planning a scan over thousands of files needs one job, not one per file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatch
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 16
FILES_PER_TASK = 256


def _locate(uri: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def first_line(uri: str) -> str | None:
    """First line of a file, compressed or not, without its line end; null for an empty file. Reads no more than it must."""
    system, path = _locate(uri)
    line = b""
    with system.open_input_stream(path) as stream:
        while b"\n" not in line and (piece := stream.read(PIECE)):
            line += piece
    return line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig", "replace") if line else None


class Files(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class FirstLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uris, self.size = json.loads(options["uris"]), int(options.get("filespertask", FILES_PER_TASK))

    def partitions(self) -> Sequence[Files]:
        return [Files(self.uris[i : i + self.size]) for i in range(0, len(self.uris), self.size)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        lines = [first_line(uri) for uri in partition.uris]
        yield pa.RecordBatch.from_arrays([pa.array(partition.uris, pa.string()), pa.array(lines, pa.string())], ["path", "line"])


class FirstLines(DataSource):
    """``path, line`` of the files in option ``uris`` (a JSON list), ``filesPerTask`` of them in a task."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "path string, line string"

    def reader(self, schema) -> FirstLinesReader:
        return FirstLinesReader(self.options)


def first_lines(spark: SparkSession, uris: Sequence[str]) -> DataFrame:
    """``path, line``. File systems that only the JVM can open are scanned as text instead, one row kept per file and task."""
    try:
        _locate(uris[0])
    except (pa.ArrowException, OSError):
        at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
        lines = spark.read.text(list(uris)).select("value", F.col("_metadata.file_path").alias("path"), at.alias("at"))
        return lines.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("uris", json.dumps(list(uris))).load()


def _given(paths: Sequence[str]) -> Callable[[str], tuple[int, str]]:
    """Sort key of a file: the first of the paths that it is or lies below, then its name."""
    plain = {}
    for i, path in enumerate(paths):
        plain.setdefault((urlparse(path).path if "://" in path else path).rstrip("/"), i)
    globs = [(path, i) for path, i in plain.items() if any(c in path for c in "*?[{")]

    def place(uri: str) -> tuple[int, str]:
        name = unquote(urlparse(uri).path)
        found = [plain[str(p)] for p in (PurePosixPath(name), *PurePosixPath(name).parents) if str(p) in plain]
        found += [i for path, i in globs if fnmatch(name, path)]
        return min(found, default=len(plain)), name

    return place


def layouts(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """The files below the paths (files, folders or globs), those with the same first line together, in the order given; empty files left out."""
    uris = spark.read.text(list(paths)).inputFiles()
    if not len(uris):
        return []
    place, found = _given(paths), {}
    for row in sorted(first_lines(spark, list(uris)).where("line IS NOT NULL").collect(), key=lambda row: place(row["path"])):
        found.setdefault(row["line"], []).append(row["path"])
    return list(found.values())
