"""Scans: CSV files matched by column name, and Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.columns import quoted
from surveyloom.sources.headers import layouts


def state_paths(pattern: str, states: Sequence[str], dim: Mapping[str, str]) -> list[str]:
    """One path per requested state; ``["ALL"]`` means every state of the dimension.

    ``pattern`` holds ``{usps}`` and / or ``{fips}``.
    """
    wanted = list(dim) if list(states) == ["ALL"] else list(states)
    unknown = [s for s in wanted if s not in dim]
    if unknown:
        raise ValueError(f"unknown states: {unknown}")
    return [pattern.format(usps=s.lower(), fips=dim[s]) for s in wanted]


def _digits(t: T.DataType) -> int:
    return t.precision if isinstance(t, T.DecimalType) else {T.IntegerType(): 10, T.LongType(): 20}[t]


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest type that reads both; text where the two have nothing in common.

    Whole numbers widen from int over bigint to decimals of scale 0, all numbers to double, dates to timestamps.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole, times = (T.IntegerType, T.LongType, T.DecimalType), (T.DateType, T.TimestampType)
    if isinstance(a, whole) and isinstance(b, whole):
        if T.DecimalType in (type(a), type(b)):
            return T.DecimalType(min(38, max(_digits(a), _digits(b))), 0)
        return T.LongType()
    if isinstance(a, (*whole, T.DoubleType)) and isinstance(b, (*whole, T.DoubleType)):
        return T.DoubleType()
    return T.TimestampType() if isinstance(a, times) and isinstance(b, times) else T.StringType()


def _inferred(reader: DataFrameReader, header: Sequence[str], members: list[str]) -> Iterator[tuple[str, T.DataType]]:
    found = reader.options(inferSchema=True, samplingRatio=1.0).csv(members).schema
    return zip(header, (field.dataType for field in found.fields))


def _without_values(reader: DataFrameReader, members: list[str], names: Sequence[str]) -> list[str]:
    """Which of the columns hold nulls only: inference calls them text, but they fit the type that other files have."""
    if not names:
        return []
    seen = reader.options(inferSchema=False).csv(members).agg(*[F.count(quoted(n)).alias(str(i)) for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if not seen[i]]


def read_csv_by_name(
    spark: SparkSession,
    paths: Iterable[str],
    schema: T.StructType | None = None,
    text_columns: Iterable[str] = (),
    strict: bool = True,
    sep: str = ",",
) -> DataFrame:
    """Union of CSV files with columns matched by name; a column that a file lacks is null there.

    A path is a file, a folder or a glob; every file starts with its header, empty files are passed over. Headers are read in tasks, and
    files with the same one by one scan, since Spark matches the columns of a multi-path CSV scan by position: jobs go by layouts, not by
    files. Without a schema every row is used to infer the types,
    each column gets one type over all files, and ``text_columns`` stay text, which keeps leading zeros of codes.
    """
    reader = spark.read.options(header=True, sep=sep)
    paths = list(paths)
    if not paths:
        raise ValueError("no CSV paths given")
    by_columns: dict[tuple[str, ...], list[str]] = {}
    for members in layouts(spark, paths):
        by_columns.setdefault(tuple(reader.csv(members[0]).columns), []).extend(members)
    if not by_columns:
        raise ValueError(f"no CSV file with a header below {paths}")

    if schema is None:
        inferred = {h: dict(_inferred(reader, h, members)) for h, members in by_columns.items()}
        apart = {n for found in inferred.values() for n, t in found.items() if t != T.StringType()}
        types: dict[str, T.DataType] = {}
        for header, found in inferred.items():
            texts = [n for n, t in found.items() if t == T.StringType() and n in apart and n not in set(text_columns)]
            found.update(dict.fromkeys(_without_values(reader, by_columns[header], texts), T.NullType()))
            for name, found_type in found.items():
                types[name] = _wider(types.get(name, T.NullType()), found_type)
        text = set(text_columns)
        types = {n: T.StringType() if n in text or isinstance(t, T.NullType) else t for n, t in types.items()}
    else:
        types = {f.name: f.dataType for f in schema.fields}

    mode = "FAILFAST" if strict else "PERMISSIVE"
    parts = []
    for header, members in by_columns.items():
        layout = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])
        part = (
            spark.read.options(header=True, sep=sep, mode=mode, enforceSchema=False)  # header must equal the layout
            .schema(layout)
            .csv(members)
        )
        parts.append(part.select(*[quoted(n) for n in header if n in types]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if schema is not None:
        out = out.select(*[
            quoted(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields
        ])
    return out


def read_parquet(
    spark: SparkSession,
    *paths: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet scan of one or many paths; give the schema of a partitioned table to keep codes such as ``06``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*paths)
    return df if columns is None else df.select(*[quoted(c) for c in columns])


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
