"""From the raw table to the feature table: select, recode, adjust, cast, impute. Each step is one projection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions import columns as C
from surveyloom.session import written
from surveyloom.spec import TableSpec


def exclude_rename(df: DataFrame, rename: Mapping[str, str]) -> DataFrame:
    """Move columns to the end under a new name: ``{"STATE": "ST"}``."""
    missing = [c for c in rename if c not in df.columns]
    if missing:
        raise ValueError(f"columns to rename are missing: {missing}")
    kept = [C.quoted(c) for c in df.columns if c not in rename]
    return df.select(*kept, *[C.quoted(old).alias(new) for old, new in rename.items()])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns; unlike ``DataFrame.drop`` an absent name is an error."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns to drop are missing: {missing}")
    return df.drop(*names)


def select_required(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The columns of the spec in spec order; all missing ones are listed in the error."""
    missing = [c for c in spec.names if c not in df.columns]
    if missing:
        raise ValueError(f"configured columns missing from the input: {missing}")
    return df.select(*[C.quoted(c) for c in spec.names])


def relabel(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Rename through a label map; columns without a label keep their name."""
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})


def split_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric columns and of all others."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in set(numeric)]


def _replaced(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else C.quoted(c) for c in df.columns])


def recode(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Apply the code maps of the spec."""
    return _replaced(df, {c.name: C.recoded(C.quoted(c.name), c.recode) for c in spec.present(df.columns) if c.recode})


def adjust(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Multiply the flagged amounts by the row's factor; the factor column itself stays as it is."""
    if spec.factor is None or spec.factor not in df.columns:
        return df
    factor = C.quoted(spec.factor)
    flagged = [c.name for c in spec.present(df.columns) if c.adjusted]
    return _replaced(df, {n: C.adjusted(C.quoted(n), factor, spec.factor_scale) for n in flagged})


def cast_lenient(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast every column of the spec to its kind; text that does not parse becomes null."""
    return _replaced(df, {c.name: C.lenient(C.quoted(c.name), c.kind) for c in spec.present(df.columns)})


def impute(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Fill nulls: text with "NA", longs with the rounded column mean, doubles with the column mean.

    The means are scalar subqueries: Catalyst merges them into one aggregate over the numeric columns that the query
    uses, and every row is filled in place, without a join or a shuffle.
    """
    filled = {}
    for c in spec.present(df.columns):
        col = C.quoted(c.name)
        if c.kind == "string":
            filled[c.name] = C.or_missing(col)
        else:
            mean = df.agg(F.avg(col).alias("mean")).scalar()
            filled[c.name] = F.coalesce(col, F.round(mean).cast("bigint") if c.kind == "long" else mean)
    return _replaced(df, filled)


def build_features(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The whole chain; the order of the steps is part of the result."""
    return impute(cast_lenient(adjust(recode(select_required(df, spec), spec), spec), spec), spec)


def group_means(df: DataFrame, group: str, names: Iterable[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(C.quoted(n)).alias(n) for n in names])


def fill_from_groups(df: DataFrame, train: DataFrame, group: str) -> DataFrame:
    """Fill nulls of a synthetic table: numbers with the mean of their group in ``train``, text with "NA"."""
    numeric, other = split_by_type(df)
    numeric = [n for n in numeric if n in train.columns and n != group]
    means = written(group_means(train, group, numeric), "group-means")
    joined = df.alias("d").join(means.alias("m"), group, "left")
    filled = {n: F.coalesce(F.col(f"d.`{n}`").cast("double"), F.col(f"m.`{n}`")) for n in numeric}
    filled |= {n: C.or_missing(F.col(f"d.`{n}`")) for n in other if n != group}
    return joined.select(*[
        C.quoted(n) if n == group else filled.get(n, F.col(f"d.`{n}`")).alias(n) for n in df.columns
    ])
