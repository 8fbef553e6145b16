"""Group totals, supported groups, and the training table partitioned by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.columns import quoted
from surveyloom.spec import TableSpec


def group_population(df: DataFrame, group: str, weight: str, total: str = "state_population") -> DataFrame:
    """Sum of the weight per group, each weight truncated to a whole number first."""
    return df.groupBy(group).agg(F.sum(quoted(weight).try_cast("bigint")).alias(total))


def keep_supported(
    df: DataFrame, group: str, dim: DataFrame, code: str = "fips", wanted: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose group is in the dimension and, if given, in the wanted list.

    A null group never matches. The wanted list reaches the scan as a filter.
    """
    if wanted is not None:
        df = df.where(quoted(group).isin(list(wanted)))
    return df.join(dim.select(F.col(code).alias(group)), group, "left_semi")


def supported_groups(
    df: DataFrame, group: str, dim: DataFrame, code: str = "fips", wanted: Sequence[str] | None = None
) -> DataFrame:
    """Sorted distinct group values that the dimension knows."""
    present = df.select(group).distinct()
    return keep_supported(present, group, dim, code, wanted).orderBy(group)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail on an empty result. Runs a job, so call it at the boundary of a step."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def with_group_value(df: DataFrame, values: DataFrame, group: str, value: str) -> DataFrame:
    """Look up the value of each row's group; a group without a value is an error."""
    known = values.select(F.col(group), F.col(value).alias("_value"), F.lit(True).alias("_known"))
    failure = F.raise_error(F.concat(F.lit(f"no {value} for {group} "), F.coalesce(quoted(group), F.lit("null"))))
    joined = df.join(known, group, "left")
    looked_up = F.when(F.col("_known"), F.col("_value")).otherwise(failure.cast("bigint"))
    return joined.select(*[quoted(c) for c in df.columns if c != value], looked_up.alias(value))


def sample_size(population: DataFrame, total: str, fixed: int | None = None, divisor: int = 10) -> DataFrame:
    """Add ``n``: the fixed number of rows, or the group total // divisor."""
    n = F.lit(fixed).cast("bigint") if fixed is not None else F.expr(f"`{total}` div {int(divisor)}")
    return population.select("*", n.alias("n"))


def partition_training(
    df: DataFrame, spec: TableSpec, dim: DataFrame, code: str = "fips", wanted: Sequence[str] | None = None
) -> DataFrame:
    """Supported rows with the columns to synthesise and the group column."""
    rows = keep_supported(df, spec.group, dim, code, wanted)
    return rows.select(spec.group, *[quoted(c) for c in spec.synthesised(df.columns)])


def rows_per_group(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
