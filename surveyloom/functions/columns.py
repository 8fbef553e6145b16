"""Scalar expressions. All are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.spec import SPARK_TYPES

MISSING = "NA"


def quoted(name: str) -> Column:
    """Column by its exact name; labels hold dots, commas and parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def recoded(col: Column, codes: Mapping[str, str]) -> Column:
    """Code → new code as string; codes without an entry keep their own text."""
    text = col.cast("string")
    pairs = [F.lit(str(part)) for pair in codes.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[text], text)


def adjusted(col: Column, factor: Column, scale: float = 1e6) -> Column:
    """Amount × factor, where the factor is stored with implied decimals."""
    return col.try_cast("double") * (factor.try_cast("double") / F.lit(float(scale)))


def lenient(col: Column, kind: str) -> Column:
    """Cast where text that does not parse becomes null instead of an error."""
    return col.try_cast(SPARK_TYPES[kind])


def or_missing(col: Column) -> Column:
    return F.coalesce(col, F.lit(MISSING))


def min_max_scaled(col: Column, low, high, constant: str = "null") -> Column:
    """(x − low) / (high − low) as float; a constant or empty column gives null, with ``constant`` "nan" NaN, with "zero" 0."""
    value = {"null": None, "nan": float("nan"), "zero": 0.0}[constant]
    if low is None or high is None:
        return F.lit(0.0 if constant == "zero" else None).cast("float")
    if high == low:
        return F.when(col.isNotNull(), F.lit(value).cast("float"))
    return ((col - F.lit(low)) / (F.lit(high) - F.lit(low))).cast("float")


def indicator(col: Column, code: str) -> Column:
    """1 where the column equals the code, 0 where it differs, null where it is null."""
    return (col.cast("string") == F.lit(code)).cast("tinyint")


def above(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(float(threshold))).cast("tinyint")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def cross_entropy(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def group_seed(seed: int, group: Column) -> Column:
    """Stable 60-bit seed of a group: the same in every session and partitioning."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), group), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _json_text(value: Column) -> Column:
    """A string as JSON, quotes and control characters escaped."""
    in_array = F.to_json(F.array(value))
    return F.substring(in_array, F.lit(2), F.length(in_array) - 2)


def extract_key(year: Column, horizon: Column, states: Column) -> Column:
    """First 16 hex digits of SHA-256 over the canonical JSON of the extract settings (states sorted)."""
    listed = F.array_join(F.transform(F.array_sort(states), _json_text), ", ")
    text = F.concat(
        F.lit('{"horizon": '), _json_text(horizon), F.lit(', "states": ['), listed, F.lit('], "year": '), year.cast("string"), F.lit("}")
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def long_form(names: Sequence[str], label_of: Mapping[str, str] | None = None, keep_type: str = "string") -> Column:
    """Array of (feature, value) structs, to be exploded into one row per column."""
    label_of = label_of or {}
    return F.array(
        *[
            F.struct(F.lit(label_of.get(n, n)).alias("feature"), quoted(n).cast(keep_type).alias("value"))
            for n in names
        ]
    )
