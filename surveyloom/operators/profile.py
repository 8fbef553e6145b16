"""Profiling: shape, distinct counts, value frequencies, descriptive statistics, correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import columns as C
from surveyloom.operators.features import split_by_type
from surveyloom.session import literal_table

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
ACCURACY = 10_000  # of percentile_approx: rank error at most 1 / ACCURACY of the rows
SKETCH = 4096  # size of a quantile sketch
SKETCH_ERROR = 2.296 / SKETCH**0.9021  # its rank error, as a share of the rows, is below this with 99 % probability
BRACKET_ROWS = 200_000  # a bracket of at most this many rows is not narrowed again


def shape(df: DataFrame) -> DataFrame:
    """Row and column count; the row count is read from file footers where the table is a plain scan."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def _cells(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str] | None) -> DataFrame:
    return df.select(F.explode(C.long_form(columns, labels)).alias("cell")).select("cell.*")


def value_counts(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per (feature, value), nulls included. Rows are summed before the shuffle, so a hot value is one row per task."""
    return _cells(df, columns, labels).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct values per column; null counts as a value."""
    columns = split_by_type(df)[1] if columns is None else columns
    return value_counts(df, columns, labels).groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))


def value_frequencies(
    df: DataFrame, columns: Sequence[str] | None = None, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Share of each value in its column, most frequent first. Every column has the table's row count as its total."""
    columns = split_by_type(df)[1] if columns is None else columns
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = value_counts(df, columns, labels)
    return counts.select("feature", "value", "n", (F.col("n") / total).alias("proportion")).orderBy(
        "feature", F.desc("n"), F.asc_nulls_first("value")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations ``(x, y, r)`` for every ordered pair, each over the rows where both are present.

    Tasks turn their rows into matrix products around the column means, one small set of sums per task, which are then
    added up per pair; hundreds of pairs would be too many for one generated aggregate. A column that is constant on
    the rows of a pair has no correlation: null.
    """
    columns = split_by_type(df)[0] if columns is None else list(columns)
    pairs = [(c, c) for c in columns] + list(combinations(columns, 2))
    at = {c: i for i, c in enumerate(columns)}
    first, second = np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs])
    as_double = df.select(*[C.quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = as_double.agg(*[F.avg(c) for c in as_double.columns]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names), len(pairs)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            known = ~np.isnan(x)
            z, m = np.where(known, x, 0.0), known.astype(float)
            products = (m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z)
            held += np.array([p[first, second] for p in products])
        pair = np.arange(len(pairs), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(pair), *map(pa.array, held)], ["pair", *names])

    schema = "pair int, " + ", ".join(f"{n} double" for n in names)
    total = as_double.mapInArrow(sums, schema).groupBy("pair").agg(*[F.sum(n).alias(n) for n in names])
    n = F.col("n")
    xx, yy = (n * F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") for v in "xy")
    varies = (xx > 1e-12 * n * F.col("sxx")) & (yy > 1e-12 * n * F.col("syy"))
    xy = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r = F.when(varies, F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))
    both = F.array(
        *[F.array(*[F.struct(F.lit(p).alias("x"), F.lit(q).alias("y")) for p, q in dict.fromkeys([(a, b), (b, a)])]) for a, b in pairs]
    )
    return total.select(r.alias("r"), F.inline(both[F.col("pair")])).select("x", "y", "r")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, null_count, mean, std, min, quartiles, max.

    A quartile is the value at position round((n - 1)·q) of the sorted column, half away from zero, exactly. Columns
    are not sorted as a whole. One scan takes the moments and a mergeable quantile sketch, whose quantiles around the position are a
    bracket; a second one counts the rows below the bracket and ranks the distinct values inside, which proves the value or finds none.
    Only what was not proved, and columns so long that a sketch's bracket is over ``BRACKET_ROWS``, take further scans.
    """
    columns = split_by_type(df)[0] if columns is None else list(columns)
    values = df.select(*[C.quoted(c).cast("double").alias(c) for c in columns])
    cells = values.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), C.quoted(c).alias("value")) for c in columns])))
    v, asked = F.col("value"), F.array(*[F.lit(p) for q in QUARTILES.values() for p in _outside(q)])
    moments = cells.groupBy("feature").agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"),
    )
    known = F.kll_sketch_get_n_double("sketch") > 0
    near = F.when(known, F.kll_sketch_get_quantile_double("sketch", asked)).alias("near")
    stats = {r["feature"]: r for r in moments.withColumn("near", near).drop("sketch").collect()}
    stats = {c: stats[c] for c in columns if c in stats}
    brackets, guessed = {}, {}
    for c, s in stats.items():
        for k, (name, q) in enumerate(QUARTILES.items()):
            if s["count"]:
                brackets[c, name] = _Bracket(s["min"], s["max"], _position(s["count"], q), inside=s["count"])
                low, high = _outside(q)
                if s["near"] and min(1.0, high - low) * s["count"] <= BRACKET_ROWS:
                    guessed[c, name] = _Bracket(*s["near"][2 * k : 2 * k + 2], brackets[c, name].position)
    found = {(r["feature"], r["quantile"]): r["value"] for r in _proved(values, guessed).collect()}
    missing = {k: b for k, b in brackets.items() if k not in found}
    if missing:
        asked = {c: F.percentile_approx(C.quoted(c), [p for q in QUARTILES.values() for p in _around(q)], ACCURACY) for c, _ in missing}
        near = values.agg(*[e.alias(c) for c, e in asked.items()]).first()
        for c, name in missing:
            at = 2 * list(QUARTILES).index(name)
            missing[c, name].guess = tuple(near[c][at : at + 2])
        found.update({(r["feature"], r["quantile"]): r["value"] for r in _ranked(values, _narrowed(values, missing)).collect()})
    summary = literal_table(
        df.sparkSession,
        {
            "feature": pa.array(list(stats), pa.string()),
            **{n: pa.array([s[n] for s in stats.values()], pa.int64()) for n in ("count", "null_count")},
            **{n: pa.array([s[n] for s in stats.values()], pa.float64()) for n in ("mean", "std", "min", "max")},
            **{q: pa.array([found.get((c, q)) for c in stats], pa.float64()) for q in QUARTILES},
        },
    )
    return summary.select("feature", "count", "null_count", "mean", "std", "min", *QUARTILES, "max")


@dataclass
class _Bracket:
    """Values low..high hold the searched position; ``below`` rows are smaller than low, ``inside`` rows lie in it."""

    low: float
    high: float
    position: int
    below: int = 0
    inside: int = 0
    guess: tuple[float, float] | None = None

    @property
    def is_wide(self) -> bool:
        return self.inside > BRACKET_ROWS and self.low < self.high


def _position(n: int, q: float) -> int:
    return math.floor((n - 1) * q + 0.5)


def _around(q: float) -> list[float]:
    """Percentages on both sides of q, further off than the error of an approximate percentile."""
    return [max(0.0, q - 3 / ACCURACY), min(1.0, q + 3 / ACCURACY)]


def _outside(q: float) -> list[float]:
    """Percentages on both sides of q, further off than the error of a sketch."""
    low, high = _around(q)
    return [max(0.0, low - 2 * SKETCH_ERROR), min(1.0, high + 2 * SKETCH_ERROR)]


def _proved(values: DataFrame, brackets: dict[tuple[str, str], _Bracket]) -> DataFrame:
    """``(feature, quantile, value)`` of the brackets that hold their position, in one scan.

    Rows below a bracket are summed to one row of it, with a null value, and rows above are not counted.
    """
    if not brackets:
        return values.sparkSession.createDataFrame([], "feature string, quantile string, value double")
    targets = [
        F.struct(F.lit(i).alias("i"), F.when(C.quoted(c) >= b.low, C.quoted(c)).alias("value"), (C.quoted(c) <= b.high).alias("counts"))
        for i, ((c, _), b) in enumerate(brackets.items())
    ]
    counts = values.select(F.inline(F.array(*targets))).where("counts").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    names = [F.struct(F.lit(c).alias("feature"), F.lit(name).alias("quantile"), F.lit(b.position).cast("bigint").alias("position")) for (c, name), b in brackets.items()]
    upto = F.sum("n").over(Window.partitionBy("i").orderBy(F.col("value").asc_nulls_first()))
    ranked = counts.select("value", "n", upto.alias("upto"), F.array(*names)[F.col("i")].alias("of"))
    hit = ranked.where("value IS NOT NULL AND upto - n <= of.position AND of.position < upto")
    return hit.select("of.feature", "of.quantile", "value")


def _narrowed(
    values: DataFrame, brackets: dict[tuple[str, str], _Bracket]
) -> dict[tuple[str, str], _Bracket]:
    """Replace every bracket by its guess where a count proves it, and guess again inside wide ones while it helps.

    A bracket whose guess fails is kept as it is, so the result is exact in any case. Only a handful of numbers per
    column reaches the driver.
    """
    brackets = dict(brackets)
    open_ = {k: b for k, b in brackets.items() if b.low < b.high}
    while open_:
        by_column: dict[str, list] = {}
        for k, b in open_.items():
            by_column.setdefault(k[0], []).append((k, b))
        depth = max(map(len, by_column.values()))
        flags = [f"{part}{j}" for j in range(depth) for part in ("below", "inside")]
        tests = []
        for i, (c, members) in enumerate(by_column.items()):
            x = C.quoted(c)
            bits = [bit for _, b in members for bit in (x < b.guess[0], x.between(*b.guess))]
            bits += [F.lit(False)] * (len(flags) - len(bits))
            tests.append(F.struct(F.lit(i).alias("i"), *[bit.alias(n) for bit, n in zip(bits, flags)]))
        found = values.select(F.inline(F.array(*tests))).groupBy("i").agg(*[F.count_if(n).alias(n) for n in flags])
        rows = {r["i"]: r for r in found.collect()}
        counts = {
            k: (rows[i][f"below{j}"], rows[i][f"inside{j}"])
            for i, members in enumerate(by_column.values())
            for j, (k, _) in enumerate(members)
        }
        again = {}
        for k, b in open_.items():
            below, inside = counts[k]
            if below <= b.position < below + inside and inside < b.inside:
                brackets[k] = _Bracket(*b.guess, b.position, below, inside)
                if brackets[k].is_wide:
                    again[k] = brackets[k]
        if again:
            near = values.agg(
                *[
                    F.percentile_approx(
                        F.when(C.quoted(c).between(b.low, b.high), C.quoted(c)),
                        _around((b.position - b.below) / b.inside),
                        ACCURACY,
                    ).alias(str(i))
                    for i, ((c, _), b) in enumerate(again.items())
                ]
            ).first()
            for i, b in enumerate(again.values()):
                b.guess = tuple(near[str(i)])
        open_ = {k: b for k, b in again.items() if b.guess != (b.low, b.high)}
    return brackets


def _ranked(values: DataFrame, brackets: dict[tuple[str, str], _Bracket]) -> DataFrame:
    """``(feature, quantile, value)``: rank the distinct values inside each bracket. Rows outside all are filtered first."""
    if not brackets:
        return values.sparkSession.createDataFrame([], "feature string, quantile string, value double")
    within = [C.quoted(c).between(b.low, b.high) for (c, _), b in brackets.items()]
    targets = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(name).alias("quantile"),
                F.lit(b.position - b.below).cast("bigint").alias("position"),
                F.when(hit, C.quoted(c)).alias("value"),
            )
            for ((c, name), b), hit in zip(brackets.items(), within)
        ]
    )
    counts = (
        values.where(reduce(or_, within))
        .select(F.inline(targets))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "quantile", "position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("feature", "quantile").orderBy("value")
    ranked = counts.select("*", F.sum("n").over(upto).alias("upto"))
    hit = (F.col("upto") - F.col("n") <= F.col("position")) & (F.col("position") < F.col("upto"))
    return ranked.where(hit).select("feature", "quantile", "value")
