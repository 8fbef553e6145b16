"""Gaussian copula with normal marginals, fitted and sampled per group.

Method: Patki, Wedge, Veeramachaneni, "The Synthetic Data Vault", DSAA 2016. A categorical value becomes a uniform
draw from the interval that its share of the group covers. With normal marginals the normal score of a column is
z = (x - mean) / sd, so the fit needs moments only. The uniform draw is taken into account in closed form: it adds
variance inside the interval and nothing to covariances, which makes mean 1/2 and variance 1/12 for every categorical
column, so that its score is z = (midpoint - 1/2)·√12 and the fit is deterministic.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from surveyloom.functions.columns import long_form, quoted
from surveyloom.operators.features import split_by_type
from surveyloom.session import written

BLOCK_ROWS = 8192  # rows made from one random stream; part of what a seed means
BLOCKS_PER_CHUNK = 64  # blocks of one group that a task makes in a row
MAX_DIGITS = 9
VALUES_IN_ROW = 4096  # categories of one group and column that may travel in one row; longer lists are looked up by a join
END_SALTS = 16  # tasks that share the first, and the last, bucket of a looked-up column, where draws beyond the ends are
GROUPS_IN_MEMORY = 256  # Gram matrices held by a task before they are sent on


@dataclass
class CopulaModel:
    """Fitted copula: three tables with one row set per group, and the columns in output order."""

    group: str
    columns: list[str]
    numeric: list[str]
    long: list[str]
    intervals: DataFrame  # group, feature, value, n, lo, hi
    marginals: DataFrame  # group, feature, n, mean, sd, low, high, digits
    correlations: DataFrame  # group, x, y, r  (x < y in column order)
    codes: dict[str, str] = field(default_factory=dict)  # categorical columns that are no text, and their type

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.columns if c not in self.numeric]

    def save(self, path: str) -> None:
        for name in ("intervals", "marginals", "correlations"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        layout = [(c, c in self.numeric, c in self.long, self.group, self.codes.get(c)) for c in self.columns]
        spark = self.intervals.sparkSession
        spark.createDataFrame(layout, "name string, numeric boolean, long boolean, group string, code string").withColumn(
            "position", F.monotonically_increasing_id()
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CopulaModel:
        layout = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
        tables = [spark.read.parquet(f"{path}/{n}") for n in ("intervals", "marginals", "correlations")]
        return CopulaModel(
            layout[0]["group"],
            [r["name"] for r in layout],
            [r["name"] for r in layout if r["numeric"]],
            [r["name"] for r in layout if r["long"]],
            *tables,
            {r["name"]: r["code"] for r in layout if r["code"]},
        )


def category_intervals(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(group, feature, value, n, lo, hi)``: the part of [0, 1) that a value's share covers, most frequent first."""
    if not columns:
        kind = df.schema[group].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{group}` {kind}, feature string, value string, n bigint, lo double, hi double")
    counts = (
        df.select(group, F.explode(long_form(columns)).alias("cell"))
        .groupBy(group, "cell.feature", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    within = Window.partitionBy(group, "feature")
    upto = F.sum("n").over(within.orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(within)
    return counts.select(
        group, "feature", "value", "n", ((upto - F.col("n")) / total).alias("lo"), (upto / total).alias("hi")
    )


def _digits(col) -> F.Column:
    """Fewest decimals that state the value exactly; MAX_DIGITS + 1 where none do."""
    out = F.when(col.isNull(), F.lit(0))
    for d in range(MAX_DIGITS + 1):
        scale = float(10**d)
        out = out.when(F.rint(col * scale) / scale == col, F.lit(d))
    return out.otherwise(F.lit(MAX_DIGITS + 1))


def column_marginals(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(group, feature, n, mean, sd, low, high, digits)`` of the numeric columns; sd is that of the population."""
    fields = ("n", "mean", "sd", "low", "high", "digits")
    if not columns:
        kind = df.schema[group].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{group}` {kind}, feature string, n bigint, mean double, sd double, low double, high double, digits int")
    stats = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        whole = not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
        digits = F.lit(0) if whole else _digits(x)
        for field, value in zip(
            fields, (F.count(x), F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), F.max(digits))
        ):
            stats.append(value.alias(f"{i}_{field}"))
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}_{f}").alias(f) for f in fields])
            for i, c in enumerate(columns)
        ]
    )
    return df.groupBy(group).agg(*stats).select(group, F.inline(rows))


def group_chunks(df: DataFrame, group: str, tasks: int) -> dict:
    """Number of chunks of the groups that are cut: those with more than a fair part of half a task's rows.

    At most 2 · ``tasks`` groups can have that many rows, which bounds what reaches the driver.
    """
    counts = written(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "copula-sizes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(1, -(-total // (2 * tasks)))
    return {r[group]: -(-r["n"] // part) for r in counts.where(F.col("n") > part).collect()}


class _Lookup:
    """Scores of one group: z of each value of its text columns, mean and deviation of its numbers."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple]] = {}
        self.ready: dict[int, tuple[pd.Index, np.ndarray]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        places = batch.column("place").to_numpy(zero_copy_only=False)
        for place in np.unique(places):
            rows = batch.filter(pa.array(places == place))
            held = rows.column("value"), *(rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            self.parts.setdefault(int(place), []).append(held)

    def texts(self, place: int, column: pa.Array) -> np.ndarray:
        """z of every text; 0 for nulls and texts that the fit has not seen."""
        if place not in self.ready:
            parts = self.parts.get(place, [])
            values = pd.Index([v for values, *_ in parts for v in values.to_pylist()], dtype=object)
            self.ready[place] = values, np.append(np.concatenate([z for _, z, _ in parts] or [np.zeros(0)]), 0.0)
        values, z = self.ready[place]
        coded = column.dictionary_encode()
        known = z[values.get_indexer(pd.Index(coded.dictionary.to_pylist(), dtype=object))] if len(coded.dictionary) else z[:0]
        return np.append(known, 0.0)[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]

    def numbers(self, place: int, column: pa.Array) -> np.ndarray:
        x = column.to_numpy(zero_copy_only=False)
        mean, sd = next(((m[0], s[0]) for _, m, s in self.parts.get(place, [])), (np.nan, np.nan))
        return np.nan_to_num((x - mean) / sd, nan=0.0) if sd > 0 else np.zeros(len(x))


def _score_stream(group: str, columns: Sequence[str], numeric: set[str]):
    """mapInArrow function over sorted rows: the lookup of a (group, chunk) comes first, then its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lookup = None, _Lookup()
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(group).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            chunks, kinds = (batch.column(c).to_numpy() for c in ("chunk", "kind"))
            changes = (np.diff(codes) != 0) | (np.diff(chunks) != 0) | (np.diff(kinds) != 0)
            edges = [0, *(np.flatnonzero(changes) + 1), len(batch)]
            for begin, end in zip(edges, edges[1:]):
                part = batch.slice(begin, end - begin)
                own = part.column(group)[0].as_py(), int(chunks[begin])
                if own != key:
                    key, lookup = own, _Lookup()
                if kinds[begin] == 0:
                    lookup.add(part)
                    continue
                z = [lookup.numbers(i, part.column(f"c{i}")) if c in numeric else lookup.texts(i, part.column(f"c{i}")) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column(group), *[pa.array(v, pa.float64()) for v in z]], [group, *[f"z{i}" for i in range(len(z))]])

    return run


def normal_scores(
    df: DataFrame, group: str, columns: Sequence[str], intervals: DataFrame, marginals: DataFrame, categorical: Sequence[str] | None = None
) -> DataFrame:
    """Group and one score column ``z0, z1, …`` per input column; nulls and values that the fit has not seen score 0.

    Rows are shuffled once, by group and chunk, and meet there what is needed to score them: the group's intervals and moments, sent to each of
    its chunks ahead of the rows. A hot group has as many chunks as its rows fill half tasks. Rows are streamed; a task
    holds the vocabulary of one group.
    """
    numeric = {c for c in columns if (c in split_by_type(df)[0] if categorical is None else c not in categorical)}
    places = {c: i for i, c in enumerate(columns)}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = group_chunks(df.select(group), group, tasks)
    chunks = F.lit(1)
    for name, n in cut.items():
        chunks = F.when(quoted(group).eqNullSafe(F.lit(name)), F.lit(n)).otherwise(chunks)
    place = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("feature")]
    z = ((F.col("lo") + F.col("hi")) / 2 - 0.5) * math.sqrt(12.0)
    known = intervals.where(F.col("value").isNotNull()).select(
        quoted(group), place.alias("place"), F.col("value").cast("string").alias("value"), z.alias("a"), F.lit(None).cast("double").alias("b")
    )
    moments = marginals.select(quoted(group), place.alias("place"), F.lit(None).cast("string").alias("value"), F.col("mean").alias("a"), F.col("sd").alias("b"))
    lookup = known.unionByName(moments).where(F.col("place").isNotNull())
    each = F.explode(F.sequence(F.lit(0), chunks - 1))
    cells = [quoted(c).cast("double" if c in numeric else "string").alias(f"c{i}") for i, c in enumerate(columns)]
    kinds = {f"c{i}": "double" if c in numeric else "string" for i, c in enumerate(columns)}
    ahead = lookup.select(
        quoted(group), each.alias("chunk"), F.lit(0).alias("kind"), "place", "value", "a", "b", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    )
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), chunks).cast("int")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("value", "string"), ("a", "double"), ("b", "double"))]
    rows = df.select(quoted(group), dealt.alias("chunk"), F.lit(1).alias("kind"), *nothing, *cells)
    together = ahead.unionByName(rows).repartition(tasks, quoted(group), "chunk").sortWithinPartitions(quoted(group), "chunk", "kind")
    kind = df.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, " + ", ".join(f"z{i} double" for i in range(len(columns)))
    return together.mapInArrow(_score_stream(group, list(columns), numeric), schema)


def _gram_partials(group: str, width: int, key_type: pa.DataType):
    """mapInArrow function: per task and group the sums of z_i·z_j over the upper triangle."""
    rows, cols = np.triu_indices(width, 1)

    def emit(held: dict) -> pa.RecordBatch:
        sums = [gram[rows, cols] for _, gram in held.values()]
        arrays = [pa.array(list(held), key_type), pa.array([n for n, _ in held.values()]), pa.array(sums)]
        return pa.RecordBatch.from_arrays(arrays, ["g", "n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            z = np.column_stack([batch.column(f"z{i}").to_numpy(zero_copy_only=False) for i in range(width)])
            keys = batch.column(group).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(keys.dictionary.to_pylist()):
                part = z[codes == k]
                n, gram = held.get(name, (0, 0.0))
                held[name] = (n + len(part), gram + part.T @ part)
            if len(held) > GROUPS_IN_MEMORY:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    return run


def score_correlations(scores: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(group, x, y, r)`` for every pair. Tasks send one Gram matrix per group instead of rows."""
    width = len(columns)
    rows, cols = np.triu_indices(width, 1)
    kind = scores.schema[group].dataType.simpleString()
    partials = _gram_partials(group, width, to_arrow_type(scores.schema[group].dataType))
    partial = scores.mapInArrow(partials, f"g {kind}, n bigint, sums array<double>")
    summed = (
        partial.select("g", "n", F.posexplode("sums").alias("pair", "s"))
        .groupBy("g", "pair")
        .agg((F.sum("s") / F.sum("n")).alias("r"))
    )
    first = F.array(*[F.lit(columns[i]) for i in rows])
    second = F.array(*[F.lit(columns[j]) for j in cols])
    return summed.select(F.col("g").alias(group), first[F.col("pair")].alias("x"), second[F.col("pair")].alias("y"), "r")


def fit_copula(
    df: DataFrame, group: str, columns: Sequence[str], long: Sequence[str] = (), categorical: Sequence[str] | None = None
) -> CopulaModel:
    """Fit one copula per group. ``categorical``: the columns of codes, whatever their type; by default the text columns. All others are numeric.

    A null has the score 0, the middle of its column, so it weakens the column's correlations and changes nothing else. Nulls of a categorical
    column are a category of their own; a numeric column without values in a group is drawn as null there. Codes are drawn in their
    own type.
    """
    columns = list(columns)
    types = split_by_type(df)[0]
    categorical = [c for c in columns if (c not in types if categorical is None else c in categorical)]
    numeric = [c for c in columns if c not in categorical]
    text = [c for c in numeric if c not in types]
    if text:
        raise ValueError(f"text columns cannot be numeric: {text}")
    codes = {c: df.schema[c].dataType.simpleString() for c in categorical if not isinstance(df.schema[c].dataType, T.StringType)}
    long = [c for c in numeric if c in long or not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    intervals = written(category_intervals(df, group, categorical), "copula-intervals", "feature")
    marginals = written(column_marginals(df, group, numeric), "copula-marginals")
    scores = normal_scores(df, group, columns, intervals, marginals, categorical)
    correlations = written(score_correlations(scores, group, columns), "copula-correlations")
    return CopulaModel(group, columns, numeric, long, intervals, marginals, correlations, codes)


def correlation_factors(model: CopulaModel) -> DataFrame:
    """``(group, factor)``: lower Cholesky factor of the nearest correlation matrix, row by row.

    The input has d·(d-1)/2 rows per group for d columns, however many rows the table holds.
    """
    group, columns = model.group, model.columns
    width = len(columns)
    position = {c: i for i, c in enumerate(columns)}
    kind = model.correlations.schema[group].dataType.simpleString()

    def factor(pairs: pd.DataFrame) -> pd.DataFrame:
        corr = np.eye(width)
        i, j = pairs["x"].map(position).to_numpy(), pairs["y"].map(position).to_numpy()
        corr[i, j] = corr[j, i] = pairs["r"].to_numpy()
        values, vectors = np.linalg.eigh(corr)
        fixed = (vectors * np.clip(values, 1e-9, None)) @ vectors.T
        scale = 1 / np.sqrt(np.diag(fixed))
        lower = np.linalg.cholesky(fixed * np.outer(scale, scale))
        return pd.DataFrame({group: [pairs[group].iloc[0]], "factor": [lower.ravel()]})

    return model.correlations.groupBy(group).applyInPandas(factor, f"`{group}` {kind}, factor array<double>")


def value_counts(model: CopulaModel) -> DataFrame:
    """``(group, feature, n_values)`` of the categorical columns."""
    return written(model.intervals.groupBy(model.group, "feature").agg(F.count(F.lit(1)).alias("n_values")), "copula-values")


def sampler_parameters(model: CopulaModel, counts: DataFrame) -> DataFrame:
    """One row per group with everything a block needs: factor, numeric marginals, categories with their upper ends.

    Lists of more than ``VALUES_IN_ROW`` categories stay out of the row; only their lengths are in it.
    """
    group = model.group
    out = correlation_factors(model)
    if model.numeric:
        marginals = model.marginals.groupBy(group).agg(
            F.map_from_entries(
                F.collect_list(F.struct("feature", F.array(*[F.col(c).cast("double") for c in ("mean", "sd", "low", "high", "digits")])))
            ).alias("marginals")
        )
        out = out.join(marginals, group)
    else:
        out = out.withColumn("marginals", F.lit(None).cast("map<string,array<double>>"))
    if model.categorical:
        short = model.intervals.join(counts.where(F.col("n_values") <= VALUES_IN_ROW), [group, "feature"], "left_semi")
        per_column = short.groupBy(group, "feature").agg(F.sort_array(F.collect_list(F.struct("hi", "value"))).alias("ends"))
        categories = per_column.groupBy(group).agg(
            F.map_from_entries(F.collect_list(F.struct("feature", F.struct(F.col("ends.hi").alias("hi"), F.col("ends.value").alias("value"))))).alias("categories")
        )
        lengths = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("feature", "n_values"))).alias("lengths"))
        out = out.join(categories, group, "left").join(lengths, group)
    else:
        out = out.withColumn("categories", F.lit(None).cast("map<string,struct<hi:array<double>,value:array<string>>>"))
        out = out.withColumn("lengths", F.lit(None).cast("map<string,bigint>"))
    return out


def _stream(seed: int, group: object, block: int) -> np.random.Generator:
    """Random stream of one block: a function of seed, group and block only; keyed by ``functions.columns.group_seed``."""
    key = int(hashlib.sha256(f"{seed}|{group}".encode()).hexdigest()[:15], 16)
    return np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, 0, block], dtype=np.uint64)))


def draw_block(columns, numeric, long, parameters: dict, group: object, block: int, rows: int, seed: int, looked_up: Sequence = ()) -> list[pa.Array]:
    """The rows of one block, column by column: correlated normals turned back into values.

    Categories that are not in the parameters are null; for the columns of ``looked_up`` place and number of values follow.
    """
    z = _stream(seed, group, block).standard_normal((rows, len(columns))) @ parameters["lower"].T
    out = []
    for i, c in enumerate(columns):
        if c in numeric:
            mean, sd, low, high, digits = parameters["marginals"][c]
            if mean is None:
                out.append(pa.nulls(rows, pa.int64() if c in long else pa.float64()))
                continue
            x = np.clip(mean + sd * z[:, i], low, high)
            x = np.round(x, int(digits)) if digits <= MAX_DIGITS else x
            out.append(pa.array(x.astype(np.int64) if c in long else x))
        elif c in parameters["categories"]:
            ends, values = parameters["categories"][c]
            out.append(values.take(pa.array(np.minimum(np.searchsorted(ends, _share(z[:, i]), side="right"), len(ends) - 1))))
        else:
            out.append(pa.nulls(rows, pa.string()))
    for i, c in looked_up:
        length = None if c in parameters["categories"] else parameters["lengths"].get(c)
        out += [pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.int64())] if length is None else [pa.array(_share(z[:, i])), pa.repeat(length, rows)]
    return out


def _share(z: np.ndarray) -> np.ndarray:
    """Place of a normal score in the unit interval that the categories share."""
    return np.clip(0.5 + z / math.sqrt(12.0), 0.0, 1.0)


def _looked_up(drawn: DataFrame, model: CopulaModel, counts: DataFrame, place: int, feature: str) -> DataFrame:
    """Fill a column from its place ``_u`` among the ``_b`` values of its group, by a join on (group, bucket of the place).

    As many buckets as values: a value is in each bucket that its interval touches, at most twice as many entries as values in all. The end
    buckets, which also take the draws beyond the ends, are shared by several tasks. Rows whose group has a short list have no
    place; they go by buckets of their own that meet nothing.
    """
    u, b, row = F.col(f"_u{place}"), F.col(f"_b{place}"), F.col("_row")
    long = counts.where((F.col("feature") == feature) & (F.col("n_values") > VALUES_IN_ROW)).select(model.group, F.col("n_values").alias("_n"))
    values = model.intervals.where(F.col("feature") == feature).join(long, model.group)
    last = F.col("_n") - 1
    first, end = (F.least(F.floor(F.col(x) * F.col("_n")), last) for x in ("lo", "hi"))
    values = values.select(quoted(model.group).alias("_g"), F.col("value").alias("_value"), "lo", "hi", "_n", F.explode(F.sequence(first, end)).alias("_bucket"))
    at_end = (F.col("_bucket") == 0) | (F.col("_bucket") == last)
    salts = F.sequence(F.lit(0), F.when(at_end, F.lit(END_SALTS - 1)).otherwise(F.lit(0)))
    values = written(values.withColumn("_salt", F.explode(salts)), "copula-buckets")
    own = F.coalesce(F.least(F.floor(u * b), b - 1), -1 - F.pmod(row, F.lit(4096)))
    salt = F.when((own == 0) | (own == b - 1), F.pmod(row, F.lit(END_SALTS))).otherwise(F.lit(0))
    inside = (F.col("lo") <= u) & ((u < F.col("hi")) | (F.col("hi") >= 1.0))
    on = (quoted(model.group) == F.col("_g")) & (own == F.col("_bucket")) & (salt == F.col("_salt")) & inside
    joined = drawn.join(values, on, "left")
    filled = F.coalesce(quoted(feature), F.col("_value")).alias(feature)
    return joined.select(*[filled if c == feature else quoted(c) for c in drawn.columns])


def _parameters(row: dict, width: int) -> dict:
    return {
        "lower": np.array(row["factor"], dtype=np.float64).reshape(width, width),
        "marginals": dict(row["marginals"] or []),
        "categories": {
            c: (np.array(e["hi"]), pa.array(e["value"], pa.string())) for c, e in (row["categories"] or [])
        },
        "lengths": dict(row["lengths"] or []),
    }


def sample_chunks(sizes: DataFrame, group: str) -> DataFrame:
    """Cut the rows wanted per group into chunks of blocks: ``(group, first, blocks, n)`` and the other columns.

    Two explodes, so that even a very large group never becomes one long array.
    """
    long, per, step = (lambda n: F.lit(n).cast("bigint")), BLOCKS_PER_CHUNK, BLOCKS_PER_CHUNK * 10_000
    total = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("bigint")
    starts = F.explode(F.sequence(long(0), F.col("_blocks") - 1, long(step)))
    inner = F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + step, F.col("_blocks")) - 1, long(per)))
    cut = sizes.where(F.col("n") > 0).withColumn("_blocks", total).withColumn("_start", starts).withColumn("first", inner)
    return cut.withColumn("blocks", F.least(long(per), F.col("_blocks") - F.col("first"))).drop("_blocks", "_start")


def sample_copula(model: CopulaModel, sizes: DataFrame, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    """Draw ``sizes.n`` rows per group; ``carry`` are columns of ``sizes`` repeated on each row of the group.

    A chunk of blocks carries its group's parameters, and chunks are dealt out after the join, so a hot group is made by as many
    tasks whether or not the join was a broadcast. The rows depend only on seed, group and block. No row holds more than
    ``VALUES_IN_ROW`` categories of a column: longer lists are looked up row by row, see ``_looked_up``.
    """
    group, columns, numeric, long = model.group, model.columns, model.numeric, model.long
    wanted = written(sample_chunks(sizes.select(group, "n", *carry), group), "copula-chunks")
    tasks = max(wanted.count(), 1)
    tasks = min(tasks, max(sizes.sparkSession.sparkContext.defaultParallelism * 4, tasks // 16))
    counts = value_counts(model) if model.categorical else None
    jobs = wanted.join(written(sampler_parameters(model, counts), "copula-parameters"), group).repartition(tasks, group, "first")
    listed = [] if counts is None else [r["feature"] for r in counts.where(F.col("n_values") > VALUES_IN_ROW).select("feature").distinct().collect()]
    looked_up = [(i, c) for i, c in enumerate(columns) if c in listed]
    places = {name: kind for i, _ in looked_up for name, kind in ((f"_u{i}", "double"), (f"_b{i}", "bigint"))}
    places |= {"_row": "bigint"} if looked_up else {}
    kinds = {c: "bigint" if c in long else "double" if c in numeric else "string" for c in columns}
    carried = {c: sizes.schema[c].dataType.simpleString() for c in (group, *carry)}
    schema = ", ".join(f"`{c}` {t}" for c, t in {**kinds, **places, **carried}.items())

    arrow_types = {c: to_arrow_type(sizes.schema[c].dataType) for c in carried}
    numbers, whole, names = set(numeric), set(long), [*columns, *places, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.select([group, "first", "blocks", "n", *carry]).to_pylist()
            for at, row in enumerate(keys):
                if row[group] not in held:
                    held = held if len(held) < GROUPS_IN_MEMORY else {}
                    wide = batch.slice(at, 1).select(["factor", "marginals", "categories", "lengths"]).to_pylist()[0]
                    held[row[group]] = _parameters(wide, len(columns))
                for block in range(row["first"], row["first"] + row["blocks"]):
                    n = min(BLOCK_ROWS, row["n"] - block * BLOCK_ROWS)
                    drawn = draw_block(columns, numbers, whole, held[row[group]], row[group], block, n, seed, looked_up)
                    drawn += [pa.array(np.arange(n, dtype=np.int64) + block * BLOCK_ROWS)] if looked_up else []
                    drawn += [pa.repeat(pa.scalar(row[c], arrow_types[c]), n) for c in carried]
                    yield pa.RecordBatch.from_arrays(drawn, names)

    drawn = jobs.mapInArrow(run, schema)
    for i, c in looked_up:
        drawn = _looked_up(drawn, model, counts, i, c)
    drawn = drawn.drop(*places)
    return drawn.select(*[quoted(c).cast(model.codes[c]).alias(c) if c in model.codes else quoted(c) for c in drawn.columns])
