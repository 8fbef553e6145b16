"""Design matrix with sparse rows, for text columns of very many values.

The same columns as ``design``, in the same order: scaled numbers, labelled codes, found values. Nothing of the found values reaches the
driver: the vocabulary is a table whose positions are counted per range of the sorted values, rows get their positions by a
join, and a row is a list of its non-zero cells.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.functions import columns as C
from surveyloom.operators.design import DesignModel, DesignSpec
from surveyloom.session import literal_table, written

CELL = "struct<index:bigint,value:double>"
VOCABULARY = "position bigint, place int, feature string, value string"


def with_positions(df: DataFrame, order: Sequence[str], name: str, first: int = 0, partition_by: str | None = None) -> DataFrame:
    """``df`` with ``position``, counted from ``first`` in the given order, as a written table. No task sees more than a range.

    The rows are range-partitioned and sorted; a row's number within its range is added to the number of rows of the ranges before,
    of which there are as many as partitions.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges = written(ranges, f"{name}-ranges").withColumn("_range", F.shiftright("_at", 33))
    counts = ranges.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), f"{name}-offsets")
    own = F.col("_at") - F.shiftleft(F.col("_range"), 33)
    placed = ranges.join(offsets, F.col("_range") == F.col("_of"))
    placed = placed.select((own + F.col("_before") + F.lit(first)).alias("position"), *df.columns)
    return written(placed, name, partition_by).select(*placed.columns)


@dataclass
class SparseDesign:
    """``dense`` encodes numbers and codes; ``vocabulary`` is ``position, place, feature, value`` of the text columns, by ``place``."""

    dense: DesignModel
    texts: list[str]
    vocabulary: DataFrame
    width: int

    @property
    def first(self) -> int:
        """Position of the first found value."""
        return len(self.dense.bounds) + sum(len(codes) for codes in self.dense.codes.values())

    def names(self, spark: SparkSession) -> DataFrame:
        """``position, name`` of all columns, named as in the dense matrix."""
        fixed = self.dense.names[self.dense.weight is not None :]
        known = literal_table(spark, {"position": list(range(len(fixed))), "name": fixed}) if fixed else None
        labels = [F.lit(x) for t in self.texts for x in (t, self.dense.label(t))]
        found = self.vocabulary.select("position", F.concat(F.create_map(*labels)[F.col("feature")], F.lit("_"), "value").alias("name")) if labels else None
        return found if known is None else known if found is None else known.unionAll(found)

    def _known_cells(self, columns: Mapping[str, Column]) -> Column:
        """Cells of numbers and codes: a zero is no cell, an unreadable number is NaN, a code without a label has none."""
        cells, at = [], 0
        for c, (low, high) in self.dense.bounds.items():
            value = F.coalesce(C.min_max_scaled(columns[c], low, high, self.dense.constant).cast("double"), F.lit(float("nan")))
            cells.append(F.struct(F.lit(at).cast("bigint").alias("index"), value.alias("value")))
            at += 1
        for c, codes in self.dense.codes.items():
            places = F.create_map(*[x for i, code in enumerate(codes) for x in (F.lit(code), F.lit(at + i).cast("bigint"))])
            cells.append(F.struct(places[columns[c].cast("string")].alias("index"), F.lit(1.0).alias("value")))
            at += len(codes)
        if not cells:
            return F.array().cast(f"array<{CELL}>")
        return F.filter(F.array(*cells), lambda x: x["index"].isNotNull() & (x["value"] != 0))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Kept columns, the weight under its label, and ``indices, values`` of the non-zero cells in ascending order of the index.

        A null or unknown text has no cell. Each text column meets its own part of the vocabulary in one join that keeps all rows; a part that is small is
        broadcast by Spark's threshold, only a long one moves the rows, in which a frequent value may be split over tasks, as every value is in the
        vocabulary once. The rows travel as they came, and their cells are made at the end.
        """
        weight = [] if self.dense.weight is None else [C.quoted(self.dense.weight).alias(self.dense.label(self.dense.weight))]
        kept = [*weight, *[C.quoted(k) for k in keep]]
        names = [*([self.dense.label(self.dense.weight)] if weight else []), *keep]
        inputs = [*self.dense.bounds, *self.dense.codes]
        carried = [*[c.alias(f"_k{i}") for i, c in enumerate(kept)], *[C.quoted(c).alias(f"_c{i}") for i, c in enumerate(inputs)]]
        rows = df.select(*carried, *[C.quoted(t).cast("string").alias(f"_t{i}") for i, t in enumerate(self.texts)])
        for i in range(len(self.texts)):
            known = self.vocabulary.where(F.col("place") == i).select(F.col("value").alias(f"_v{i}"), F.col("position").alias(f"_p{i}"))
            rows = rows.join(known, F.col(f"_t{i}") == F.col(f"_v{i}"), "left").drop(f"_t{i}", f"_v{i}")
        found = [F.struct(F.col(f"_p{i}").alias("index"), F.lit(1.0).alias("value")) for i in range(len(self.texts))]
        ones = F.filter(F.array(*found), lambda x: x["index"].isNotNull()) if found else F.array().cast(f"array<{CELL}>")
        whole = F.array_sort(F.concat(self._known_cells({c: F.col(f"_c{i}") for i, c in enumerate(inputs)}), ones)).alias("cells")
        out = rows.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)], whole)
        return out.select(*[C.quoted(n) for n in names], F.col("cells.index").alias("indices"), F.col("cells.value").alias("values"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.dense.save(spark, f"{path}/dense")
        self.vocabulary.write.partitionBy("place").mode("overwrite").parquet(f"{path}/vocabulary")
        text = json.dumps({"texts": self.texts, "width": self.width})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseDesign:
        layout = json.loads(spark.read.text(f"{path}/layout", wholetext=True).first()["value"])
        return SparseDesign(DesignModel.load(spark, f"{path}/dense"), layout["texts"], spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary"), layout["width"])


def fit_sparse(spec: DesignSpec, df: DataFrame) -> SparseDesign:
    """Fit ``spec`` without a limit on found values: bounds take one row to the driver, the vocabulary stays a table."""
    dense, texts = spec.fit_known(df)
    first = len(dense.bounds) + sum(len(codes) for codes in dense.codes.values())
    spark = df.sparkSession
    if texts:
        cells = F.filter(F.array(*[F.struct(F.lit(i).alias("place"), C.quoted(t).cast("string").alias("value")) for i, t in enumerate(texts)]), lambda x: x["value"].isNotNull())
        vocabulary = with_positions(df.select(F.inline(cells)).distinct(), ["place", "value"], "vocabulary", first, "place")
        vocabulary = vocabulary.select("position", "place", F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("place") + 1).alias("feature"), "value")
    else:
        vocabulary = spark.createDataFrame([], VOCABULARY)
    return SparseDesign(dense, texts, vocabulary, first + vocabulary.count())
