"""Reader of a published data dictionary: a CSV file without a header that mixes two kinds of records.

``NAME, column, C or N, width, description`` describes a column, ``VAL, column, C or N, width, low, high, label`` one code of it, or, where
``low`` and ``high`` differ, a range of codes. A code of the letter ``b`` only stands for a blank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.columns import MISSING, long_form
from surveyloom.operators.labels import ValueLabels
from surveyloom.session import written

RECORD = "record string, col string, kind string, width string, low string, high string, label string"


@dataclass(frozen=True)
class Dictionary:
    """``columns``: ``col, kind, width, label``. ``values``: ``col, kind, low, high, label``, where equal ends are one code."""

    columns: DataFrame
    values: DataFrame

    def codes(self, names: Sequence[str], blank: str | None = None) -> ValueLabels:
        """Labels of the single codes of some columns, as the design takes them. Ranges are left out.

        ``blank``: the code that blanks have in the table, such as "NA"; without it they have no label. The dictionary's codes of
        the columns named reach the driver, each of which becomes an output column.
        """
        single = self.values.where((F.col("low") == F.col("high")) & F.col("col").isin(list(names)))
        out: dict[str, dict[str, str]] = {n: {} for n in names}
        for r in single.select("col", "low", "label").orderBy("col", "low").collect():
            code = blank if _is_blank(r["low"]) else r["low"]
            if code is not None:
                out[r["col"]][code] = r["label"]
        return {n: codes for n, codes in out.items() if codes}


def _is_blank(code: str) -> bool:
    return bool(code) and not code.strip("b")


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """Parse the file. A record of another kind, or a code without a column or label, is an error that names the records."""
    rows = spark.read.schema(RECORD).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.select(*[F.trim(c).alias(c) for c in rows.columns])
    wrong = rows.where(
        ~F.coalesce(F.col("record").isin("NAME", "VAL") & F.col("col").isNotNull() & F.col("kind").isin("C", "N"), F.lit(False))
        | ((F.col("record") == "VAL") & (F.col("low").isNull() | F.col("high").isNull() | F.col("label").isNull()))
    ).limit(5).collect()
    if wrong:
        raise ValueError(f"not records of a data dictionary: {[tuple(r) for r in wrong]}")
    columns = rows.where("record = 'NAME'").select("col", "kind", F.col("width").cast("int").alias("width"), F.col("low").alias("label"))
    values = rows.where("record = 'VAL'").select("col", "kind", "low", "high", "label")
    return Dictionary(columns, values.distinct())


def _number(c: Column) -> Column:
    return c.try_cast("decimal(38,9)")


def label_values(df: DataFrame, names: Sequence[str], dictionary: Dictionary) -> DataFrame:
    """``feature, value, label`` per row and column, the label by code or by range; null where the dictionary has none.

    A null, or the text of a filled gap, takes the label of the blank. A code goes before a range; of several ranges the narrowest
    counts, then the lower one. Ranges of ``N`` columns compare numbers, those of ``C`` columns text of the same length. Labels are found once per
    distinct value, and rows meet their values by equality, so that a frequent value can be split over tasks.
    """
    cells = df.select(F.explode(long_form(names)).alias("cell")).select("cell.*")
    blank = F.col("value").isNull() | (F.col("value") == MISSING)
    distinct = written(cells.distinct(), "dictionary-values")
    rules = dictionary.values.where(F.col("col").isin(list(names)))
    empty = F.length(F.regexp_replace("low", "b", "")) == 0
    code = (F.col("low") == F.col("high")) & (F.col("value") == F.col("low"))
    numbers = (F.col("kind") == "N") & _number(F.col("value")).between(_number(F.col("low")), _number(F.col("high")))
    same_length = (F.length("value") == F.length("low")) & (F.length("value") == F.length("high"))
    texts = (F.col("kind") == "C") & same_length & F.col("value").between(F.col("low"), F.col("high"))
    fits = F.when(blank, empty).otherwise(~empty & F.coalesce(code | numbers | texts, F.lit(False)))
    found = distinct.join(rules, (F.col("feature") == F.col("col")) & fits)
    span = F.coalesce(_number(F.col("high")) - _number(F.col("low")), F.lit(0).cast("decimal(38,9)"))
    best = F.min(F.struct((~code).alias("range"), span.alias("span"), "low", "label"))["label"]
    labels = found.groupBy("feature", F.col("value").alias("of")).agg(best.alias("label")).withColumnRenamed("feature", "by")
    labels = written(labels, "dictionary-labels")
    return cells.join(labels, (F.col("feature") == F.col("by")) & F.col("value").eqNullSafe(F.col("of")), "left").select("feature", "value", "label")
