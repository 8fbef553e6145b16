"""Sparse rows against the dense matrix, and vocabularies that do not fit a driver's columns."""

import pytest
from pyspark.sql import functions as F

from surveyloom import census
from surveyloom.operators.design import DesignSpec
from surveyloom.operators.sparse_design import SparseDesign, fit_sparse, with_positions

LABELS = {"SEX": {"1": "Male", "2": "Female"}}
SCHEMA = "SEX string, AGEP bigint, PINCP double, INDP string, state_population bigint, OCCP string, `a.b (c)` string"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(str(1 + i % 3), i % 17, float(i % 5), f"i{i % 7}", 100 + i, "x", ["é", "", "z z"][i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def spec():
    return DesignSpec(LABELS, census.COLUMN_LABELS, ["OCCP"], "state_population")


def dense_rows(row, width):
    out = [0.0] * width
    for i, x in zip(row["indices"], row["values"]):
        out[i] = x
    return out


def test_equals_the_dense_matrix(spark, table, spec):
    sparse, dense = fit_sparse(spec, table), spec.fit(table)
    names = [r["name"] for r in sparse.names(spark).orderBy("position").collect()]
    assert names == dense.names[1:] and sparse.width == len(names)
    mine = {r["State population"]: dense_rows(r, sparse.width) for r in sparse.transform(table).collect()}
    theirs = {r[0]: [float(x) for x in r[1:]] for r in dense.transform(table).collect()}
    assert mine == theirs


def test_other_tables_keep_positions(spark, table, spec):
    sparse = fit_sparse(spec, table)
    other = spark.createDataFrame([("2", 99, 2.0, "new", 1, "y", None), ("9", None, 0.0, "i3", 2, "y", "é")], SCHEMA)
    found = {r["state_population"]: dict(zip(r["indices"], r["values"])) for r in sparse.transform(other, keep=["state_population"]).collect()}
    names = {r["name"]: r["position"] for r in sparse.names(spark).collect()}
    assert found[1] == {names["Age"]: pytest.approx(99 / 16), names["Total personal income"]: 0.5, names["Sex_Female"]: 1.0}
    assert set(found[2]) == {names["Age"], names["Industry_i3"], names["a.b (c)_é"]} and found[2][names["Age"]] != found[2][names["Age"]]  # NaN


def test_round_trip(spark, table, spec, tmp_path):
    sparse = fit_sparse(spec, table)
    sparse.save(spark, str(tmp_path / "m"))
    again = SparseDesign.load(spark, str(tmp_path / "m"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(again.transform(table)) == order(sparse.transform(table)) and again.width == sparse.width


def test_many_values_without_a_collect(spark):
    """200,000 values, one of them in a third of all rows; the driver gets bounds and counts only."""
    df = spark.range(300_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', lpad(id % 300000, 6, '0')) END AS t", "id % 10 AS k")
    sparse = fit_sparse(DesignSpec({}), df)
    assert sparse.width == 1 + 1 + 200_000
    found = sparse.transform(df)
    sums = found.select(F.inline(F.arrays_zip("indices", "values"))).where("indices > 0").agg(F.count("*"), F.countDistinct("indices"), F.max("indices")).first()
    assert tuple(sums) == (300_000, 200_001, 200_001)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan and "MapInArrow" not in plan


def test_odd_tables(spark):
    numbers = spark.createDataFrame([(1.0, 5), (3.0, 5)], "a double, b int")
    only = fit_sparse(DesignSpec({}, constant="zero"), numbers)
    assert sorted((r["indices"], r["values"]) for r in only.transform(numbers).collect()) == [([], []), ([0], [1.0])]
    texts = spark.createDataFrame([("x",), (None,), ("x",)], "t string")
    words = fit_sparse(DesignSpec({}), texts)
    assert sorted(r["indices"] for r in words.transform(texts).collect()) == [[], [0], [0]] and words.width == 1
    assert fit_sparse(DesignSpec({}), texts.limit(0)).width == 0
    assert words.transform(texts.limit(0)).count() == 0


def test_positions_follow_the_order(spark):
    df = spark.createDataFrame([(g, v) for g in (2, 0, 1) for v in "cab"], "g int, v string").repartition(6)
    placed = with_positions(df, ["g", "v"], "test", 10).orderBy("position").collect()
    assert [tuple(r) for r in placed] == [(10 + i, *x) for i, x in enumerate((g, v) for g in (0, 1, 2) for v in "abc")]


def test_rows_move_for_long_vocabularies_only(spark, table, spec):
    """Two text columns of a few values: their parts of the vocabulary are broadcast, and no row is shuffled."""
    found = fit_sparse(spec, table).transform(table)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_an_empty_vocabulary_is_saved(spark, tmp_path):
    words = fit_sparse(DesignSpec({}), spark.createDataFrame([(None, 1.0), (None, 3.0)], "t string, a double"))
    words.save(spark, str(tmp_path / "m"))
    again = SparseDesign.load(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([("x", 3.0)], "t string, a double")
    assert [tuple(r) for r in again.transform(rows).collect()] == [([0], [1.0])] and again.width == 1
