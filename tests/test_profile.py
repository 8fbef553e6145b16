import math

import numpy as np
import pytest

from surveyloom.operators import profile


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        x = float(rng.normal()) if i % 7 else None
        rows.append((x, float(rng.integers(0, 5)), 4.0 if i % 3 else None, "v" if i % 2 else None))
    return spark.createDataFrame(rows, "x double, hot double, flat double, s string").cache()


def _nearest(values, q):
    ordered = sorted(v for v in values if v is not None)
    return ordered[int(math.floor((len(ordered) - 1) * q + 0.5))]


def _check(table):
    rows = table.collect()
    for r in profile.describe(table).collect():
        values = [row[r["feature"]] for row in rows]
        present = [v for v in values if v is not None]
        assert r["count"] == len(present) and r["null_count"] == len(values) - len(present)
        assert [r["q25"], r["q50"], r["q75"]] == [_nearest(values, q) for q in (0.25, 0.5, 0.75)]
        assert r["mean"] == pytest.approx(np.mean(present)) and r["std"] == pytest.approx(np.std(present, ddof=1))
        assert (r["min"], r["max"]) == (min(present), max(present))


def test_describe(table):
    _check(table)


def test_describe_through_brackets(table, monkeypatch):
    """Narrowing gives the same positions, also where half of a column is one value."""
    monkeypatch.setattr(profile, "BRACKET_ROWS", 10)
    monkeypatch.setattr(profile, "ACCURACY", 100)
    _check(table)


def test_describe_when_the_guess_fails(table, monkeypatch):
    """Guesses that do not hold the position are not used."""
    monkeypatch.setattr(profile, "BRACKET_ROWS", 10)
    monkeypatch.setattr(profile, "_around", lambda q: [0.9, 0.95])
    _check(table)


def test_describe_takes_two_scans(spark):
    """Moments and sketches, then the proof; a job is not a scan, so scans are counted by the rows they read."""
    rng = np.random.default_rng(5)
    values = [(float(x), float(y)) for x, y in zip(rng.normal(size=30_000), rng.integers(0, 3, 30_000))]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(values, "x double, hot double").mapInArrow(count, "x double, hot double")
    got = {r["feature"]: r for r in profile.describe(table).collect()}
    assert read.value == 2 * len(values)
    for i, c in enumerate(("x", "hot")):
        assert [got[c][q] for q in ("q25", "q50", "q75")] == [_nearest([v[i] for v in values], q) for q in (0.25, 0.5, 0.75)]


def test_describe_with_not_a_number(spark):
    """Not a number counts as the largest value; the sketch leaves it out, so the proof fails and the fallback answers."""
    nan = float("nan")
    df = spark.createDataFrame([(float(i) if i < 40 else nan, nan) for i in range(100)], "a double, b double")
    got = {r["feature"]: r for r in profile.describe(df).collect()}
    assert got["a"]["q25"] == 25.0 and math.isnan(got["a"]["q50"]) and math.isnan(got["a"]["q75"])
    assert all(math.isnan(got["b"][q]) for q in ("q25", "q50", "q75"))


def test_describe_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    got = {r["feature"]: r for r in profile.describe(df).collect()}
    assert got["a"]["count"] == 0 and got["a"]["q50"] is None and got["a"]["mean"] is None
    assert got["b"]["q50"] == 2.0  # position round(0.5) = 1


def test_correlation_uses_pairwise_complete_rows(table):
    got = {(r["x"], r["y"]): r["r"] for r in profile.correlation_matrix(table).collect()}
    assert len(got) == 9
    pairs = [(r["x"], r["hot"]) for r in table.collect() if r["x"] is not None]
    assert got[("x", "hot")] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-12)
    assert got[("hot", "x")] == got[("x", "hot")]
    assert got[("flat", "flat")] is None and got[("x", "flat")] is None
    assert got[("x", "x")] == pytest.approx(1.0)


def test_unique_counts_take_null_as_a_value(table):
    assert [tuple(r) for r in profile.unique_counts(table, labels={"s": "Label"}).collect()] == [("Label", 2)]


def test_frequencies_are_sorted_shares(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    got = [tuple(r) for r in profile.value_frequencies(df).collect()]
    assert got == [("s", "b", 2, 0.5), ("s", None, 1, 0.25), ("s", "a", 1, 0.25)]


def test_shape(table):
    assert tuple(profile.shape(table).first()) == (2000, 4)


def test_correlation_shuffles_sums_per_pair_and_no_rows(table):
    plan = profile.correlation_matrix(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(pair" in plan
