import pytest

from surveyloom.operators import features
from surveyloom.spec import ColumnSpec, TableSpec, job_config

SPEC = TableSpec(
    columns=(
        ColumnSpec("ADJ", "double", "key"),
        ColumnSpec("W", "double", "weight"),
        ColumnSpec("G", "string", "geography"),
        ColumnSpec("N", "long", "x"),
        ColumnSpec("C", "string", "x", recode={"1": "one", "2": "two"}),
        ColumnSpec("INC", "double", "x", adjusted=True),
    ),
    group="G",
    weight="W",
    factor="ADJ",
)
SCHEMA = "ADJ bigint, W double, G string, N string, C int, INC double, other string"


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(
        [
            (1010207, 1.5, "01", "2", 1, 100.0, "a"),
            (1000000, None, "01", "bbbb", 2, None, "b"),
            (None, 2.5, None, "3", 3, 50.0, "c"),
            (2000000, 4.9, "06", None, None, 10.0, "d"),
        ],
        SCHEMA,
    )


def test_missing_columns_are_all_listed(raw):
    with pytest.raises(ValueError, match=r"\['G', 'N'\]"):
        features.select_required(raw.drop("G", "N"), SPEC)


def test_select_keeps_spec_order_and_drops_others(raw):
    assert features.select_required(raw, SPEC).columns == SPEC.names


def test_recode_falls_back_to_own_text(raw):
    got = [r["C"] for r in features.recode(raw, SPEC).select("C").collect()]
    assert got == ["one", "two", "3", None]


def test_adjust_uses_implied_decimals_and_keeps_the_factor(raw):
    got = features.adjust(raw, SPEC).select("ADJ", "INC").collect()
    assert [r["INC"] for r in got] == [100.0 * (1010207 / 1e6), None, None, 20.0]
    assert [r["ADJ"] for r in got] == [1010207, 1000000, None, 2000000]


def test_lenient_cast(spark):
    spec = TableSpec((ColumnSpec("a", "long", "x"), ColumnSpec("b", "double", "x")), "a", "b")
    df = spark.createDataFrame([("12", "1.5"), ("x", "y"), ("12.5", ""), (None, None)], "a string, b string")
    assert [tuple(r) for r in features.cast_lenient(df, spec).collect()] == [(12, 1.5), (None, None), (None, None), (None, None)]
    whole = spark.createDataFrame([(12.7, 1.0), (float("nan"), 1.0), (1e30, 1.0)], "a double, b double")
    assert [r["a"] for r in features.cast_lenient(whole, spec).collect()] == [12, None, None]


def test_chain_order(raw):
    """A null factor makes the income null, and the null gets the mean of the adjusted incomes."""
    got = {r["G"] + r["C"]: r for r in features.build_features(raw, SPEC).collect()}
    assert set(got) == {"01one", "01two", "NA3", "06NA"}
    mean = (100.0 * (1010207 / 1e6) + 20.0) / 2
    assert got["01two"]["INC"] == got["NA3"]["INC"] == pytest.approx(mean)
    assert got["01two"]["N"] == 3 and got["06NA"]["N"] == 3  # mean 2.5 rounds half away from zero
    assert got["01two"]["W"] == pytest.approx((1.5 + 2.5 + 4.9) / 3)


def test_negative_half_rounds_away_from_zero(spark):
    spec = TableSpec((ColumnSpec("a", "long", "x"),), "a", "a")
    df = spark.createDataFrame([(-2,), (-3,), (None,)], "a bigint")
    assert sorted(r["a"] for r in features.impute(df, spec).collect()) == [-3, -3, -2]


def test_all_null_numeric_stays_null(spark):
    spec = TableSpec((ColumnSpec("a", "long", "x"), ColumnSpec("b", "string", "x")), "a", "a")
    df = spark.createDataFrame([(None, None), (None, "z")], "a bigint, b string")
    got = sorted(tuple(r) for r in features.impute(df, spec).collect())
    assert [b for _, b in got] == ["NA", "z"] and [a for a, _ in got] == [None, None]


def test_drop_of_an_absent_column_fails(raw):
    with pytest.raises(ValueError, match="nope"):
        features.drop_columns(raw, ["C", "nope"])


def test_exclude_rename_moves_to_the_end(raw):
    assert features.exclude_rename(raw, {"G": "ST"}).columns == ["ADJ", "W", "N", "C", "INC", "other", "ST"]


def test_relabel_handles_dots_and_parentheses(raw):
    out = features.relabel(raw, {"G": "State (FIPS, v.1)", "zz": "never"})
    assert "State (FIPS, v.1)" in out.columns and "W" in out.columns


def test_fill_from_groups(spark, rows):
    train = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 2, 4.0, "x"), ("b", 7, 9.0, "y")], "g string, n bigint, d double, s string")
    gaps = spark.createDataFrame([("a", None, None, None), ("b", 3, None, "q")], train.schema)
    assert rows(features.fill_from_groups(gaps, train, "g")) == [("a", 1.5, 3.0, "NA"), ("b", 3.0, 9.0, "q")]


def test_imputation_reads_the_table_without_a_join(raw):
    plan = features.build_features(raw, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_only_used_means_are_computed(spark, sf_dir):
    """The flagship query reads three columns, and its subquery only the weight."""
    from checks.queries import group_population

    plan = group_population(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan


def test_unknown_mode_and_kind_are_errors():
    with pytest.raises(ValueError):
        job_config("prod")
    with pytest.raises(ValueError):
        ColumnSpec("a", "decimal", "x")
    assert job_config("TEST").rows_per_group is None
