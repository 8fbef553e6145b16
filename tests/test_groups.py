import pytest

from surveyloom import census
from surveyloom.operators import groups


def test_weights_are_truncated_before_the_sum(spark, rows):
    df = spark.createDataFrame([("a", 1.9), ("a", 1.9), ("b", 2.0)], "g string, w double")
    assert rows(groups.group_population(df, "g", "w")) == [("a", 2), ("b", 2)]


def test_supported_groups_leaves_out_null_and_unknown(spark):
    df = spark.createDataFrame([("56",), ("01",), ("03",), (None,), ("01",)], "ST string")
    dim = census.state_dim(spark)
    assert [r["ST"] for r in groups.supported_groups(df, "ST", dim).collect()] == ["01", "56"]
    wanted = census.state_codes(["WY"])
    assert [r["ST"] for r in groups.supported_groups(df, "ST", dim, wanted=wanted).collect()] == ["56"]
    with pytest.raises(ValueError):
        groups.require_rows(groups.supported_groups(df, "ST", dim, wanted=["99"]), "none")


def test_wanted_groups_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("56", 1), ("01", 2)], "ST string, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = groups.keep_supported(df, "ST", census.state_dim(spark), wanted=["56"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ST), EqualTo(ST,56)]" in plan or "PushedFilters: [In(ST" in plan
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_group_without_a_value_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    values = spark.createDataFrame([("a", 3)], "g string, total bigint")
    with pytest.raises(Exception, match="no total for g b"):
        groups.with_group_value(df, values, "g", "total").collect()


def test_sample_size(spark, rows):
    totals = spark.createDataFrame([("a", 99), ("b", 9)], "g string, total bigint")
    assert rows(groups.sample_size(totals, "total")) == [("a", 99, 9), ("b", 9, 0)]
    assert rows(groups.sample_size(totals, "total", fixed=5000)) == [("a", 99, 5000), ("b", 9, 5000)]


def test_states():
    assert len(census.STATES) == 50 and len(set(census.STATES.values())) == 50
    assert census.state_codes(["ALL"]) is None
    with pytest.raises(ValueError):
        census.state_codes(["DC"])


def test_person_spec():
    assert len(census.PERSON.columns) == 65
    assert len(census.PERSON.sequence) == 53 and len(set(census.PERSON.sequence)) == 53
    left_out = set(c.name for c in census.PERSON.columns if c.role not in ("key", "weight")) - set(census.PERSON.sequence)
    assert left_out == {"ST", "RACWHT", "RACBLK", "RACASN", "ANC1P", "YOEP", "POBP"}
    kinds = [census.PERSON.kind_of(n) for n in census.PERSON.sequence]
    assert kinds.count("string") == 38 and len(kinds) - kinds.count("string") == 15
    assert len(census.COLUMN_LABELS) == 55
