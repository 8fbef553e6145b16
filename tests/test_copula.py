import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import copula

COLUMNS = ["age", "sex", "income"]


@pytest.fixture(scope="module")
def training(spark):
    """Two groups with opposite dependence between age and income."""
    rng = np.random.default_rng(5)
    rows = []
    for group, sign, n in (("06", 1, 4000), ("11", -1, 1000)):
        age = np.clip(np.round(rng.normal(40, 10, n)), 0, 90)
        income = np.round(1000 + sign * 30 * (age - 40) + rng.normal(0, 200, n), 2)
        sex = rng.choice(["1", "2", "NA"], n, p=[0.6, 0.3, 0.1])
        rows += [(group, int(a), str(s), float(i)) for a, s, i in zip(age, sex, income)]
    return spark.createDataFrame(rows, "ST string, age bigint, sex string, income double").cache()


@pytest.fixture(scope="module")
def model(training):
    return copula.fit_copula(training, "ST", COLUMNS)


def _sizes(spark, **n):
    return spark.createDataFrame([(k[1:], v, v * 10) for k, v in n.items()], "ST string, n bigint, total bigint")


def test_intervals_cover_the_unit_interval(model):
    for group in ("06", "11"):
        ends = sorted((r["lo"], r["hi"]) for r in model.intervals.where(F.col("ST") == group).collect())
        assert ends[0][0] == 0.0 and ends[-1][1] == 1.0
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_interval_width_is_the_share(model, training):
    counts = {(r["ST"], r["sex"]): r["count"] for r in training.groupBy("ST", "sex").count().collect()}
    totals = {"06": 4000, "11": 1000}
    for r in model.intervals.collect():
        assert r["hi"] - r["lo"] == pytest.approx(counts[(r["ST"], r["value"])] / totals[r["ST"]], abs=1e-12)


def test_correlations_match_a_simulated_draw(model, training):
    """The closed form for the uniform draw inside an interval against drawing it."""
    rng = np.random.default_rng(0)
    pdf = training.where("ST = '06'").toPandas()
    ends = {r["value"]: (r["lo"], r["hi"]) for r in model.intervals.where("ST = '06'").collect()}
    lo, hi = np.array([ends[s] for s in pdf["sex"]]).T
    got = {(r["x"], r["y"]): r["r"] for r in model.correlations.where("ST = '06'").collect()}
    assert set(got) == {("age", "sex"), ("age", "income"), ("sex", "income")}
    drawn = np.mean([np.corrcoef(pdf["age"], lo + (hi - lo) * rng.random(len(pdf)))[0, 1] for _ in range(200)])
    assert got[("age", "sex")] == pytest.approx(drawn, abs=0.005)
    assert got[("age", "income")] == pytest.approx(np.corrcoef(pdf["age"], pdf["income"])[0, 1], abs=1e-10)


def test_rows_per_group_and_carried_column(spark, model):
    drawn = copula.sample_copula(model, _sizes(spark, _06=20_001, _11=3), 42, carry=["total"])
    assert drawn.columns == [*COLUMNS, "ST", "total"]
    got = {r["ST"]: (r["n"], r["t"]) for r in drawn.groupBy("ST").agg(F.count("*").alias("n"), F.max("total").alias("t")).collect()}
    assert got == {"06": (20_001, 200_010), "11": (3, 30)}


def test_group_without_rows_is_left_out(spark, model):
    drawn = copula.sample_copula(model, _sizes(spark, _06=0, _11=5), 42)
    assert [r["ST"] for r in drawn.collect()] == ["11"] * 5


def test_sample_does_not_depend_on_partitioning(spark, model, monkeypatch):
    def draw():
        return sorted(tuple(r) for r in copula.sample_copula(model, _sizes(spark, _06=30_000, _11=100), 7).collect())

    one = draw()
    monkeypatch.setattr(copula, "BLOCKS_PER_CHUNK", 1)
    assert draw() == one


def test_seed_changes_the_sample(spark, model):
    a = copula.sample_copula(model, _sizes(spark, _11=50), 1).collect()
    b = copula.sample_copula(model, _sizes(spark, _11=50), 2).collect()
    assert a != b


def test_moments_shares_and_dependence(spark, model, training):
    drawn = copula.sample_copula(model, _sizes(spark, _06=20_000, _11=20_000), 42).toPandas()
    for group, real in training.toPandas().groupby("ST"):
        made = drawn[drawn["ST"] == group]
        for c in ("age", "income"):
            assert abs(made[c].mean() - real[c].mean()) <= 5 * real[c].std() / np.sqrt(len(made)) + 0.02 * real[c].std()
            assert made[c].between(real[c].min(), real[c].max()).all()
        assert made["age"].dtype == np.int64
        assert np.allclose(made["income"], made["income"].round(2))
        r = np.corrcoef(made["age"], made["income"])[0, 1]
        assert r == pytest.approx(np.corrcoef(real["age"], real["income"])[0, 1], abs=0.05)
        assert set(made["sex"]) == {"1", "2", "NA"}


def test_factor_reproduces_the_correlations(model):
    for row in copula.correlation_factors(model).collect():
        lower = np.array(row["factor"]).reshape(3, 3)
        corr = lower @ lower.T
        want = {(r["x"], r["y"]): r["r"] for r in model.correlations.where(F.col("ST") == row["ST"]).collect()}
        assert corr[0, 2] == pytest.approx(want[("age", "income")], abs=1e-9)
        assert np.allclose(np.diag(corr), 1)


def test_constant_column_and_single_category(spark):
    df = spark.createDataFrame([("a", 5, "x", 1.0), ("a", 5, "x", 2.0), ("a", 5, "x", 3.5)], "g string, k bigint, c string, v double")
    model = copula.fit_copula(df, "g", ["k", "c", "v"])
    drawn = copula.sample_copula(model, spark.createDataFrame([("a", 40)], "g string, n bigint"), 1).toPandas()
    assert set(drawn["k"]) == {5} and set(drawn["c"]) == {"x"} and drawn["v"].between(1.0, 3.5).all()


def test_a_column_of_many_values_is_a_category_too(spark):
    df = spark.range(30_000).selectExpr("'a' AS g", "concat('v', id) AS c", "CAST(id AS DOUBLE) AS v")
    model = copula.fit_copula(df, "g", ["c", "v"])
    drawn = copula.sample_copula(model, spark.createDataFrame([("a", 2000)], "g string, n bigint"), 1)
    assert drawn.select("c").distinct().count() > 1500
    assert drawn.join(df, "c", "left_anti").count() == 0


def test_long_lists_are_looked_up_with_the_same_draw(spark, training, model, monkeypatch):
    """Every list looked up by buckets, or only that of the longer ones: the rows are those of lists in the parameters."""
    mixed = training.withColumn("sex", F.when((F.col("ST") == "06") & (F.col("age") % 2 == 0), F.concat(F.lit("v"), F.col("age"))).otherwise(F.col("sex")))
    mixed = mixed.withColumn("kind", F.when(F.col("age") > 45, F.lit(None)).otherwise(F.concat("sex", F.col("age") % 3)))
    wide = copula.fit_copula(mixed, "ST", ["age", "sex", "kind", "income"])
    sizes = _sizes(spark, _06=9000, _11=500)
    draw = lambda: sorted(map(tuple, copula.sample_copula(wide, sizes, 5, carry=["total"]).collect()), key=repr)
    one = draw()
    for limit in (0, 3, 12):
        monkeypatch.setattr(copula, "VALUES_IN_ROW", limit)
        assert draw() == one


def test_a_column_of_200_000_values_is_sampled_with_bounded_rows(spark):
    df = spark.range(200_000).selectExpr("'a' AS g", "concat('v', id) AS c", "CAST(id % 100 AS DOUBLE) AS v")
    model = copula.fit_copula(df, "g", ["c", "v"])
    longest = copula.sampler_parameters(model, copula.value_counts(model)).select(F.size("categories")).collect()
    assert [r[0] for r in longest] == [None]  # no list in any row
    drawn = copula.sample_copula(model, spark.createDataFrame([("a", 20_000)], "g string, n bigint"), 1)
    assert drawn.columns == ["c", "v", "g"] and drawn.where("c IS NULL").count() == 0
    assert drawn.count() == 20_000 and drawn.select("c").distinct().count() > 15_000
    assert drawn.join(df, "c", "left_anti").count() == 0


def test_model_round_trip(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = copula.CopulaModel.load(spark, str(tmp_path / "m"))
    assert (again.columns, again.numeric, again.long) == (model.columns, model.numeric, model.long)
    sizes = _sizes(spark, _11=20)
    assert copula.sample_copula(again, sizes, 3).collect() == copula.sample_copula(model, sizes, 3).collect()


def test_large_groups_are_cut_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(copula, "BLOCK_ROWS", 1)
    sizes = spark.createDataFrame([("a", 2_000_001), ("b", 1), ("c", 0)], "g string, n bigint")
    got = copula.sample_chunks(sizes, "g").groupBy("g").agg(F.count("*"), F.sum("blocks"), F.max("first"))
    assert {tuple(r) for r in got.collect()} == {("a", 31_251, 2_000_001, 2_000_000), ("b", 1, 1, 0)}


def test_hot_group_is_made_by_many_tasks_without_a_broadcast(spark, model, monkeypatch):
    monkeypatch.setattr(copula, "BLOCK_ROWS", 16)
    monkeypatch.setattr(copula, "BLOCKS_PER_CHUNK", 2)
    sizes = _sizes(spark, _11=3200)
    with_broadcast = sorted(map(tuple, copula.sample_copula(model, sizes, 3).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = copula.sample_copula(model, sizes, 3)
        assert drawn.select(F.spark_partition_id()).distinct().count() > 10
        assert sorted(map(tuple, drawn.collect())) == with_broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def brute_scores(pdf, columns, numeric):
    """Scores of a table from the definition, group by group."""
    out = {}
    for g, part in pdf.groupby("ST"):
        z = {}
        for c in columns:
            if c in numeric:
                sd = part[c].std(ddof=0)
                z[c] = ((part[c] - part[c].mean()) / sd).fillna(0.0) if sd > 0 else part[c] * 0.0
            else:
                counts = sorted(((-n, v) for v, n in part[c].fillna("\x00").value_counts().items()))
                at, mid = 0, {}
                for n, v in counts:
                    mid[v] = (at - n / 2) / len(part)
                    at -= n
                z[c] = part[c].map(lambda v: 0.0 if v is None else (mid[v] - 0.5) * np.sqrt(12))
        out[g] = sorted(zip(*[z[c].round(9) for c in columns]))
    return out


@pytest.mark.parametrize("tasks", [1, 8, 40])
def test_scores_against_the_definition(spark, training, model, tasks):
    """Also with a group cut over many chunks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        scores = copula.normal_scores(training, "ST", COLUMNS, model.intervals, model.marginals).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = {g: sorted(zip(*[p[f"z{i}"].round(9) + 0.0 for i in range(3)])) for g, p in scores.groupby("ST")}
    expected = brute_scores(training.toPandas(), COLUMNS, {"age", "income"})
    for g in expected:
        assert np.allclose(found[g], expected[g], atol=1e-8)


def test_rows_are_shuffled_once_however_many_text_columns(spark):
    """53 text columns, broadcast joins off: one exchange of rows, no join."""
    texts = [f"t{i}" for i in range(53)]
    df = spark.range(3000).select(
        F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("g"), *[(F.col("id") * (i + 3) % (i + 2)).cast("string").alias(t) for i, t in enumerate(texts)]
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        intervals = copula.written(copula.category_intervals(df, "g", texts), "intervals")
        marginals = spark.createDataFrame([], "g string, feature string, mean double, sd double")
        scores = copula.normal_scores(df, "g", texts, intervals, marginals)
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        assert scores.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_nulls_and_empty_columns_do_not_stop_the_fit(spark):
    rows = [("a", 1.0, "x", None), ("a", None, None, None), ("a", 3.0, "x", None), ("b", 2.0, "y", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double, c string, e double")
    model = copula.fit_copula(df, "g", ["v", "c", "e"])
    drawn = copula.sample_copula(model, spark.createDataFrame([("a", 50), ("b", 5)], "g string, n bigint"), 1).toPandas()
    a = drawn[drawn["g"] == "a"]
    assert a["v"].between(1.0, 3.0).all() and a["e"].isna().all() and set(a["c"]) <= {"x", None}
    assert set(drawn[drawn["g"] == "b"]["e"]) == {7.0}


def test_group_seed_keys_the_streams(spark):
    from surveyloom.functions.columns import group_seed

    seed = spark.createDataFrame([("11",)], "g string").select(group_seed(42, F.col("g"))).first()[0]
    own = np.random.Generator(np.random.Philox(key=seed, counter=np.array([0, 0, 0, 5], dtype=np.uint64)))
    assert (copula._stream(42, "11", 5).random(4) == own.random(4)).all()


def test_roles_of_columns_are_the_callers(spark, tmp_path):
    """Integer codes as categories: only codes that occur are drawn, in their own type; by type they would be numbers."""
    df = spark.createDataFrame([("a", (1, 5, 900)[i % 3], float(i)) for i in range(300)], "g string, code bigint, v double")
    model = copula.fit_copula(df, "g", ["code", "v"], categorical=["code"])
    assert model.categorical == ["code"] and model.numeric == ["v"]
    model.save(str(tmp_path / "m"))
    for m in (model, copula.CopulaModel.load(spark, str(tmp_path / "m"))):
        drawn = copula.sample_copula(m, spark.createDataFrame([("a", 200)], "g string, n bigint"), 4)
        assert drawn.schema["code"].dataType.simpleString() == "bigint" and {r["code"] for r in drawn.collect()} == {1, 5, 900}
    assert copula.fit_copula(df, "g", ["code", "v"]).numeric == ["code", "v"]
    with pytest.raises(ValueError, match="numeric"):
        copula.fit_copula(df.withColumn("v", F.col("v").cast("string")), "g", ["code", "v"], categorical=["code"])


def test_profile_looks_texts_up_by_a_join(spark, sf_dir, monkeypatch):
    """One row in four gets a text of another group, a null or a number beyond the range; no list of values is searched row by row."""
    from checks import queries

    training, drawn = queries._drawn(spark, sf_dir)
    drawn = drawn.where("ST IN ('01', '06')").withColumn("OCCP", F.when(F.col("ST") == "06", F.lit("none")).otherwise(F.col("OCCP"))).limit(4000)
    drawn = drawn.withColumn("WAGP", F.when(F.col("AGEP") % 2 == 0, F.lit(1e12)).otherwise(F.col("WAGP"))).withColumn(
        "SEX", F.when(F.col("AGEP") % 3 == 0, F.lit(None)).otherwise(F.col("SEX"))
    )
    drawn = queries.written(drawn, "test-drawn")
    monkeypatch.setattr(queries, "_drawn", lambda *_: (training, drawn))
    found = queries.copula_sample_profile(spark, sf_dir)
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
    good = (F.col("ST") != "06") & (F.col("AGEP") % 2 != 0) & (F.col("AGEP") % 3 != 0)
    expected = {r["ST"]: (r["n"], r["good"]) for r in drawn.groupBy("ST").agg(F.count("*").alias("n"), F.count_if(good).alias("good")).collect()}
    assert {r["ST"]: (r["n_rows"], r["n_inside"]) for r in found.collect()} == expected
