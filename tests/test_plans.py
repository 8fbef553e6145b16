"""Whole jobs on a small person file in the public layout."""

import numpy as np
import pytest

from surveyloom import census
from surveyloom.plans import modelling, synthesis
from surveyloom.sources.runs import RunLayout, run_metadata
from surveyloom.spec import JobConfig

CODES = {"DIS": {"1": "With a disability", "2": "Without a disability"}, "SEX": {"1": "Male", "2": "Female"}}


def _person_csv(path, fips, n, columns, seed):
    rng = np.random.default_rng(seed)
    lines = [",".join(columns)]
    for i in range(n):
        values = {"STATE": fips, "SERIALNO": f"{fips}{i}", "SPORDER": "1", "PUMA": "00100", "ADJINC": "1010207"}
        values |= {"PWGTP": str(rng.integers(1, 40)), "AGEP": str(rng.integers(0, 95)), "SEX": str(rng.integers(1, 3))}
        values |= {"DIS": "1" if rng.random() < 0.3 else "2", "PINCP": "" if i % 9 == 0 else str(rng.integers(0, 90000))}
        for c in columns:
            kind = census.PERSON.kind_of(c)
            values.setdefault(c, "" if i % 5 == 0 else f"{rng.integers(1, 4):02d}" if kind == "string" else str(rng.integers(0, 50)))
        lines.append(",".join(values[c] for c in columns))
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def pattern(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    columns = ["STATE" if c == "ST" else c for c in census.PERSON.names]
    _person_csv(folder / "psam_p56.csv", "56", 300, columns, 1)
    _person_csv(folder / "psam_p01.csv", "01", 200, [*columns[::-1], "NEWCOL"], 2)  # other order, one more column
    return str(folder / "psam_p{fips}.csv")


@pytest.fixture(scope="module")
def run(spark, pattern, tmp_path_factory):
    layout = RunLayout(str(tmp_path_factory.mktemp("root")), "r1")
    config = JobConfig(2023, "5-Year", ("WY", "AL"), seed=42, rows_per_group=None)
    return layout, config, synthesis.run_person_files(spark, config, layout, pattern)


def test_tables(spark, run):
    _, _, out = run
    assert out.raw.columns[-1] == "ST" and "STATE" not in out.raw.columns and "NEWCOL" in out.raw.columns
    assert out.features.columns == census.PERSON.names and out.features.count() == 500
    assert sorted(r["ST"] for r in out.population.collect()) == ["01", "56"]
    assert set(out.training.columns) == {*census.SEQUENCE, "ST"}
    assert out.synthetic.columns == [*census.SEQUENCE, "ST", "state_population"]
    assert len(out.synthetic.columns) == 55


def test_synthetic_rows_are_a_tenth_of_the_population(run):
    _, _, out = run
    totals = {r["ST"]: r["state_population"] for r in out.population.collect()}
    made = {r["ST"]: r["count"] for r in out.synthetic.groupBy("ST").count().collect()}
    assert made == {st: total // 10 for st, total in totals.items()}


def test_no_nulls_in_the_feature_and_synthetic_tables(run):
    from pyspark.sql import functions as F

    _, _, out = run
    for table in (out.features, out.synthetic):
        nulls = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in table.columns]).first().asDict()
        assert {c: n for c, n in nulls.items() if n} == {}


def test_lineage(spark, run):
    layout, _, _ = run
    rows = {r["step"]: r for r in run_metadata(spark, layout).collect()}
    assert set(rows) == {"extract_cache", "extract", "features", "training", "synthetic"}
    assert rows["extract"]["params"]["source"] == "built" and rows["features"]["rows"] == 500
    assert rows["features"]["cols"] == 65 and rows["synthetic"]["cols"] == 55


def test_second_run_takes_the_cached_extract(spark, run, pattern):
    layout, config, _ = run
    again = RunLayout(layout.root, "r2")
    synthesis.run_person_files(spark, config, again, "/nowhere/{fips}.csv")
    rows = [r for r in run_metadata(spark, again).collect() if r["run_id"] == "r2" and r["step"] == "extract"]
    assert [r["params"]["source"] for r in rows] == ["cache"]


def test_same_seed_same_table(spark, run, pattern, tmp_path):
    _, config, out = run
    again = synthesis.run_person_files(spark, config, RunLayout(str(tmp_path), "x"), pattern)
    assert out.synthetic.exceptAll(again.synthetic).isEmpty()


def test_no_supported_group_is_an_error(spark, run):
    layout, config, out = run
    other = JobConfig(2023, "5-Year", ("TX",), 42, 10)
    with pytest.raises(ValueError, match="TX"):
        synthesis.synthesise(out.features, out.population, census.PERSON, other, RunLayout(layout.root, "r3"), census.state_dim(spark), ["48"])


def test_train_and_test(spark, run, tmp_path):
    layout, _, out = run
    codes = {**CODES, "ST": {v: k for k, v in census.STATES.items()}}
    spec = modelling.person_design(codes)
    train, model = modelling.write_design(out.synthetic, spec, str(tmp_path / "train"))
    test, _ = modelling.write_design(out.synthetic, spec, str(tmp_path / "test"), model)
    assert train.columns == test.columns and train.columns[0] == census.WEIGHT
    assert {census.TARGET, census.COMPLEMENT} <= set(train.columns)
    found = modelling.train(spark, layout, train, "logistic_regression", {"maxIter": 20})
    assert found.count() == 20
    scores, labelled = modelling.test(spark, layout, test, "logistic_regression", str(tmp_path / "labelled"))
    assert labelled.columns == [census.TARGET, "predicted_disability_standard", "predicted_disability_survey_weighted"]
    assert labelled.count() == out.synthetic.count()
    report = modelling.run_report(spark, layout, "logistic_regression")
    names = {r["metric"] for r in report.collect()}
    assert len(names) == 20 and {"train_unweighted_roc_auc", "test_weighted_f1"} <= names
