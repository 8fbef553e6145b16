"""Synthetic table → design matrix → classifiers with and without survey weights → metrics and labelled output."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import census
from surveyloom.operators import metrics, models
from surveyloom.operators.design import DesignModel, DesignSpec
from surveyloom.operators.labels import ValueLabels
from surveyloom.session import written
from surveyloom.sources import commits, runs, writers

RESULT_SCHEMA = "run_id string, kind string, variant string, split string, weighting string, metric string, value double, uri string, created_at timestamp"
PARAM_SCHEMA = "run_id string, kind string, variant string, split string, name string, value string"
PREFIX = "predicted_disability_"


def person_design(codes: ValueLabels, **changes) -> DesignSpec:
    """Design of the synthetic person table; ``codes`` are its value labels, see ``operators.labels``. Constant columns become 0."""
    settings = {"labels": census.COLUMN_LABELS, "drop": census.HIGH_CARDINALITY, "weight": census.POPULATION, "constant": "zero", **changes}
    return DesignSpec(codes=codes, **settings)


def write_design(df: DataFrame, spec: DesignSpec, path: str, model: DesignModel | None = None) -> tuple[DataFrame, DesignModel]:
    """Encode a table and write it. Pass the model fitted on the training table to encode a test table alike."""
    model = spec.fit(df) if model is None else model
    return writers.write_parquet(model.transform(df), path, writers.DESIGN_CODEC), model


def _problem(table: DataFrame, exclude: Sequence[str]) -> models.Problem:
    return models.Problem.split(table, census.TARGET, census.COMPLEMENT, census.WEIGHT, exclude)


def _input(table: DataFrame) -> str:
    """The folders that a table is read from."""
    return ",".join(sorted({path.rsplit("/", 1)[0] for path in table.inputFiles()}))


def _log(
    spark: SparkSession, layout: runs.RunLayout, kind: str, split: str, found: DataFrame, params: Mapping[str, Mapping], uris: Mapping[str, str]
) -> DataFrame:
    uri = F.create_map(*[F.lit(x) for pair in uris.items() for x in pair])[F.col("variant")]
    table = found.select(
        F.lit(layout.run_id).alias("run_id"), F.lit(kind).alias("kind"), "variant", "split", "weighting", "metric", "value",
        uri.alias("uri"), F.lit(datetime.now(timezone.utc)).alias("created_at"),
    )
    commits.append_table(table, f"{layout.root}/_run_metrics")
    rows = [(layout.run_id, kind, v, split, name, str(value)) for v, ps in params.items() for name, value in ps.items()]
    commits.append_rows(spark, f"{layout.root}/_run_params", rows, PARAM_SCHEMA)
    return found


def train(
    spark: SparkSession,
    layout: runs.RunLayout,
    table: DataFrame,
    kind: str,
    settings: Mapping | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Fit both variants, save them under their names, and log parameters and training metrics."""
    problem = _problem(table, exclude)
    fitted = models.fit_variants(problem, kind, settings)
    n_rows, uris = table.count(), {}
    for variant, model in fitted.items():
        uris[variant] = f"{layout.run}/models/{kind}-{variant}-{uuid.uuid4().hex[:8]}"
        models.save_model(model, spark, uris[variant])
        runs.register_model(spark, layout, variant, kind, uris[variant])
    scored = written(models.score_variants(problem, fitted), "train-scores")
    p_cols = {v: f"p_{v}" for v in fitted}
    found = metrics.evaluate(scored, "label", p_cols, "weight", split="train")
    logged = {
        v: {**models.SETTINGS[kind], **(settings or {}), "target": census.TARGET, "weight_col": census.WEIGHT,
            "n_rows": n_rows, "n_features": len(problem.features), "input": _input(table)}
        for v in fitted
    }
    for v, model in fitted.items():
        if hasattr(model, "epochs"):
            logged[v]["trained_epochs"] = model.epochs
    return _log(spark, layout, kind, "train", found, logged, uris)


def test(
    spark: SparkSession,
    layout: runs.RunLayout,
    table: DataFrame,
    kind: str,
    out: str,
    threshold: float = 0.5,
    keep: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Score with the newest model of each variant; log metrics and write target and predictions."""
    problem = _problem(table, exclude)
    uris = {v: runs.latest_model(spark, layout, v, kind) for v in models.VARIANTS}
    fitted = {v: models.load_model(kind, spark, uri) for v, uri in uris.items()}
    scored = written(models.score_variants(problem, fitted, keep), "test-scores")
    p_cols = {v: f"p_{v}" for v in fitted}
    found = metrics.evaluate(scored, "label", p_cols, "weight", threshold, split="test")
    shared = {"threshold": threshold, "n_rows": scored.count(), "n_features": len(problem.features), "input": _input(table)}
    _log(spark, layout, kind, "test", found, {v: {"model_uri": uri, **shared} for v, uri in uris.items()}, uris)
    labelled = metrics.threshold_labels(scored, "label", p_cols, threshold, tuple(keep), PREFIX)
    labelled = labelled.withColumn("label", F.col("label").cast("tinyint")).withColumnRenamed("label", census.TARGET)
    return found, writers.write_parquet(labelled, out)


def run_report(spark: SparkSession, layout: runs.RunLayout, kind: str) -> DataFrame:
    """Metrics of this run's kind, variants side by side; after several trainings those of the newest."""
    table = commits.read_rows(spark, f"{layout.root}/_run_metrics", RESULT_SCHEMA)
    return metrics.variant_report(table.where((F.col("run_id") == layout.run_id) & (F.col("kind") == kind)), newest="created_at")
