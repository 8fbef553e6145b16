"""Survey files → feature table → copula per group → synthetic table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom import census
from surveyloom.functions import columns as columns_of
from surveyloom.operators import copula, features, groups
from surveyloom.sources import readers, runs, writers
from surveyloom.spec import JobConfig, TableSpec


@dataclass
class Synthesis:
    """Tables of one run, each read back from its files."""

    raw: DataFrame
    features: DataFrame
    population: DataFrame
    training: DataFrame
    model: copula.CopulaModel
    synthetic: DataFrame


def extract_csv(
    spark: SparkSession, paths: Iterable[str], spec: TableSpec, rename: dict[str, str] | None = None
) -> DataFrame:
    """Union of the person files; code columns stay text and the state column gets its name."""
    rename = rename or {}
    text = {c.name for c in spec.columns if c.kind == "string"}
    text |= {old for old, new in rename.items() if new in text}
    table = readers.read_csv_by_name(spark, paths, text_columns=text)
    return features.exclude_rename(table, rename) if rename else table


def select_features(raw: DataFrame, spec: TableSpec, layout: runs.RunLayout, params: dict) -> tuple[DataFrame, DataFrame]:
    """Write the feature table and the group totals."""
    table = writers.write_parquet(features.build_features(raw, spec), layout.features)
    runs.record_step(layout, "features", table, layout.features, params)
    totals = groups.group_population(table, spec.group, spec.weight)
    return table, writers.write_group_values(totals, layout.population, spec.group)


def synthesise(
    table: DataFrame,
    population: DataFrame,
    spec: TableSpec,
    config: JobConfig,
    layout: runs.RunLayout,
    dim: DataFrame,
    wanted: Sequence[str] | None = None,
) -> tuple[DataFrame, copula.CopulaModel, DataFrame]:
    """Training table by group, fitted copula, and the synthetic table."""
    training = groups.require_rows(
        groups.partition_training(table, spec, dim, wanted=wanted), f"no supported groups for {config.states}"
    )
    training = writers.write_by_group(training, layout.training, spec.group)
    runs.record_step(layout, "training", training, layout.training)
    columns = spec.synthesised(training.columns)
    model = copula.fit_copula(training, spec.group, columns, categorical=[c for c in columns if spec.kind_of(c) == "string"])
    present = groups.rows_per_group(training, spec.group).select(spec.group)
    totals = groups.with_group_value(present, population, spec.group, census.POPULATION)
    sizes = groups.sample_size(totals, census.POPULATION, config.rows_per_group, config.divisor)
    drawn = copula.sample_copula(model, sizes, config.seed, carry=[census.POPULATION])
    synthetic = writers.write_parquet(features.fill_from_groups(drawn, training, spec.group), layout.synthetic)
    lineage = groups.rows_per_group(training, spec.group).withColumnRenamed("n_rows", "training_rows")
    lineage = lineage.join(groups.rows_per_group(synthetic, spec.group).withColumnRenamed("n_rows", "synthetic_rows"), spec.group, "left")
    seed = columns_of.group_seed(config.seed, F.col(spec.group))
    writers.write_parquet(lineage.withColumn("seed", seed), layout.group_lineage)
    params = {"seed": config.seed, "rows_per_group": config.rows_per_group, "divisor": config.divisor}
    runs.record_step(layout, "synthetic", synthetic, layout.synthetic, params)
    return training, model, synthetic


def run_synthesis(
    spark: SparkSession,
    config: JobConfig,
    layout: runs.RunLayout,
    extract: Callable[[], DataFrame],
    spec: TableSpec = census.PERSON,
    dim: DataFrame | None = None,
    wanted: Sequence[str] | None = None,
) -> Synthesis:
    """The whole job. ``extract`` builds the raw table if the cache has none for these settings."""
    params = {"year": config.year, "horizon": config.horizon, "states": list(config.states)}
    key = runs.extract_cache_key(config.year, config.horizon, config.states)
    raw, source = runs.cached_extract(spark, layout, key, extract, params)
    runs.record_step(layout, "extract", raw, f"{layout.cache}/{key}", {**params, "source": source, "cache_key": key})
    table, population = select_features(raw, spec, layout, params)
    dim = census.state_dim(spark) if dim is None else dim
    wanted = census.state_codes(config.states) if wanted is None else wanted
    training, model, synthetic = synthesise(table, population, spec, config, layout, dim, wanted)
    return Synthesis(raw, table, population, training, model, synthetic)


def run_person_files(spark: SparkSession, config: JobConfig, layout: runs.RunLayout, pattern: str) -> Synthesis:
    """The job for the public person files, one CSV per state: ``pattern`` such as ``…/psam_p{fips}.csv``."""

    def extract() -> DataFrame:
        paths = readers.state_paths(pattern, config.states, census.STATES)
        return extract_csv(spark, paths, census.PERSON, rename={"STATE": "ST"})

    return run_synthesis(spark, config, layout, extract)
