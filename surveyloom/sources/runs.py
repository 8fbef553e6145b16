"""Run layout, lineage table, extract cache, and the model catalogue. All are plain tables in shared storage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.columns import extract_key
from surveyloom.sources.commits import append_rows, committed, publish, read_rows
from surveyloom.sources.writers import EXTRACT_CODEC, write_parquet

METADATA_SCHEMA = (
    "written_at timestamp, run_id string, step string, path string, rows bigint, cols int, "
    "columns array<string>, params map<string,string>"
)
MODEL_SCHEMA = "name string, kind string, uri string, created_at timestamp"


@dataclass(frozen=True)
class RunLayout:
    """Paths of one run below a root folder."""

    root: str
    run_id: str

    @property
    def run(self) -> str:
        return f"{self.root}/{self.run_id}"

    @property
    def raw(self) -> str:
        return f"{self.run}/raw"

    @property
    def features(self) -> str:
        return f"{self.run}/features"

    @property
    def population(self) -> str:
        return f"{self.run}/group_population"

    @property
    def training(self) -> str:
        return f"{self.run}/synth/training"

    @property
    def synthetic(self) -> str:
        return f"{self.run}/synth/full"

    @property
    def group_lineage(self) -> str:
        """Per group: training rows, synthetic rows, and the seed that keys its random streams."""
        return f"{self.run}/synth/groups"

    @property
    def cache(self) -> str:
        return f"{self.root}/_extract_cache"

    @property
    def metadata(self) -> str:
        return f"{self.root}/_run_metadata"

    @property
    def models(self) -> str:
        return f"{self.root}/_models"


def record_step(
    layout: RunLayout, step: str, table: DataFrame, path: str, params: Mapping[str, object] | None = None
) -> DataFrame:
    """Append one lineage row for a table just written. ``table`` is the read-back, so the count uses file footers."""
    row = (
        datetime.now(timezone.utc),
        layout.run_id,
        step,
        path,
        table.count(),
        len(table.columns),
        table.columns,
        {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in (params or {}).items()},
    )
    return append_rows(table.sparkSession, layout.metadata, [row], METADATA_SCHEMA)


def run_metadata(spark: SparkSession, layout: RunLayout) -> DataFrame:
    return read_rows(spark, layout.metadata, METADATA_SCHEMA)


def extract_cache_key(year: int, horizon: str, states: Iterable[str]) -> str:
    """``functions.columns.extract_key`` of one extract, for use where a path is built; evaluated without a job."""
    settings = SparkSession.active().createDataFrame([(year, horizon, list(states))], "year int, horizon string, states array<string>")
    return settings.select(extract_key(F.col("year"), F.col("horizon"), F.col("states"))).first()[0]


def cached_extract(
    spark: SparkSession, layout: RunLayout, key: str, build: Callable[[], DataFrame], params: Mapping | None = None
) -> tuple[DataFrame, str]:
    """Reuse the extract of this key, or build and publish it. Returns the table and ``"cache"`` or ``"built"``.

    Of several builders at once the first to finish publishes, the others take its version; lineage has one row for it.
    """
    folder = f"{layout.cache}/{key}"
    version, built = committed(spark, folder), False
    if version is None:
        version, built = publish(spark, folder, lambda path: write_parquet(build(), path, EXTRACT_CODEC))
    table = spark.read.parquet(version)
    if built:
        record_step(layout, "extract_cache", table, version, params)
    return table, "built" if built else "cache"


def register_model(spark: SparkSession, layout: RunLayout, name: str, kind: str, uri: str) -> None:
    """Enter a saved model. The entry is its commit: readers find models by the catalogue only, so one half saved is never read."""
    append_rows(spark, layout.models, [(name, kind, uri, datetime.now(timezone.utc))], MODEL_SCHEMA)


def latest_models(catalogue: DataFrame, name: str = "name", created: str = "created_at", uri: str = "uri") -> DataFrame:
    """Newest entry per name; equal times are settled by the larger uri."""
    return catalogue.groupBy(name).agg(
        F.max_by(F.col(uri), F.struct(created, uri)).alias(uri), F.max(created).alias(created)
    )


def latest_model(spark: SparkSession, layout: RunLayout, name: str, kind: str) -> str:
    """Path of the newest saved model of a name and kind; fails if there is none."""
    catalogue = read_rows(spark, layout.models, MODEL_SCHEMA)
    found = latest_models(catalogue.where((F.col("name") == name) & (F.col("kind") == kind))).first()
    if found is None:
        raise LookupError(f"no saved {kind} model named {name!r} under {layout.models}")
    return found["uri"]
