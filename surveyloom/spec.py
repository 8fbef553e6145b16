"""Column specs and job settings that drive the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

SPARK_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its kind (``string``, ``long``, ``double``), role, optional code map, and inflation flag."""

    name: str
    kind: str
    role: str
    recode: Mapping[str, str] | None = None
    adjusted: bool = False

    def __post_init__(self):
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}, use one of {sorted(SPARK_TYPES)}")


@dataclass(frozen=True)
class TableSpec:
    """A survey table: columns in output order, the group and weight columns, and the synthesised sequence."""

    columns: tuple[ColumnSpec, ...]
    group: str
    weight: str
    factor: str | None = None
    factor_scale: float = 1e6
    sequence: tuple[str, ...] = ()

    def __post_init__(self):
        names = [c.name for c in self.columns]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"columns listed twice: {twice}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def having(self, **wanted) -> list[ColumnSpec]:
        """Columns whose attributes equal the given values, e.g. ``having(role="key")``."""
        return [c for c in self.columns if all(getattr(c, k) == v for k, v in wanted.items())]

    def present(self, available: Iterable[str]) -> list[ColumnSpec]:
        available = set(available)
        return [c for c in self.columns if c.name in available]

    def kind_of(self, name: str) -> str:
        """Kind of a column; a column without a spec counts as categorical."""
        return next((c.kind for c in self.columns if c.name == name), "string")

    def synthesised(self, available: Iterable[str]) -> list[str]:
        """The sequence restricted to what a table has, without the group column."""
        available = set(available)
        return [n for n in self.sequence if n in available and n != self.group]


@dataclass(frozen=True)
class JobConfig:
    """Settings of one synthesis run; ``rows_per_group=None`` means group total // ``divisor``."""

    year: int
    horizon: str
    states: tuple[str, ...]
    seed: int
    rows_per_group: int | None
    divisor: int = 10


# The three run modes.
JOBS = {
    "train": JobConfig(year=2023, horizon="5-Year", states=("ALL",), seed=42, rows_per_group=5000),
    "sample": JobConfig(year=2023, horizon="5-Year", states=("WY",), seed=42, rows_per_group=5000),
    "test": JobConfig(year=2023, horizon="5-Year", states=("ALL",), seed=42, rows_per_group=None),
}


def job_config(mode: str = "train") -> JobConfig:
    try:
        return JOBS[mode.lower()]
    except KeyError:
        raise ValueError(f"unknown mode {mode!r}, use one of {sorted(JOBS)}") from None
