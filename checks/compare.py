"""Run queries next to their SQL: ``python -m checks.compare [sf] [query …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("surveyloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    order = pd.Series([repr(row) for row in df.itertuples(index=False, name=None)], dtype=object)
    return df.iloc[order.argsort(kind="stable")].reset_index(drop=True)


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    """What differs between two results, order of rows and columns aside; values must be equal, not close."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return [f"columns {sorted(set(mine.columns) ^ set(theirs.columns))}"]
    if len(mine) != len(theirs):
        return [f"rows {len(mine)} vs {len(theirs)}"]
    a, b = _sorted(mine), _sorted(theirs)
    out = []
    for c in a.columns:
        unequal = [(x, y) for x, y in zip(a[c], b[c]) if x != y]
        if unequal:
            out.append(f"{c}: {len(unequal)} of {len(a)}, e.g. {unequal[0]}")
    return out


def check(spark: SparkSession, con, name: str, sf_dir: str) -> list[str]:
    mine = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return [] if len(mine) else ["no rows"]
    return differences(mine, con.execute(ORACLES[name]).df())


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, sf_dir = local_session(), f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = check(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {'; '.join(found)}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
