"""Connected components of a link table, in rounds of joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from surveyloom.llm.scratch import Scratch

MAX_ROUNDS = 100


def _written(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The written table, with its number of rows and an order-free checksum taken while it was written."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    table = scratch.write(edges.observe(seen, *sums), "links")
    return table, (seen.get["n"], seen.get["x"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", "m")).toDF("u", "v").distinct()


def components(links: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links (u, v)``: the smallest node that it reaches.

    Alternating large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014). Links of
    a hub are summed to one minimum before the shuffle, and the join back is an inner join whose hot side AQE splits. Each
    round is a written table. Self-links and nulls are ignored. With ``rounds`` it stops after so many, settled or not: then a node may
    be given any smaller node that it reaches.
    """
    edges = links.where(F.col("u") != F.col("v"))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = _written(edges, scratch)
    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        if not before[0]:
            break
        edges, now = _written(_small_star(_large_star(edges)), scratch)
        if now == before:
            break
        before = now
    else:
        if rounds is None:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
    return found if rounds is None else found.groupBy("node").agg(F.min("component").alias("component"))
