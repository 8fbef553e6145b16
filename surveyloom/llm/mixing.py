"""Mix sources to target weights: repetition rates from token totals, whole copies plus one hash-seeded draw."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.scratch import Scratch, tasks_for

WORD = r"[^\x20\x09-\x0D]+"
SPAN = float(1 << 52)  # 13 hexadecimal digits


@dataclass(frozen=True)
class Settings:
    """``weights`` repeat over the sources in code point order; no source is repeated more than ``most`` times."""

    weights: Sequence[int] = (1, 2, 3)
    most: int = 3
    seed: int = 20240229


def source_ranks(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """``totals`` with ``rank``, 0 for the first source in code point order, null last; no task sees all sources.

    Ranges of sources are ranked each by itself; the driver adds up one count per range.
    """
    order = F.asc_nulls_last("source")
    ranges = totals.repartitionByRange(tasks_for(totals), order).withColumn("range", F.spark_partition_id())
    ranges = scratch.write(ranges, "source-ranges")
    counts = sorted(tuple(r) for r in ranges.groupBy("range").count().collect())
    before, at = [(-1, 0)], 0
    for number, n in counts:
        before.append((number, at))
        at += n
    offsets = totals.sparkSession.createDataFrame(before, "range int, before bigint")
    own = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.withColumn("own", own).join(offsets, "range").withColumn("rank", F.col("own") + F.col("before")).drop("range", "own", "before")


def source_targets(totals: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """``(source, source_size, target)`` for ``totals (source, source_size)``.

    Targets share the whole size by weight. A source whose share is above ``most`` times its size gets that limit, and the rest is shared
    again among the others, until no share is above. Each round is one aggregate; limited sources never become free again.
    """
    weights = F.array(*[F.lit(w).cast("bigint") for w in settings.weights])
    ranked = source_ranks(totals, scratch).withColumn("weight", F.element_at(weights, (F.col("rank") % len(settings.weights) + 1).cast("int")))
    ranked = scratch.write(ranked, "source-weights")
    limit = F.col("source_size") * settings.most
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        sums = ranked.agg(F.sum(F.when(capped, limit)), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if not sums[1]:
            break
        after = (whole - (sums[0] or 0)) / sums[1]
        if after == level:
            break
        level = after
    target = F.when(F.col("weight") * F.lit(level or 0.0) > limit, limit.cast("double")).otherwise(F.col("weight") * F.lit(level or 0.0))
    return ranked.select("source", "source_size", target.alias("target"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate), plus 1 with probability equal to the fraction, decided by a hash of seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(SPAN)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def source_rates(sizes: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> DataFrame:
    """``(of, source_size, target, rate)`` per source from ``sizes (source, size)``; a source without words has rate 0."""
    totals = scratch.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = source_targets(totals, scratch, settings).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return scratch.write(targets.withColumn("rate", rate), "source-rates")


def mix_sources(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, n_copies``.

    ``size`` is the number of words, 0 for a null or empty text. A null source is a source of its own, the last in order. Rows with the
    same id share a draw, a null id has the draw of null. A source without words has target 0. An empty table gives an empty
    result; extra columns are not read. Equal input and seed give equal copies in every run.
    """
    with Scratch(docs.sparkSession) as scratch:
        columns = [F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")]
        sizes = scratch.write(docs.select(*columns), "sizes")
        rates = source_rates(sizes, scratch, settings)
        out = sizes.join(rates, F.col("source").eqNullSafe(F.col("of")))
        out = out.withColumn("n_copies", copies(F.col("rate"), F.col("doc_id"), settings.seed))
        out = out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")
        return scratch.keep(out, "mix")


def emit_copies(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` says, all columns unchanged; texts are not shuffled by id.

    Extra columns may have any name: helper columns take names that ``docs`` lacks.
    """
    of, rate, copy = (free_name(docs, name) for name in ("of", "rate", "copy"))
    with Scratch(docs.sparkSession) as scratch:
        sizes = docs.select(F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
        rates = source_rates(sizes, scratch, settings).select(F.col("of").alias(of), F.col("rate").alias(rate))
        rated = docs.join(rates, F.col(source).cast("string").eqNullSafe(F.col(of)))
        n = copies(F.col(rate), F.col(key).cast("bigint"), settings.seed)
        each = rated.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
        return scratch.keep(each.drop(of, rate, copy), "mixed")


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
