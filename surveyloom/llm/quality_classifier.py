"""Quality of documents from their own evidence and from what is known of their site, by hierarchical empirical Bayes.

Evidence: counts over the text are put into fixed bins; a bin's weight is the log of how often it occurs in good and in bad labelled
documents. Two numbers fitted on the labelled rows turn the sum of weights into a probability. Sites: the mean of these
probabilities per host and per path of a host; how far hosts differ from each other, and paths from their host, is
estimated by moments (Morris, "Parametric Empirical Bayes Inference", JASA 1983), and sparse sites shrink to what stands
above them. A document does not count for its own path's mean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import text as T
from surveyloom.llm.language import held_out
from surveyloom.llm.quality_rules import SYMBOLS, repeated_lines, repeated_words
from surveyloom.llm.scratch import Scratch, ship

# Lower edges of the bins of each feature; a value below the first edge is in bin 0.
BINS = {
    "words": (5, 20, 50, 100, 200, 500, 1000, 5000),
    "word_length": (2.5, 3.5, 4.0, 4.5, 4.8, 5.1, 5.5, 6.0, 7.0, 9.0),
    "symbols": (1e-9, 0.001, 0.01, 0.03, 0.1, 0.25),
    "repeated_words": (1e-9, 0.01, 0.03, 0.1, 0.2, 0.4, 0.7),
    "repeated_lines": (1e-9, 0.05, 0.1, 0.2, 0.4, 0.7),
    "capitals": (0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.4, 0.7),
    "full_stops": (1e-9, 0.02, 0.05, 0.08, 0.12, 0.2, 0.4),
    "digits": (1e-9, 0.005, 0.02, 0.1, 0.3),
    "distinct_words": (0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
}

UPPER, DIGIT, STOP = (np.zeros(256, dtype=bool) for _ in range(3))
UPPER[65:91] = DIGIT[48:58] = STOP[ord(".")] = True


@dataclass(frozen=True)
class Settings:
    smoothing: float = 0.5
    threshold: float = 0.5
    edge: float = 1e-6  # probabilities stay this far from 0 and 1


def measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The features of ``BINS`` for each text of a slice."""
    words = T.find_words(data, offsets)
    hashes = T.hash_ranges(data, words.starts, words.ends, fold=True)
    n = np.diff(words.first)
    some, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    characters = (data & 0xC0) != 0x80
    keyed = T.mix(hashes + words.row.astype(np.uint64) * T.U(0x9FB21C651E98DF25))
    _, once = np.unique(keyed, return_index=True)
    distinct = np.bincount(words.row[once], minlength=len(n)) if len(once) else np.zeros(len(n))
    raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(n))]
    lines = np.array([max(1, r.count(b"\n") + 1) for r in raw])
    return [
        n,
        T.sums(characters & ~T.WHITE[data], offsets) / some,
        T.sums(SYMBOLS[data], offsets) / size,
        repeated_words(hashes, words.first) / some,
        np.array([repeated_lines(r) for r in raw]) / lines,
        T.sums(UPPER[data], offsets) / some,
        T.sums(STOP[data], offsets) / some,
        T.sums(DIGIT[data], offsets) / size,
        distinct / some,
    ]


def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in T.slices(batch.column("text")):
            found = [np.searchsorted(edges, x, "right") for edges, x in zip(BINS.values(), measures(data, offsets))]
            flat = pa.array(np.column_stack(found).astype(np.int32).ravel())
            bins = pa.ListArray.from_arrays(pa.array(np.arange(end - start + 1, dtype=np.int32) * len(BINS)), flat)
            columns = [*batch.drop_columns(["text"]).slice(start, end - start).columns, bins]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "path", "held_out", "bins"])


def bin_weights(counts: list, settings: Settings) -> list[list[float]]:
    """Log ratio of good and bad per feature and bin, from rows (feature, bin, good, n)."""
    table = [np.zeros((len(edges) + 1, 2)) for edges in BINS.values()]
    for row in counts:
        table[row["feature"]][row["bin"], row["good"]] = row["n"]
    out = []
    for part in table:
        shares = (part + settings.smoothing) / (part + settings.smoothing).sum(axis=0)
        out.append(np.log(shares[:, 1] / shares[:, 0]).tolist())
    return out


def calibration(rows: list) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve through (evidence, good, n), by Newton steps with a weak prior."""
    if not rows:
        return 0.0, 1.0
    x = np.array([[1.0, r["evidence"]] for r in rows])
    y, w = np.array([r["good"] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float)
    beta, prior, centre = np.array([0.0, 0.5]), np.diag([0.01, 1.0]), np.array([0.0, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - prior @ (beta - centre)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + prior, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def logit(p: Column, edge: float) -> Column:
    p = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(p / (1 - p))


def document_evidence(rows: DataFrame, labels: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """``rows`` with ``own``, the probability from the document alone, and ``good``, its label if it may be learned from."""
    y = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    joined = rows.join(y, (F.col("doc_id") == F.col("id")) & ~F.col("held_out"), "left").drop("id")
    rows = scratch.write(joined, "evidence")
    known = rows.where(F.col("good").isNotNull())
    counts = known.select("good", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "good").agg(F.count(F.lit(1)).alias("n"))
    weights = bin_weights(counts.collect(), settings)  # features times bins times two
    evidence = F.lit(0.0)
    for i, part in enumerate(weights):
        evidence += F.element_at(F.array(*map(F.lit, part)), F.col("bins")[i] + 1)
    rows = rows.withColumn("evidence", evidence)
    steps = rows.where(F.col("good").isNotNull()).groupBy(F.round("evidence", 1).alias("evidence"), "good").agg(F.count(F.lit(1)).alias("n"))
    intercept, slope = calibration(steps.collect())  # tenths of the range of the weights
    return rows.withColumn("own", 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("evidence"))))).drop("bins", "evidence")


def _spread(groups: DataFrame, above: str) -> tuple[float, float]:
    """(variance inside groups, variance of group means around ``above`` beyond what the former explains)."""
    row = groups.agg(
        (F.sum(F.col("n") * F.col("variance")) / F.sum("n")).alias("inside"),
        (F.sum(F.col("n") * (F.col("mean") - F.col(above)) ** 2) / F.sum("n")).alias("between"),
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
    ).first()
    if not row["n"]:
        return 1.0, 0.0
    inside = max(row["inside"], 1e-9)
    return inside, max(row["between"] - inside * row["groups"] / row["n"], 0.0)


def _shrunk(n: Column, mean: Column, above: Column, inside: float, between: float) -> Column:
    weight = n * F.lit(between) / (n * F.lit(between) + F.lit(inside))
    return weight * mean + (1 - weight) * above


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, settings: Settings = Settings(), text: str = "text",
                  key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, held_out, own, host_posterior, path_posterior, score, kept``.

    ``labels (doc_id, quality)``: 1 is good; several labels of a document are averaged, null ones count for nothing, and rows held out (see
    ``language.held_out``) and rows with a null id are not learned from. ``host`` and ``path`` are expressions over ``docs``; null is a site of its own. ``score``
    is the odds of the document's own probability times those of its path over the overall ones. Null and empty texts have no words and
    are scored like others. Repeated rows have equal results but for their own share in the path. Without labels every ``own`` is 1/2. An
    empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).cast("string").alias("text")
    ).select("doc_id", "host", "path", held_out("doc_id").alias("held_out"), "text")
    with Scratch(spark) as scratch:
        schema = "doc_id bigint, host string, path string, held_out boolean, bins array<int>"
        rows = document_evidence(own.mapInArrow(binned, schema), labels, scratch, settings)
        value = F.coalesce(F.col("good").cast("double"), F.col("own"))
        moments = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")]
        overall = rows.agg(F.avg(value)).first()[0]
        overall = 0.5 if overall is None else overall
        hosts = rows.groupBy("host").agg(*moments).withColumn("above", F.lit(overall))
        hosts = scratch.write(hosts, "hosts")
        inside, between = _spread(hosts, "above")
        hosts = hosts.select(F.col("host").alias("h"), _shrunk(F.col("n"), F.col("mean"), F.col("above"), inside, between).alias("host_posterior"))
        paths = rows.groupBy("host", "path").agg(*moments).join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
        paths = scratch.write(paths.withColumnsRenamed({"host": "of_host", "path": "of_path"}), "paths")
        inside, between = _spread(paths, "host_posterior")
        same = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
        out = rows.join(paths, same)
        others = F.col("n") - 1
        without = F.when(others > 0, (F.col("n") * F.col("mean") - value) / others).otherwise(F.col("host_posterior"))
        out = out.withColumn("path_posterior", _shrunk(others, without, F.col("host_posterior"), inside, between))
        total = logit(F.col("own"), settings.edge) + logit(F.col("path_posterior"), settings.edge) - F.lit(math.log(max(overall, settings.edge) / max(1 - overall, settings.edge)))
        out = out.withColumn("score", 1 / (1 + F.exp(-total)))
        out = out.select("doc_id", "held_out", "own", "host_posterior", "path_posterior", "score", (F.col("score") >= settings.threshold).alias("kept"))
        return scratch.keep(out, "quality")
