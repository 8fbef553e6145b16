"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidate edges.

One hash of each shingle serves all bins: its high bits choose the bin, the smallest hash of a bin is its value (Li, Owen,
Zhang, "One Permutation Hashing", NIPS 2012). An empty bin copies a non-empty one found by its own fixed random probing order
(Shrivastava, "Optimal Densification for Fast and Accurate Minwise Hashing", ICML 2017), so every bin agrees for two
documents with probability equal to their similarity.

Documents with equal sets are one class and only its smallest id goes on. In each bucket the member that shares most
buckets with others is the centre, and the others are compared with it only: a bucket of m members gives m - 1 candidates.
Candidates are confirmed on full shingle sets. Members of buckets that still hold several components are then joined exactly, by an
index of the rarest shingles of their full sets, so a star loses no link that the buckets hold; texts of one template below the
threshold meet neither there nor on the way. Before a text is read, a sketch of four bits per bin (Li, König, "b-Bit
Minwise Hashing", WWW 2010) rules out pairs whose similarity is far below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm import text as T
from surveyloom.llm.components import components
from surveyloom.llm.scratch import Scratch, documents, ship


@dataclass(frozen=True)
class Settings:
    """48 bands of 5 bins miss a pair of similarity 0.75 with probability 2·10^-6, and 0.85 with 10^-12.

    A pair goes on if its sketches agree in at least the number of bins that a pair at the threshold has in expectation, less
    ``deviations`` standard deviations; 4.8 loses such a pair with probability 10^-6. Only the bins that a set fills are
    independent, so the deviation grows as sets get shorter, and the shortest are never ruled out.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 48
    rows: int = 5
    growth: int = 64
    deviations: float = 4.8

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    def least_agreement(self, n: Column) -> Column:
        """Bins in which the sketches of two sets must agree, the smaller of which has ``n`` shingles."""
        agree = self.percent / 100 + (1 - self.percent / 100) / 16
        filled = F.lit(float(self.bins)) * (F.lit(1.0) - F.exp(-n / F.lit(float(self.bins))))
        return F.lit(self.bins * agree) - F.lit(self.deviations * self.bins * (agree * (1 - agree)) ** 0.5) / F.sqrt(filled)


def probe_order(bins: int) -> np.ndarray:
    """For every bin a fixed random order of all bins."""
    draw = np.random.Generator(np.random.Philox(key=77)).random((bins, bins))
    return np.argsort(draw, axis=1).astype(np.int32)


def signature(distinct: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Densified values of all bins for a sorted, non-empty array of distinct hashes."""
    bins = len(order)
    place = ((distinct >> T.U(32)) * T.U(bins)) >> T.U(32)
    head = np.flatnonzero(np.diff(place, prepend=T.U(bins)))
    filled = np.zeros(bins, dtype=bool)
    values = np.zeros(bins, dtype=np.uint64)
    at = place[head].astype(np.int64)
    filled[at] = True
    values[at] = distinct[head]
    empty = np.flatnonzero(~filled)
    depth = 16
    while len(empty):
        tried = filled[order[empty, :depth]]
        found = tried.any(axis=1)
        hit = empty[found]
        values[hit] = values[order[hit, tried[found].argmax(axis=1)]]
        empty = empty[~found]
        depth = min(bins, depth * 8)
    return values


def sketch(values: np.ndarray) -> np.ndarray:
    """Four bits of every bin, sixteen bins to a 64-bit word."""
    bits = T.mix(values) & T.U(15)
    bits = np.concatenate([bits, np.zeros(-len(bits) % 16, dtype=np.uint64)]).reshape(-1, 16)
    return T.signed((bits << (T.U(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))


def agreement(a: str, b: str, bins: int) -> Column:
    """Bins in which two sketches agree."""
    words = -(-bins // 16)
    differing = F.lit(0)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        some = some.bitwiseOR(F.shiftrightunsigned(some, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing += F.bit_count(some)
    return F.lit(bins) - differing


SET = ["n_shingles", "set_a", "set_b"]  # what tells sets apart
SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, buckets array<bigint>, sketch array<bigint>"


def sign(settings: Settings):
    """Set size, 128-bit set digest and bucket of every band for each document."""
    order = probe_order(settings.bins)
    band = T.mix(np.arange(1, settings.bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in T.slices(batch.column("text")):
                words = T.find_words(data, offsets)
                hashes = T.hash_ranges(data, words.starts, words.ends, fold=True)
                grams, at = T.windows(hashes, words.first, settings.shingle, whole_short=True)
                n = np.zeros(end - start, dtype=np.int64)
                digests = np.zeros((end - start, 2), dtype=np.uint64)
                buckets: list = [None] * (end - start)
                sketches: list = [None] * (end - start)
                for i in range(end - start):
                    distinct = np.unique(grams[at[i] : at[i + 1]])
                    n[i] = len(distinct)
                    if len(distinct):
                        digests[i] = distinct.sum(), T.mix(distinct + T.U(0x5851F42D4C957F2D)).sum()
                        values = signature(distinct, order)
                        sketches[i] = sketch(values)
                        rows = values.reshape(settings.bands, settings.rows)
                        joined = (rows * T.STEPS[: settings.rows]).sum(axis=1, dtype=np.uint64)
                        buckets[i] = T.signed(T.mix(joined + band))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(n),
                        pa.array(T.signed(np.ascontiguousarray(digests[:, 0]))),
                        pa.array(T.signed(np.ascontiguousarray(digests[:, 1]))),
                        pa.array(buckets, pa.list_(pa.int64())),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "buckets", "sketch"],
                )

    return run


def text_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for start, end, data, offsets in T.slices(column):
        words = T.find_words(data, offsets)
        grams, at = T.windows(T.hash_ranges(data, words.starts, words.ends, fold=True), words.first, shingle, True)
        for i in range(end - start):
            yield np.unique(grams[at[i] : at[i + 1]])


def confirm(settings: Settings):
    """Candidates (a, b, text_a, text_b) with a flag whether the full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(text_sets(batch.column("text_a"), settings.shingle), text_sets(batch.column("text_b"), settings.shingle)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= settings.percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


def candidates(members: DataFrame, sketches: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of a bucket's centre, its heaviest member, with its other members, each pair once, if sizes and sketches allow it.

    ``members (bucket, node, weight, n)``.
    """
    best = F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("best")
    centres = members.groupBy("bucket").agg(best)
    centres = centres.select(F.col("bucket").alias("of"), (-F.col("best.minus")).alias("centre"), F.col("best.n").alias("centre_n"))
    near = (F.col("bucket") == F.col("of")) & (F.col("node") != F.col("centre"))
    near &= F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * settings.percent
    pairs = members.join(centres, near).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return _alike(pairs.distinct(), sketches, settings)


def _alike(pairs: DataFrame, sketches: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that their sketches do not rule out."""
    pairs = pairs.join(sketches.toDF("a", "sketch_a", "n_a"), "a").join(sketches.toDF("b", "sketch_b", "n_b"), "b")
    enough = agreement("sketch_a", "sketch_b", settings.bins) >= settings.least_agreement(F.least("n_a", "n_b"))
    return pairs.where(enough).select("a", "b").distinct()


def shingle_rows(settings: Settings):
    """``node, of, n, shingle``: the shingles of each text; ``of`` tells the texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, grams in zip(batch.column("doc_id"), text_sets(batch.column("text"), settings.shingle)):
                n = len(grams)
                columns = [
                    pa.repeat(node, n),
                    pa.array(T.signed(np.full(n, grams.sum(dtype=np.uint64)))),
                    pa.array(np.full(n, n, dtype=np.int64)),
                    pa.array(T.signed(grams)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "of", "n", "shingle"])

    return run


def prefix_index(texts: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """``bucket, node, n, rank, indexed``: the rarest shingles of each text, as many as a partner at the threshold cannot avoid.

    Shingles of a set are ranked by how many of the texts hold them, rarest first (Xiao et al., "Efficient Similarity Joins for
    Near Duplicate Detection", WWW 2008). Two sets of the least similarity share a shingle among the first n - ceil(3n/4) + 1 of the
    larger one and the first n - ceil(6n/7) + 1 (``indexed``) of the other, for any threshold likewise. Shingles of a template
    are frequent, so they are among these only where the template is nearly the whole text.
    """
    rows = scratch.write(texts.mapInArrow(shingle_rows(settings), "node bigint, of bigint, n bigint, shingle bigint"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"))
    in_order = Window.partitionBy("node", "of").orderBy("texts", "shingle")
    ranked = rows.join(counts, "shingle").withColumn("rank", F.row_number().over(in_order))
    p, n = settings.percent, F.col("n")
    probe = n - F.ceil(n * p / 100) + 1
    indexed = n - F.ceil(n * (2 * p) / (100 + p)) + 1
    ranked = ranked.where((F.col("rank") <= probe) & (F.col("texts") > 1))
    return ranked.select(F.col("shingle").alias("bucket"), "node", "n", "rank", (F.col("rank") <= indexed).alias("indexed"))


def prefix_candidates(members: DataFrame, slots: int | None, settings: Settings) -> DataFrame:
    """Pairs in different components that meet in a bucket of the prefix index, each pair once.

    ``slots``: each bucket has so many centres at most, one of each slot, and the others are compared with them; None compares all. A
    pair goes on if the shingles left after the common one can still reach the threshold, which they can at the first common one.
    """
    columns = ["bucket", "node", "n", "rank", "indexed", "component"]
    centres = members.select(*columns)
    if slots is not None:
        slot = F.pmod(F.xxhash64("node", F.lit(slots)), F.lit(slots))
        best = F.min(F.struct(*columns[1:])).alias("best")
        centres = centres.groupBy("bucket", slot.alias("slot")).agg(best).select("bucket", "best.*")
    centres = centres.toDF(*[f"c_{c}" for c in columns])
    small, large, p = F.least("n", "c_n"), F.greatest("n", "c_n"), settings.percent
    left = F.least(F.col("n") - F.col("rank"), F.col("c_n") - F.col("c_rank")) + 1
    near = (F.col("bucket") == F.col("c_bucket")) & (F.col("component") != F.col("c_component"))
    near &= (small * 100 >= large * p) & (left * (100 + p) >= (small + large) * p)
    near &= F.when(F.col("n") < F.col("c_n"), F.col("indexed")).when(F.col("n") > F.col("c_n"), F.col("c_indexed")).otherwise(
        F.col("indexed") | F.col("c_indexed")
    )
    if slots is None:
        near &= F.col("node") < F.col("c_node")
    return members.join(centres, near).select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two ids are linked if any of their rows have sets with 100·|intersection| >= percent·|union|. ``component_id`` is the
    smallest id reachable, ``kept`` says that this is the row's own id. Null or empty texts and texts without a word have an
    empty set and no link. A row with a null id has no link either: component null, kept. Rows that repeat an id share its
    component. An empty table gives an empty result; extra columns are not read; texts may be of any length.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = documents(docs, text, key)
    with Scratch(spark) as scratch:
        signed = scratch.write(docs.mapInArrow(sign(settings), SIGNATURES), "signatures")
        full = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        classes = scratch.write(full.groupBy(*SET).agg(F.min("doc_id").alias("rep")), "classes")
        copies = full.join(classes, SET).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        links = scratch.write(copies.where("u != v").distinct(), "copies")
        found = _all_components(docs, full, classes, links, scratch, settings)
        out = (
            signed.select("doc_id", "n_shingles")
            .join(found, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        )
        return scratch.keep(out, "near-duplicates")


def _all_components(docs: DataFrame, full: DataFrame, classes: DataFrame, links: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """Components of ``links`` between equal sets and of the confirmed links between representatives of different ones."""
    signed = full.join(classes.withColumnRenamed("rep", "node"), SET).where(F.col("doc_id") == F.col("node"))
    signed = signed.dropDuplicates(["node", *SET])
    rows = signed.select(F.explode("buckets").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = scratch.write(rows.join(shared, "bucket").select("bucket", "node", "n", "size"), "members")
    weights = sized.groupBy("node", "n").agg(F.sum("size").alias("weight"))
    members = scratch.write(sized.drop("size").join(weights, ["node", "n"]), "members")
    texts = docs.join(weights.select(F.col("node").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id", "text"])
    texts = scratch.write(texts, "texts")
    sketches = signed.select("node", "sketch", F.col("n_shingles").alias("sketch_n"))
    sketches = scratch.write(sketches.join(weights.select("node").distinct(), "node"), "sketches")
    checked = _checked(scratch.write(candidates(members, sketches, settings), "pairs"), texts, scratch, settings)
    links = links.union(_confirmed(checked))
    found = components(links, scratch)
    now = _labelled(members, found)
    unsettled = _unsettled(now).where("size > 2")  # of two members both were compared
    open_ = scratch.write(now.join(unsettled, "bucket", "left_semi").select("node").distinct(), "unsettled")
    if open_.isEmpty():
        return found
    own = texts.join(open_.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    index = scratch.write(prefix_index(own, scratch, settings), "prefixes")
    done = checked.select("a", "b")
    slots: int | None = settings.growth
    while True:
        now = _labelled(index, found)
        unsettled = scratch.write(_unsettled(now), "unsettled")
        largest = unsettled.agg(F.max("size")).first()[0]
        if largest is None:
            return found
        slots = slots if slots is not None and slots < largest else None
        now = now.join(unsettled.select("bucket"), "bucket", "left_semi")
        pairs = prefix_candidates(now, slots, settings).join(done, ["a", "b"], "left_anti")
        pairs = _alike(scratch.write(pairs, "prefix-pairs"), sketches, settings)
        checked = _checked(scratch.write(pairs, "pairs"), texts, scratch, settings)
        links = links.union(_confirmed(checked))
        found = components(links, scratch)
        if slots is None:
            return found
        done = done.union(checked.select("a", "b"))
        slots *= settings.growth


def _confirmed(checked: DataFrame) -> DataFrame:
    return checked.where("good").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Buckets whose members are in several components."""
    ends = [F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")]
    return members.groupBy("bucket").agg(*ends).where("low != high")


def _checked(pairs: DataFrame, texts: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return scratch.write(both.mapInArrow(confirm(settings), "a bigint, b bigint, good boolean"), "checked")
