"""Hard negatives by exact integer scores: products of an anchor with several candidates at once, in fields of one wide integer.

Candidates are shifted to be non-negative and laid side by side: field k of a packed number holds component j of candidate k. A packed
number times an anchor component is the product for all its candidates at once, and the sum over the components leaves each candidate's
score in its own field, as a field is wide enough for the largest sum (Kronecker substitution). Shifts are taken off again
after unpacking. Packed numbers stay below 2^53, where doubles are exact integers and the product of two blocks is one
matrix product; components too wide for that go into Python's unbounded integers, by the same steps.

Anchors and candidates meet in blocks of bounded size. Scores never leave a task: the first pass returns the best positives per
block, the second, which knows the anchor's positives, the first negatives within their bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.scratch import Scratch, ship

EXACT_BITS = 53  # integers up to here are exact in a double
CELLS = 1 << 21  # scores held at once in a task
GROUP_CELLS = 1 << 21  # components of the candidates that a task gets at most, about


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high``: bounds of 100 * negative score / positive score, in percent."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    anchor_rows: int = 1024
    candidate_rows: int = 8192
    blocks_per_task: int = 4


@dataclass(frozen=True)
class Packing:
    """``shift`` makes components non-negative; ``bits`` is the width of a field, ``fields`` their number."""

    shift: int
    size: int
    bits: int
    fields: int

    @staticmethod
    def of(largest: int, size: int) -> Packing:
        """Fields for vectors of ``size`` components of at most ``largest`` in absolute value."""
        bits = max(1, (max(size, 1) * (2 * largest) ** 2).bit_length())
        return Packing(largest, size, bits, max(1, EXACT_BITS // bits))

    @property
    def exact(self) -> bool:
        return self.bits * self.fields <= EXACT_BITS

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of packed numbers; the last one is filled up with empty fields."""
        groups = -(-len(vectors) // self.fields)
        kind = np.float64 if self.exact else object
        out = np.zeros((groups, self.size), dtype=kind)
        for k in range(self.fields):
            part = vectors[k :: self.fields].astype(object if kind is object else np.int64) + self.shift
            out[: len(part)] += (part * (1 << (self.bits * k))).astype(kind)
        return out

    def scores(self, anchors: np.ndarray, packed: np.ndarray, candidate_sums: np.ndarray) -> np.ndarray:
        """Inner products of all anchors with all candidates."""
        n = len(candidate_sums)
        kind = np.float64 if self.exact else object
        moved = anchors.astype(object if kind is object else np.int64) + self.shift
        total = moved.astype(kind) @ packed.T
        total = total.astype(np.int64) if self.exact else total
        out = np.zeros((len(anchors), n), dtype=np.int64)
        # (a + s)(c + s) = ac + s(a + s) + s(c + s) - s²
        own = self.shift * moved.sum(axis=1)[:, None] - self.shift * self.shift * self.size
        sums = self.shift * (candidate_sums.astype(moved.dtype) + self.shift * self.size)[None, :]
        for k in range(self.fields):
            field = (total >> (self.bits * k)) & ((1 << self.bits) - 1)
            columns = sums[:, k :: self.fields]
            out[:, k :: self.fields] = field[:, : columns.shape[1]] - own - columns
        return out


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Integer rows of equal length; shorter vectors count as filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size), dtype=np.int64)
    inside = np.arange(size)[None, :] < lengths[:, None]
    out[inside] = flat
    return out


def _first(order: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Of entries taken in ``order``, which goes by row, the first ``most`` of each row."""
    sorted_rows = rows[order]
    begin = np.searchsorted(sorted_rows, sorted_rows, "left")
    return order[np.arange(len(order)) - begin < most]


def _meetings(packing: Packing, anchors: pa.Table, candidates: pa.Table, settings: Settings) -> Iterator[tuple]:
    """(anchor rows, ids and labels of the candidates, scores, equal row) of one block product after another."""
    vectors = matrix(anchors.column("q"), packing.size)
    at_once = max(1, CELLS // max(1, settings.candidate_rows))
    for begin in range(0, len(candidates), settings.candidate_rows):
        part = candidates.slice(begin, settings.candidate_rows)
        own = matrix(part.column("q"), packing.size)
        packed, sums = packing.pack(own), own.astype(object if not packing.exact else np.int64).sum(axis=1)
        ids, labels, uids = (part.column(c).to_numpy() for c in ("vec_id", "label", "uid"))
        for low in range(0, len(vectors), at_once):
            rows = np.arange(low, min(low + at_once, len(vectors)))
            yield rows, ids, labels, uids, packing.scores(vectors[rows], packed, sums)


def best_positives(packing: Packing, settings: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``uid, positive_id, positive_score``: the anchors' best rows of their label among these candidates, themselves aside."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        own_uid, own_label = (anchors.column(c).to_numpy() for c in ("uid", "label"))
        found: list[tuple[np.ndarray, ...]] = []
        for rows, ids, labels, uids, scores in _meetings(packing, anchors, candidates, settings):
            r, c = np.nonzero((labels[None, :] == own_label[rows][:, None]) & (uids[None, :] != own_uid[rows][:, None]))
            s = scores[r, c]
            keep = _first(np.lexsort((ids[c], -s, r)), r, settings.positives)
            found.append((rows[r[keep]], ids[c[keep]], s[keep]))
        r, i, s = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*found)) or [[], [], []]))
        keep = _first(np.lexsort((i, -s, r)), r, settings.positives)
        return pa.table({"uid": own_uid[r[keep]], "positive_id": i[keep], "positive_score": s[keep]})

    return run


def first_negatives(packing: Packing, settings: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``uid, place, negative_id, negative_score``: the best rows of other labels within the bounds of each positive of the anchors."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        own_uid, own_label = (anchors.column(c).to_numpy() for c in ("uid", "label"))
        positives = anchors.column("positives").to_pylist()
        depth = settings.positives
        low, high = np.ones((len(anchors), depth), dtype=np.int64), np.zeros((len(anchors), depth), dtype=np.int64)
        for row, scores in enumerate(positives):
            for k, score in enumerate(scores):
                low[row, k], high[row, k] = -(-settings.low * score // 100), settings.high * score // 100
        least = np.where((low <= high).any(axis=1), np.where(low <= high, low, np.iinfo(np.int64).max).min(axis=1), np.iinfo(np.int64).max)
        most = np.where(low <= high, high, np.iinfo(np.int64).min).max(axis=1)
        found: list[tuple[np.ndarray, ...]] = []
        for rows, ids, labels, _, scores in _meetings(packing, anchors, candidates, settings):
            near = (scores >= least[rows][:, None]) & (scores <= most[rows][:, None]) & (labels[None, :] != own_label[rows][:, None])
            r, c = np.nonzero(near)
            s = scores[r, c]
            order = np.lexsort((ids[c], -s, r))
            for k in range(depth):
                inside = order[(s[order] >= low[rows[r[order]], k]) & (s[order] <= high[rows[r[order]], k])]
                keep = _first(inside, r, settings.negatives)
                found.append((rows[r[keep]], np.full(len(keep), k), ids[c[keep]], s[keep]))
        r, k, i, s = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*found)) or [[], [], [], []]))
        slot = r * depth + k
        keep = _first(np.lexsort((i, -s, slot)), slot, settings.negatives)
        return pa.table({"uid": own_uid[r[keep]], "place": k[keep].astype(np.int32), "negative_id": i[keep], "negative_score": s[keep]})

    return run


def quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(embedding: Column, label: Column, key: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return label.isNotNull() & key.isNotNull() & embedding.isNotNull() & finite


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding", label: Column | None = None
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows for which ``is_anchor`` holds.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Rows equal in id, label and quantised
    vector are one; rows that share an id only are rows of their own, and the results of anchors of one id are put together.
    Scores are integers; higher ones come first, ties by the smaller id. A shorter vector counts as filled up with zeros. An anchor without
    positives, or a positive without negatives within its bounds, has no row; without rows the result is empty. ``is_anchor`` and
    ``label`` may use the table's columns; no other columns are read. A score beyond 64 bits is an error of the caller's scale.
    """
    spark = rows.sparkSession
    ship(spark)
    label = F.col("label") if label is None else label
    own = rows.where(usable(F.col(vector), label, F.col(key))).select(
        F.col(key).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), quantised(F.col(vector), settings.scale).alias("q"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    with Scratch(spark) as scratch:
        own = own.groupBy("vec_id", "label", "q").agg(F.max("anchor").alias("anchor"))
        own = scratch.write(own.withColumn("uid", F.monotonically_increasing_id()), "hard-rows")
        largest = F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))))
        n, n_anchors, size, largest = own.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("q")), largest).first()
        packing = Packing.of(largest or 0, size or 0)
        group_rows = max(256, min(settings.candidate_rows * settings.blocks_per_task, GROUP_CELLS // max(1, size or 0)))
        groups = max(1, -(-n // group_rows))
        anchor_blocks = max(1, -(-n_anchors // settings.anchor_rows))

        # An anchor block meets every group of candidates: a grid of (anchor block, group), one task's work each.
        def dealt(df: DataFrame, own_key: str, own_n: int, other_key: str, other_n: int) -> DataFrame:
            placed = df.withColumn(own_key, F.pmod(F.xxhash64("uid"), F.lit(own_n)))
            return placed.withColumn(other_key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_n - 1).cast("bigint"))))

        candidates = dealt(own.drop("anchor"), "part", groups, "block", anchor_blocks).groupBy("block", "part")

        def meet(anchors: DataFrame, function: Callable, schema: str) -> DataFrame:
            return dealt(anchors, "block", anchor_blocks, "part", groups).groupBy("block", "part").cogroup(candidates).applyInArrow(function, schema)

        anchors = own.where("anchor").drop("anchor")
        best = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
        positives = meet(anchors, best_positives(packing, settings), "uid bigint, positive_id bigint, positive_score bigint")
        positives = positives.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < settings.positives)
        positives = scratch.write(positives, "hard-positives")
        scores = positives.groupBy(F.col("uid").alias("of")).agg(
            F.array_sort(F.collect_list(F.struct("place", "positive_score"))).getField("positive_score").alias("positives")
        )
        bounded = scratch.write(anchors.join(scores, F.col("uid") == F.col("of")).drop("of"), "hard-anchors")
        negatives = meet(bounded, first_negatives(packing, settings), "uid bigint, place int, negative_id bigint, negative_score bigint")
        ranked = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id")
        negatives = negatives.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= settings.negatives)
        names = own.where("anchor").select("uid", F.col("vec_id").alias("anchor_id"))
        out = negatives.join(positives, ["uid", "place"]).join(names, "uid")
        return scratch.keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
