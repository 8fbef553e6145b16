"""Merkle manifest of a table: a tree per group over its rows and a tree over the groups, kept as a log in postorder.

A tree joins every ``fanout`` consecutive nodes of a level (the last run may be shorter, even one node) until one node is left.
Builders take aligned blocks of ``fanout ** levels`` nodes, each a subtree of its own, and append the nodes to the log in the
order in which they are completed: children before parents. The place of a node in the log of its tree follows from sizes
of subtrees alone (``place``), so proofs address siblings without a search. Large trees take several rounds, each over the tops of
the blocks before; proofs go the other way, from the top round down, and every block gets the path above it as one row. So no
task holds more than a block, whatever the size of a group, and no node near a root is asked for more than once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm.scratch import Scratch, ship, tasks_for
from surveyloom.session import scratch_path

TOP = -1  # the tree over the groups; the others are numbered from 0 in the order of their groups
LOG = "tree bigint, place bigint, level int, node bigint, n bigint, digest string"
STEPS = "array<struct<slot:int,siblings:array<string>>>"
PATHS = f"tree bigint, block bigint, subroot string, steps {STEPS}"
LEAVES = "tree bigint, node bigint, key bigint, leaf string, claim string"
STEP_TYPE = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))


@dataclass(frozen=True)
class Shape:
    fanout: int = 16
    levels: int = 3

    @property
    def block(self) -> int:
        return self.fanout**self.levels

    def height(self, n: int) -> int:
        """Levels above the leaves of a tree of n leaves; a lone leaf is its own root."""
        height = 0
        while n > 1:
            n, height = -(-n // self.fanout), height + 1
        return height

    def place(self, level: int, node: int, n: int) -> int:
        """Position of a node in the postorder log of its tree: the nodes completed before its first leaf, then its own subtree."""
        width = self.fanout**level
        first = node * width
        leaves = min(first + width, n) - first
        before = sum(first // self.fanout**j for j in range(self.height(n) + 1))
        return before + sum(-(-leaves // self.fanout**j) for j in range(level + 1)) - 1


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(leaf: str, steps: Sequence[dict]) -> str:
    """Root that a leaf and its siblings, level by level, give."""
    for step in steps:
        siblings = step["siblings"]
        leaf = joined([*siblings[: step["slot"]], leaf, *siblings[step["slot"] :]])
    return leaf


def append_block(shape: Shape, base: int) -> Callable[[pa.Table], pa.Table]:
    """Builder of one aligned block of nodes of level ``base``: the log entries of its subtree as they are completed.

    Above level 0 the block's own nodes are in the log already, as tops of the blocks below.
    """

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        tree, n, first = (block.column(c)[0].as_py() for c in ("tree", "n", "node"))
        top = min(base + shape.levels, shape.height(n))
        waiting: dict[int, list[str]] = {level: [] for level in range(base, top + 1)}
        following = {level: first // shape.fanout ** (level - base) for level in waiting}
        out: dict[str, list] = {"place": [], "level": [], "node": [], "digest": []}

        def complete(level: int, digest: str) -> None:
            if level > base or not base:
                for name, value in zip(out, (shape.place(level, following[level], n), level, following[level], digest)):
                    out[name].append(value)
            following[level] += 1
            waiting[level].append(digest)
            if level < top and len(waiting[level]) == shape.fanout:
                close(level)

        def close(level: int) -> None:
            run, waiting[level] = waiting[level], []
            complete(level + 1, joined(run))

        for digest in block.column("digest").to_pylist():
            complete(base, digest)
        for level in range(base, top):
            if waiting[level]:
                close(level)
        rows = len(out["place"])
        return pa.table({
            "tree": pa.array([tree] * rows, pa.int64()), "place": pa.array(out["place"], pa.int64()), "level": pa.array(out["level"], pa.int32()),
            "node": pa.array(out["node"], pa.int64()), "n": pa.array([n] * rows, pa.int64()), "digest": pa.array(out["digest"], pa.string()),
        })

    return build


def _block_proofs(shape: Shape, base: int, block: pa.Table):
    """(node, digest, steps to the root, subroot) of the nodes of level ``base`` in one block."""
    kind = block.column("kind").to_pylist()
    at = kind.index("path")
    above, subroot = block.column("steps")[at].as_py(), block.column("subroot")[at].as_py()
    entries = [(p, d, n) for k, p, d, n in zip(kind, *(block.column(c).to_pylist() for c in ("place", "digest", "n"))) if k == "log"]
    log, n = {place: digest for place, digest, _ in entries}, entries[0][2]
    number = block.column("block")[0].as_py()
    top = min(base + shape.levels, shape.height(n))
    first = number * shape.block
    for node in range(first, min(first + shape.block, -(-n // shape.fanout**base))):
        steps, own = [], node
        for level in range(base, top):
            width, run = -(-n // shape.fanout**level), own - own % shape.fanout
            others = [j for j in range(run, min(run + shape.fanout, width)) if j != own]
            steps.append({"slot": own - run, "siblings": [log[shape.place(level, j, n)] for j in others]})
            own //= shape.fanout
        yield node, log[shape.place(base, node, n)], steps + above, subroot


def extend_paths(shape: Shape, base: int) -> Callable[[pa.Table], pa.Table]:
    """Paths of the blocks below, one for each node of this block. In the tree of the groups a node is a subroot."""

    def run(block: pa.Table) -> pa.Table:
        tree = block.column("tree")[0].as_py()
        found = list(_block_proofs(shape, base, block))
        trees = [node if tree == TOP and not base else tree for node, *_ in found]
        blocks = [0 if tree == TOP and not base else node for node, *_ in found]
        subroots = [digest if tree == TOP and not base else subroot for _, digest, _, subroot in found]
        return pa.table({
            "tree": pa.array(trees, pa.int64()), "block": pa.array(blocks, pa.int64()), "subroot": pa.array(subroots, pa.string()),
            "steps": pa.array([steps for _, _, steps, _ in found], STEP_TYPE),
        })

    return run


def leaf_proofs(shape: Shape, digest: bool) -> Callable[[pa.Table], pa.Table]:
    """Proof of every leaf of a block, or its digest and the root that the claimed leaf folds to."""

    def run(block: pa.Table) -> pa.Table:
        proofs = {node: found for node, *found in _block_proofs(shape, 0, block)}
        names = ("kind", "node", "key", "leaf", "claim")
        rows = [r for r in zip(*(block.column(c).to_pylist() for c in names)) if r[0] == "leaf"]
        own = [proofs[node] for _, node, *_ in rows]
        out = {
            "key": pa.array([r[2] for r in rows], pa.int64()), "leaf": pa.array([leaf for leaf, _, _ in own], pa.string()),
            "subroot": pa.array([subroot for *_, subroot in own], pa.string()),
        }
        if digest:
            flat = ["".join(s for step in steps for s in step["siblings"]) for _, steps, _ in own]
            out["proof_sha256"] = pa.array([joined([x]) for x in flat], pa.string())
            out["folded_root"] = pa.array([fold(r[4], steps) for r, (_, steps, _) in zip(rows, own)], pa.string())
        else:
            out["steps"] = pa.array([steps for _, steps, _ in own], STEP_TYPE)
        return pa.table(out)

    return run


@dataclass
class Manifest:
    """``log``: ``tree, place, level, node, n, digest``; ``leaves``: ``tree, node, key, leaf, claim``; ``root`` is null without rows."""

    log: DataFrame
    leaves: DataFrame
    trees: DataFrame
    largest: int
    groups: int
    root: str | None
    shape: Shape


def field(value: Column) -> Column:
    """Null as ``-``, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(df: DataFrame, scratch: Scratch, name: str, group: str | None, order: Sequence[str]) -> DataFrame:
    """``df`` with ``node``, the row's number from 0 in its group, and ``n``, the group's size. Groups may be of any size.

    Rows are range-partitioned and sorted; each (group, range) counts for itself, and the counts are chained.
    """
    keys = [*([group] if group else []), *order]
    ranges = df.repartitionByRange(tasks_for(df), *keys).sortWithinPartitions(*keys)
    placed = scratch.write(ranges.withColumn("at", F.monotonically_increasing_id()), name)
    own = F.col(group) if group else F.lit(0)
    placed = placed.withColumn("range", F.shiftright("at", 33))
    pieces = placed.groupBy(own.alias("of"), "range").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    chained = pieces.select(
        "of", F.col("range").alias("part"), "begin", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy("of")).alias("n"),
    )
    chained = scratch.write(chained, f"{name}-pieces")
    joined_rows = placed.join(chained, (F.col("range") == F.col("part")) & own.eqNullSafe(F.col("of")))
    return joined_rows.select(*df.columns, (F.col("at") - F.col("begin") + F.col("offset")).alias("node"), "n")


def _grown(spark: SparkSession, nodes: DataFrame, path: str, shape: Shape, largest: int) -> DataFrame:
    """Append all levels above ``tree, node, n, digest`` to the log at ``path``, one round for every ``levels`` levels."""
    base, height = 0, shape.height(largest)
    while base == 0 or base < height:
        blocks = nodes.withColumn("block", F.floor(F.col("node") / F.lit(shape.block)).cast("bigint")).groupBy("tree", "block")
        blocks.applyInArrow(append_block(shape, base), LOG).write.parquet(f"{path}/round={base // shape.levels}")
        base += shape.levels
        done = spark.read.schema(LOG).parquet(f"{path}/round={base // shape.levels - 1}")
        # A tree of one node on this level is complete.
        nodes = done.where((F.col("level") == base) & (F.col("n") > F.lit(shape.fanout**base))).select("tree", "node", "n", "digest")
    return spark.read.schema(f"{LOG}, round int").parquet(path)


def build_manifest(
    rows: DataFrame, key: Column, group: Column, values: Sequence[Column], claim: Column | None = None, shape: Shape = Shape()
) -> Manifest:
    """Manifest of a table: leaves are the digests of ``values``, in ascending order of ``key`` (null first), one tree per ``group``.

    ``claim`` is another digest of the row that is carried along, to be checked against the manifest; the leaf itself if not
    given. Rows with the same key follow by their leaf; equal rows are leaves of their own with equal digests. A null group
    is a group, before all others. Null and empty values differ. A table without rows has a log without rows and no root. Only the columns
    named are read.
    """
    spark = rows.sparkSession
    ship(spark)
    leaf = row_digest(values)
    own = rows.select(
        group.cast("string").alias("group"), key.cast("bigint").alias("key"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim")
    )
    with Scratch(spark) as scratch:
        placed = scratch.write(numbered(own, scratch, "merkle-rows", "group", ["key", "leaf"]), "merkle-placed")
        sizes = scratch.write(placed.groupBy("group").agg(F.max("n").alias("leaves")), "merkle-groups")
        trees = numbered(sizes, scratch, "merkle-trees", None, ["group"]).withColumnsRenamed({"group": "name", "node": "tree", "n": "groups"})
        trees = scratch.keep(trees, "merkle-trees")
        largest, groups = trees.agg(F.max("leaves"), F.count(F.lit(1))).first()
        leaves = placed.join(trees.select("name", "tree"), F.col("group").eqNullSafe(F.col("name")))
        leaves = scratch.keep(leaves.select("tree", "node", "key", "leaf", "claim", "n"), "merkle-leaves")
        path = scratch_path(spark, "merkle-log")
        log = _grown(spark, leaves.select("tree", "node", "n", F.col("leaf").alias("digest")), f"{path}/groups", shape, largest or 0)
        roots = log.where(_is_root(shape))
        tops = roots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("node"), F.lit(groups).cast("bigint").alias("n"), "digest")
        top = _grown(spark, tops, f"{path}/top", shape, groups)
        root = top.where(_is_root(shape)).select("digest").first()
    return Manifest(log.unionByName(top), leaves, trees, largest or 0, groups, root and root["digest"], shape)


def _is_root(shape: Shape) -> Column:
    """The log has no level above the root, so the root is the node that covers all leaves."""
    return F.pow(F.lit(float(shape.fanout)), F.col("level")) >= F.col("n")


def prove(manifest: Manifest, digest: bool = False) -> DataFrame:
    """``key, leaf, subroot, steps`` per row: the siblings on each level up to the root, and the row's slot among them.

    ``digest``: instead of the steps ``proof_sha256``, the hash of all siblings in order, and ``folded_root``, the root that the
    carried claim folds to with them.
    """
    shape, log = manifest.shape, manifest.log
    spark = log.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], PATHS)
    result = f"key bigint, leaf string, subroot string, {'proof_sha256 string, folded_root string' if digest else f'steps {STEPS}'}"

    def segments(base: int, entries: DataFrame, paths: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
        """Everything a block needs, under its number: its log entries, the path above it, and its rows."""
        cells = {
            "place": "bigint", "digest": "string", "n": "bigint", "subroot": "string", "steps": STEPS, "node": "bigint", "key": "bigint",
            "leaf": "string", "claim": "string",
        }
        block = F.lit(0)
        for level in range(base, base + shape.levels):
            width = shape.fanout ** (base + shape.levels - level)
            block = F.when(F.col("level") == level, F.expr(f"node div {width}")).otherwise(block)
        used = entries.where(F.col("level").between(base, base + shape.levels - 1))
        used = used.where(F.col("n") > F.lit(shape.fanout**base)) if base else used  # else the tree has no such round
        sides = [("log", used.withColumn("block", block), {"place", "digest", "n"}), ("path", paths, {"subroot", "steps"})]
        if leaves is not None:
            sides.append(("leaf", leaves.withColumn("block", F.expr(f"node div {shape.block}")), {"node", "key", "leaf", "claim"}))
        out = None
        for kind, df, names in sides:
            columns = [(F.col(c) if c in names else F.lit(None)).cast(t).alias(c) for c, t in cells.items()]
            part = df.select("tree", F.col("block").cast("bigint").alias("block"), F.lit(kind).alias("kind"), *columns)
            out = part if out is None else out.unionAll(part)
        return out

    def tops(base: int, trees: DataFrame, n: str) -> Column:
        """The tree's highest round starts at this level."""
        low, high = F.lit(shape.fanout**base), F.lit(shape.fanout ** (base + shape.levels))
        return (F.col(n) <= high) if not base else (F.col(n) > low) & (F.col(n) <= high)

    def descend(entries: DataFrame, starts: DataFrame, largest: int, lowest: int) -> DataFrame:
        """Paths of the blocks of round 0 (or, with ``lowest`` 0, the rows of it) from those of the trees' tops."""
        paths, base = empty, max(0, (shape.height(largest) - 1) // shape.levels * shape.levels)
        while base >= lowest:
            here = paths.unionAll(starts.where(tops(base, starts, "n")).select("tree", "block", "subroot", "steps"))
            paths = segments(base, entries, here).groupBy("tree", "block").applyInArrow(extend_paths(shape, base), PATHS)
            base -= shape.levels
        return paths.unionAll(starts.where(tops(0, starts, "n")).select("tree", "block", "subroot", "steps")) if lowest else paths

    if not manifest.groups:
        return spark.createDataFrame([], result)
    with Scratch(spark) as scratch:
        of_top = F.col("tree") == TOP
        start = spark.createDataFrame([(TOP, 0, None, [], manifest.groups)], f"{PATHS}, n bigint")
        above = scratch.write(descend(log.where(of_top), start, manifest.groups, 0), "merkle-top-paths")
        sizes = manifest.trees.select("tree", F.col("leaves").alias("n"))
        starts = above.join(sizes, "tree").select("tree", "block", "subroot", "steps", "n")
        paths = scratch.write(descend(log.where(~of_top), starts, manifest.largest, shape.levels), "merkle-paths")
        whole = segments(0, log.where(~of_top), paths, manifest.leaves)
        return scratch.keep(whole.groupBy("tree", "block").applyInArrow(leaf_proofs(shape, digest), result), "merkle-proofs")
