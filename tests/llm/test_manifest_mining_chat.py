"""Merkle manifest, hard negatives and chat formatting against brute force, and on odd tables."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
from checks.compare import differences, duck
from surveyloom.llm import chat_format, hard_negatives, merkle
from surveyloom.llm.queries import EXTRA_CHAT, ORACLES
from surveyloom.session import scratch_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NEW = ("op11_merkle_manifest", "op12_hard_negatives", "op13_chat_format")


@pytest.mark.parametrize("name", NEW)
def test_matches_sql(spark, sf_dir, name):
    mine = driver.queries()[name](spark, sf_dir).toPandas()
    assert differences(mine, duck(sf_dir).execute(ORACLES[name]).df()) == []


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = i - i % fanout
        out.append([d for j, d in enumerate(level[run : run + fanout], run) if j != i])
        i //= fanout
    return out


def brute_manifest(rows, fanout):
    """{(key, leaf): (subroot, root, flat siblings)} for rows (doc_id, source, lang, n_chars, text)."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0], leaf_of(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [grow([leaf for _, leaf in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for g in names]
    top = grow([t[-1][0] for t in trees], fanout)
    out = []
    for g, (name, tree) in enumerate(zip(names, trees)):
        ordered = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        for i, (key, leaf) in enumerate(ordered):
            proof = siblings(tree, i, fanout) + siblings(top, g, fanout)
            out.append((key, leaf, tree[-1][0], top[-1][0], [d for run in proof for d in run]))
    return out


def manifest_of(df, **more):
    values = [F.col(c) for c in FIELDS]
    return merkle.build_manifest(df, F.col("doc_id"), F.col("source"), values, **more)


def check_manifest(df, shape):
    rows = [tuple(r) for r in df.select(*FIELDS).collect()]
    manifest = manifest_of(df, shape=shape)
    found = merkle.prove(manifest).collect()
    mine = [(r["key"], r["leaf"], r["subroot"], manifest.root, [d for s in r["steps"] for d in s["siblings"]]) for r in found]
    assert sorted(mine, key=repr) == sorted(brute_manifest(rows, shape.fanout), key=repr)
    assert all(merkle.fold(r["leaf"], r["steps"]) == manifest.root for r in found)
    return manifest


def sequential_log(shape, n):
    """(level, node) in the order in which one builder over all leaves completes them."""
    height, out = shape.height(n), []
    waiting, following = [0] * (height + 1), [0] * (height + 1)

    def complete(level):
        out.append((level, following[level]))
        following[level] += 1
        waiting[level] += 1
        if level < height and waiting[level] == shape.fanout:
            waiting[level] = 0
            complete(level + 1)

    for _ in range(n):
        complete(0)
    for level in range(height):
        if waiting[level]:
            waiting[level] = 0
            complete(level + 1)
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_places_are_the_order_of_completion(fanout):
    shape = merkle.Shape(fanout, 2)
    for n in [*range(1, 70), 255, 256, 257, 4097]:
        for place, (level, node) in enumerate(sequential_log(shape, n)):
            assert shape.place(level, node, n) == place


def test_manifest_of_odd_rows(edges):
    check_manifest(edges, merkle.Shape())


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 2), (16, 1)])
def test_manifest_in_many_rounds(spark, fanout, levels):
    """Trees of 1 to 300 rows, heights of up to nine levels, so that blocks take several rounds up and down."""
    rows = [(i, f"s{g}", None, i * g, f"text {i}") for g, n in enumerate([1, 2, 3, 9, 10, 65, 300]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    shape = merkle.Shape(fanout, levels)
    manifest = check_manifest(df, shape)
    sizes = {r["tree"]: r["leaves"] for r in manifest.trees.collect()} | {merkle.TOP: 7}
    log = collections.defaultdict(list)
    for r in manifest.log.collect():
        log[r["tree"]].append((r["place"], r["level"], r["node"]))
    assert {t: [x[1:] for x in sorted(v)] for t, v in log.items()} == {t: sequential_log(shape, n) for t, n in sizes.items()}


def test_manifest_finds_claims_that_differ(spark):
    rows = [(i, "a", "en", 1, f"Text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    values = [F.col(c) for c in FIELDS[:-1]]
    claim = F.when(F.col("doc_id") % 7 == 0, merkle.row_digest([*values, F.lower("text")])).otherwise(merkle.row_digest([*values, F.col("text")]))
    manifest = manifest_of(df, claim=claim)
    found = merkle.prove(manifest, digest=True).collect()
    assert {r["key"] for r in found if r["folded_root"] != manifest.root} == set(range(0, 40, 7))


def test_manifest_of_nothing(nothing):
    manifest = manifest_of(nothing)
    assert manifest.root is None and manifest.log.count() == 0
    assert merkle.prove(manifest).count() == 0 and merkle.prove(manifest, digest=True).columns[-1] == "folded_root"


# hard negatives


def brute_negatives(rows, is_anchor, most=hard_negatives.Settings()):
    rows = {(i, lab, tuple(int(np.floor(256 * np.float64(x))) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in (r for r in rows if is_anchor(r[0])):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r != a))
        for s, p, _ in [x for x in scored if x[2] == a[1]][: most.positives]:
            near = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][: most.negatives]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, size, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    return [(int(i), [float(x) for x in scale * (rng.normal(size=size) * 0.7 + centres[i % 4])], int(i % 3)) for i in range(n)]


VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("scale", [1.0, 1e6])  # the second needs more than 53 bits
def test_negatives_against_brute_force(spark, scale):
    rows = vectors(3, 120, 6, scale)
    few = hard_negatives.Settings(anchor_rows=7, candidate_rows=16, blocks_per_task=2)
    mine = hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, few)
    assert sorted(tuple(r) for r in mine.collect()) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_odd_rows(spark):
    rows = vectors(5, 40, 4)
    rows += [(None, [1.0] * 4, 1), (41, None, 1), (42, [1.0, None, 1.0, 1.0], 1), (43, [float("nan")] * 4, 0), (44, [float("inf")] * 4, 0), (45, [0.5] * 4, None)]
    rows += [(50, [0.0] * 4, 1), (55, [], 1), (60, [0.25, 0.25], 2), (65, [2.0, 1.0, 1.0, 1.0, 3.0], 0)]  # zero, empty, short, long
    rows += [rows[5], rows[5], (10, [1.0, 2.0, 0.5, 0.5], 1), (10, [1.0, 2.0, 0.5, 0.5], 2)]  # repeated row; ids used twice
    rows += [(100 + i, [1.0, 1.0, 0.0, 0.0], i % 2) for i in range(12)]  # ties
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{VECTORS}, uid string, score string")
    mine = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in mine.collect()) == brute_negatives(rows, lambda i: i % 5 == 0)
    empty = hard_negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0)
    assert empty.count() == 0 and empty.columns == mine.columns
    assert hard_negatives.mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("largest, size", [(1, 1), (3, 7), (256, 64), (10**6, 64), (10**8, 300)])
def test_packed_products_are_exact(largest, size):
    rng = random.Random(largest)
    a, c = ([[rng.randint(-largest, largest) for _ in range(size)] for _ in range(n)] for n in (3, 8))
    a[0], c[0], c[1] = [largest] * size, [largest] * size, [-largest] * size
    packing = hard_negatives.Packing.of(largest, size)
    found = packing.scores(np.array(a), packing.pack(np.array(c)), np.array([sum(v) for v in c]))
    assert found.tolist() == [[sum(x * y for x, y in zip(u, v)) for v in c] for u in a]


def test_vectors_of_other_lengths_are_filled_up():
    column = pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))
    assert hard_negatives.matrix(column, 2).tolist() == [[1, 2], [0, 0], [3, 0]]


# chat formatting

PARTS = st.sampled_from(["\\", "###", " ", "### ", "</turn>", "\n", ":", "a", "### user:\n", "\n</turn>\n", "é", "日"])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@hypothesis_settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
def test_formatted_turns_come_back(turns):
    formatted, found = chat_format.format_turns(turns)
    assert [(t.role, t.text) for t in chat_format.parse(formatted)] == turns
    assert [chat_format.unescape(formatted[t.start : t.stop]) for t in found] == [text for _, text in turns]


def test_plain_text_is_not_changed():
    formatted, _ = chat_format.format_turns([("user", "a \\ b"), ("assistant", "# c")])
    assert formatted == "### user:\na \\ b\n</turn>\n### assistant:\n# c\n</turn>\n"
    assert "\\\\### Assistant: \\</turn> ok" in chat_format.format_turns([("user", EXTRA_CHAT)])[0]


@pytest.mark.parametrize("text", ["x", "### user\nx\n</turn>\n", "### user:\nx", "### user:\nx\n</turn>", "### user:\nx</turn>\n", "### a:\nb\n### c:\nd\n</turn>\n"])
def test_other_text_is_refused(text):
    with pytest.raises(chat_format.FormatError):
        chat_format.parse(text)


def brute_chats(rows):
    chats = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        chats[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, turns in chats.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), sha(*[f"{r}\n{t}\n" for r, t in turns]), len(loss), sha(loss))
    return out


def test_chats_of_odd_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "</turn>" * (i % 3)) for i in range(400)]  # one long conversation
    rows += [(2, 0, None, None), (2, None, "assistant", ""), (2, 1, "assistant", EXTRA_CHAT), (2, 1, "assistant", EXTRA_CHAT), (2, 1, "a:\\\n", "z")]
    rows += [(None, 3, "assistant", "é" * 5000), (None, None, "user", "\n"), (3, 0, "assistant", "w ### " * 40_000)]
    df = spark.createDataFrame([(*r, "part", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, piece int")
    path = chat_format.write_chats(df.repartition(4), scratch_path(spark, "chats"))
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.chat_digests(spark, path).collect()}
    assert found == brute_chats(rows)
    turns = chat_format.read_turns(spark, path).where("conv_id = 1").orderBy("part", "piece", "place").collect()
    assert [(r["role"], r["text"], r["learned"]) for r in turns] == [(r, t, r == "assistant") for _, _, r, t in rows[:400]]
    nothing = chat_format.write_chats(df.limit(0), scratch_path(spark, "chats"))
    assert chat_format.chat_digests(spark, nothing).count() == 0 and chat_format.read_turns(spark, nothing).count() == 0


def test_long_conversations_are_cut_into_pieces():
    rows = [{"conv_id": 1, "role": "user", "text": "x" * 300_000} for _ in range(10)]
    pieces = list(chat_format._pieces(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [len(turns) for _, turns in pieces] == [4, 4, 2]
