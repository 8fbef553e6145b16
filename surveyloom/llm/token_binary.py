"""Token ids of a corpus as entropy-coded binary blocks, and back.

A data set is a folder with three tables. ``frequencies (token, freq)`` is the shared static model. ``blocks (part, block, n_docs, n_tokens,
doc_ids, lengths, payload)`` holds the ids: parts in ascending order of document id, each a task's range, cut into blocks
of whole documents; ``payload`` is the byte layout of ``ans.py``. ``starts (part, block, start)`` has the number of ids
before each block. Every block decodes by itself, in any task, and from checkpoints inside. Spark's own writer commits the files, so
a lost or repeated task leaves none behind.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm import ans
from surveyloom.llm.scratch import Scratch, documents, ship, tasks_for
from surveyloom.llm.text import hash_ranges, slices

CACHE_PIECES = 1_500_000  # pieces of text whose ids a worker remembers, some 30 bytes each; then it starts anew
TOGETHER = 1000  # new pieces that the library gets as one text
SLICE_BYTES = 2_000_000
SIDE_BY_SIDE = 3_000_000  # tokens that a task holds to encode at once


@dataclass(frozen=True)
class Settings:
    end_id: int = 0
    block_tokens: int = 65_536


SPACE, BREAK, MARKS = ord(" "), ord("\n"), (ord(","), ord("."))
# Last and next to last bytes that white space beyond ASCII may have; other characters with such bytes are only cut less often.
TAIL, BEFORE_TAIL = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
TAIL[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
BEFORE_TAIL[[0xC2, 0x80, 0x81, 0x9A]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces: of each text that is not empty, of spaces and line breaks after something that is no white space, and of a
    , or . between a letter and such a place.
    """
    cut = (data == SPACE) | (data == BREAK)
    cut[1:] &= data[:-1] > 0x20
    cut[2:] &= ~(TAIL[data[1:-1]] & BEFORE_TAIL[data[:-2]])
    begins = offsets[:-1][np.diff(offsets) > 0]
    cut[begins] = True
    before_cut = np.append(cut[1:], True)
    before_cut &= ~cut & ((data == MARKS[0]) | (data == MARKS[1]))
    before_cut[1:] &= LETTER[data[:-1]]
    return np.flatnonzero(cut | before_cut)


class Encoder:
    """A tokenizer with a memory of pieces.

    Byte-level pre-tokenizers never join a character with a space or line break after it, so a text may be cut before a space or
    line break that follows something else than white space, and equal pieces have equal ids; a letter before a final , or . ends a
    pre-token too. The library sees each new piece once. Where the rule does not hold (another pre-tokenizer, a normaliser, a special
    token in the text), it gets the whole text. Pieces are told apart by two hashes of 64 bits each; texts with pieces that
    agree in one of them only go to the library whole. What is remembered are arrays: hashes in ascending order, and places in one pool of ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        before = state.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = plain and not state.get("normalizer") and not state.get("post_processor")
        self.special = [t["content"].encode() for t in state.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._forget()
        self.bytes_of = np.zeros(self.size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)  # byte-level vocabularies write each byte as one character

    def _forget(self) -> None:
        self.known, self.check = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.begin, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(0, dtype=self.kind)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = self._library([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
        return np.concatenate([np.zeros(0, self.kind), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and numbers of ids, of pieces that may follow each other in a text: coded as texts, told apart by the bytes that tokens stand for."""
        ids, lengths = [], []
        for i in range(0, len(starts), TOGETHER):
            first, size = starts[i : i + TOGETHER], ends[i : i + TOGETHER] - starts[i : i + TOGETHER]
            upto = np.cumsum(size)
            joined = data[np.repeat(first - upto + size, size) + np.arange(upto[-1])]
            ids.append(self._library([joined.tobytes().decode()])[0])
            places = np.searchsorted(np.cumsum(self.bytes_of[ids[-1]]), upto) + 1
            lengths.append(np.diff(places, prepend=0))
        return ids, lengths

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Remember the ids of new pieces; ``one`` ascends."""
        head, last = data[starts], data[ends - 1]
        joins = ((head == SPACE) | (head == BREAK)) & (last > 0x20) & ~(TAIL[last] & BEFORE_TAIL[data[ends - 2]])
        alone = ~joins
        ids, lengths = self._together(data, starts[joins], ends[joins])
        more = self._library([data[a:b].tobytes().decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist())])
        length = np.zeros(len(one), dtype=np.int32)
        length[joins] = np.concatenate([np.zeros(0, dtype=np.int64), *lengths])
        length[alone] = [len(x) for x in more]
        in_pool = np.concatenate([np.flatnonzero(joins), np.flatnonzero(alone)])
        begin = np.zeros(len(one), dtype=np.int64)
        begin[in_pool] = np.cumsum(length[in_pool]) - length[in_pool] + len(self.pool)
        at = np.searchsorted(self.known, one)
        self.known, self.check = np.insert(self.known, at, one), np.insert(self.check, at, two)
        self.begin, self.length = np.insert(self.begin, at, begin), np.insert(self.length, at, length)
        self.pool = np.concatenate([self.pool, *ids, *more])

    def _found(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash among the known ones, whether it is there)."""
        at = np.searchsorted(self.known, one)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == one[there]
        return at, there

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins); texts are data[offsets[i]:offsets[i + 1]]."""
        raw = data.tobytes()
        n = len(offsets) - 1
        if not self.cuts or any(s in raw for s in self.special):
            return self._whole(raw, offsets)
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(n + 1, dtype=np.int64)
        if len(self.known) > CACHE_PIECES:
            self._forget()
        starts = cut_places(data, offsets)
        ends = np.append(starts[1:], len(data))
        one, two = (hash_ranges(data, starts, ends, fold=f) for f in (False, None))
        which, distinct = pd.factorize(one)
        order = np.argsort(distinct)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        which, distinct = rank[which], distinct[order]
        first = np.zeros(len(distinct), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        at, there = self._found(distinct)
        if (two != two[first][which]).any() or (self.check[at[there]] != two[first[there]]).any():  # two pieces with one hash
            return self._whole(raw, offsets)
        if not there.all():
            new = first[~there]
            self._learn(data, starts[new], ends[new], distinct[~there], two[new])
            at = np.searchsorted(self.known, distinct)
        size = self.length[at][which]
        upto = np.cumsum(size, dtype=np.int64)
        out = self.pool[np.repeat(self.begin[at][which] - upto + size, size) + np.arange(upto[-1])]
        return out, np.append(upto - size, upto[-1])[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(path: str, end_id: int):
    """Ids of each document with the end id, packed with zstandard for the way through the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        coder = encoder(path)
        end = np.array([end_id], dtype=coder.kind)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                flat, bounds = coder.encode_slice(data, offsets)
                ids = [np.concatenate([flat[a:b], end]) for a, b in zip(bounds[:-1], bounds[1:])]
                columns = [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(np.diff(bounds) + 1),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([packer.compress(x) for x in ids], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "tie", "ids"])

    return run


def histogram(kind: str, size: int):
    """Counts of every token over all documents of the task; one row per token seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        unpacker = zstandard.ZstdDecompressor()
        held, parts = 0, []
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                parts.append(unpacker.decompress(raw))
                held += len(parts[-1])
                if held >= SLICE_BYTES:
                    total += np.bincount(np.frombuffer(b"".join(parts), dtype=kind), minlength=size)
                    held, parts = 0, []
        total += np.bincount(np.frombuffer(b"".join(parts), dtype=kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    return run


BLOCKS = "part int, block int, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def pack(kind: str, freq: list[int], block_tokens: int):
    """Blocks of whole documents, a few of them encoded side by side; a very long document is encoded alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table, unpacker = TaskContext.get().partitionId(), ans.Table.of(freq), zstandard.ZstdDecompressor()
        done = 0
        full: list[tuple[list, list[np.ndarray]]] = []
        names: list = []
        parts: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            nonlocal done, full
            packed = ans.encode([np.concatenate(ids) for _, ids in full], table)
            lengths = [[len(x) for x in ids] for _, ids in full]
            columns = [
                pa.repeat(pa.scalar(part, pa.int32()), len(full)),
                pa.array(range(done, done + len(full)), pa.int32()),
                pa.array([len(x) for x in lengths], pa.int64()),
                pa.array([sum(x) for x in lengths], pa.int64()),
                pa.array([n for n, _ in full], pa.list_(pa.int64())),
                pa.array(lengths, pa.list_(pa.int64())),
                pa.array(packed, pa.binary()),
            ]
            done, full = done + len(full), []
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "n_docs", "n_tokens", "doc_ids", "lengths", "payload"])

        held = tokens = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(unpacker.decompress(raw), dtype=kind)
                if full and len(ids) > 2 * block_tokens:
                    yield emit()
                    held = 0
                names.append(doc_id)
                parts.append(ids)
                tokens += len(ids)
                if tokens >= block_tokens:
                    full.append((names, parts))
                    held += tokens
                    long = tokens > 2 * block_tokens
                    names, parts, tokens = [], [], 0
                    if held >= SIDE_BY_SIDE or long:
                        yield emit()
                        held = 0
        if names:
            full.append((names, parts))
        if full:
            yield emit()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> str:
    """Encode every text, append the end id, and write the data set described above to ``path``; returns ``path``.

    ``tokenizer``: file of the tokenizers library, which every executor can open. Documents come in ascending order of id, null
    ids first, rows with the same id in an order fixed by their ids' content. A null or empty text is its end id alone. An empty table
    gives three empty tables. Extra columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    coder = encoder(tokenizer)
    kind, size = coder.kind.str, coder.size
    with Scratch(spark) as scratch:
        tokens = documents(docs, text, key).mapInArrow(tokenize(tokenizer, settings.end_id), "doc_id bigint, n_tokens bigint, tie bigint, ids binary")
        tokens = scratch.write(tokens, "token-ids")
        counts = tokens.select("ids").mapInArrow(histogram(kind, size), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
        found = np.zeros(size, dtype=np.int64)
        for row in counts.collect():  # one row per entry of the vocabulary at most
            found[row["token"]] = row["n"]
        freq = ans.scaled(found)
        used = np.flatnonzero(freq)
        spark.createDataFrame(list(zip(used.tolist(), freq[used].tolist())), "token bigint, freq bigint").coalesce(1).write.parquet(f"{path}/frequencies")
        order = [F.asc_nulls_first("doc_id"), F.col("n_tokens"), F.col("tie")]
        ranges = tokens.repartitionByRange(tasks_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "ids")
        scratch.settle()
        ranges.mapInArrow(pack(kind, freq.tolist(), settings.block_tokens), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row per range
    before = dict(zip(sorted(r["part"] for r in parts), np.cumsum([0, *[r["n"] for r in sorted(parts)]]).tolist()))
    offsets = spark.createDataFrame(list(before.items()), "part int, before bigint")
    upto = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block"))
    starts = blocks.withColumn("start", upto - F.col("n_tokens")).join(offsets, "part")
    starts.select("part", "block", (F.col("start") + F.col("before")).alias("start")).write.parquet(f"{path}/starts")
    return path


def unpack(freq: list[int]):
    """Documents of each block: place of their first id in the block, number of ids, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.Table.of(freq)
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.slice(at, 16)
                for row, ids in zip(part.drop_columns(["payload"]).to_pylist(), ans.decode(part.column("payload").to_pylist(), table)):
                    lengths = np.array(row["lengths"], dtype=np.int64)
                    ends = np.cumsum(lengths)
                    n = len(lengths)
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                    columns = [
                        pa.repeat(pa.scalar(row["part"], pa.int32()), n),
                        pa.repeat(pa.scalar(row["block"], pa.int32()), n),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        own,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "block", "doc_id", "offset", "n_tokens", "ids"])

    return run


def checksums(freq: list[int]):
    """As ``unpack``, with the CRC-32 of each document's ids as little-endian 32-bit integers in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpack(freq)(batches):
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return run


def _frequencies(spark: SparkSession, path: str) -> list[int]:
    rows = spark.read.schema("token bigint, freq bigint").parquet(f"{path}/frequencies").collect()  # the vocabulary
    freq = [0] * (max((r["token"] for r in rows), default=-1) + 1)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return freq


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ids of every document, or their ``ids_crc32`` with ``digest``."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    starts = spark.read.schema("part int, block int, start bigint").parquet(f"{path}/starts")
    freq, what = _frequencies(spark, path), "ids_crc32 bigint" if digest else "ids array<int>"
    decode = (checksums if digest else unpack)(freq)
    decoded = blocks.select("part", "block", "doc_ids", "lengths", "payload").mapInArrow(
        decode, f"part int, block int, doc_id bigint, offset bigint, n_tokens bigint, {what}"
    )
    placed = decoded.join(starts, ["part", "block"])
    return placed.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", what.split()[0])
