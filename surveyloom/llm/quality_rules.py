"""Quality rules: counts over words and lines, and bands of zstandard ratios.

Repetitive text compresses far better than prose, noise far worse. Ratios depend on length, so the limits do too, for the
whole document and for fixed chunks; long documents whose chunks mostly fall outside their band are rejected as well.
One scan, no shuffle; a task holds one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from surveyloom.llm import text as T
from surveyloom.llm.scratch import documents, ship

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, reason string"
)


@dataclass(frozen=True)
class Limits:
    """Production settings. ``bands``: (least bytes, lowest ratio, highest ratio); the last entry that fits is used.

    Ratios are compressed / raw bytes. Below the first band's length the ratio says nothing, so nothing is rejected.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk_bytes: int = 4096
    bands: tuple[tuple[int, float, float], ...] = (
        (512, 0.12, 0.95),
        (2048, 0.08, 0.80),
        (16384, 0.05, 0.75),
        (131072, 0.03, 0.70),
    )
    max_bad_chunks: float = 0.5

    def band(self, n_bytes: int) -> tuple[float, float]:
        found = (0.0, float("inf"))
        for least, low, high in self.bands:
            if n_bytes >= least:
                found = (low, high)
        return found


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per row the words that lie in a window of ``size`` words found twice or more in the row."""
    grams, at = T.windows(hashes, first, size, whole_short=False)
    if not len(grams):
        return np.zeros(len(first) - 1, dtype=np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keyed = T.mix(grams + row.astype(np.uint64) * T.U(0x9FB21C651E98DF25))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin = np.repeat(first[:-1] - at[:-1], np.diff(at)) + np.arange(len(grams))
    covered = np.zeros(len(hashes), dtype=bool)
    for i in range(size):
        covered[begin[twice] + i] = True
    return T.sums(covered, first)


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def compression(raw: bytes, limits: Limits, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, str | None]:
    """(ratio, chunks, chunks outside their band, reason of a rejection)."""
    if not raw:
        return 0.0, 0, 0, None
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = limits.band(len(raw))
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else None
    size = limits.chunk_bytes
    chunks = [raw[i : i + size] for i in range(0, len(raw), size)] if len(raw) > size else []
    bad = 0
    for chunk in chunks:
        low, high = limits.band(len(chunk))
        bad += not low <= len(packer.compress(chunk)) / len(chunk) <= high
    if reason is None and chunks and bad > limits.max_bad_chunks * len(chunks):
        reason = "chunks"
    return ratio, len(chunks), bad, reason


def measure(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=limits.level)
        for batch in batches:
            for start, end, data, offsets in T.slices(batch.column("text")):
                words = T.find_words(data, offsets)
                hashes = T.hash_ranges(data, words.starts, words.ends, fold=False)
                n_words = np.diff(words.first)
                characters = (data & 0xC0) != 0x80
                raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - start)]
                repeat = repeated_words(hashes, words.first)
                found = [compression(r, limits, packer) for r in raw]
                failed = (n_words < limits.min_words) | (100 * repeat > limits.max_repeat_percent * n_words)
                kept = ~failed & np.array([f[3] is None for f in found])
                reason = ["words" if a else f[3] for a, f in zip(failed, found)]
                columns = [
                    batch.column("doc_id").slice(start, end - start),
                    n_words,
                    T.sums(characters & ~T.WHITE[data], offsets),
                    T.sums(SYMBOLS[data], offsets),
                    np.array([repeated_lines(r) for r in raw], dtype=np.int64),
                    repeat,
                    failed,
                    kept,
                    np.array([f[0] for f in found], dtype=np.float64),
                    np.array([f[1] for f in found], dtype=np.int64),
                    np.array([f[2] for f in found], dtype=np.int64),
                    pa.array(reason, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return run


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def quality_rules(docs: DataFrame, limits: Limits = Limits(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: counts, base verdict, compression ratio and verdict.

    A null text counts as empty: no words, failed, not kept. Repeated rows each get a row; a null key stays null. Ties do not
    occur. An empty table gives an empty result. Extra columns are not read.
    """
    ship(docs.sparkSession)
    return documents(docs, text, key).mapInArrow(measure(limits), SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns unchanged; one scan, no join."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], ["doc_id", "text"])
            kept = [m.column("kept") for m in measure(limits)(iter([part]))]
            if kept:
                yield batch.filter(pa.chunked_array(kept).combine_chunks())

    return docs.mapInArrow(run, docs.schema)
