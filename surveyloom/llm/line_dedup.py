"""Lines that many documents share: drop all but those of one document, as bitmaps per document.

Line hashes are range-partitioned together with the document id and sorted inside each range, so that a very frequent line is cut
over many tasks. A task streams its range: within a line's run the largest id comes first and keeps its lines. Only the
first run of a range may have begun in an earlier one; its rows wait for one small table of run totals, two rows per range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import text as T
from surveyloom.llm.scratch import Scratch, documents, ship, tasks_for

NO_ID = -(1 << 63)  # stands for a null id: the smallest
LINES = "doc_id bigint, digest bigint, n_lines bigint, hi bigint, lo bigint, positions array<int>"
DECISIONS = "kind string, hi bigint, lo bigint, doc_id bigint, digest bigint, positions array<int>, n bigint"
TYPES = {
    "kind": pa.string(), "hi": pa.int64(), "lo": pa.int64(), "doc_id": pa.int64(), "digest": pa.int64(),
    "positions": pa.list_(pa.int32()), "n": pa.int64(), "n_lines": pa.int64(),
}


@dataclass(frozen=True)
class Settings:
    min_chars: int = 40
    min_docs: int = 5


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z lower-cased; bytes methods know ASCII only, as wanted."""
    return line.strip().lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "replace")) >= chars)


def split_lines(settings: Settings):
    """One header row per document with its number of lines, and one row per distinct key with its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in T.slices(batch.column("text")):
                rows, n_lines, digests, positions = [], [], [], []
                for i in range(end - start):
                    lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
                    found: dict[bytes, list[int]] = {}
                    for at, line in enumerate(lines):
                        key = line_key(line)
                        if long_enough(key, settings.min_chars):
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                    rows += [start + i] * (1 + len(found))
                    n_lines += [len(lines)] + [None] * len(found)
                    digests += [None, *found]
                    positions += [None, *found.values()]
                known = np.array([d is not None for d in digests])
                halves = np.zeros((len(digests), 2), dtype=np.int64)
                halves[known] = np.frombuffer(b"".join(d for d in digests if d), dtype="<i8").reshape(-1, 2)
                taken = batch.select(["doc_id", "digest"]).take(pa.array(rows, pa.int64()))
                columns = [
                    *taken.columns,
                    pa.array(n_lines, pa.int64()),
                    pa.array(halves[:, 0], mask=~known),
                    pa.array(halves[:, 1], mask=~known),
                    pa.array(positions, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_lines", "hi", "lo", "positions"])

    return run


@dataclass
class Run:
    """A line's run as far as it has been read. ``first``: it is the first of its range and may have begun before."""

    key: tuple[int, int]
    first: bool
    top: int
    n: int = 0
    last: tuple = (None, None)
    waiting: list = field(default_factory=list)


def _decided(kind: str, rows: pa.RecordBatch) -> pa.RecordBatch:
    columns = {
        "kind": pa.repeat(pa.scalar(kind), len(rows)),
        **{c: rows.column(c) for c in ("hi", "lo", "doc_id", "digest", "positions")},
        "n": pa.nulls(len(rows), pa.int64()),
    }
    return pa.RecordBatch.from_arrays([columns[c].cast(TYPES[c]) for c in columns], list(columns))


def _total(run: Run) -> pa.RecordBatch:
    """What a range knows about a line that other ranges may hold as well."""
    top = None if run.top == NO_ID else run.top
    row = {"kind": "total", "hi": run.key[0], "lo": run.key[1], "doc_id": top, "digest": None, "positions": None, "n": run.n}
    return pa.RecordBatch.from_arrays([pa.array([v], TYPES[c]) for c, v in row.items()], list(row))


def decide(min_docs: int):
    """Stream one sorted range: ``drop`` rows, ``wait`` rows of lines at its ends, and ``total`` rows of these lines."""

    def feed(run: Run, batch: pa.RecordBatch, docs: np.ndarray, digests: np.ndarray, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        own, tags = docs[begin:end], digests[begin:end]
        before = np.concatenate([[own[0] if run.last[0] is None else run.last[0]], own[:-1]])
        tags_before = np.concatenate([[tags[0] if run.last[0] is None else run.last[1]], tags[:-1]])
        repeated = (own == before) & (tags == tags_before)
        if run.last[0] is None:
            repeated[0] = False
            run.n += 1
        run.n += int((own != before).sum())
        run.last = (own[-1], tags[-1])
        fresh = batch.take(pa.array(begin + np.flatnonzero(~repeated)))
        if run.first:
            yield _decided("wait", fresh)
            return
        run.waiting.append(fresh)
        if run.n >= min_docs:
            for rows in run.waiting:
                ids = rows.column("doc_id").fill_null(NO_ID)
                yield _decided("drop", rows.filter(pc.not_equal(ids, run.top)))
            run.waiting = []

    def finish(run: Run, last: bool) -> Iterator[pa.RecordBatch]:
        if last:
            for rows in run.waiting:
                yield _decided("wait", rows)
        if last or run.first:
            yield _total(run)

    def run_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            if not len(batch):
                continue
            hi, lo, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "digest"))
            docs = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1])
            ends = np.append(starts[1:], len(hi))
            # Runs of fewer rows than documents asked for end without effect, unless they touch an end of the batch.
            worth = ends - starts >= min_docs
            worth[[0, -1]] = True
            for begin, end in zip(starts[worth], ends[worth]):
                key = (int(hi[begin]), int(lo[begin]))
                if current is None or current.key != key:
                    if current is not None:
                        yield from finish(current, last=False)
                    current = Run(key, current is None, int(docs[begin]))
                yield from feed(current, batch, docs, digests, begin, end)
        if current is not None:
            yield from finish(current, last=True)

    return run_range


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmap per document: bit i says that line i stays; zlib, most significant bit first."""
    for batch in batches:
        out, dropped = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            bits = np.ones(n, dtype=bool)
            bits[gone or []] = False
            dropped.append(n - int(bits.sum()))
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        columns = [*batch.select(["doc_id", "digest", "n_lines"]).columns, pa.array(dropped, pa.int64()), pa.array(out, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_lines", "n_dropped", "keep"])


def _identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row's identity is its id and a digest of its text, so that repeated ids do no harm. A null text is empty."""
    docs = documents(docs, text, key)
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.xxhash64("text"))


def line_bitmaps(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, digest, n_lines, n_dropped, keep`` (bitmap, see ``pack``).

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of ``min_chars`` code points or
    more found under ``min_docs`` ids or more lose all lines but those of the largest id. A null or empty text is one empty
    line. Null ids count as one id, smaller than all others. Rows with the same id each keep or lose their own lines; equal rows
    have equal results. An empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        lines = scratch.write(_identified(docs, text, key).mapInArrow(split_lines(settings), LINES), "lines")
        order = ["hi", "lo", F.desc_nulls_last("doc_id")]
        ranges = lines.where(F.col("hi").isNotNull()).repartitionByRange(tasks_for(docs), *order)
        decided = scratch.write(ranges.sortWithinPartitions(*order, "digest").mapInArrow(decide(settings.min_docs), DECISIONS), "decisions")
        totals = decided.where("kind = 'total'").groupBy("hi", "lo").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top"))
        totals = scratch.write(totals.where(F.col("docs") >= settings.min_docs), "totals")
        late = decided.where("kind = 'wait'").join(totals, ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
        columns = ["doc_id", "digest", "positions"]
        gone = decided.where("kind = 'drop'").select(*columns).union(late.select(*columns))
        gone = gone.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("positions")).alias("gone"))
        gone = gone.select(F.col("doc_id").alias("id"), F.col("digest").alias("tag"), "gone")
        headers = lines.where(F.col("hi").isNull()).select("doc_id", "digest", "n_lines")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("tag"))
        marked = headers.join(gone, same, "left").select("doc_id", "digest", "n_lines", "gone")
        out = marked.mapInArrow(pack, "doc_id bigint, digest bigint, n_lines bigint, n_dropped bigint, keep binary")
        return scratch.keep(out, "line-bitmaps")


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n_lines).astype(bool)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in T.slices(batch.column("text")):
            part = batch.slice(start, end - start)
            texts = []
            for i, (n, dropped, keep) in enumerate(zip(*(part.column(c).to_pylist() for c in ("n_lines", "n_dropped", "keep")))):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if dropped:
                    raw = b"\n".join(line for line, stays in zip(raw.split(b"\n"), unpack(keep, n)) if stays)
                texts.append(raw)
            columns = [*part.select(["doc_id", "n_lines", "n_dropped"]).columns, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` with only the lines whose bit is set; one row per input row."""
    ship(docs.sparkSession)
    marks = bitmaps.dropDuplicates(["doc_id", "digest"]).withColumnsRenamed({"doc_id": "id", "digest": "tag"})
    own = _identified(docs, text, key)
    joined = own.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("tag")))
    columns = ["doc_id", "text", "n_lines", "n_dropped", "keep"]
    return joined.select(*columns).mapInArrow(_apply, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
