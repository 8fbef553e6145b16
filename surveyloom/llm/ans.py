"""Static range asymmetric numeral system for token ids, vectorised over blocks and lanes with numpy.

Method: Duda, "Asymmetric numeral systems", arXiv 1311.2540; interleaving: Giesen, "Interleaved entropy coders", arXiv
1402.3392. State of 64 bits, renormalised by words of 32 bits. A block's tokens go round robin to LANES states that share one
stream of words. After every CHECKPOINT tokens the states and the place in the stream are kept, so that the parts of a
block decode side by side.

Block layout, little-endian: 4 bytes magic; u32 version, number of tokens, lanes, tokens per checkpoint, number of
checkpoints, number of words; then per checkpoint its place in the stream (u32) and the states (u64 each lane); then the words
(u32) in reading order; last the CRC-32 of all bytes before it (u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

MAGIC = b"RANS"
VERSION = 1
LANES = 32
CHECKPOINT = 8192
SCALE_BITS = 20
LOW = 1 << 31  # least value of a state between steps
HEAD = struct.Struct("<4s6I")
U = np.uint64


@dataclass
class Table:
    """Frequencies that sum to 2^SCALE_BITS, their running starts, and the symbol of each slot."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def of(freq: Sequence[int]) -> Table:
        freq = np.asarray(freq, dtype=np.int64)
        start = np.cumsum(freq) - freq
        return Table(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.int32), freq))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^SCALE_BITS with at least 1 for each symbol that occurs."""
    total, scale = int(counts.sum()), 1 << SCALE_BITS
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), dtype=np.int64)
    if len(used) > scale // 2:
        raise ValueError(f"{len(used)} symbols do not fit a table of {scale} slots")
    freq = np.zeros(len(counts), dtype=np.int64)
    freq[used] = np.maximum(1, (counts[used].astype(np.float64) * (scale - len(used)) / total).astype(np.int64))
    left = scale - int(freq.sum())
    largest = used[np.argsort(-counts[used], kind="stable")]
    freq[largest[0]] += left  # never negative: the shares were cut down from scale minus one slot per symbol
    return freq


def encode(blocks: Sequence[np.ndarray], table: Table) -> list[bytes]:
    """One byte string per block of token ids; blocks are coded side by side."""
    n = np.array([len(b) for b in blocks], dtype=np.int64)
    steps = int(-(-n.max(initial=0) // LANES))
    grid = np.zeros((len(blocks), steps * LANES), dtype=np.int32)
    for i, b in enumerate(blocks):
        grid[i, : len(b)] = b
    lane = np.arange(LANES)
    state = np.full((len(blocks), LANES), LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    written = np.zeros(len(blocks), dtype=np.int64)
    per_check = CHECKPOINT // LANES
    checks: list[list[tuple[int, np.ndarray]]] = [[] for _ in blocks]
    for step in range(steps - 1, -1, -1):
        live = (step * LANES + lane)[None, :] < n[:, None]
        ids = grid[:, step * LANES : (step + 1) * LANES]
        freq = np.where(live, table.freq[ids], U(1 << SCALE_BITS))
        start = np.where(live, table.start[ids], U(0))
        full = state >= (freq << U(63 - SCALE_BITS))
        full &= live
        if full.any():
            # The decoder reads words in lane order, so the reversed stream holds them from the last lane to the first.
            at = np.nonzero(full[:, ::-1])
            words.append((state[:, ::-1][at] & U(0xFFFFFFFF)).astype(np.uint32))
            owners.append(at[0].astype(np.int32))
            written += full.sum(axis=1)
            state = np.where(full, state >> U(32), state)
        turns = state // freq
        state = (turns << U(SCALE_BITS)) + (state - turns * freq) + start
        if step % per_check == 0:
            for i in np.flatnonzero(step * LANES < n):
                checks[i].append((int(written[i]), state[i].copy()))
    stream = np.concatenate(words) if words else np.zeros(0, dtype=np.uint32)
    owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int32)
    order = np.argsort(owner, kind="stable")
    stream, ends = stream[order], np.cumsum(written)
    out = []
    for i in range(len(blocks)):
        own = stream[ends[i] - written[i] : ends[i]][::-1]
        points = checks[i][::-1]
        body = HEAD.pack(MAGIC, VERSION, int(n[i]), LANES, CHECKPOINT, len(points), len(own))
        body += b"".join(struct.pack("<I", len(own) - place) + s.astype("<u8").tobytes() for place, s in points)
        body += own.astype("<u4").tobytes()
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode(packed: Sequence[bytes], table: Table) -> list[np.ndarray]:
    """Token ids of each block. Damage raises; all checkpoints of all blocks advance together."""
    states, places, counts, streams, sizes = [], [], [], [], []
    base = 0
    for raw in packed:
        if len(raw) < HEAD.size + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        magic, version, n, lanes, every, n_points, n_words = HEAD.unpack_from(raw)
        if (magic, version, lanes, every) != (MAGIC, VERSION, LANES, CHECKPOINT):
            raise ValueError("a block has another format")
        at = HEAD.size
        for i in range(n_points):
            places.append(base + struct.unpack_from("<I", raw, at)[0])
            states.append(np.frombuffer(raw, "<u8", LANES, at + 4))
            counts.append(min(CHECKPOINT, n - i * CHECKPOINT))
            at += 4 + 8 * LANES
        streams.append(np.frombuffer(raw, "<u4", n_words, at))
        base += n_words
        sizes.append(n)
    if not counts:
        return [np.zeros(0, dtype=np.int32) for _ in packed]
    words = np.concatenate([*streams, np.zeros(LANES, dtype=np.uint32)])
    state, place, count = np.array(states, dtype=np.uint64), np.array(places), np.array(counts)
    steps = int(-(-count.max() // LANES))
    grid = np.zeros((len(count), steps * LANES), dtype=np.int32)
    lane = np.arange(LANES)
    for step in range(steps):
        live = (step * LANES + lane)[None, :] < count[:, None]
        slot = state & U((1 << SCALE_BITS) - 1)
        ids = table.symbol[slot.astype(np.int64)]
        ids = np.where(live, ids, 0)
        grid[:, step * LANES : (step + 1) * LANES] = ids
        after = table.freq[ids] * (state >> U(SCALE_BITS)) + slot - table.start[ids]
        short = (after < U(LOW)) & live
        if short.any():
            rank = np.cumsum(short, axis=1)
            more = words[np.where(short, place[:, None] + rank - 1, 0)].astype(np.uint64)
            after = np.where(short, (after << U(32)) | more, after)
            place = place + rank[:, -1]
        state = np.where(live, after, state)
    out, at = [], 0
    for n in sizes:
        used = -(-n // CHECKPOINT)
        out.append(np.concatenate([grid[at + i, : count[at + i]] for i in range(used)]) if n else np.zeros(0, dtype=np.int32))
        at += used
    return out
