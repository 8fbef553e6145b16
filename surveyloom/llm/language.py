"""Language of documents and of the spans inside them.

Each word has a score per language: the sum of log probabilities of its character n-grams. The script of its letters narrows the
languages down to those that were seen in that script. A Viterbi path over the words, with a penalty for every change of language,
labels spans; the document's language is the one with most letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import text as T
from surveyloom.llm.scratch import ship

UNDETERMINED = "und"

# First code points of script ranges; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"),
    (0x2C80, "other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"),
    (0x3400, "Han"), (0xA000, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"),
    (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x323B0, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@dataclass(frozen=True)
class Settings:
    """``switch``: penalty of a change of language. ``least_share``: share of a language's letters that a script must have to count."""

    buckets: int = 1 << 15
    orders: int = 3
    smoothing: float = 0.5
    switch: float = 12.0
    least_share: float = 0.001
    foreign: float = -40.0


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # (orders * buckets, languages)
    allowed: np.ndarray  # (scripts, languages), 0 or the penalty of a script that the language lacks
    prior: np.ndarray


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter; built once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


@dataclass
class Grams:
    """n-grams of the distinct words of a slice: places in the score table, owners, and letters and script of each word."""

    place: list[np.ndarray]
    owner: list[np.ndarray]
    n_letters: np.ndarray
    script: np.ndarray


def word_grams(words: list[str], settings: Settings) -> Grams:
    """n-grams of 1 to ``orders`` letters; whatever is no letter, and both ends of a word, count as a boundary mark."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.cumsum(points == 10) - 1
    is_letter = letters()[points]
    coded = np.where(is_letter, points, 0).astype(np.uint64)
    n = len(words)
    own = owner[is_letter]
    n_letters = np.bincount(own, minlength=n)[:n]
    script = np.zeros(n, dtype=np.int64)
    if len(own):
        kind = SCRIPT_OF_RANGE[np.searchsorted(STARTS, points[is_letter], "right") - 1]
        table = np.bincount(own * len(SCRIPT_NAMES) + kind, minlength=n * len(SCRIPT_NAMES))
        script = table[: n * len(SCRIPT_NAMES)].reshape(n, -1).argmax(axis=1)
    places, owners = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    for order in range(settings.orders):
        size = len(points) - order
        rolled = T.mix(rolled[:size] * T.U(0x9E3779B97F4A7C15) + coded[order:] + T.U(1))
        # From a boundary or letter of a word up to its closing boundary; some letter must be inside.
        inside = is_letter[:size].copy()
        for k in range(1, order + 1):
            inside |= is_letter[k : k + size]
        last = np.maximum(owner[order:] - (points[order:] == 10), 0)
        whole = owner[:size] == last
        keep = inside & whole
        places.append((rolled[keep] % T.U(settings.buckets)).astype(np.int64) + order * settings.buckets)
        owners.append(owner[:size][keep])
    return Grams(places, owners, n_letters, script)


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, list[str], np.ndarray]:
    """Words of a slice, the distinct ones as text, and for each word which of these it is."""
    words = T.find_words(data, offsets)
    hashes = T.hash_ranges(data, words.starts, words.ends, fold=True)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return words, [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first], words.ends[first])], which


def count_grams(settings: Settings):
    """Per task and language: how often each place of the score table and each script occurs."""
    size = settings.orders * settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        n_docs: Counter = Counter()
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, end, data, offsets in T.slices(batch.column("text")):
                words, distinct, which = distinct_words(data, offsets)
                grams = word_grams(distinct, settings)
                own = langs[start:end]
                n_docs.update(own.tolist())
                for lang in set(own.tolist()):
                    times = np.bincount(which[(own == lang)[words.row]], minlength=len(distinct)).astype(np.float64)
                    total = totals.setdefault(lang, np.zeros(size + len(SCRIPT_NAMES)))
                    for place, owner in zip(grams.place, grams.owner):
                        total[:size] += np.bincount(place, times[owner], minlength=size)
                    total[size:] += np.bincount(grams.script, times * grams.n_letters, minlength=len(SCRIPT_NAMES))
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            columns = [pa.repeat(pa.scalar(lang), len(seen) + 1), pa.array([-1, *seen], pa.int32()), pa.array([n_docs[lang], *total[seen]], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "n"])

    return run


def learn(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from all rows of ``text, lang``. What reaches the driver is bounded by languages times places of the score table."""
    ship(labelled.sparkSession)
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = labelled.mapInArrow(count_grams(settings), "lang string, place int, n double")
    rows = counts.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    size = settings.orders * settings.buckets
    table = np.zeros((size + len(SCRIPT_NAMES), len(languages)))
    prior = np.zeros(len(languages))
    at = rows["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(dtype=np.int64)
    place, value = rows["place"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64)
    table[place[place >= 0], at[place >= 0]] = value[place >= 0]
    prior[at[place < 0]] = value[place < 0]
    scores = np.zeros((size, len(languages)))
    for order in range(settings.orders if languages else 0):
        part = table[order * settings.buckets : (order + 1) * settings.buckets] + settings.smoothing
        scores[order * settings.buckets : (order + 1) * settings.buckets] = np.log(part / part.sum(axis=0))
    shares = table[size:] / np.maximum(table[size:].sum(axis=0), 1)
    known = shares >= settings.least_share
    allowed = np.where(known | ~known.any(axis=1, keepdims=True), 0.0, settings.foreign)
    return Model(languages, scores, allowed, np.log((prior + 1) / (prior + 1).sum()) if languages else prior)


def viterbi(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word; rows of text are worked on side by side, step by step, the longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    path = np.zeros(len(scores), dtype=np.int8 if scores.shape[1] < 128 else np.int32)
    stay = np.zeros(scores.shape, dtype=bool)
    jump = np.zeros(len(scores), dtype=path.dtype)
    steps = int(counts[0]) if len(counts) else 0
    live = np.searchsorted(-counts, -np.arange(steps), "left")
    value = np.broadcast_to(prior, (len(counts), len(prior))).copy()
    for t in range(steps):
        k = live[t]
        at = begin[:k] + t
        before = value[:k]
        best = before.argmax(axis=1)
        change = before[np.arange(k), best][:, None] - switch
        keep = before >= change
        stay[at], jump[at] = keep, best
        value[:k] = np.where(keep, before, change) + scores[at]
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        own = state[:k]
        path[at] = own
        state[:k] = np.where(stay[at, own], own, jump[at])
    return path


def label(model: Model, settings: Settings):
    names = pa.array([*model.languages, UNDETERMINED])
    width = len(model.languages)
    scores32 = model.scores.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in T.slices(batch.column("text")):
                n = end - start
                words, distinct, which = distinct_words(data, offsets)
                pred, score = np.full(n, width), np.zeros(n)
                bounds, spans = np.zeros(n + 1, dtype=np.int32), None
                grams = word_grams(distinct, settings) if width else None
                if grams is not None and len(which):
                    own = np.zeros((len(distinct), width))
                    for place, owner in zip(grams.place, grams.owner):
                        for i in range(width):
                            own[:, i] += np.bincount(owner, scores32[place, i], minlength=len(distinct))
                    own += model.allowed[grams.script]
                    own[grams.n_letters == 0] = 0.0
                    path = viterbi(own[which], words.first, model.prior, settings.switch).astype(np.int64)
                    size = grams.n_letters[which]
                    per = np.bincount(words.row * width + path, size, minlength=n * width).reshape(n, width)
                    total = per.sum(axis=1)
                    some = total > 0
                    pred[some] = per[some].argmax(axis=1)
                    score[some] = per[some].max(axis=1) / total[some]
                    head = np.ones(len(path), dtype=bool)
                    head[1:] = (path[1:] != path[:-1]) | (words.row[1:] != words.row[:-1])
                    at = np.flatnonzero(head)
                    bounds = np.searchsorted(words.row[at], np.arange(n + 1)).astype(np.int32)
                    begin = at - words.first[words.row[at]]
                    stop = np.append(at[1:], len(path)) - words.first[words.row[at]]
                    spans = [pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), names.take(pa.array(path[at]))]
                spans = spans or [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.string())]
                listed = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(spans, ["start", "end", "lang"]))
                columns = [*batch.select(["doc_id", "held_out"]).slice(start, n).columns, names.take(pa.array(pred)), pa.array(score), listed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


LABELLED = "doc_id bigint, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, spans``.

    Learned from rows with text, language and id that are not held out; ``und`` is predicted for null texts, texts without a letter, and if
    there was nothing to learn from. ``score`` is the share of letters in the predicted language, 0 for ``und``; ties go to the first
    language by name. ``spans`` have word positions, end exclusive. Repeated rows have equal results. An empty table gives an empty
    result; extra columns are not read.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = learn(own.where(~held_out() & F.col("doc_id").isNotNull()), settings)
    rows = own.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(label(model, settings), LABELLED)
