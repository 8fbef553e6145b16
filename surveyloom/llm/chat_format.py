r"""Chat formatting that is proven by reading it back.

A conversation is written turn by turn as ``### role:\n text \n</turn>\n``. ``### `` and ``</turn>`` are the control strings. In a text,
a control string with any number of backslashes before it gets one backslash more, and the parser takes one off; a role
escapes ``\``, ``:`` and line breaks, which would end it. A text without control strings is written as it is.

A writer renders a piece of a conversation plainly, parses it with the same parser that readers use, and compares the turns with the source. Turns
that do not come back are escaped and the piece is rendered again until it comes back identical. As every piece ends with a turn, the
pieces of a conversation put one after the other parse to its turns. So long conversations are cut into pieces over many tasks, and
only their digests are taken in one stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.scratch import ship, tasks_for

HEAD, TAIL = "### ", "</turn>"
CONTROL = re.compile(r"\\*(?:### |</turn>)")
ROLE = re.compile(r"### ((?:[^\\:\n]|\\[^\n])*):\n")
PIECE_CHARS = 1 << 20
LEARNED = "assistant"
PIECES = "conv_id bigint, part bigint, piece bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>"
PIECE_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
])
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
])


class FormatError(ValueError):
    """Text that the grammar does not produce."""


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m.group()[1:] if m.group().startswith("\\") else m.group(), text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), role)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    start: int = field(default=0, compare=False)  # of the written text, in code points
    stop: int = field(default=0, compare=False)


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted text, deterministically: a control string without a backslash before it is always a mark."""
    turns, at = [], 0
    while at < len(formatted):
        head = ROLE.match(formatted, at)
        if head is None:
            raise FormatError(f"no turn begins at {at}")
        begin, mark = head.end(), None
        for found in CONTROL.finditer(formatted, begin):
            if not found.group().startswith("\\"):
                mark = found
                break
        if mark is None or mark.group() != TAIL:
            raise FormatError(f"the turn that begins at {at} has no end")
        stop = mark.start() - 1
        if stop < begin or formatted[stop] != "\n" or formatted[mark.end() : mark.end() + 1] != "\n":
            raise FormatError(f"the turn that begins at {at} ends within a line")
        turns.append(Turn(unescape_role(head.group(1)), unescape(formatted[begin:stop]), begin, stop))
        at = mark.end() + 1
    return turns


def render(turns: Sequence[tuple[str, str]], escaped: set[int]) -> str:
    parts = []
    for i, (role, text) in enumerate(turns):
        parts += [HEAD, escape_role(role), ":\n", escape(text) if i in escaped else text, f"\n{TAIL}\n"]
    return "".join(parts)


def format_turns(turns: Sequence[tuple[str, str]]) -> tuple[str, list[Turn]]:
    """Formatted text that parses to exactly these turns, and the turns as parsed.

    Each round escapes all turns with control strings from the first on that does not come back, so that two rounds suffice.
    """
    escaped: set[int] = set()
    while True:
        formatted = render(turns, escaped)
        try:
            found = parse(formatted)
        except FormatError:
            found = []
        if [(t.role, t.text) for t in found] == list(turns):
            return formatted, found
        agree = next((i for i, (t, s) in enumerate(zip(found, turns)) if (t.role, t.text) != s), min(len(found), len(turns)))
        more = {i for i in range(agree if found else 0, len(turns)) if CONTROL.search(turns[i][1])} - escaped
        if not more:
            raise FormatError("the turns do not come back although all texts are escaped")
        escaped |= more


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows as (conversation, turns) pieces of about ``PIECE_CHARS`` at most, unless one turn is longer."""
    conversation, turns, chars = None, [], 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and (conv_id != conversation or chars > PIECE_CHARS):
                yield conversation, turns
                turns, chars = [], 0
            conversation = conv_id
            turns.append((role, text))
            chars += len(role) + len(text)
    if turns:
        yield conversation, turns


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    rows, chars = [], 0
    for number, (conv_id, turns) in enumerate(_pieces(batches)):
        formatted, found = format_turns(turns)
        loss = [{"start": t.start, "stop": t.stop} for t in found if t.role == LEARNED]
        rows.append({"conv_id": conv_id, "part": part, "piece": number, "n_turns": len(found), "formatted": formatted, "loss": loss})
        chars += len(formatted)
        if chars > PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(rows, PIECE_SCHEMA)
            rows, chars = [], 0
    yield pa.RecordBatch.from_pylist(rows, PIECE_SCHEMA)


def write_chats(conversations: DataFrame, path: str) -> str:
    """Format a table ``conv_id, turn, role, text`` into a folder of Parquet files, a row per piece; returns the path.

    Rows go by turn (null first), those of one turn by role and text; repeated rows are turns of their own. A null or empty text is
    empty, a null role too; a null ``conv_id`` is a conversation of its own. Conversations, turns and texts may be of any length: a long conversation
    is cut over tasks, in order of ``part`` and ``piece``. ``loss`` holds the ranges of the assistant's texts in code points of ``formatted``. A
    table without rows gives an empty folder; extra columns are not read.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ranges = rows.repartitionByRange(tasks_for(rows), "conv_id", "turn", "role", F.substring("text", 1, 64))
    ordered = ranges.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    ordered.mapInArrow(_write, PIECES).write.parquet(path)
    return path


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIECES).parquet(path)


def _read_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("place", pa.int64()), ("role", pa.string()),
                        ("text", pa.string()), ("learned", pa.bool_())])
    for batch in batches:
        for row in batch.to_pylist():
            loss = {(span["start"], span["stop"]) for span in row["loss"]}
            turns = [
                {"conv_id": row["conv_id"], "part": row["part"], "piece": row["piece"], "place": i, "role": t.role, "text": t.text,
                 "learned": (t.start, t.stop) in loss}
                for i, t in enumerate(parse(row["formatted"]))
            ]
            yield pa.RecordBatch.from_pylist(turns, schema)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, part, piece, place, role, text, learned``: the turns that the files hold, in order of part, piece and place."""
    ship(spark)
    schema = "conv_id bigint, part bigint, piece bigint, place bigint, role string, text string, learned boolean"
    return read_pieces(spark, path).mapInArrow(_read_turns, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream the pieces of whole conversations; only hashes and counts are kept."""
    open_, turns, loss, sums = False, None, None, {}

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**sums, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}], DIGEST_SCHEMA)

    for batch in batches:
        for conv_id, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if not open_ or sums["conv_id"] != conv_id:
                if open_:
                    yield row()
                open_, turns, loss = True, hashlib.sha256(), hashlib.sha256()
                sums = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            for turn in parse(formatted):
                turns.update(f"{turn.role}\n{turn.text}\n".encode())
                sums["n_turns"] += 1
            for span in spans:
                text = unescape(formatted[span["start"] : span["stop"]])
                loss.update(text.encode())
                sums["loss_chars"] += len(text)
            sums["formatted_chars"] += len(formatted)
    if open_:
        yield row()


def chat_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation, read back from the files: number and hash of the turns, length and hash of the text under the loss mask."""
    ship(spark)
    pieces = read_pieces(spark, path).select("conv_id", "part", "piece", "formatted", "loss")
    whole = pieces.repartition(tasks_for(pieces), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.mapInArrow(_digest, DIGESTS)
