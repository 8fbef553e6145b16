"""From raw documents to encoded training tokens: five stages over whole tables, each a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm.decontaminate import contaminated
from surveyloom.llm.minhash_dedup import near_duplicates
from surveyloom.llm.mixing import emit_copies
from surveyloom.llm.quality_rules import keep_good
from surveyloom.llm.queries import tokenizer_path
from surveyloom.llm.scratch import Scratch
from surveyloom.llm.token_binary import read_tokens, write_tokens
from surveyloom.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows equal in id and text are one."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()  # never null: rows without an id are kept
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return emit_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the encoded files."""
    return read_tokens(spark, write_tokens(docs, scratch_path(spark, "pipeline-tokens"), tokenizer_path()), digest=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

# Compression ratios of the first stage and min-hashes of the second have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        before: list[str] = []
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.settle(*before)  # nothing reads a stage's input any more
            before = [f"pipeline-{name}"]
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
