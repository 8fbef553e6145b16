"""Secret scan with a ledger of content-addressed blobs; DataFrame functions only.

Every version of a text is a blob named by its SHA-256. The ledger has a row per blob and run: which rule versions were applied and
what they found. A run scans one copy of each blob, and only with rule versions the ledger lacks for it; findings are
joined back to every path and version that holds the blob. Positions come from the text between matches, whose lengths and
those of the matches are summed up in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` is shorter than ``least`` are dropped after they were found."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


# The patterns of the base kinds, in the order in which kinds are listed. A run of [0-9a-f] or a key after AKIA is
# always matched to its end, so its least length may stand in the pattern; for assignments it may not, as a match that is
# dropped still uses up its text.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _pieces(rule: Rule, number: int) -> Column:
    """Matches of a rule with the text before each, if the rule is wanted for the row and matches at all."""
    pattern = F.lit(rule.pattern)
    text = F.col("text")
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else match
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), match.alias("match"), value.alias("value"))
    wanted = F.array_contains("wanted", rule.name) & text.rlike(rule.pattern)
    lengths = F.transform(
        F.when(wanted, parts),
        lambda p: F.struct(
            F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("match"), F.length(p["value"]).alias("value")
        ),
    )
    return F.struct(F.lit(number).alias("rule"), lengths.alias("parts"))


def scan(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(blob, found)`` for ``texts (blob, text, wanted)``; only blobs with a finding."""
    each = texts.select("blob", F.explode(F.array(*[_pieces(r, i) for i, r in enumerate(rules)])).alias("of"))
    each = each.where(F.col("of.parts").isNotNull())
    rows = each.select("blob", "of.rule", F.posexplode("of.parts").alias("at", "part"))
    order = Window.partitionBy("blob", "rule").orderBy("at")
    upto = F.sum(F.col("part.gap") + F.coalesce("part.match", F.lit(0))).over(order)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("rule") + 1)
    spans = rows.withColumn("end", upto).where(F.col("part.value") >= least)
    span = F.struct(name.alias("rule"), (F.col("end") - F.col("part.match")).alias("start"), F.col("end").alias("end"))
    return spans.groupBy("blob").agg(F.collect_list(span).alias("found"))


def update_ledger(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it, and return the findings of ``rules`` per blob.

    ``versions (path, version, text)``. The result ``(blob, found)`` covers every blob of ``versions``; ``found`` is empty where
    nothing was found. A folder without a ledger is an empty ledger.
    """
    spark = versions.sparkSession
    names = [r.name for r in rules]
    with Scratch(spark) as scratch:
        blobs = versions.select("path", "version", blob_id(F.col("text")).alias("blob"))
        first = blobs.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("of"))
        first = first.select("blob", F.col("of.path").alias("path"), F.col("of.version").alias("version"))
        old = read_ledger(spark, ledger_path)
        if old is None:
            pending = first.withColumn("wanted", F.array(*map(F.lit, names)))
        else:
            known = old.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"))
            wanted = F.array_except(F.array(*map(F.lit, names)), F.coalesce("rules", F.array().cast("array<string>")))
            pending = first.join(known, "blob", "left").withColumn("wanted", wanted).drop("rules").where(F.size("wanted") > 0)
        pending = scratch.write(pending.withColumnsRenamed({"path": "p", "version": "v", "blob": "b"}), "pending")
        same = F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("v"))
        texts = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text"), blob_id(F.col("text")).alias("blob"))
        texts = texts.join(pending, same).where(F.col("blob") == F.col("b")).select("blob", "text", "wanted")
        found = scan(texts, rules).withColumn("found", F.array_distinct("found"))
        none = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
        rows = pending.select(F.col("b").alias("blob"), F.col("wanted").alias("rules")).join(found, "blob", "left")
        rows.withColumn("found", F.coalesce("found", none)).write.mode("append").parquet(ledger_path)
        all_found = read_ledger(spark, ledger_path).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
        return all_found.withColumn("found", F.filter("found", lambda s: s["rule"].isin(names)))


def read_ledger(spark, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def scan_secrets(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``path, version, blob, found`` for every row of ``versions (path, version, text)``.

    ``found``: spans ``(start, place, kind, end)`` in code points, end exclusive, sorted by start and then by the order of rules.
    Null texts are empty. Paths and versions may be null or repeat; equal rows have equal results. An empty table gives
    an empty result. Extra columns are not read.
    """
    found = update_ledger(versions.select("path", "version", "text"), ledger_path, rules)
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    spans = F.sort_array(
        F.transform(
            "found",
            lambda s: F.struct(s["start"].alias("start"), place[s["rule"]].alias("place"), kind[s["rule"]].alias("kind"), s["end"].alias("end")),
        )
    )
    paths = versions.select("path", "version", blob_id(F.col("text")).alias("blob"))
    return paths.join(found.select("blob", spans.alias("found")), "blob").select("path", "version", "blob", "found")


def span_list(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
