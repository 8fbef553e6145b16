"""The text operators as queries over the given tables, and SQL for DuckDB where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.chat_format import chat_digests, write_chats
from surveyloom.llm.decontaminate import contaminated
from surveyloom.llm.hard_negatives import mine_hard_negatives
from surveyloom.llm.language import identify_languages
from surveyloom.llm.line_dedup import apply_bitmaps, line_bitmaps
from surveyloom.llm.merkle import build_manifest, prove, row_digest
from surveyloom.llm.minhash_dedup import near_duplicates
from surveyloom.llm.mixing import mix_sources
from surveyloom.llm.passages import repeated_passages
from surveyloom.llm.quality_classifier import score_quality
from surveyloom.llm.quality_rules import quality_rules
from surveyloom.llm.secret_scan import BASE, RULES, scan_secrets, span_list
from surveyloom.llm.token_binary import read_tokens, write_tokens
from surveyloom.session import literal_table, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EXTRA_CHAT = r"\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    """File of the byte-level vocabulary; the package that holds it is part of the installation on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    kept = apply_bitmaps(docs, line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_binary(spark: SparkSession, sf: str) -> DataFrame:
    path = write_tokens(_table(spark, sf, "documents"), scratch_path(spark, "tokens"), tokenizer_path())
    return read_tokens(spark, path, digest=True)


def op3_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = scan_secrets(versions, scratch_path(spark, "secret-ledger"))
    kinds = [rule.kind for rule in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.array_remove("found.kind", k)) for k in kinds]
    counts = [(F.size("found") - n).cast("bigint").alias(f"n_{k}") for k, n in zip(kinds, counts)]
    digest = F.sha2(span_list(base), 256).alias("base_sha256")
    return found.select(F.col("path").alias("doc_id"), *counts, digest, span_list(F.col("found")).alias("spans"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_table(spark, sf, "documents"))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    return identify_languages(_table(spark, sf, "documents")).drop("spans")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(_table(spark, sf, "documents"))


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """The tables have no addresses: a document's source is its host, the language within it its path."""
    return score_quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"), F.col("source"), F.col("lang"))


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(_table(spark, sf, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The claimed rows are tampered with where 5 divides the CRC of the id: A-Z of the text in lower case."""
    docs = _table(spark, sf, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf, lowered = (row_digest([*values, text]) for text in (F.col("text"), F.translate("text", UPPER, LOWER)))
    manifest = build_manifest(docs, F.col("doc_id"), F.col("source"), [*values, F.col("text")], F.when(chosen, lowered).otherwise(leaf))
    root = F.lit(manifest.root)
    return prove(manifest, digest=True).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    chats = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = {"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [EXTRA_CHAT, EXTRA_CHAT]}
    path = write_chats(chats.unionByName(literal_table(spark, extra)), scratch_path(spark, "chats"))
    return chat_digests(spark, path)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_binary": op2_token_binary,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_format": op13_chat_format,
}

WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split
), keyed AS (
    SELECT *, translate(trim(line, {WHITE}), '{UPPER}', '{LOWER}') AS key FROM line
), shared AS (
    SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT keyed.*, top IS NOT NULL AND top <> doc_id AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def _op5() -> str:
    """Spans by the lengths of the texts before and of the matches, as in the operator."""
    kinds = []
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(f"""
    SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, {rule.least} AS least, string_split_regex(t, '{pattern}') AS gaps,
        regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS vals FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(kinds)}
), r AS (
    SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m
), s AS (
    SELECT doc_id, kind, place, least, length(vals[i]) AS size, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS stop, length(hits[i]) AS span FROM r
), f AS (
    SELECT doc_id, kind, place, CAST(stop - span AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE size >= least
), g AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
    FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


OP6 = """
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), c AS (
    SELECT *, (SELECT sum(source_size) FROM s) AS whole, 3 * sum(source_size) OVER own AS limits, sum(weight) OVER own AS weights,
        (SELECT sum(weight) FROM w) AS all_weights
    FROM w WINDOW own AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
    SELECT greatest(max(CASE WHEN all_weights > weights THEN CAST(whole - limits AS DOUBLE) / CAST(all_weights - weights AS DOUBLE) END),
        max(CAST(whole AS DOUBLE) / CAST(all_weights AS DOUBLE))) AS level FROM c
), t AS (
    SELECT source, source_size, CASE WHEN weight * level > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target
    FROM w, level
), r AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5(concat_ws(':', '20240229', doc_id)), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
    SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS n_copies FROM r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, size * n_copies AS taken, n_copies FROM n
"""



def _op11(levels: int = 8) -> str:
    """Levels one after the other: 16 ** levels rows of a source, and as many sources, at most."""

    def value(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*(value(c) for c in ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"

    def climb(tree: str, level: int) -> str:
        """Nodes of the next level, with the siblings and slot of each node below."""
        return f"""
), {tree}{level}s AS MATERIALIZED (
    SELECT *, i // 16 AS up, string_agg(digest, '') OVER earlier AS sib_before, string_agg(digest, '') OVER later AS sib_after,
        count(*) OVER (PARTITION BY g) = 1 AS alone
    FROM {tree}{level} WINDOW earlier AS (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        later AS (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), {tree}{level + 1} AS MATERIALIZED (
    SELECT g, up AS i, CASE WHEN bool_or(alone) THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest
    FROM {tree}{level}s GROUP BY g, up"""

    def follow(tree: str, level: int, before: str) -> str:
        """Siblings and folded digest of every row after this level."""
        place = "g" if tree == "s" else "zero"
        return f"""
), f{tree}{level} AS MATERIALIZED (
    SELECT r.* REPLACE (r.pos // 16 AS pos, r.proof || CASE WHEN alone THEN '' ELSE coalesce(sib_before, '') || coalesce(sib_after, '') END AS proof,
        CASE WHEN alone THEN r.folded ELSE sha256(coalesce(sib_before, '') || r.folded || coalesce(sib_after, '')) END AS folded)
    FROM {before} r JOIN {tree}{level}s n ON n.g = r.{place} AND n.i = r.pos"""

    crc = """list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
    sql = f"""
WITH leaf AS MATERIALIZED (
    SELECT doc_id, source, {leaf("text")} AS leaf,
        CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS folded
    FROM documents
), source AS (
    SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)
), placed AS MATERIALIZED (
    SELECT doc_id, leaf, folded, g, 0 AS zero, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof
    FROM leaf JOIN source ON leaf.source IS NOT DISTINCT FROM source.source
), s0 AS (
    SELECT g, pos AS i, leaf AS digest FROM placed"""
    for level in range(levels):
        sql += climb("s", level)
    sql += f"""
), t0 AS (
    SELECT 0 AS g, g AS i, digest FROM s{levels}"""
    for level in range(levels):
        sql += climb("t", level)
    before = "placed"
    for tree in "st":
        for level in range(levels):
            sql += follow(tree, level, before)
            before = f"f{tree}{level}"
        if tree == "s":
            sql += f"""
), middle AS (
    SELECT * REPLACE (g AS pos) FROM {before}"""
            before = "middle"
    return f"""{sql}
)
SELECT doc_id, leaf, s{levels}.digest AS subroot, t{levels}.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
    folded = t{levels}.digest AS verified
FROM {before} r JOIN s{levels} ON s{levels}.g = r.g CROSS JOIN t{levels}
"""


OP12 = """
WITH r AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, a.q AS anchor_q, c.vec_id AS other_id, c.label AS other_label, c.q AS other_q,
        CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
    FROM r a JOIN r c ON a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, anchor_label, anchor_q, other_id AS positive_id, score AS positive_score FROM s
    WHERE anchor_label = other_label AND (anchor_id <> other_id OR anchor_q <> other_q)
    QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor_q ORDER BY score DESC, other_id) <= 5
), n AS (
    SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor_q, positive_id, positive_score ORDER BY score DESC, other_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.anchor_label = p.anchor_label AND s.anchor_q = p.anchor_q
    WHERE other_label <> s.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP13 = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{EXTRA_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_CHAT}'
), e AS (
    SELECT *, length(regexp_replace(text, '\\*(### |</turn>)', '\\\0', 'g')) AS text_chars,
        length(replace(replace(replace(role, '\', '\\'), ':', '\:'), chr(10), '\n')) AS role_chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + role_chars + 2 + text_chars + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op5_secret_scan": _op5(),
    "op6_mixing": OP6,
    "op11_merkle_manifest": _op11(),
    "op12_hard_negatives": OP12,
    "op13_chat_format": OP13,
}
