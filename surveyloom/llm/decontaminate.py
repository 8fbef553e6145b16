"""Benchmark passages in documents, also with other numbers, names and units; DataFrame functions only.

Texts become tokens; numbers, names and units become typed placeholders. Windows of canonical tokens are hashed and joined with
those of the benchmark. Windows come in three forms: a capital at the begin of a sentence is no name, is a name, or nothing is a
placeholder. A window match names an alignment (document, item, shift between positions, or a band of shifts). Its slots must be
consistent: each benchmark value stands for one value of the document; windows where it does not are not counted unless they hold
the benchmark's own values. The original has the same values, a re-parameterised question others.

First the forms are made as texts in generated code, for all documents; only windows whose hash passes a bitmap of the benchmark's hashes leave
the scan, and documents that hold too few windows of every item are done. The bitmap has a size that is fixed by the number of benchmark
windows, within the stated limits, so what reaches every task is bounded; a larger benchmark makes it less selective, never wrong.
Places and slots are worked out for the documents that are left; a bitmap of their ids keeps the texts of the others where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.scratch import Scratch, documents

TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[.!?\n]"
ENDS = [".", "!", "?", "\n"]

# Unit words and signs that follow a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams",
    "kilogram", "kilograms", "ton", "tons", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres",
    "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "meter",
    "meters", "metre", "metres", "kilometer", "kilometers", "centimeter", "centimeters", "watt", "watts", "volt", "volts",
]

NUMBER, NAME, UNIT, END = "#n", "#name", "#unit", "#end"
CAPITAL = r"[\p{Lu}\p{Lt}]"
UNIT_WORD = f"(?i:{'|'.join(UNITS)})"


@dataclass(frozen=True)
class Settings:
    """``literals``: least number of tokens in a window that are no placeholders. ``coverage``: least share of an item's windows."""

    window: int = 8
    literals: int = 3
    coverage: float = 0.5
    least_bits: int = 1 << 16
    most_bits: int = 1 << 24


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def canonical(tokens: Column) -> Column:
    """Structs ``raw, a, b, c`` for the tokens: canonical forms are a placeholder with a leading ``#``, or the token in lower case.

    A unit is a unit word after a number. In form ``a`` a name is a token with a capital that does not open a text, line or
    sentence, in form ``b`` an opener with a capital is one too. Form ``c`` has no placeholders.
    """
    before = F.concat(F.array(F.lit("\n")), tokens)

    def form(pair: Column) -> Column:
        token, last = pair["token"], pair["last"]
        low, end, capital = F.lower(token), token.isin(ENDS), token.rlike(f"^{CAPITAL}")
        fixed = F.when(end, F.lit(END)).when(token.rlike(r"^\p{N}"), F.lit(NUMBER))
        fixed = fixed.when(last.rlike(r"^\p{N}") & token.rlike(f"^{UNIT_WORD}$"), F.lit(UNIT))
        return F.struct(
            token.alias("raw"),
            fixed.when(capital & ~last.isin(ENDS), F.lit(NAME)).otherwise(low).alias("a"),
            fixed.when(capital, F.lit(NAME)).otherwise(low).alias("b"),
            F.when(end, F.lit(END)).otherwise(low).alias("c"),
        )

    pairs = F.arrays_zip(tokens.alias("token"), before.alias("last"))
    return F.transform(F.filter(pairs, lambda p: p["token"].isNotNull()), form)


FORMS = ("a", "b", "c")


def _prepared(df: DataFrame, *key: str) -> DataFrame:
    """The key columns and for each form an array of structs ``at, raw, kind, hash``: tokens without sentence ends; a run of names is one token.

    ``at`` counts the tokens before runs are joined. Each array is used more than once by the next step, so the optimiser keeps
    the steps apart. No filter stands above them: it would be pushed through with the whole computation copied into it.
    """
    df = df.select(*key, tokens_of(F.col("text")).alias("tokens"))
    df = df.select(*key, canonical(F.col("tokens")).alias("t"))
    before = F.concat(F.array(F.lit(END)), F.col("t.a")), F.concat(F.array(F.lit(END)), F.col("t.b"))
    df = df.select(*key, F.arrays_zip("t", before[0].alias("la"), before[1].alias("lb")).alias("z"))
    df = df.select(*key, F.filter("z", lambda z: z["t"].isNotNull() & (z["t"]["c"] != END)).alias("z"))

    def one(form: str) -> Column:
        last = f"l{form}"
        every = F.transform("z", lambda z, i: F.struct(
            i.alias("at"), z["t"]["raw"].alias("raw"), z["t"][form].alias("kind"), F.xxhash64(z["t"][form]).alias("hash"),
            (F.lit(False) if form == "c" else (z["t"][form] == NAME) & (z[last] == NAME)).alias("more"),
        ))
        return F.filter(every, lambda x: ~x["more"]).alias(form)

    return df.select(*key, *[one(form) for form in FORMS])


def _window_hashes(form: str, size: int) -> Column:
    """``form, k, at, hash`` of the window at each position; a text with fewer tokens than a window has one window, all of it."""
    last = F.greatest(F.size(form) - size, F.lit(0))
    places = F.when(F.size(form) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(
        F.lit(form).alias("form"), k.alias("k"), F.get(F.col(form), k)["at"].alias("at"),
        F.xxhash64(*[F.get(F.col(form), k + n)["hash"] for n in range(size)]).alias("hash"),
    ))


def _window(size: int) -> Column:
    """Tokens of the window of the row's form."""
    parts = [F.slice(F.col(form), F.col("k") + 1, size) for form in FORMS]
    return F.when(F.col("form") == "a", parts[0]).when(F.col("form") == "b", parts[1]).otherwise(parts[2])


def _slots(window: Column) -> Column:
    """Values at the placeholders of a window, in order; a run of names has its first."""
    return F.transform(F.filter(window, lambda v: v["kind"].startswith("#")), lambda v: F.lower(v["raw"]))


def benchmark_windows(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """``item_id, at, hash, slots, main`` of the windows with enough literal tokens; an item without such a window has none.

    ``main``: a window with placeholders begins here.
    """
    ready = _prepared(benchmark, "item_id")
    every = F.concat(*[_window_hashes(form, settings.window) for form in FORMS])
    rows = ready.select("item_id", *FORMS, F.inline_outer(every)).where(F.col("hash").isNotNull())
    rows = rows.select("item_id", "form", "at", "hash", _window(settings.window).alias("w"))
    literal = F.size(F.filter("w", lambda v: ~v["kind"].startswith("#")))
    rows = rows.where(literal >= F.least(F.lit(settings.literals), F.size("w")))
    main = F.max(F.col("form") != "c").over(Window.partitionBy("item_id", "at"))
    return rows.select("item_id", "at", "hash", _slots(F.col("w")).alias("slots"), main.alias("main")).distinct()


def form_texts(df: DataFrame, key: str) -> DataFrame:
    """``key, f, form``: a row for each of the three forms of a text, its number and its canonical tokens with a blank between two.

    The same tokens as in the arrays of ``_prepared``, made by replacements in the whole text, which run in generated code; lambdas over
    arrays do not. Each step is used more than once by the next, so the optimiser keeps them apart.
    """

    def replaced(text: Column, pattern: str, by: str) -> Column:
        return F.regexp_replace(text, F.lit(pattern), F.lit(by))

    def without_ends(text: Column) -> Column:
        return F.rtrim(F.lower(replaced(text, r"[.!?\n](?: |$)", "")))

    df = df.select(key, F.concat(F.lit("\n "), F.concat_ws(" ", tokens_of(F.col("text")))).alias("plain"))
    typed = replaced(replaced(F.col("plain"), r" \p{N}[^ ]*", f" {NUMBER}"), f" {NUMBER} {UNIT_WORD}(?= |$)", f" {NUMBER} {UNIT}")
    df = df.select(key, "plain", typed.alias("typed"))
    names = [replaced(F.col("typed"), f" {after}{CAPITAL}[^ ]*", f" {NAME}") for after in (r"(?<=[^.!?\n] )", "")]
    forms = [without_ends(replaced(n, f"{NAME}(?: {NAME})+", NAME)) for n in names]
    return df.select(key, F.posexplode_outer(F.array(*forms, without_ends(F.col("plain")))).alias("f", "form"))


def form_windows(df: DataFrame, key: str, size: int) -> DataFrame:
    """``key, f, k, w0, w1, ...``: the windows of each form of each text; missing tokens of a text shorter than a window are null."""
    df = form_texts(df, key).select(key, "f", F.when(F.col("form") != "", F.split("form", " ")).alias("t"))
    df = df.select(key, "f", "t", F.greatest(F.size("t") - (size - 1), F.lit(1)).alias("n"))
    places = F.arrays_zip(*[F.slice("t", i + 1, F.col("n")).alias(f"w{i}") for i in range(size)])
    return df.select(key, "f", F.posexplode_outer(places).alias("k", "w")).select(key, "f", "k", "w.*").where(F.col("w0").isNotNull())


def likely(own: DataFrame, items: DataFrame, sizes: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """``doc_id, spots`` of the documents that hold as many windows of some item, in any places, as the coverage asks for at least.

    ``spots``: form and place of each window that is also one of the benchmark's. No document with a result is left out: a window of an item that counts is also equal in the form's text.
    """
    tokens = [F.col(f"w{i}") for i in range(settings.window)]
    literal = sum((F.coalesce(~t.startswith("#"), F.lit(False)).cast("int") for t in tokens), F.lit(0))
    filled = sum((t.isNotNull().cast("int") for t in tokens), F.lit(0))
    hashed = F.xxhash64(*tokens).alias("hash")
    rows = items.select(F.struct("item_id", F.xxhash64("text").alias("row")).alias("item"), "text")
    wanted = form_windows(rows, "item", settings.window).where(literal >= F.least(F.lit(settings.literals), filled))
    wanted = scratch.write(wanted.select("item.*", "f", "k", hashed).distinct(), "benchmark-forms")
    words = bitmap_words(wanted.count(), settings)
    bitmap = scratch.write(hash_bitmap(wanted, words), "benchmark-bitmap")
    hits = form_windows(own, "doc_id", settings.window).select("doc_id", "f", "k", hashed)
    hits = hits.where(in_bitmap(bitmap, words, F.col("hash")))
    hits = scratch.write(hits.join(wanted.select("hash").distinct(), "hash"), "form-matches")
    found = hits.select("doc_id", "hash").distinct().join(wanted, "hash")
    found = found.groupBy("doc_id", "item_id").agg(F.count_distinct("row", "f", "k", "hash").alias("n"))
    least = F.least(F.when(F.col("n_main") > 0, F.col("n_main")), "n_all") * settings.coverage
    found = found.join(sizes, "item_id").where(F.col("n") >= least)
    hits = hits.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return scratch.write(hits.groupBy("doc_id").agg(F.collect_set(F.struct("f", "k")).alias("spots")), "likely")


def perhaps_in(own: DataFrame, found: DataFrame, scratch: Scratch, settings: Settings) -> DataFrame:
    """Rows of ``own`` with a ``doc_id`` of ``found``, and few others: a bitmap of the ids keeps their texts out of the shuffle."""
    ids = found.select(F.xxhash64("doc_id").alias("hash"))
    words = bitmap_words(ids.count(), settings)
    bitmap = scratch.write(hash_bitmap(ids, words), "document-bitmap")
    return own.where(in_bitmap(bitmap, words, F.xxhash64("doc_id")))


def in_bitmap(bitmap: DataFrame, words: int, hashed: Column) -> Column:
    word = F.get(bitmap.scalar(), F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(words - 1)).cast("int"))
    return F.getbit(word, hashed.bitwiseAND(F.lit(63)).cast("int")) == 1


def bitmap_words(n_windows: int, settings: Settings) -> int:
    bits = settings.least_bits
    while bits < min(64 * n_windows, settings.most_bits):
        bits *= 2
    return bits // 64


def hash_bitmap(windows: DataFrame, words: int) -> DataFrame:
    """One row with one array of 64-bit words in which the bit of every hash is set."""
    word = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(words - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("hash").bitwiseAND(F.lit(63)).cast("int"))
    set_ = windows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = windows.sparkSession.range(words).withColumnRenamed("id", "word").join(set_, "word", "left")
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(ordered["bits"].alias("bitmap"))


def _matched(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Windows of an item that count in each scope of a document: ``doc_id, item_id, kind, place, item_at, main, values``.

    A scope is one shift, or a band of shifts as wide as the item: text may be put in or left out. Two rows of overlapping bands
    hold any two shifts that are half a band apart. Of several matches of an item's window that of the shift with most windows counts. A
    benchmark value with several values in the scope costs the windows that hold it changed, no others.
    """
    pair = ["doc_id", "item_id"]
    shifts = pairs.groupBy(*pair, "shift").agg(F.count_distinct("item_at").alias("n_shift"))
    pairs = pairs.join(shifts, [*pair, "shift"]).join(sizes.select("item_id", F.greatest("n_all", F.lit(16)).alias("wide")), "item_id")
    bands = [(F.lit(0), F.col("shift")), (F.lit(1), F.floor(F.col("shift") / F.col("wide"))), (F.lit(2), F.floor((F.col("shift") + F.col("wide") / 2) / F.col("wide")))]
    scopes = F.array(*[F.struct(k.alias("kind"), p.cast("bigint").alias("place")) for k, p in bands])
    changed = F.size(F.filter("values", lambda v: v["slots"] != v["own"]))
    best = F.max(F.struct("n_shift", (-changed).alias("same"), F.size("values").alias("n"), (-F.col("shift")).alias("at"), "main", "values")).alias("b")
    scope = [*pair, "kind", "place"]
    rows = pairs.select("*", F.inline(scopes)).groupBy(*scope, "item_at").agg(best).select(*scope, "item_at", "b.main", "b.values")
    slots = rows.select(*scope, F.explode("values").alias("v")).groupBy(*scope, "v.slots").agg(F.count_distinct("v.own").alias("n"))
    bad = slots.where("n > 1").groupBy(*scope).agg(F.collect_set("slots").alias("bad"))
    fits = F.forall("values", lambda v: (v["own"] == v["slots"]) | ~F.array_contains("bad", v["slots"]))
    return rows.join(bad, scope, "left").where(F.col("bad").isNull() | fits).drop("bad")


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id",
                 item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, n_matched, n_windows, coverage, n_slots, verbatim``.

    ``n_matched``: windows of the item that fit in its best alignment, of ``n_windows``. ``verbatim``: no slot has another value.
    Null and empty texts have no tokens and match nothing; rows with a null id are not reported. Rows that repeat a document's or an item's id
    count as parts of it. Either table may be empty, then so is the result. Extra columns are not read; texts may be of any
    length.
    """
    with Scratch(docs.sparkSession) as scratch:
        items = benchmark.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
        wanted = scratch.write(benchmark_windows(items.where(F.col("item_id").isNotNull()), settings), "benchmark-windows")
        count = [F.count_distinct(F.when(F.col("main"), F.col("at"))).alias("n_main"), F.count_distinct("at").alias("n_all")]
        sizes = scratch.write(wanted.groupBy("item_id").agg(*count), "benchmark-sizes")
        own = documents(docs, text, key).where(F.col("doc_id").isNotNull())
        found = likely(own, items.where(F.col("item_id").isNotNull()), sizes, scratch, settings)
        own = perhaps_in(own, found, scratch, settings).join(found, "doc_id")
        hits = _prepared(own, "doc_id", "spots").select("doc_id", *FORMS, F.explode_outer("spots").alias("spot"))
        name = F.get(F.array(*[F.lit(form) for form in FORMS]), F.col("spot.f"))
        hits = hits.select("doc_id", *FORMS, name.alias("form"), F.col("spot.k").alias("k")).select("doc_id", _window(settings.window).alias("w"))
        hashed = F.xxhash64(*[F.get("w", F.lit(n))["hash"] for n in range(settings.window)])
        hits = hits.where(F.size("w") > 0).select("doc_id", F.get("w", F.lit(0))["at"].alias("at"), hashed.alias("hash"), _slots(F.col("w")).alias("own"))
        pairs = hits.join(wanted.withColumnRenamed("at", "item_at"), "hash").where(F.size("own") == F.size("slots"))
        pairs = pairs.select("doc_id", "item_id", "item_at", "main", (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip("slots", "own").alias("values"))
        pairs = scratch.write(pairs.distinct(), "window-matches")
        rows = scratch.write(_matched(pairs, sizes), "matched")
        scope = ["doc_id", "item_id", "kind", "place"]
        counts = rows.groupBy(*scope).agg(F.count_if("main").alias("m_main"), F.count(F.lit(1)).alias("m_all"))
        values = rows.select(*scope, F.explode("values").alias("v")).select(*scope, "v.slots", "v.own").distinct()
        other = F.count_if(F.col("own") != F.col("slots")).alias("other")
        slots = values.groupBy(*scope).agg(F.count_distinct("slots").alias("n_slots"), other)
        found = counts.join(slots, scope, "left").join(sizes, "item_id")
        parts = [F.struct((F.col(f"m_{n}") / F.nullif(f"n_{n}", F.lit(0))).alias("coverage"), F.col(f"m_{n}").alias("m"), F.col(f"n_{n}").alias("n")) for n in ("main", "all")]
        found = found.withColumn("c", F.when(parts[0]["coverage"] >= parts[1]["coverage"], parts[0]).otherwise(parts[1]))
        best = F.max(F.struct("c.coverage", (-F.coalesce("other", F.lit(0))).alias("same"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "c.m", "c.n"))
        found = found.groupBy("doc_id", "item_id").agg(best.alias("best")).where(F.col("best.coverage") >= settings.coverage)
        out = found.select(
            "doc_id", "item_id", F.col("best.m").alias("n_matched"), F.col("best.n").alias("n_windows"), "best.coverage", "best.n_slots",
            (F.col("best.same") == 0).alias("verbatim"),
        )
        return scratch.keep(out, "contaminated")
