"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question keeps its template when its parameters change. Any
capitalised word may be a name, wherever it stands and however lines are wrapped; items list their windows both with the
placeholder and with the word, for documents that have it in lower case. Every
window of ``WINDOW`` template tokens is hashed; document windows meet benchmark windows in a hash join. Matches of a
document and an item on one diagonal (document position minus item position) form an instance; in it, equal values of
the item must stand for equal values of the document (slot consistency). A document is contaminated by an item if
consistent windows cover at least ``THRESHOLD`` of the item's windows.

Documents are read once and never shuffled. What is broadcast is a Bloom filter of the benchmark's hashes of at most
``MAX_WINDOWS`` words; the few windows that pass it meet the benchmark windows in a join by hash. Items of equal text are
matched once. A larger benchmark lets more windows pass by chance, which the join removes; it takes no more memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.shared import stored, table

WINDOW = 5
THRESHOLD = 0.8
MAX_WINDOWS = 1_000_000  # words of 64 bits
FEW_KEYS = 500_000  # keys of contaminated documents that the stage sends to the documents; more are joined by a shuffle

# Units that may follow a number.
UNITS = [
    "%", "percent", "kg", "g", "mg", "t", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "miles", "ft", "feet",
    "inches", "yd", "l", "ml", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months",
    "years", "usd", "eur", "gbp", "dollars", "euros", "cents", "kmh", "mph", "w", "kw", "kwh", "v", "hz", "gb", "mb",
    "°c", "°f",
]

_MARK = "\u0001"  # starts a placeholder; followed by n, m or u and then the value
_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*"  # a capitalised word
_INNER_NAME = r"\p{Lu}(?<=[\p{Ll}\p{N},;] \p{Lu})\p{L}*"  # one within a sentence
_UNIT = rf"(?<=\p{{N}})\s?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
_CURRENCY = r"([$€£])\s?(?=\p{N})"
_PUNCTUATION = rf"[^\p{{L}}\p{{N}}\s{_MARK}]++(?!\p{{N}})|(?<!\p{{N}})[^\p{{L}}\p{{N}}\s{_MARK}]++"
_NUMBER = rf"\p{{N}}++(?:[^\p{{L}}\p{{N}}\s{_MARK}]++\p{{N}}++)*+"


def marked_text(text: Column, name: str = _NAME) -> Column:
    """Lower-case text without punctuation whose numbers, names and units carry a typed mark before their value."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\s\p{{Z}}{_MARK}]+", " ")
    text = F.regexp_replace(text, name, _MARK + "m$0")
    text = F.regexp_replace(text, _UNIT, f" {_MARK}u$1")
    text = F.regexp_replace(text, _CURRENCY, f"{_MARK}u$1 ")
    text = F.regexp_replace(text, _PUNCTUATION, " ")
    return F.lower(F.regexp_replace(text, _NUMBER, _MARK + "n$0"))


def template_text(marked: Column) -> Column:
    """The same text with the values gone: token for token the same positions."""
    return F.regexp_replace(marked, _MARK + r"([nmu])\S*", _MARK + "$1")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def windows(tokens: Column) -> Column:
    """Hashes of all windows in order; fewer tokens than a window are one window, no tokens are none."""
    n = F.size(tokens)
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)]),
    )
    whole = F.xxhash64(F.concat_ws(" ", tokens))
    return F.when(n >= WINDOW, each).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))


def windowed(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys``, values (marked tokens) and hashes (of template windows) per row.

    Explode ``hashes`` with an outer generator only: for an inner one Spark infers a filter on the array's size, pushes
    it below these projections and so repeats the whole chain of replacements for every window.
    """
    marked = texts.select(*keys, marked_text(F.col("text")).alias("marked"))
    tokens = marked.select(
        *keys, _tokens(F.col("marked")).alias("values"), _tokens(template_text(F.col("marked"))).alias("tokens")
    )
    return tokens.select(*keys, "values", windows(F.col("tokens")).alias("hashes"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items' different texts: item_key, n_windows, item_at, hash, item_values.

    A window is listed in every form a document may have it: a capitalised word as a name or as the word, and the first
    word as a name that is this word. An item shorter than a window would match any names, so only names within its
    sentences are free there, and each other word may be capitalised.
    """
    items = benchmark.select("text", F.xxhash64("text").alias("item_key")).distinct()
    long_values, short_values = _tokens(marked_text(F.col("text"))), _tokens(marked_text(F.col("text"), _INNER_NAME))
    items = items.select("item_key", long_values.alias("long_values"), short_values.alias("short_values"))
    short = F.size("long_values") < WINDOW
    # stored step by step: else Spark repeats the chain of replacements wherever a later expression uses it
    items = stored(items.select("item_key", short.alias("short"), F.when(short, F.col("short_values")).otherwise(F.col("long_values")).alias("values")), "items")
    n_windows = F.when(F.size("values") > 0, F.greatest(F.size("values") - WINDOW + 1, F.lit(1))).otherwise(0)
    at = items.withColumn("n_windows", n_windows).where("n_windows > 0").select(
        "item_key", "short", "n_windows", "values", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("item_at")
    ).withColumn("item_values", F.slice("values", F.col("item_at") + 1, WINDOW))

    def forms(v: Column, k: Column) -> Column:
        name = F.startswith(v, F.lit(_MARK + "m"))
        capital = F.col("short") | ((k == 0) & (F.col("item_at") == 0))
        other = F.when(name, F.substring(v, 3, 1 << 30)).when(~F.contains(v, F.lit(_MARK)) & capital, F.lit(_MARK + "m"))
        return F.struct(template_text(v).alias("usual"), other.alias("other"))

    listed = stored(at.withColumn("forms", F.transform("item_values", forms)).drop("values"), "forms").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << WINDOW) - 1))))
    picked = F.transform("forms", lambda f, k: F.when(F.expr("mask").bitwiseAND(F.pow(F.lit(2), k).cast("int")) > 0, f["other"]).otherwise(f["usual"]))
    listed = stored(listed.where(F.col("mask") < F.pow(F.lit(2), F.size("forms"))).withColumn("tokens", picked), "forms_picked")
    listed = listed.where(F.forall("tokens", lambda t: t.isNotNull()))
    return listed.select("item_key", "n_windows", "item_at", windows(F.col("tokens"))[0].alias("hash"), "item_values").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per contaminated document and item: doc_id, text_key, item_id, matched, n_windows, containment, verbatim.

    ``matched`` counts the item's windows found consistently in the document, ``verbatim`` tells that no slot value
    differs. Documents without a contaminating item have no row. Items and texts that are NULL or empty have no
    windows and match nothing; an item shorter than a window matches documents that consist of it. Documents with a
    NULL id are told apart by ``text_key`` (xxhash64 of the text); repeated rows give one row. Other columns are
    ignored; empty tables give no rows.
    """
    ids = benchmark.select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item_key")).distinct()
    return (
        _contaminated(documents, benchmark, threshold).join(ids, "item_key")
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(F.struct((F.col("matched") / F.col("n_windows")).alias("containment"), "matched", "n_windows", "verbatim")).alias("b"))
        .select("doc_id", "text_key", "item_id", "b.matched", "b.n_windows", "b.containment", "b.verbatim")
    )


def _contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same per document and text of an item: doc_id, text_key, item_key, n_windows, matched, verbatim."""
    items = stored(item_windows(benchmark), "benchmark")
    texts = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    docs = windowed(texts, "doc_id", "text_key")
    docs = _in_filter(docs.select("doc_id", "text_key", "values", F.posexplode_outer("hashes").alias("at", "hash")), items)
    docs = docs.select("doc_id", "text_key", "at", "hash", F.slice("values", F.col("at") + 1, WINDOW).alias("doc_values"))
    found = docs.join(items, "hash").withColumn("diagonal", F.col("at") - F.col("item_at")).drop("hash", "at")
    # filtered once stored: as a condition of the join, the test would take each window's row with its whole text along
    found = stored(_with_slots(found), "windows").where("fits").drop("fits")
    pair = ["doc_id", "text_key", "item_key"]
    covered = found.groupBy(*pair, "n_windows").agg(F.count_distinct("item_at").alias("hits"))
    likely = covered.where(F.col("hits") >= threshold * F.col("n_windows")).select(*pair)
    same_pair = reduce(Column.__and__, [F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")) for c in pair])
    found = found.alias("f").join(likely.alias("l"), same_pair, "left_semi")
    return _consistent(found, pair, threshold)


def _in_filter(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``hash`` may be one of ``items``: all that are, and of the others about one in 10,000 while
    the hashes are fewer than ``MAX_WINDOWS``. A hash sets four bits of one word."""
    words = max(1, min(MAX_WINDOWS, items.count()))
    word = F.pmod("hash", F.lit(words))
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(hash, {k}) & 63 AS int))" for k in (40, 46, 52, 58)))
    bits = items.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    return docs.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(mask) == mask)


def _with_slots(found: DataFrame) -> DataFrame:
    """``slots``: the placeholders of the window with the values of item and document; most windows have none.

    Names are compared without their mark, as either side may have the word in lower case. ``fits`` tells that each word
    of the item that is no placeholder is the same word in the document, capitalised or not.
    """
    word = lambda v: F.when(F.startswith(v, F.lit(_MARK + "m")), F.substring(v, 3, 1 << 30)).otherwise(v)
    free = lambda v: F.contains(v, F.lit(_MARK))
    both = F.zip_with("item_values", "doc_values", lambda i, d: F.struct(free(i).alias("free"), word(i).alias("item_value"), word(d).alias("doc_value")))
    fits = F.forall("both", lambda s: s["free"] | (s["item_value"] == s["doc_value"]))
    slots = F.transform(F.filter("both", lambda s: s["free"]), lambda s: F.struct(s["item_value"].alias("item_value"), s["doc_value"].alias("doc_value")))
    return found.withColumn("both", both).withColumns({"slots": slots, "fits": fits}).drop("item_values", "doc_values", "both")


def _consistent(found: DataFrame, pair: list[str], threshold: float) -> DataFrame:
    instance = [*pair, "diagonal"]
    votes = (
        found.select(*instance, F.explode("slots").alias("s")).groupBy(*instance, "s.item_value", "s.doc_value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*instance, "item_value")
        .agg(F.max_by("doc_value", F.struct("n", "doc_value")).alias("usual"))
        .groupBy(*instance)
        .agg(F.map_from_entries(F.collect_list(F.struct("item_value", "usual"))).alias("usual"))  # one item's slots
    )
    same = reduce(Column.__and__, [F.col(f"w.{c}").eqNullSafe(F.col(f"v.{c}")) for c in instance])
    agrees = F.forall("slots", lambda s: F.element_at(F.col("usual"), s["item_value"]) == s["doc_value"])
    verbatim = F.forall("slots", lambda s: s["item_value"] == s["doc_value"])
    judged = found.alias("w").join(votes.alias("v"), same, "left").select(
        *[f"w.{c}" for c in pair], "n_windows", "item_at", (F.size("slots") == 0).alias("plain"), agrees.alias("agrees"), verbatim.alias("verbatim")
    )
    return (
        judged.where("plain OR agrees")
        .groupBy(*pair, "n_windows")
        .agg(F.count_distinct("item_at").alias("matched"), F.bool_and("verbatim").alias("verbatim"))
        .where(F.col("matched") >= threshold * F.col("n_windows"))
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no benchmark item contaminates, all columns as they are."""
    bad = stored(
        _contaminated(docs, table(spark, sf_dir, "benchmark"))
        .select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct(),
        "contaminated",
    )
    bad = F.broadcast(bad) if bad.count() <= FEW_KEYS else bad
    return docs.join(
        bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti"
    )
