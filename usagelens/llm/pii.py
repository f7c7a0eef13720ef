"""Personal data: pattern findings, and terms that disclose them.

Base findings are e-mail addresses, IP addresses, card numbers (Luhn) and telephone numbers. Each distinct finding is a
protected entity. Words near its mentions (``REACH`` code points on either side) are its context. Over the whole corpus,
pointwise mutual information tells how strongly a word reveals an entity:

    disclosure(term, entity) = log(N * n(term, entity) / (n(term) * n(entity))) / log(N / n(entity))

with N documents, n the numbers of documents and n(term, entity) those where the term is in the entity's context. At 1
the term is as revealing as the entity itself. Terms met in at least ``SUPPORT`` contexts with a disclosure of at least
``GENERALISE`` become spans of kind ``term`` in those contexts; from ``REMOVE`` on they are removed, below they are
replaced by a general word.

Everything is DataFrame expressions. One pass over the texts finds mentions and contexts, a second counts documents per
term; counts are partial before the shuffle, and context pairs are linear in the number of mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import stored, table

REACH = 60
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95

#: In the order of ties. Runs are possessive and start only where a run starts or the last match ended (\G): the same
#: leftmost matches as with plain repetition, in linear time and without recursion on long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}+"

_SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"
_TERMS = "array<struct<term:string,start:int,end:int>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            F.split(hit, r"\."),
            lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(False),
        )
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _located(gaps: Column, hits: Column, item, kind: str, empty: str) -> Column:
    """Walk the texts between matches and the matches, and list ``item(hit, start, end)`` of the accepted ones."""

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.when(_valid(kind, pair["hit"]), F.concat(acc["found"], F.array(item(pair["hit"], start, end)))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.cast(empty).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("found"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def _terms(segment: Column, offset: Column) -> Column:
    """Words of a piece of text that starts at ``offset``, with their places."""
    return _located(
        F.split(segment, TERM, -1), F.regexp_extract_all(segment, F.lit(TERM), F.lit(0)),
        lambda hit, start, end: F.struct(F.lower(hit).alias("term"), (start + offset).cast("int").alias("start"), (end + offset).cast("int").alias("end")),
        "term", _TERMS,
    )


def mentions(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, spans (base findings), entities, context (entity, term, start, end) and pairs."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("any", F.col("text").rlike("[0-9@]"))
    none = F.array().cast("array<string>")
    need = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.contains("text", F.lit(".")), "card": F.lit(True)}
    matched = texts.select(
        "*",
        *[F.when(F.col("any") & need[k], F.split("text", p, -1)).otherwise(none).alias(f"{k}_gaps") for k, p in PATTERNS.items()],
        *[F.when(F.col("any") & need[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_hits") for k, p in PATTERNS.items()],
    )
    located = matched.select(
        "doc_id", "text",
        *[
            _located(
                F.col(f"{k}_gaps"), F.col(f"{k}_hits"),
                lambda hit, start, end, k=k, place=place: F.struct(
                    start.cast("int").alias("start"), F.lit(place).alias("place"), F.lit(k).alias("kind"), end.cast("int").alias("end")
                ),
                k, _SPANS,
            ).alias(k)
            for place, k in enumerate(PATTERNS)
        ],
    )
    spans = located.select("doc_id", "text", F.array_sort(F.concat(*PATTERNS)).alias("spans"))
    # findings are blanked out in what the contexts are taken from
    blank = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(
                acc["out"],
                F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0))),
            ).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    blanked = spans.withColumn("blank", F.when(F.size("spans") > 0, blank))

    def entity(s: Column) -> Column:
        hit = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        value = F.when(s["kind"].isin("card", "phone"), _digits(hit)).otherwise(F.lower(hit))
        return F.concat(s["kind"], F.lit("\u0001"), value)

    def around(s: Column) -> Column:
        low = F.greatest(s["start"] - REACH, F.lit(0))
        high = F.least(s["end"] + REACH, F.length("text"))
        before = _terms(F.substring(F.col("blank"), low + 1, s["start"] - low), low)
        after = _terms(F.substring(F.col("blank"), s["end"] + 1, high - s["end"]), s["end"])
        # a word that touches the edge may be cut
        whole = F.filter(
            F.concat(before, after),
            lambda t: ((t["start"] > low) | (low == 0)) & ((t["end"] < high) | (high == F.length("text"))),
        )
        return F.transform(whole, lambda t: F.struct(entity(s).alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")))

    context = F.when(F.size("spans") > 0, F.flatten(F.transform("spans", around)))
    found = blanked.select(
        "doc_id", F.xxhash64("text").alias("text_key"), "spans",
        F.when(F.size("spans") > 0, F.array_distinct(F.transform("spans", entity))).alias("entities"), context.alias("context"),
    )
    pair = F.transform("context", lambda c: F.concat(c["entity"], F.lit("\u0002"), c["term"]))
    return found.withColumn("pairs", F.array_distinct(pair))


def disclosures(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (entity, term, disclosure) of the terms that reveal an entity; ``found`` as stored by ``mentions``."""
    joint = (
        found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= SUPPORT)
        .select(F.substring_index("pair", "\u0002", 1).alias("entity"), F.substring_index("pair", "\u0002", -1).alias("term"), "n_both")
    )
    of_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    words = documents.select(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("words"))
    of_term = (
        # outer: an inner generator would have its array computed once more for a filter on its size
        words.select(F.explode_outer("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    )
    total = found.agg(F.count(F.lit(1)).cast("double").alias("n")).select("n").scalar()
    counted = joint.join(of_entity, "entity").join(of_term, "term", "left")
    n_term = F.greatest(F.coalesce("n_term", F.lit(0)), F.col("n_both"))
    pmi = F.log(total * F.col("n_both") / (n_term * F.col("n_entity")))
    known = counted.where(F.col("n_entity") < total).select("entity", "term", (pmi / F.log(total / F.col("n_entity"))).alias("disclosure"))
    return known.where(F.col("disclosure") >= GENERALISE)


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, text_key (xxhash64 of the text), base and all spans.

    ``all`` is an array of (start, place, kind, end, disclosure) sorted by start and kind; places are code points and
    the end is exclusive; ``disclosure`` is NULL for base findings. NULL texts count as empty and have no spans. Rows
    with a NULL or repeated id are told apart by ``text_key``; equal rows have equal spans. Other columns are ignored.
    An empty table gives no rows.
    """
    found = stored(mentions(documents), "mentions")
    risky = disclosures(documents, found)
    at = found.select("doc_id", "text_key", F.explode("context").alias("c")).select("doc_id", "text_key", "c.*")
    terms = (
        at.join(risky, ["entity", "term"])
        .groupBy("doc_id", "text_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key"))
        .agg(
            F.collect_list(
                F.struct("start", F.lit(len(PATTERNS)).alias("place"), F.lit("term").alias("kind"), "end", "disclosure")
            ).alias("terms")  # at most the words of one text
        )
    )
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("disclosure")))
    return found.select("doc_id", "text_key", "spans").join(
        terms, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key")), "left"
    ).select("doc_id", "text_key", "spans", F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, "terms"))).alias("all"))


def sanitised(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with every span replaced: base findings by their kind, terms by a general word or nothing."""
    found = personal_data(documents).where(F.size("all") > 0).select("doc_id", "text_key", "all").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_key")), "left")

    def instead(s: Column) -> Column:
        hit = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        general = F.when(hit.rlike(r"^\p{N}+$"), "[number]").when(hit.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
        return F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["disclosure"] >= REMOVE, "").otherwise(general)

    clean = F.aggregate(
        "all",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), instead(s)).alias("out"), s["end"].alias("at")
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return joined.select(F.col("id").alias("doc_id"), F.when(F.col("all").isNull(), F.col("text")).otherwise(clean).alias("text"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    n_term = (F.size("all") - F.size("spans")).cast("long").alias("n_term")
    return found.select("doc_id", *counts, F.sha2(_joined("spans").cast("binary"), 256).alias("base_sha256"), _joined("all").alias("spans"), n_term)
