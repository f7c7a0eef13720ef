"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

The model is fitted on a bounded sample of labelled rows (``EXAMPLES``, the lowest hashes of their ids; rows whose
crc32(doc_id) mod 5 is 0 are held out and never learned from). Features are words and word beginnings of three to six
letters; those in at least ``MIN_TEXTS`` different texts whose counts differ between the classes (chi-squared at least
``CHI2``, beyond what chance gives among a million features; the best ``FEATURES``) form the vector space. Toxic texts
with none of these, as with few labels or in a rare language, add their ``COVER`` most telling features each: such as
chance gives once among all features, or else at a level of 1 % (``CHI2_LEAST``). Copies count
once here, or every rare word of a copied toxic text would look telling. Document vectors are TF-IDF with unit length, so a product is the cosine.

The examples lie in an inverted index whose posting lists are cut into blocks of ``BLOCK`` examples with the largest
weight of each term and block. A query takes the exact scores of the most promising blocks, drops every block whose
bound stays below the k-th best score, and scores the rest: the k nearest are exact. Their votes are weighted by
distance, and a monotone fit of leave-one-out votes to labels turns the vote into a calibrated probability. The nearest
example ids are the evidence.

The index is small and broadcast: at most ``EXAMPLES`` examples over ``FEATURES`` terms at every input size. Scoring is
one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.shared import kept, small_batches, stored, table

EXAMPLES = 20_000
FEATURES = 4096
CHI2 = 40.0
MIN_TEXTS = 8
COVER = 4
COVER_TEXTS = 2
CHI2_LEAST = 6.63
NEAREST = 25
BLOCK = 64
SEED_BLOCKS = 4
HELD_OUT_MOD = 5
WORD_CACHE = 50_000
COUNTED = 50_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *("^" + word[:n] for n in range(3, min(6, len(word)) + 1))]


def feature_counts(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for feature in word_features(word):
            found[feature] += n
    return found


def chi_squared(with_toxic: np.ndarray, with_all: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Of the 2 x 2 table feature x label, per feature."""
    a, b = with_toxic.astype(float), (with_all - with_toxic).astype(float)
    c, d = toxic - a, (total - toxic) - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(below > 0, total * (a * d - b * c) ** 2 / np.maximum(below, 1e-12), 0.0)


@dataclass(eq=False)
class Space:
    """The vector space: feature ids and inverse document frequencies."""

    ids: dict[str, int]
    idf: np.ndarray

    def _known(self) -> dict[str, tuple[int, ...]]:
        """Terms of words met before: one bounded memory per worker, for the space it used last."""
        return kept(self, dict)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted term ids and unit-length weights; empty where the text has no feature."""
        counts: dict[int, int] = {}
        known = self._known()
        for word, n in Counter(_WORD.findall(text.lower())).items():
            terms = known.get(word)
            if terms is None:
                if len(known) >= WORD_CACHE:
                    known.clear()
                terms = known[word] = tuple(self.ids[f] for f in word_features(word) if f in self.ids)
            for t in terms:
                counts[t] = counts.get(t, 0) + n
        terms = np.array(sorted(counts), dtype=np.int64)
        weights = (1 + np.log([counts[t] for t in terms])) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, weights / np.sqrt((weights**2).sum()) if len(terms) else weights


class BlockMaxIndex:
    """Inverted index over unit vectors with the largest weight of every term and block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], features: int):
        self.n, blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        rows = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(vectors)] or [np.zeros(0)]).astype(np.int64)
        terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int64)
        weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(np.float64)
        order = np.lexsort((rows, terms))
        self.rows, self.weights = rows[order], weights[order]
        block_of = self.rows // BLOCK
        self.most = np.zeros((features, blocks))
        np.maximum.at(self.most, (terms[order], block_of), self.weights)
        # at[t, b]: where the postings of term t in block b begin; at[t, b + 1] is where they end
        counts = np.zeros((features, blocks + 1), dtype=np.int32)
        np.add.at(counts, (terms[order], block_of + 1), 1)
        self.at = np.searchsorted(terms[order], np.arange(features))[:, None].astype(np.int32) + np.cumsum(counts, axis=1, dtype=np.int32)

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Exact scores of the examples in the given blocks, zero elsewhere."""
        rows = self.at[terms]
        first = rows[:, blocks].ravel()
        sizes = rows[:, blocks + 1].ravel() - first
        total = int(sizes.sum())
        before = np.cumsum(sizes) - sizes
        postings = np.repeat(first - before, sizes) + np.arange(total)
        query = np.repeat(weights, sizes.reshape(len(terms), -1).sum(axis=1))
        return np.bincount(self.rows[postings], self.weights[postings] * query, minlength=self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above zero and their cosines, nearest first, ties to the smaller index."""
        bound = weights @ self.most[terms]
        seeds = np.argpartition(-bound, min(SEED_BLOCKS, len(bound)) - 1)[:SEED_BLOCKS]
        scores = self._scores(terms, weights, seeds)
        if without >= 0:
            scores[without] = 0
        floor = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
        rest = (bound >= floor - 1e-12) & (bound > 0)
        rest[seeds] = False
        if rest.any():
            scores += self._scores(terms, weights, np.nonzero(rest)[0])
            if without >= 0:
                scores[without] = 0
        found = np.nonzero(scores > 0)[0]
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        found = found[np.lexsort((found, -scores[found]))][:k]
        return found, np.minimum(scores[found], 1.0)


def monotone_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic least squares by pooling adjacent violators: block centres and means."""
    blocks: list[list[float]] = []
    values, where = np.unique(x, return_inverse=True)
    n, s = np.bincount(where), np.bincount(where, weights=y)
    for v, count, total in zip(values, n, s):
        blocks.append([total, count, v * count])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    """What scoring needs; all parts are bounded by ``EXAMPLES`` and ``FEATURES``."""

    space: Space
    index: BlockMaxIndex | None
    labels: np.ndarray
    doc_ids: np.ndarray
    base: float
    without_features: float
    centres: np.ndarray
    means: np.ndarray

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        near, cosines = self.index.nearest(terms, weights, NEAREST, without)
        pull = 1.0 / (1.1 - cosines)
        return float((pull @ self.labels[near] + self.base) / (pull.sum() + 1)), near, cosines

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Calibrated score, ids of the nearest examples and their cosines."""
        terms, weights = self.space.vector(text)
        if not len(terms) or self.index is None:
            return self.without_features, np.zeros(0, dtype=np.int64), np.zeros(0)
        vote, near, cosines = self.vote(terms, weights)
        # the small share of the raw vote keeps the order within a pooled block
        fitted = 0.99 * np.interp(vote, self.centres, self.means) + 0.01 * vote
        return float(min(max(fitted, 0.0), 1.0)), self.doc_ids[near], cosines


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_MOD)) == 0


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most ``EXAMPLES`` rows of ``labels`` (doc_id, toxic) that are not held out and have a document.

    A document with several labels is toxic if any says so; NULL labels are no labels. Without labelled rows every
    score is 0.
    """
    spark = documents.sparkSession
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(EXAMPLES)
    )
    examples = stored(
        documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most EXAMPLES rows of two numbers
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text")),
        "examples",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            names = list(every)
            columns = [pa.array(names, type=pa.string()), *(pa.array([of[f] for f in names], type=pa.int64()) for of in (toxic, every))]
            return pa.RecordBatch.from_arrays(columns, names=["feature", "n_toxic", "n"])

        toxic, every = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                features = feature_counts(text.as_py()).keys()
                every.update(features)
                if label:
                    toxic.update(features)
                if len(every) > COUNTED:
                    yield counted()
                    toxic, every = Counter(), Counter()
        yield counted()

    texts = stored(examples.groupBy("text").agg(F.max("toxic").alias("toxic")), "texts")
    totals = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    total, toxic = totals[0], int(totals[1] or 0)
    if not 0 < toxic < total:
        base = float(examples.agg(F.avg("toxic")).first()[0] or 0)  # one text, or one class: nothing to tell apart
        return Model(Space({}, np.zeros(0)), None, np.zeros(0), np.zeros(0), base, base, np.zeros(1), np.zeros(1))
    counted = stored(
        texts.select("toxic", "text").mapInArrow(count, "feature string, n_toxic long, n long")
        .groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n")).where(F.col("n") >= COVER_TEXTS),
        "features",
    )
    a, n = F.col("n_toxic").cast("double"), F.col("n").cast("double")
    gap = a * (total - toxic) - (n - a) * toxic  # a * d - b * c
    chi2 = total * gap * gap / (n * (total - n) * float(toxic) * (total - toxic))
    tested = counted.where(n < total).select("feature", "n", "n_toxic", chi2.alias("chi2"))
    best = tested.where((F.col("chi2") >= CHI2) & (F.col("n") >= MIN_TEXTS))
    best = best.orderBy(F.desc("chi2"), "feature").limit(FEATURES).collect()  # at most FEATURES rows
    best += _covering(texts, tested, best, counted.count())
    space = Space({r["feature"]: i for i, r in enumerate(best)}, np.array([1 + np.log((total + 1) / (r["n"] + 1)) for r in best]))
    shared = spark.sparkContext.broadcast(space)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.vector(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in found], type=pa.list_(pa.int64())), pa.array([w for _, w in found], type=pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "terms", "weights"],
            )

    rows = examples.mapInArrow(vectors, "doc_id long, toxic int, terms array<long>, weights array<double>").toPandas()
    empty = rows["terms"].map(len) == 0
    without = (rows.loc[empty, "toxic"].sum() + toxic / total) / (empty.sum() + 1)
    rows = rows[~empty]
    # examples with the same strongest terms lie in the same blocks, which makes the block bounds tight
    strongest = [tuple(np.asarray(t)[np.argsort(-np.asarray(w), kind="stable")[:3]].tolist()) for t, w in zip(rows["terms"], rows["weights"])]
    rows = rows.assign(strongest=strongest).sort_values(["strongest", "doc_id"], kind="stable")
    pairs = [(np.asarray(t), np.asarray(w)) for t, w in zip(rows["terms"], rows["weights"])]
    model = Model(
        space, BlockMaxIndex(pairs, len(best)) if pairs else None, rows["toxic"].to_numpy(float), rows["doc_id"].to_numpy(),
        toxic / total, float(without), np.zeros(1), np.zeros(1),
    )
    if model.index is None:
        return model
    drawn = spark.sparkContext.broadcast((model, pairs))

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = drawn.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            votes = [model.vote(*pairs[i], without=i)[0] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(votes, type=pa.float64())], names=["at", "vote"])

    votes = spark.range(len(pairs)).mapInArrow(leave_one_out, "at long, vote double").toPandas()
    model.centres, model.means = monotone_fit(votes["vote"].to_numpy(), model.labels[votes["at"].to_numpy()])
    return model


def _covering(texts: DataFrame, tested: DataFrame, best: list, features: int) -> list:
    """Features for the toxic texts that have none of ``best``: at most ``COVER`` for each of these examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, f) for at, text in zip(batch.column(0).to_pylist(), batch.column(1)) for f in feature_counts(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], type=pa.int64()), pa.array([f for _, f in found], type=pa.string())], names=["at", "feature"])

    toxic = texts.where("toxic = 1").select(F.xxhash64("text").alias("at"), "text").mapInArrow(run, "at long, feature string")
    met = toxic.join(tested, "feature")
    chance = NormalDist().inv_cdf(1 - 0.5 / max(features, 2)) ** 2  # chi-squared that one of so many features reaches
    floor = best[-1]["chi2"] if len(best) == FEATURES else CHI2
    strict = (F.col("chi2") >= floor) & (F.col("n") >= MIN_TEXTS)
    telling = (F.col("chi2") >= CHI2_LEAST) & (2 * F.col("n_toxic") >= F.col("n"))
    each = F.when(telling, F.struct((-F.col("chi2")).alias("minus"), "feature", "n"))
    bare = met.groupBy("at").agg(F.max(strict).alias("covered"), F.slice(F.sort_array(F.collect_list(each)), 1, COVER).alias("own"))  # of one text
    added: dict[str, dict] = {}
    for row in bare.where(~F.col("covered")).select("own").collect():  # at most COVER features of each example
        sure = [x for x in row["own"] if -x["minus"] >= chance]
        added.update({x["feature"]: {"feature": x["feature"], "n": x["n"]} for x in sure or row["own"]})
    return [added[f] for f in sorted(added.keys() - {r["feature"] for r in best})]


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (nearest example ids), evidence_cosines."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(text.as_py() or "") for text in batch.column(2)]
            score = np.array([s for s, _, _ in found], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                    pa.array([e[:3] for _, e, _ in found], type=pa.list_(pa.int64())),
                    pa.array([c[:3] for _, _, c in found], type=pa.list_(pa.float64())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "evidence", "evidence_cosines"],
            )

    narrow = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return narrow.mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, evidence_cosines array<double>"
    )


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score all rows of ``documents``.

    NULL texts count as empty; texts without any feature get the smoothed rate of such examples. NULL ids are held out.
    Repeated rows get equal scores. Other columns are ignored. An empty table gives no rows.
    """
    return scored(documents, fit(documents, labels))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that the model does not call toxic."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.score(text.as_py() or "")[0] < 0.5 for text in batch.column(at)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


