"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

Vectors become integers, ``floor(256 * x)``. Cut a vector into segments and keep each segment's mean and standard
deviation: with L the segment length, ``sum L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)`` is a lower bound of the
squared distance. The inner product is ``(|q|^2 + |x|^2 - distance^2) / 2``, so the same statistics bound it from
above: ``sum L * (mean_q * mean_x + dev_q * dev_x)``. Bounds are taken from few segments to many (``LEVELS``); only
pairs whose bound reaches the query's k-th best score so far go on, and survivors get the exact integer score.

The queries (every row whose id is divisible by ``step``) are handled in blocks of about ``BLOCK`` vectors: one block
at a time is broadcast, a bounded size, and every task scans its own rows against it and returns at most k rows for
each query. No partition of the rows is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.shared import table

SCALE = 256
TOP = 5
QUERY_STEP = 50
BLOCK = 16_384
LEVELS = (4, 16)
ROWS, QUERIES, PAIRS = 4096, 512, 1 << 17

RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and integer vectors of the rows that take part: no NULL id, vector or component and all finite."""
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()) & (bad[ends] == bad[ends - lengths])
    whole = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0)).astype(np.int64)
    return (
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[good],
        [whole[e - n : e] for e, n in zip(ends[good], lengths[good])],
    )


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of one width: shorter vectors end in zeros, and what lies beyond the width meets zeros of every query."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(L) * mean and sqrt(L) * deviation per segment; the product of two rows bounds the inner product."""
    width = x.shape[1]
    edges = np.unique(np.linspace(0, width, min(segments, max(width, 1)) + 1).astype(int))
    means, devs = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        part = x[:, a:b].astype(np.float64)
        means.append(part.mean(axis=1) * np.sqrt(b - a))
        devs.append(part.std(axis=1) * np.sqrt(b - a))
    return np.stack(means + devs, axis=1) if means else np.zeros((len(x), 1))


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        keep = place < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.floor[q[last]] = score[last]


def scan(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, features: list[np.ndarray], best: Best) -> int:
    """Update ``best`` with a chunk of rows; returns the number of exact scores computed."""
    exact, own = 0, [segment_features(x, s) for s in LEVELS]
    for start in range(0, len(queries), QUERIES):
        part = slice(start, start + QUERIES)
        bound = features[0][part] @ own[0].T
        slack = 1e-9 * (np.abs(bound).max(initial=0) + 1)
        bound[query_ids[part, None] == ids[None, :]] = -np.inf
        if len(ids) > best.k and np.isneginf(best.floor[part]).any():  # seed the floor with the most promising rows
            likely = np.argpartition(-bound, best.k - 1, axis=1)[:, : best.k]
            q = np.repeat(np.arange(len(likely)), best.k)
            r = likely.ravel()
            r, q = r[bound[q, r] > -np.inf], q[bound[q, r] > -np.inf]
            seed = Best(len(likely), best.k)
            seed.add(q, (queries[part][q] * x[r]).sum(axis=1), ids[r])
            floor = np.maximum(best.floor[part], seed.floor)
            exact += len(q)
        else:
            floor = best.floor[part]
        q, r = np.nonzero((bound + slack >= floor[:, None]) & (bound > -np.inf))
        for k in range(0, len(q), PAIRS):
            qq, rr = q[k : k + PAIRS], r[k : k + PAIRS]
            for level in range(1, len(LEVELS)):
                tight = np.einsum("ij,ij->i", features[level][part][qq], own[level][rr]) + slack >= floor[qq]
                qq, rr = qq[tight], rr[tight]
            score = (queries[part][qq] * x[rr]).sum(axis=1)
            exact += len(qq)
            reach = score >= floor[qq]
            best.add(qq[reach] + start, score[reach], ids[rr[reach]])
    return exact


def top_k(embeddings: DataFrame, k: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest scores of each query row among all rows but its own.

    ``embeddings`` has vec_id and embedding; other columns are ignored. Rows with a NULL id take no part. Vectors of
    unequal length are compared over their common length. A repeated row is a candidate as often as it occurs; equal
    query rows are asked once, and query rows that share an id but not the vector give k ranks each. An empty table
    gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = vectors.where("vec_id % " + str(int(step)) + " = 0 AND embedding IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // BLOCK))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        query_ids, lists = integer_vectors(block["vec_id"].combine_chunks(), block["embedding"].combine_chunks())
        if len(query_ids):
            queries = matrix(lists, max(map(len, lists)))
            found.append(_search(vectors, spark.sparkContext.broadcast((query_ids, queries)), k, b))
    if not found:
        return spark.createDataFrame([], RESULT)
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return (
        reduce(DataFrame.unionAll, found)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search(vectors: DataFrame, shared, k: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        features = [segment_features(queries, s) for s in LEVELS]
        best = Best(len(queries), k)
        for batch in batches:
            ids, lists = integer_vectors(batch.column(0), batch.column(1))
            for n in range(0, len(ids), ROWS):
                scan(matrix(lists[n : n + ROWS], queries.shape[1]), ids[n : n + ROWS], queries, query_ids, features, best)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(best.q), block, dtype=np.int32)),
                pa.array(best.q),
                pa.array(query_ids[best.q]),
                pa.array(best.id),
                pa.array(best.score),
            ],
            names=["block", "query", "query_id", "vec_id", "score"],
        )

    return vectors.mapInArrow(run, "block int, query long, query_id long, vec_id long, score long")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
