"""K-means for several (k, seed) models at once: every pass over the rows is one Lloyd step of all models.

A model starts from the ``k`` rows with the smallest MD5 of seed and key, so a start is the same in every engine and run.
A task keeps one count and one vector sum per model and cluster and sends only those, so a pass shuffles a few numbers a
task however many rows there are. Ties go to the lower cluster number; a cluster that loses all rows keeps its centre. A
model stands still once no coordinate of a centre moves by more than ``STILL``, and later passes leave it out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STILL = 1e-10
MAX_PASSES = 300
BLOCK = 4096
SAME_COST = 1e-9  # restarts whose costs differ by less reached one optimum; the lower seed stands for it


@dataclass(frozen=True)
class Clusters:
    """A fitted model: its centres, and per cluster the rows, the sum of their vectors and of their squared lengths."""

    k: int
    seed: int
    centres: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    cost: float

    def silhouette(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared-Euclidean silhouettes of rows: mean distances follow from the sums of each cluster; 0 for a lone row."""
        filled = self.sizes > 0
        n = np.where(filled, self.sizes, 1)
        mean = (x**2).sum(axis=1)[:, None] + (self.squares / n)[None, :] - 2 * x @ (self.sums / n[:, None]).T
        mean[:, ~filled] = np.inf
        rows = np.arange(len(x))
        own = n[cluster]
        inside = mean[rows, cluster] * own / np.maximum(own - 1, 1)
        mean[rows, cluster] = np.inf
        outside = mean.min(axis=1)
        width = np.maximum(inside, outside)
        usable = (own > 1) & (width > 0) & np.isfinite(outside)
        return np.where(usable, (np.where(usable, outside, 0) - inside) / np.where(usable, width, 1), 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row and the squared distance to it."""
    return _nearest(np.ascontiguousarray(x.T), centres)


def _nearest(columns: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for rows given column by column: whole columns at a time, a few vectors of working memory."""
    n = columns.shape[1]
    cluster, least = np.zeros(n, dtype=np.int64), np.full(n, np.inf)
    distance, step = np.empty(n), np.empty(n)
    for j, centre in enumerate(centres):
        distance.fill(0.0)
        for column, c in zip(columns, centre):
            np.subtract(column, c, out=step)
            np.multiply(step, step, out=step)
            np.add(distance, step, out=distance)
        cluster[distance < least] = j
        np.minimum(least, distance, out=least)
    return cluster, least


def _values(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def starts(matrix: DataFrame, columns: Sequence[str], key: str, ks: Sequence[int], seeds: Sequence[int]) -> dict:
    """{(k, seed): centres}; with fewer rows than ``k`` a model has as many centres as there are rows."""
    order = W.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", "seed", key)), key)
    first = (
        matrix.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(ks))
    )
    rows = sorted(first.collect(), key=lambda r: (r["seed"], r["place"]))  # max(ks) rows a seed
    of_seed = {s: np.array([[r[c] for c in columns] for r in rows if r["seed"] == s]).reshape(-1, len(columns)) for s in seeds}
    return {(k, s): of_seed[s][:k] for k in ks for s in seeds}


def _blocks(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The vectors as blocks of up to ``BLOCK`` rows, column by column, so that a pass reads no single rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _values(batch, columns).astype(np.float64)
            cut = [np.ascontiguousarray(x[i : i + BLOCK].T).tobytes() for i in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["block"])

    return matrix.select(*columns).mapInArrow(run, "block binary")


def _pass(blocks: DataFrame, columns: Sequence[str], centres: Sequence[np.ndarray], measured: bool = False) -> dict:
    """{(model, cluster): (rows, squares, cost, sums)} of one pass over all blocks; squares and cost are 0 unless ``measured``."""
    d = len(columns)
    sums = [f"s{i}" for i in range(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(c), d + 3)) for c in centres]
        for block in (b for batch in batches for b in batch.column(0)):
            x = np.frombuffer(block.as_py(), dtype=np.float64).reshape(d, -1)
            squares = (x.T**2).sum(axis=1) if measured else None
            for total, c in zip(totals, centres):
                cluster, distance = _nearest(x, c)
                total[:, 0] += np.bincount(cluster, minlength=len(c))
                if measured:
                    total[:, 1] += np.bincount(cluster, squares, len(c))
                    total[:, 2] += np.bincount(cluster, distance, len(c))
                for i, column in enumerate(x):
                    total[:, 3 + i] += np.bincount(cluster, column, len(c))
        model = np.repeat(np.arange(len(centres)), [len(c) for c in centres])
        cluster = np.concatenate([np.arange(len(c)) for c in centres])
        found = np.concatenate(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(model, pa.int32()), pa.array(cluster, pa.int32()), *(pa.array(column) for column in found.T)],
            names=["model", "cluster", "n", "squares", "cost", *sums],
        )

    numbers = ["n", "squares", "cost", *sums]
    schema = "model int, cluster int, " + ", ".join(f"{c} double" for c in numbers)
    per_task = blocks.mapInArrow(run, schema)
    rows = per_task.groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in numbers]).collect()  # one row per centre
    return {(r["model"], r["cluster"]): (r["n"], r["squares"], r["cost"], np.array([r[c] for c in sums])) for r in rows}


def fit(matrix: DataFrame, columns: Sequence[str], key: str, ks: Sequence[int], seeds: Sequence[int]) -> list[Clusters]:
    """All (k, seed) models, fitted by shared passes over the vectors of ``matrix``, kept in blocks meanwhile.

    Rows must have a unique ``key`` and no NULL in ``columns``. A table without rows gives no models.
    """
    blocks = _blocks(matrix, columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(matrix, blocks, columns, key, ks, seeds)
    finally:
        blocks.unpersist()


def _fit(matrix: DataFrame, blocks: DataFrame, columns: Sequence[str], key: str, ks: Sequence[int], seeds: Sequence[int]) -> list[Clusters]:
    current = {m: c for m, c in starts(matrix, columns, key, ks, seeds).items() if len(c)}
    moving = list(current)
    for _ in range(MAX_PASSES):
        if not moving:
            break
        found = _pass(blocks, columns, [current[m] for m in moving])
        still = set()
        for i, m in enumerate(moving):
            before = current[m]
            after = np.array([found[i, j][3] / found[i, j][0] if found[i, j][0] else before[j] for j in range(len(before))])
            current[m] = after
            if np.abs(after - before).max() <= STILL:
                still.add(m)
        moving = [m for m in moving if m not in still]
    names = list(current)
    found = _pass(blocks, columns, [current[m] for m in names], measured=True) if names else {}
    models = []
    for i, (k, seed) in enumerate(names):
        parts = [found[i, j] for j in range(len(current[k, seed]))]
        sizes, squares, costs = (np.array([p[at] for p in parts]) for at in range(3))
        models.append(Clusters(k, seed, current[k, seed], sizes, np.array([p[3] for p in parts]), squares, float(costs.sum())))
    return models


def best_restarts(models: Sequence[Clusters]) -> dict[int, Clusters]:
    """Per k the model of least cost, the lowest seed among those that reached it."""
    best = {}
    for k in sorted({m.k for m in models}):
        own = [m for m in models if m.k == k]
        least = min(m.cost for m in own)
        best[k] = min((m for m in own if m.cost <= least * (1 + SAME_COST)), key=lambda m: m.seed)
    return best


def mean_silhouettes(matrix: DataFrame, columns: Sequence[str], models: Sequence[Clusters]) -> list[float]:
    """The mean silhouette of every model in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(models))
        for batch in batches:
            x = _values(batch, columns)
            totals += [m.silhouette(x, nearest(x, m.centres)[0]).sum() for m in models]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(totals)], names=["model", "total"])

    sums = matrix.select(*columns).mapInArrow(run, "model int, total double").groupBy("model").agg(F.sum("total").alias("total"))
    total = {r["model"]: r["total"] for r in sums.collect()}
    return [total[i] / float(m.sizes.sum()) for i, m in enumerate(models)]


def assigned(matrix: DataFrame, columns: Sequence[str], key: str, model: Clusters) -> DataFrame:
    """Rows (key, cluster)."""
    kind = matrix.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, _ = nearest(_values(batch, columns), model.centres)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(cluster, pa.int32())], names=[key, "cluster"])

    return matrix.select(key, *columns).mapInArrow(run, f"{key} {kind}, cluster int")
