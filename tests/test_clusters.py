"""Shared-scan k-means against plain Lloyd steps and pairwise silhouettes on small tables."""

import hashlib

import numpy as np
import pytest

from usagelens.functions import clusters


def frame(spark, x):
    rows = [(f"r{i:03d}", *map(float, row)) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, a double, b double").repartition(3)


def lloyd(x, k, seed):
    order = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{seed}:r{i:03d}".encode()).hexdigest(), i))
    centres = x[order[:k]].copy()
    for _ in range(300):
        label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        after = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.abs(after - centres).max() <= 1e-10:
            break
        centres = after
    return after


def pairwise_silhouette(x, label):
    d = ((x[:, None] - x) ** 2).sum(2)
    scores = []
    for i, own in enumerate(label):
        same = (label == own).sum()
        if same == 1:
            scores.append(0.0)
            continue
        a = d[i, label == own].sum() / (same - 1)
        b = min(d[i, label == j].mean() for j in set(label) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(scores)


@pytest.fixture
def points():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(c, 0.4, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [np.full((5, 2), 9.0)])


def test_models_equal_plain_lloyd(spark, points):
    matrix = frame(spark, points).persist()
    models = clusters.fit(matrix, ["a", "b"], "id", [2, 3, 4], [1, 2, 3])
    assert len(models) == 9
    for m in models:
        want = lloyd(points, m.k, m.seed)
        assert np.allclose(m.centres, want, atol=1e-9)
        label, distance = clusters.nearest(points, want)
        assert m.sizes.tolist() == np.bincount(label, minlength=m.k).tolist()
        assert m.cost == pytest.approx(distance.sum())
    best = clusters.best_restarts(models)
    assert all(best[k].cost <= m.cost * (1 + 1e-9) for k in best for m in models if m.k == k)
    scores = clusters.mean_silhouettes(matrix, ["a", "b"], list(best.values()))
    for m, score in zip(best.values(), scores):
        assert score == pytest.approx(pairwise_silhouette(points, clusters.nearest(points, m.centres)[0]))
    got = dict(clusters.assigned(matrix, ["a", "b"], "id", best[3]).collect())
    label, _ = clusters.nearest(points, best[3].centres)
    assert got == {f"r{i:03d}": int(c) for i, c in enumerate(label)}


def test_few_equal_and_no_rows(spark):
    same = clusters.fit(frame(spark, np.ones((6, 2))), ["a", "b"], "id", [3], [1])[0]
    assert same.sizes.tolist() == [6, 0, 0] and same.cost == 0
    two = clusters.fit(frame(spark, np.eye(2)), ["a", "b"], "id", [4], [1])[0]
    assert len(two.centres) == 2 and sorted(two.sizes) == [1, 1]
    assert clusters.mean_silhouettes(frame(spark, np.eye(2)), ["a", "b"], [two, same])[0] == 0
    assert clusters.fit(frame(spark, np.zeros((0, 2))), ["a", "b"], "id", [3], [1]) == []


def test_all_models_share_their_passes(spark, points):
    tracker = spark.sparkContext.statusTracker()
    matrix = frame(spark, points).persist()
    matrix.count()

    def jobs(ks, seeds):
        group = f"passes-{len(ks)}-{len(seeds)}"
        spark.sparkContext.setJobGroup(group, group)
        clusters.fit(matrix, ["a", "b"], "id", ks, seeds)
        return len(tracker.getJobIdsForGroup(group))

    alone = max(jobs([k], [s]) for k in (2, 3) for s in range(2))
    assert jobs([2, 3], [0, 1]) <= alone + 2
    spark.sparkContext.setJobGroup("", "")


def test_passes_read_blocks_and_keep_the_distances(spark, points):
    blocks = clusters._blocks(frame(spark, points).coalesce(1), ["a", "b"]).collect()
    assert len(blocks) == 1 and np.frombuffer(blocks[0]["block"]).reshape(2, -1).shape == (2, len(points))
    x = np.random.default_rng(3).normal(size=(500, 6))
    centres = np.concatenate([x[:3], x[1:2]])  # a repeated centre: ties go to the lower number
    distance = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    cluster, least = clusters.nearest(x, centres)
    assert cluster.tolist() == distance.argmin(axis=1).tolist() and least.tolist() == distance.min(axis=1).tolist()
