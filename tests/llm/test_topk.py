import numpy as np

from usagelens.llm import topk


def test_scan_matches_all_pairs_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    x = np.floor(256 * (centres[rng.integers(0, 8, 3000)] + 0.1 * rng.normal(size=(3000, 64)))).astype(np.int64)
    ids, queries = np.arange(3000), x[::50]
    features = [topk.segment_features(queries, s) for s in topk.LEVELS]
    best = topk.Best(len(queries), 5)
    exact = sum(topk.scan(x[k : k + 700], ids[k : k + 700], queries, ids[::50], features, best) for k in range(0, 3000, 700))
    scores = queries @ x.T
    for n, q in enumerate(ids[::50]):
        want = sorted(((-scores[n, i], i) for i in ids if i != q))[:5]
        got = [(-s, i) for s, i in zip(best.score[best.q == n], best.id[best.q == n])]
        assert got == want
    assert exact < 0.5 * len(queries) * len(ids)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []), (None, [9.0, 9.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (100, [-1.0, 0.5, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame).orderBy("query_id", "rank").collect()]
    f = 256
    assert got == [
        (0, 1, 6, 5 * f * f), (0, 2, 6, 5 * f * f), (0, 3, 1, f * f), (0, 4, 5, 0), (0, 5, 100, 0),
        (100, 1, 0, 0), (100, 2, 5, 0), (100, 3, 6, 0), (100, 4, 6, 0), (100, 5, 1, -f * f),
    ]
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id = 1")).count() == 0


def test_many_query_blocks(spark, monkeypatch):
    frame = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(0, 15), k -> cast(sin(id * 13 + k * 7) AS float)) AS embedding")
    one = sorted(map(tuple, topk.top_k(frame).collect()))
    monkeypatch.setattr(topk, "BLOCK", 3)
    assert sorted(map(tuple, topk.top_k(frame).collect())) == one and len(one) == 8 * 5
