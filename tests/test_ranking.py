import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.ranking import global_rank, interpolated_quantiles, ntile_of, quantile_bucket, rank_auc


def test_global_rank_is_dense_unique_and_ordered_under_heavy_ties(spark):
    # a third of the rows share one value
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 37 % 1001).alias("v"), F.col("id")
    ).repartition(6)
    rows = global_rank(frame, ["v", "id"]).collect()
    assert {r["_n"] for r in rows} == {3000}
    ordered = sorted(rows, key=lambda r: r["_rank"])
    assert [r["_rank"] for r in ordered] == list(range(1, 3001))
    keys = [(r["v"], r["id"]) for r in ordered]
    assert keys == sorted(keys)


def test_ntile_equals_the_window_function(spark):
    for n in (3, 10, 97, 748):
        frame = spark.range(n)
        ours = {r["id"]: r["t"] for r in global_rank(frame, ["id"]).withColumn("t", ntile_of(10)).collect()}
        window = {r["id"]: r["t"] for r in frame.withColumn("t", F.ntile(10).over(W.orderBy("id"))).collect()}
        assert ours == window


def test_published_bucket_sizes(spark):
    ranked = global_rank(spark.range(748), ["id"])
    sizes = Counter(r[0] for r in ranked.select(ntile_of(10)).collect())
    assert [sizes[i] for i in range(1, 11)] == [75] * 8 + [74] * 2
    sizes = Counter(r[0] for r in ranked.select(quantile_bucket(10)).collect())
    assert [sizes[i] for i in range(1, 11)] == [75, 75, 75, 74, 75, 75, 74, 75, 75, 75]


def test_quantile_bucket_of_a_single_row(spark):
    assert global_rank(spark.range(1), ["id"]).select(quantile_bucket(10)).collect()[0][0] == 1


def test_interpolated_quantiles_match_numpy(spark):
    rng = random.Random(5)
    a = [rng.choice([0.0, 1.5, rng.random() * 100]) for _ in range(701)]
    b = [float(i) for i in range(701)]
    frame = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(5)
    got = interpolated_quantiles(frame, ["a", "b"], [0.01, 0.5, 0.99])
    assert got["a"] == pytest.approx(list(np.quantile(a, [0.01, 0.5, 0.99])))
    assert got["b"] == pytest.approx(list(np.quantile(b, [0.01, 0.5, 0.99])))


def test_rank_auc_counts_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.5, -1.25, rng.random()]), rng.random() < 0.3) for _ in range(300)]
    frame = spark.createDataFrame(rows, "score double, hit boolean").repartition(5)
    hits, rest = [s for s, hit in rows if hit], [s for s, hit in rows if not hit]
    want = sum((a > b) + (a == b) / 2 for a in hits for b in rest) / (len(hits) * len(rest))

    def counts(table):
        return table.groupBy("score").agg(F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("n"))

    for ranges in (1, 2, 7, 256):
        assert rank_auc(counts(frame), "score", "p", "n", ranges).first()["auc"] == pytest.approx(want, abs=1e-12)
    for table in (frame.where("hit"), frame.where("NOT hit"), frame.where("false")):
        assert rank_auc(counts(table), "score", "p", "n").first()["auc"] is None
