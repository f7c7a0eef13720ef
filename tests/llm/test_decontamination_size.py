"""Decontamination with large benchmarks: what is broadcast is bounded, documents are read once and not shuffled."""

import pytest
from pyspark.sql import functions as F

from usagelens.llm import decontamination

TEXTS = ["one plain question that has more than five words to find", "another quite different item of the same long benchmark table"]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, TEXTS[i % 2]) for i in range(6)] + [(None, TEXTS[0]), (9, None)], "item_id long, text string")


def test_a_large_benchmark_takes_one_pass_and_a_bounded_broadcast(spark, monkeypatch, docs, benchmark):
    kept = {}

    def recorded(frame, label, stored=decontamination.stored):
        kept[label] = frame
        return stored(frame, label)

    monkeypatch.setattr(decontamination, "stored", recorded)
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", 4)
    frame = docs((1, f"words before. {TEXTS[0].capitalize()}, words after"), (2, "nothing of it here, not at all"), (3, TEXTS[1]))
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(frame, benchmark).collect()}
    assert got == {(1, i) for i in (0, 2, 4, None)} | {(3, i) for i in (1, 3, 5)}
    plan = kept["windows"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and plan.count("strategy=broadcast") == 1
    assert kept["benchmark"].count() == kept["benchmark"].select("item_key", "item_at", "hash").distinct().count()


def test_the_filter_lets_every_window_of_an_item_pass(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    items = spark.range(500).select(F.xxhash64("id").alias("hash"))
    got = {r.hash for r in decontamination._in_filter(hashes, items).collect()}
    assert {r.hash for r in items.collect()} <= got and len(got) < 550
    assert decontamination._in_filter(hashes, items.limit(0)).count() == 0


def test_the_stage_does_not_shuffle_texts(spark, monkeypatch, tmp_path, docs, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = docs((1, TEXTS[0]), (2, "some clean words"), (None, TEXTS[1]), (3, None))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decontamination.stage(spark, frame, str(tmp_path))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in out.collect()} == {2, 3}
        monkeypatch.setattr(decontamination, "FEW_KEYS", 1)
        assert {r.doc_id for r in decontamination.stage(spark, frame, str(tmp_path)).collect()} == {2, 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
