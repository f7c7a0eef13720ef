"""The fit of the mixing rates: its steps are data, so one plan is compiled for many iterations."""

from pyspark.sql import functions as F

from usagelens.llm import mixing


def _posteriors(spark):
    a = (F.col("id") % 7 + 1) / 10.0
    return spark.range(40).select(
        F.when(F.col("id") % 11 > 0, F.col("id") * 3).otherwise(0).alias("tokens"), F.array(a, (1 - a) * 0.25, (1 - a) * 0.75).alias("posterior"), "id"
    )


def _steps(n):
    return [[0.3 / i, -0.7 / i, 0.1 * (-1) ** i / i] for i in range(1, n + 1)]


def test_steps_give_the_rates_of_the_fit(spark):
    frame = _posteriors(spark)
    for n in (0, 1, 9, 10, 11, 23):
        for lower in (0.0, 1.0, 1.5):
            fit = mixing.Fit(_steps(n), lower, [], [], [])
            want = {r["id"]: r["rate"] for r in frame.withColumn("rate", fit.rate()).collect()}
            got = mixing.stepped(frame, fit.steps, lower)
            assert got.columns == ["tokens", "posterior", "id", "rate"]
            assert {r["id"]: r["rate"] for r in got.collect()} == want


def test_iterations_share_their_code(spark, tmp_path):
    frame = _posteriors(spark)
    frame.write.parquet(str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p"))
    bodies = set()
    for n in (1, 4, 10):
        rated = mixing.stepped(kept, _steps(n), 1.0)
        codes = rated.agg(F.sum("rate"))._jdf.queryExecution().debug().codegenToSeq()
        bodies.add(tuple(sorted(codes.apply(i)._2() for i in range(codes.size()))))
    assert len(bodies) == 1


def test_iterations_broadcast_nothing_and_stay_short(spark, tmp_path, monkeypatch):
    _posteriors(spark).drop("id").write.parquet(str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p"))
    plan = mixing.stepped(kept, _steps(3), 1.0).agg(F.sum("rate"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    lengths, stepped = [], mixing.stepped
    monkeypatch.setattr(mixing, "stepped", lambda frame, steps, lower: lengths.append(len(steps)) or stepped(frame, steps, lower))
    fit = mixing.fit_rates(kept, [0.2, 0.3, 0.5], steps=2 * mixing.FOLDED + 1)
    assert len(fit.steps) == 2 * mixing.FOLDED + 1 and max(lengths) == mixing.FOLDED
    reached = kept.withColumn("rate", fit.rate()).agg(*[F.sum(F.col("rate") * F.col("tokens") * F.get("posterior", d)) for d in range(3)]).first()
    assert all(abs(a - b) <= 1e-9 * abs(b) for a, b in zip(fit.reached, reached))
