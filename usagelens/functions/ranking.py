"""Order statistics over whole tables without funnelling rows through one task.

``global_rank`` range-partitions on the ordering key, numbers rows inside each range and
adds the number of rows in the ranges before it. The only exchange is the range
partitioning; the offsets are one row per partition.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.functions.columns import dbl

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def global_rank(frame: DataFrame, order: Sequence[Column | str], rank: str = "_rank", total: str = "_n") -> DataFrame:
    """Add the 1-based global row number by ``order`` and the row count.

    ``order`` must end in a unique key so that the numbering is deterministic.
    The ranged frame is checkpointed because the offsets and the rows must come from the
    same physical partitioning.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    placed = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_slot", _ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy()).alias(total),
    )
    in_part = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + in_part + 1)
        .drop("_slot", "_part", "_before")
    )


def ntile_of(buckets: int, rank: str = "_rank", total: str = "_n") -> Column:
    """SQL NTILE from a rank and a row count: the first buckets take the remainder."""
    r, n = F.col(rank), F.col(total)
    small, larger = F.floor(n / buckets), n % buckets
    edge = larger * (small + 1)
    in_large = F.ceil(ratio_of(r, small + 1))
    in_small = larger + F.ceil(ratio_of(r - edge, small))
    return F.when(r <= edge, in_large).otherwise(in_small).cast("int")


def ratio_of(a: Column, b: Column) -> Column:
    return F.try_divide(dbl(a), dbl(b))


def quantile_bucket(buckets: int, rank: str = "_rank", total: str = "_n") -> Column:
    """Equal-frequency bucket with linearly interpolated edges over ranks 1..n.

    Edge k sits at rank 1 + k (n - 1) / buckets and belongs to the lower bucket, so the
    bucket of rank r is ceil(buckets (r - 1) / (n - 1)), at least 1. Integer arithmetic.
    """
    r, n = F.col(rank), F.col(total)
    steps = F.floor(ratio_of((r - 1) * buckets + n - 2, n - 1))
    return F.coalesce(F.greatest(F.lit(1), steps), F.lit(1)).cast("int")


def interpolated_quantiles(
    frame: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float]]:
    """Exact quantiles of several columns, interpolated linearly between neighbours.

    Equal values are counted first; the distinct values are ranked in ranges, all columns in
    one pass. Only the requested numbers reach the driver.
    """
    values = frame.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), dbl(c).alias("v")) for c in columns])).alias("x")
    ).select("x.*")
    ranked = _covered_ranks(
        values.where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count(F.lit(1)).alias("c"))
    )
    results = []
    for i, q in enumerate(probabilities):
        at = (F.col("_n") - 1) * F.lit(float(q)) + 1
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covered = (F.col("_first") <= k) & (k <= F.col("_last"))
            results.append(F.max(F.when(covered, F.col("v"))).alias(f"{side}{i}"))
        results.append(F.max(at - F.floor(at)).alias(f"w{i}"))
    found = {row["name"]: row for row in ranked.groupBy("name").agg(*results).collect()}
    return {
        c: [
            row[f"lo{i}"] + (row[f"hi{i}"] - row[f"lo{i}"]) * row[f"w{i}"]
            for row in [found[c]]
            for i in range(len(probabilities))
        ]
        for c in columns
        if c in found
    }


def _covered_ranks(counted: DataFrame) -> DataFrame:
    """First and last rank covered by each distinct value of a (name, v, c) count table."""
    ensure_checkpoint_dir(counted.sparkSession)
    placed = (
        counted.repartitionByRange("name", "v").withColumn("_part", F.spark_partition_id()).checkpoint()
    )
    sums = placed.groupBy("name", "_part").agg(F.sum("c").alias("_rows"))
    whole = W.partitionBy("name")
    offsets = sums.select(
        "name",
        "_part",
        F.coalesce(
            F.sum("_rows").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_rows").over(whole).alias("_n"),
    )
    inside = W.partitionBy("name", "_part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.join(F.broadcast(offsets), ["name", "_part"])  # one row per range and column
        .withColumn("_last", F.col("_before") + F.sum("c").over(inside))
        .withColumn("_first", F.col("_last") - F.col("c") + 1)
    )


def rank_auc(counts: DataFrame, score: str, positives: str, negatives: str, ranges: int = 256) -> DataFrame:
    """One row (auc): the Mann-Whitney share of (positive, negative) pairs in the right order, ties counting half.

    ``counts`` has one row per distinct score, so a score that most rows share is one row here. The scores are cut into
    ranges at approximate quantiles; negatives below a score are those of the lower ranges plus a running sum inside its
    own range. The cuts only spread the work: any cuts give the same result. NULL without positives or negatives.
    """
    cuts = counts.agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    edges = F.array(*[F.lit(c).cast("double") for c in sorted(set(cuts or []))]).cast("array<double>")
    placed = counts.withColumn("_range", F.size(F.filter(edges, lambda c: c < F.col(score))))
    lower = placed.groupBy("_range").agg(F.sum(negatives).alias("_own")).select(
        "_range", F.coalesce(F.sum("_own").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lower")
    )  # at most ``ranges`` rows
    inside = F.coalesce(F.sum(negatives).over(W.partitionBy("_range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = F.col(positives) * (F.col("_lower") + F.col("_inside") + F.col(negatives) / 2)
    return placed.withColumn("_inside", inside).join(F.broadcast(lower), "_range").agg(
        F.try_divide(F.sum(won), F.sum(positives).cast("double") * F.sum(negatives)).alias("auc")
    )
