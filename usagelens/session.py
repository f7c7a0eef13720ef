"""Session settings. On a cluster, pass the same SQL settings through spark-submit."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions, converts small join sides to broadcast by
# measured size and splits skewed join partitions.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str, cpus: int | None = None) -> SparkSession:
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for setting, value in SQL_SETTINGS.items():
        builder = builder.config(setting, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
