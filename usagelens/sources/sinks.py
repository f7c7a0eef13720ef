"""Report and star-schema writers."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading characters a spreadsheet reads as the start of a formula.
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r"]


def sanitize_text(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """IO6: put an apostrophe before text a spreadsheet would evaluate; other values stay as they are."""
    texts = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = [c for c in (columns if columns is not None else frame.columns) if c in texts]
    return frame.withColumns(
        {c: F.when(F.substring(c, 1, 1).isin(FORMULA_STARTS), F.concat(F.lit("'"), c)).otherwise(F.col(c)) for c in chosen}
    )


def write_report_table(frame: DataFrame, folder: str, name: str, file_format: str = "parquet") -> int:
    """IO3: write one report as ``folder/name`` and return its rows; an empty report is an error and leaves no output."""
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.count()
        if not rows:
            raise ValueError(f"report {name} returned no rows")
        path = f"{folder}/{name}"
        writer = kept.write.mode("overwrite")
        if file_format == "csv":
            writer.option("header", True).option("emptyValue", "").csv(path)
        else:
            writer.format(file_format).save(path)
        return rows
    finally:
        kept.unpersist()


def run_report_catalog(
    reports: Mapping[str, Callable[[], DataFrame]], folder: str, file_format: str = "parquet", shared: Sequence[DataFrame] = ()
) -> dict[str, int]:
    """IO4: run every named report and write it; returns name -> rows. ``shared`` frames that reports read are kept meanwhile."""
    for frame in shared:
        frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {name: write_report_table(build(), folder, name, file_format) for name, build in reports.items()}
    finally:
        for frame in shared:
            frame.unpersist()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the write that made them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_star_schema(
    star: Mapping[str, DataFrame], folder: str, compression: str = "none", as_read: Collection[str] = ()
) -> dict[str, str]:
    """IO5: one CSV folder per star table; facts are partitioned by month.

    A fact in ``as_read`` is not dealt out by month first, which costs a shuffle of all its rows: each task that reads it
    writes a file per month. That is for facts read from files, whose tasks have a set size. They are written last, when
    the others' shuffles are gone.
    """
    paths = {}
    for name, frame in sorted(star.items(), key=lambda table: table[0] in as_read):
        path = f"{folder}/{name}"
        if name.startswith("fact_"):
            # rebalance: adaptive execution merges small months and splits large ones by size
            month = F.floor(F.col("date_key") / 100).cast("int")
            by_month = frame.withColumn("month_key", month)
            by_month = by_month if name in as_read else by_month.hint("rebalance", "month_key")
            by_month.write.mode("overwrite").option("header", True).partitionBy("month_key").csv(path, compression=compression)
        else:
            frame.write.mode("overwrite").option("header", True).csv(path, compression=compression)
        paths[name] = path
    return {name: paths[name] for name in star}
