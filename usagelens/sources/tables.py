"""Reading the domain tables and the allow-lists built from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.schemas import ATTEMPTS, TABLES


def _read(spark: SparkSession, path: str, schema: T.StructType, file_format: str) -> DataFrame:
    reader = spark.read.schema(schema)
    try:
        if file_format == "csv":
            return reader.csv(path, header=True)
        return reader.format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no {file_format} table at {path}") from error
        raise


def load_tables(spark: SparkSession, folder: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """IO1: the six domain tables with their declared schemas; a missing table is an error."""
    suffix = ".csv" if file_format == "csv" else ""
    return {name: _read(spark, f"{folder}/{name}{suffix}", schema, file_format) for name, schema in TABLES.items()}


def load_benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    """IO2: benchmark attempts from CSV with a header."""
    return _read(spark, path, ATTEMPTS, "csv")


OPTION_COLUMNS = {
    "months": ("customer_months", "month"),
    "plans": ("plans", "plan"),
    "regions": ("customers", "region"),
    "channels": ("customers", "acquisition_channel"),
    "industries": ("customers", "industry"),
    "models": ("models", "model"),
    "task_types": ("agent_runs", "task_type"),
}


def filter_options_frame(tables: dict[str, DataFrame]) -> DataFrame:
    """IO7: (field, value) rows of every allow-list; one scan per table, values de-duplicated map-side."""
    by_table: dict[str, list[tuple[str, str]]] = {}
    for field, (table, column) in OPTION_COLUMNS.items():
        by_table.setdefault(table, []).append((field, column))
    frames = [
        tables[table]
        .select(
            F.explode(
                F.array(
                    *[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in columns]
                )
            ).alias("o")
        )
        .select("o.*")
        .where(F.col("value").isNotNull())
        .distinct()
        for table, columns in by_table.items()
    ]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def filter_options(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """IO7: ordered allow-lists; the distinct labels are a small domain."""
    options: dict[str, list[str]] = {field: [] for field in OPTION_COLUMNS}
    for row in filter_options_frame(tables).orderBy("field", "value").collect():
        options[row["field"]].append(row["value"])
    return options
