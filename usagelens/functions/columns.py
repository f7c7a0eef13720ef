"""Small column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.schemas import FREE


def dbl(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division in double precision; NULL when the denominator is zero or NULL."""
    return F.try_divide(dbl(numerator), dbl(denominator))


def pct(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(dbl(numerator) * F.lit(100.0), dbl(denominator))


def margin(revenue: Column | str, cost: Column | str) -> Column:
    """(revenue - cost) / revenue, NULL when there is no revenue."""
    revenue = F.col(revenue) if isinstance(revenue, str) else revenue
    cost = F.col(cost) if isinstance(cost, str) else cost
    return ratio(dbl(revenue) - dbl(cost), revenue)


def month_of(value: Column | str) -> Column:
    return F.trunc(F.to_date(value), "month")


def month_number(value: Column | str) -> Column:
    """Months since year 0, so the difference of two is a calendar month distance."""
    return F.year(value) * 12 + F.month(value)


def months_between_starts(later: Column | str, earlier: Column | str) -> Column:
    return month_number(later) - month_number(earlier)


def is_paid(plan: Column | str = "plan") -> Column:
    return (F.col(plan) if isinstance(plan, str) else plan) != FREE


def paid_only(months: DataFrame) -> DataFrame:
    return months.where(is_paid())


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.sum(flag(condition).cast("long"))


def sum_where(condition: Column, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def succeeded(status: str = "status") -> Column:
    return F.col(status) == "success"


def scalar(frame: DataFrame, column: str) -> Column:
    """Value of a one-row frame as an uncorrelated scalar subquery (planned once, no join)."""
    return frame.select(column).scalar()


def literal_frame(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence[str]]) -> DataFrame:
    """A tiny constant table from SQL literals; its size is known to the optimizer."""
    values = ", ".join("(" + ", ".join(row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def dense(cells: DataFrame, row: str, column: str) -> DataFrame:
    """``cells`` (one row per row and column label) with the missing pairs of labels added, other columns NULL.

    Meant for crosstabs: every row label carries the set of column labels, so the size is that of the crosstab.
    """
    labels = cells.agg(F.collect_set(column).alias("labels"))
    every = cells.select(row).distinct().withColumn(column, F.explode(scalar(labels, "labels")))
    return every.join(cells, [row, column], "left")
