import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from usagelens.schemas import AGENT_RUNS, CUSTOMER_MONTHS, CUSTOMERS, EXPERIMENT_ASSIGNMENTS  # noqa: E402
from usagelens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from usagelens.plans.mapping import Tables

    return Tables(spark, SMALL)


def _frame(spark, schema, rows, defaults):
    names = schema.names
    return spark.createDataFrame([tuple({**defaults, **row}.get(n) for n in names) for row in rows], schema)


@pytest.fixture(scope="session")
def make(spark):
    """Literal frames: only the fields a test cares about need to be given."""

    class Maker:
        def runs(self, *rows):
            defaults = dict(
                started_at=dt.datetime(2025, 1, 1), task_type="bug_fix", model="fast-small", steps=1, input_tokens=1,
                output_tokens=1, llm_cost_usd=Decimal("1"), latency_sec=1.0, lines_changed=1, tests_total=1,
                tests_passed=1, status="success", credits_charged=1, source_stack="Go", target_stack="Go",
            )
            numbered = [{"run_id": f"R{i:04d}", **row} for i, row in enumerate(rows)]
            return _frame(spark, AGENT_RUNS, numbered, defaults)

        def customers(self, *rows):
            defaults = dict(
                signup_date=dt.date(2025, 1, 5), industry="A", region="EU", acquisition_channel="Organic",
                is_sales_led=0, status="active", current_plan="Pro",
            )
            return _frame(spark, CUSTOMERS, rows, defaults)

        def months(self, *rows):
            defaults = dict(
                month=dt.date(2025, 1, 1), plan="Pro", monthly_fee_usd=Decimal("29"), included_credits=8, credits_used=0,
                overage_credits=0, overage_revenue_usd=Decimal("0"), revenue_usd=Decimal("29"),
            )
            return _frame(spark, CUSTOMER_MONTHS, rows, defaults)

        def assignments(self, *rows):
            defaults = dict(experiment_name="e", assigned_at=dt.date(2025, 1, 1), variant="control", pro_price_shown=29)
            return _frame(spark, EXPERIMENT_ASSIGNMENTS, rows, defaults)

        def arms(self, n1, x1, n2, x2):
            """Experiment frame with given sizes and conversions, spread over a distributed range."""
            from pyspark.sql import functions as F

            i = F.col("id")
            control = i < n1
            converted = F.when(control, i < x1).otherwise(i - n1 < x2)
            return spark.range(n1 + n2).select(
                F.when(control, "control").otherwise("treatment").alias("variant"),
                converted.cast("int").alias("converted"),
                F.when(converted, F.lit(29) + i % 7).otherwise(0).cast("decimal(18,2)").alias("revenue_first_3mo_usd"),
            )

    return Maker()
