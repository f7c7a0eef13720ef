"""Plan shape: what must hold for the operators to work on large tables."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from usagelens.operators import filtered, models, quality, reports, usage
from usagelens.schemas import TABLES
from usagelens.sources.tables import load_tables


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("domain"))
    for name in TABLES:
        getattr(tables, name).select(*TABLES[name].names).write.parquet(f"{folder}/{name}")
    return load_tables(spark, folder)


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def test_first_runs_are_cut_before_the_shuffle(stored):
    text = plan(usage.activation_scores(stored["agent_runs"]))
    assert "Partial" in text and "WindowGroupLimit" in text
    assert text.index("WindowGroupLimit") > 0 and text.count("WindowGroupLimit") >= 2
    assert "llm_cost_usd" not in text


def test_scan_reads_only_what_a_report_uses(stored):
    text = plan(reports.migration_pairs(stored["agent_runs"]))
    assert "EqualTo(task_type,code_migration)" in text
    scan = text[text.index("ReadSchema"):].split("\n")[0]
    for unused in ("run_id", "customer_id", "latency_sec", "model"):
        assert unused not in scan


def test_month_filter_reaches_the_scan_as_a_range(stored):
    chosen = filtered.Filters(months=("2025-06-01",))
    text = plan(filtered.model_task_success(stored["agent_runs"], stored["customers"], chosen))
    assert "GreaterThanOrEqual(started_at,2025-06-01" in text and "LessThan(started_at,2025-07-01" in text


def test_customer_filter_joins_aggregated_rows(stored):
    text = plan(filtered.cost_per_success(stored["agent_runs"], stored["customers"]))
    tree = text[: text.index("(1)")]
    # the semi join sits above an aggregate of the run table
    join = next(line for line in tree.split("\n") if "Join" in line)
    below = tree[tree.index(join) + len(join):]
    assert "HashAggregate" in below


@pytest.mark.parametrize(
    "build",
    [
        lambda t: reports.unit_economics_plan(t["customer_months"], t["agent_runs"]),
        lambda t: reports.task_cost_per_credit(t["agent_runs"], t["customer_months"]),
        lambda t: reports.failure_cost(t["agent_runs"]),
        lambda t: models.simpsons_reversal(t["agent_runs"]),
        lambda t: models.cost_quality_frontier(t["agent_runs"]),
        lambda t: models.routing_savings(t["agent_runs"]),
    ],
)
def test_no_cartesian_product_and_no_python(stored, build):
    text = plan(build(stored))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEval" not in text and "BatchEvalPython" not in text


def test_failure_cost_reads_runs_once(stored):
    assert plan(reports.failure_cost(stored["agent_runs"])).count("Scan parquet") == 2  # tree line and detail line


def test_quality_rules_read_a_table_once_and_run_ids_once_more(stored):
    names = ("customers", "agent_runs", "customer_months", "experiment_assignments")
    text = plan(quality.quality_report(*[stored[n] for n in names], ("2025-02-01", "2025-04-30"), {"control": 29, "treatment": 39}))
    locations = [line for line in text.split("\n") if line.startswith("Location")]
    for name in names[1:]:
        assert sum(f"/{name}]" in line for line in locations) == (2 if name == "agent_runs" else 1), name
    assert "ReadSchema: struct<run_id:string>" in text


def test_hot_customer_is_reduced_before_the_join(stored):
    hot = stored["agent_runs"].withColumn(
        "customer_id", F.when(F.xxhash64("run_id") % 3 == 0, F.lit("C00000001")).otherwise(F.col("customer_id"))
    )
    rows = usage.cost_by_customer_month(hot)
    assert rows.groupBy("customer_id", "month").count().where("count > 1").isEmpty()
    assert usage.first_runs(hot).where("customer_id = 'C00000001'").count() == 5
