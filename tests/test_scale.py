"""Work shared by the parts of a query, on tables with repeated, missing and NULL keys."""

import datetime as dt
import re
from collections import Counter

import pytest

from tests.test_plans import plan
from usagelens.operators import headline, star
from usagelens.plans import catalog
from usagelens.plans.mapping import KeptTables, Tables
from usagelens.sources import sinks


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Customer 3 is there twice, 4 not at all; order 7 is there twice, 9 has no customer; line 5's order is missing."""
    folder = str(tmp_path_factory.mktemp("odd"))
    orders = [(i, i % 5 + 1, dt.date(1995, 1, 1) + dt.timedelta(days=37 * i)) for i in range(60) if i != 5]
    orders += [(7, 3, dt.date(1996, 3, 1)), (None, 2, dt.date(1996, 4, 1)), (9, None, dt.date(1996, 5, 1))]
    lines = [
        (i % 62, i % 4 + 1, i % 41 + 1, i % 13 + 1, 100.25 * (i % 29 + 1), float(i % 50 + 1), "FO"[i % 2], "RAN"[i % 3])
        for i in range(400)
    ] + [(None, 1, 1, 1, 5.0, 1.0, "F", "R")]
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "EUROPE"), (1, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "FRANCE", 0), (1, "CHINA", 1)]),
        "customer": (
            "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
            [(1, "a", 0, 500.0, "BUILDING"), (2, "=b", 1, 5000.0, "MACHINERY"), (3, "c", 0, 9000.0, None), (3, "c2", 1, 1.0, "X"), (5, "e", 0, 2000.0, "X")],
        ),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date", orders),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
            "l_linestatus string, l_returnflag string",
            lines,
        ),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def no_small_sides(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def bag(frame):
    return Counter(frame.collect())


def test_runs_take_star_keys_without_a_shuffle_of_their_own(spark, odd, no_small_sides):
    text = plan(catalog._fact_runs(Tables(spark, odd)))
    joins = re.findall(r"\n\((\d+)\) (\w+)[^\n]*\nLeft keys \[1\]: \[(\w+)#", text)
    kinds = {key: kind for _, kind, key in joins}
    assert {kinds[key] for key in ("plan_at_run", "model", "task_type")} == {"BroadcastHashJoin"}
    last = {key: int(number) for number, _, key in joins}
    assert last["customer_id"] < last["l_orderkey"]  # customers meet the orders, below the join with the lines


def test_keys_joined_per_order_give_the_same_facts(spark, odd):
    t = Tables(spark, odd)
    customer_dim = star.dim_customer(t.customers)
    dims = star.dim_plan(t.plans), star.dim_model(t.models), star.dim_task(t.runs)
    want = bag(star.fact_agent_runs(t.agent_runs, customer_dim, *dims))
    assert bag(catalog._fact_runs(t)) == want
    assert bag(catalog._star(t)["fact_agent_runs"]) == want
    assert None in {row["customer_key"] for row in want}


def test_headline_costs_join_lines_and_orders_once(spark, odd):
    t = Tables(spark, odd)
    shared = catalog.QUERIES["m06_headline_costs"](t)
    assert "lineitem.parquet" not in plan(shared)  # the reports read the runs that one join wrote
    alone = headline.headline_costs(
        catalog.MODELS["l08_routing_savings"](t), catalog.REPORTS["r12_failure_cost"](t), catalog.REPORTS["r06_model_task_matrix"](t)
    )
    assert shared.collect() == alone.collect()


def test_report_files_derive_their_tables_once(spark, odd, monkeypatch):
    texts, write = {}, sinks.write_report_table

    def watched(frame, folder, name, file_format="parquet"):
        texts[name] = plan(frame)
        return write(frame, folder, name, file_format)

    monkeypatch.setattr(sinks, "write_report_table", watched)
    digest = catalog._report_files(Tables(spark, odd))
    assert set(texts) == set(catalog.REPORTS) == {row["table_name"] for row in digest.collect()}
    assert not [name for name, text in texts.items() if "lineitem.parquet" in text]


def test_kept_tables_are_the_tables(spark, odd, tmp_path):
    t, kept = Tables(spark, odd), KeptTables(spark, odd, str(tmp_path), catalog._REPORT_COLUMNS)
    for name in ("runs", "customers", "customer_months"):
        frame, columns = getattr(kept, name), getattr(kept, name).columns
        original = getattr(t, name)
        assert frame.dtypes == original.select(columns).dtypes
        assert name == "runs" or columns == original.columns
        assert bag(frame) == bag(original.select(columns))
    assert {row["customer_id"] for row in bag(kept.runs)} >= {None}
