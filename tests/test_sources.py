import pytest
from pyspark.sql import functions as F

from usagelens.operators import star
from usagelens.schemas import TABLES
from usagelens.sources import sinks
from usagelens.sources.tables import filter_options, load_benchmark_results, load_tables


def test_sanitize_text(spark):
    rows = [("=1+1", 1), ("+x", 2), ("-x", 3), ("@x", 4), ("\tx", 5), ("\rx", 6), ("plain=", -7), (None, 8), ("", 9)]
    frame = spark.createDataFrame(rows, "t string, n int")
    got = {r["n"]: r["t"] for r in sinks.sanitize_text(frame).collect()}
    assert got == {1: "'=1+1", 2: "'+x", 3: "'-x", 4: "'@x", 5: "'\tx", 6: "'\rx", -7: "plain=", 8: None, 9: ""}
    untouched = sinks.sanitize_text(frame.withColumn("u", F.col("t")), ["t"]).where("n = 1").first()
    assert untouched["u"] == "=1+1"


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_domain_tables_round_trip(spark, tables, tmp_path, file_format):
    for name in TABLES:
        frame = getattr(tables, name).select(*TABLES[name].names)
        path = f"{tmp_path}/{name}" + (".csv" if file_format == "csv" else "")
        if file_format == "csv":
            frame.write.option("header", True).csv(path)
        else:
            frame.write.parquet(path)
    loaded = load_tables(spark, str(tmp_path), file_format)
    for name, frame in loaded.items():
        original = getattr(tables, name).select(*TABLES[name].names)
        assert frame.schema.names == TABLES[name].names
        assert frame.count() == original.count()
    assert loaded["agent_runs"].agg(F.sum("llm_cost_usd")).first() == tables.runs.agg(F.sum("llm_cost_usd")).first()


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_tables(spark, f"{tmp_path}/nowhere")


def test_benchmark_results_from_csv(spark, tmp_path):
    path = tmp_path / "attempts.csv"
    path.write_text(
        "model,task_id,task_type,repeat,status,tests_passed,tests_total,error_type,prompt_tokens,output_tokens,"
        "total_duration_sec,eval_duration_sec,tokens_per_sec,cost_usd,code_extracted,timestamp\n"
        "MOCK/a,t1,bug_fix,1,failed,0,3,,10,20,1.5,1.0,20.0,0.00012,True,2025-01-01T00:00:00\n"
    )
    row = load_benchmark_results(spark, str(path)).collect()[0]
    assert row["error_type"] is None and row["tests_total"] == 3 and row["code_extracted"] is True


def test_reports_are_written_and_empty_ones_refused(spark, tmp_path):
    frame = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    reports = {"one": lambda: frame, "two": lambda: frame.where("k = 'a'")}
    assert sinks.run_report_catalog(reports, str(tmp_path), "csv", shared=[frame]) == {"one": 2, "two": 1}
    assert not frame.is_cached
    back = spark.read.csv(f"{tmp_path}/one", header=True)
    assert sorted(tuple(r) for r in back.collect()) == [("a", None), ("b", "2")]
    with pytest.raises(ValueError, match="nothing"):
        sinks.write_report_table(frame.where("k = 'z'"), str(tmp_path), "nothing")
    assert not (tmp_path / "nothing").exists()


def test_filter_options_are_ordered_lists(tables):
    domain = {name: getattr(tables, name) for name in TABLES}
    options = filter_options(domain)
    assert options["plans"] == ["Enterprise", "Free", "Pro", "Team"]
    assert options["months"] == sorted(options["months"]) and options["months"][0] == "2025-01-01"
    assert len(options["task_types"]) == 6 and len(options["models"]) == 4


def test_star_schema_is_written_with_facts_by_month(spark, tables, tmp_path):
    built = star.star_schema(tables.customers, tables.plans, tables.models, tables.customer_months, tables.agent_runs)
    paths = sinks.write_star_schema(built, str(tmp_path))
    facts = spark.read.csv(paths["fact_agent_runs"], header=True)
    assert facts.count() == tables.runs.count()
    assert "month_key=202501" in {p.name for p in (tmp_path / "fact_agent_runs").iterdir()}
    assert spark.read.csv(paths["dim_customer"], header=True).count() == tables.customers.count()
