"""The star written from lines that met their orders once: the same tables, without a second join or shuffled facts."""

import pytest

from tests.test_plans import plan
from tests.test_scale import bag, odd  # noqa: F401
from usagelens.operators import star
from usagelens.plans import catalog
from usagelens.plans.mapping import StarTables, Tables
from usagelens.sources import sinks

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _kept_star(kept):
    return star.star_schema(
        kept.customers, kept.plans, kept.models, kept.customer_months, kept.agent_runs, kept.keyed_runs, kept.customer_dim
    )


def test_kept_lines_give_the_same_star(spark, odd, tmp_path):  # noqa: F811
    want, got = catalog._star(Tables(spark, odd)), _kept_star(StarTables(spark, odd, str(tmp_path)))
    assert list(got) == list(want)
    for name, frame in want.items():
        assert got[name].dtypes == frame.dtypes
        # two rows of one customer may take each other's key
        names = [c for c in frame.columns if name != "dim_customer" or c != "customer_key"]
        assert bag(got[name].select(names)) == bag(frame.select(names)), name
    with pytest.raises(ValueError, match="another dimension"):
        StarTables(spark, odd, str(tmp_path / "other")).keyed_runs(want["dim_customer"])


def test_star_files_join_lines_once_and_do_not_shuffle_runs(spark, odd, monkeypatch):  # noqa: F811
    built, write, t = {}, sinks.write_star_schema, Tables(spark, odd)

    def watched(tables, folder, *given, **named):
        assert spark.conf.get(CLEANUP) == "true"
        built.update({name: plan(frame) for name, frame in tables.items()})
        return write(tables, folder, *given, **named)

    before = spark.conf.get(CLEANUP)
    monkeypatch.setattr(sinks, "write_star_schema", watched)
    counts = {r.table_name: r.n_rows for r in catalog._star_files(t).collect()}
    assert counts == {name: frame.count() for name, frame in catalog._star(t).items()}
    assert spark.conf.get(CLEANUP) == before
    assert set(built) == set(counts) and not [name for name, text in built.items() if "lineitem.parquet" in text]


def test_facts_written_as_read_are_compressed_by_month(spark, odd, tmp_path):  # noqa: F811
    whole = catalog._star(Tables(spark, odd))
    facts = {name: whole[name] for name in ("fact_agent_runs", "dim_task")}
    plain = sinks.write_star_schema(facts, f"{tmp_path}/plain")
    zipped = sinks.write_star_schema(facts, f"{tmp_path}/zipped", compression="gzip", as_read=["fact_agent_runs"])
    assert list(zipped) == list(plain) == list(facts)
    for name in facts:
        assert bag(spark.read.csv(zipped[name], header=True)) == bag(spark.read.csv(plain[name], header=True))
    assert list((tmp_path / "zipped/fact_agent_runs").glob("month_key=*/*.csv.gz"))
    assert not list((tmp_path / "plain").rglob("*.gz"))
