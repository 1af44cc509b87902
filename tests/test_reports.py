"""Every registered query against its SQL check, and its plan."""

import os

import pytest

import __spark_entry__ as contract
from passagekit import reports
from passagekit.reports import CHECKS, QUERIES
from tests import oracle


#: Large enough for ids to repeat across vessels and geofences.
CHECKED_DIR = os.environ.get("CHECKED_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(CHECKED_DIR)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_every_query_is_registered():
    assert QUERIES.items() <= contract.queries().items()
    assert CHECKS.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check(spark, con, name):
    result = QUERIES[name](spark, CHECKED_DIR)
    assert oracle.spark_types(result) == oracle.sql_types(con, CHECKS[name])
    columns, rows = oracle.spark_rows(result)
    assert (columns, rows) == oracle.sql_rows(con, CHECKS[name])
    assert rows

    plan = result._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_entry_has_the_known_result(spark):
    result = contract.entry(spark)
    assert result.count() == 63
    assert result.agg({"quantity": "sum"}).first()[0] == 1623.0


@pytest.mark.parametrize(
    "name, rows",
    [
        ("passages_filtered", 523),
        ("positions_near_filtered_passages", 1319),
        ("positions_near_passages", 46271),
        ("cargo_filtered", 523),
        ("cargo_by_unload", 19967),
    ],
)
def test_known_counts(spark, name, rows):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() == rows


@pytest.mark.parametrize("date_col, quantity", [("unload_date", 13102.0), ("load_date", 13570.0)])
def test_known_cargo(spark, date_col, quantity):
    from passagekit import reports

    folder = "/root/testdata/sf0.01"
    matched = reports._match(
        reports._filtered_passages(spark, folder), reports._cargo(spark, folder), date_col
    )
    assert matched.where("date_diff IS NULL").count() == 2
    assert matched.agg({"quantity": "sum"}).first()[0] == quantity


def test_periods_count_every_timed_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").count()
    for name in ("entries_daily", "entries_weekly", "entries_monthly"):
        assert QUERIES[name](spark, sf_dir).agg({"count": "sum"}).first()[0] == events


def test_both_pages_read_one_match(spark, monkeypatch):
    """The page before and the page itself read stored rows; their source is not run again."""
    rows = spark.range(60).selectExpr(
        "id % 7 AS vessel_key", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, id) AS passage_time",
        "IF(id % 9 = 0, NULL, CAST(id % 20 AS DOUBLE)) AS quantity", "'g' || id % 3 AS grade", "id AS other",
    )
    monkeypatch.setattr(reports, "_table", lambda spark, sf_dir: rows)
    page = reports.cargo_page_after(spark, "")
    assert "Range" not in page._jdf.queryExecution().executedPlan().toString()
    wanted = [r for r in rows.drop("other").collect() if r.quantity is not None and r.quantity >= 10]
    wanted.sort(key=lambda r: (-r.quantity, r.vessel_key, r.passage_time))
    assert page.collect() == wanted[20:30]
    monkeypatch.setattr(reports, "_table", lambda spark, sf_dir: rows.limit(0))
    assert reports.cargo_page_after(spark, "").collect() == []
