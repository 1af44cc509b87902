import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagekit.operators import charts
from passagekit.operators.frequency import entries_per_period
from passagekit.operators.quantiles import exact_quantiles


@pytest.fixture
def table(spark):
    rows = [
        ("a", "red", 1, 1.0, dt.datetime(2024, 1, 1)),
        ("a", "red", 2, 3.0, dt.datetime(2024, 1, 1)),
        ("a", "blue", 3, None, None),
        ("b", None, 4, None, dt.datetime(2024, 1, 2, 3)),
        ("b", "blue", 5, None, None),
        (None, "red", 6, 10.0, None),
    ]
    return spark.createDataFrame(rows, "x string, c string, i int, y double, t timestamp")


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_aggregates_skip_nulls_and_null_keys(table):
    assert _rows(charts.chart_agg(table, "x", "y", "sum")) == [("a", 4.0), ("b", 0.0)]
    assert _rows(charts.chart_agg(table, "x", "y", "mean")) == [("a", 2.0), ("b", None)]
    assert _rows(charts.chart_agg(table, "x", "i", "max")) == [("a", 3), ("b", 5)]
    assert _rows(charts.chart_agg(table, "x", "c", "min")) == [("a", "blue"), ("b", "blue")]
    assert _rows(charts.chart_agg(table, "x")) == [("a", 3), ("b", 2)]
    assert _rows(charts.chart_agg(table, "x", "y", "sum", color="c")) == [
        ("a", "blue", 0.0), ("a", "red", 4.0), ("b", "blue", 0.0),
    ]


def test_labelled_nulls_are_a_group(table):
    assert _rows(charts.chart_agg(table, "t", null_label="NaT")) == [
        ("2024-01-01 00:00:00", 2), ("2024-01-02 03:00:00", 1), ("NaT", 3),
    ]
    assert _rows(charts.series_values(table, "c", null_label="None")) == [("None",), ("blue",), ("red",)]


def test_value_counts_shares_and_series(table):
    assert _rows(charts.value_counts(table, "c")) == [("red", 3), ("blue", 2)]
    assert _rows(charts.value_shares(table, "c")) == [("red", 3, 0.6), ("blue", 2, 0.4)]
    assert _rows(charts.series_values(table, "c")) == [("blue",), ("red",)]
    empty = table.where("i > 100")
    assert _rows(charts.value_shares(empty, "c")) == []


def test_labels_belong_to_their_column(spark):
    rows = [("2024-01-01", None, 1.0), (None, "a", 2.0), (None, None, 3.0)]
    df = spark.createDataFrame(rows, "d string, c string, y double").withColumn("d", F.to_date("d"))
    assert _rows(charts.chart_agg(df, "d", "y", "sum", "c", null_label="NaT")) == [("NaT", "a", 2.0)]
    labels = {"d": "NaT", "c": "None"}
    assert _rows(charts.chart_agg(df, "d", "y", "sum", "c", null_label=labels)) == [
        ("2024-01-01", "None", 1.0), ("NaT", "None", 3.0), ("NaT", "a", 2.0),
    ]
    assert _rows(charts.chart_data(df, "histogram", "d", null_label="NaT")) == [("NaT", 2), ("2024-01-01", 1)]
    points = charts.chart_data(df, "scatter", "d", "y", color="c", null_label="NaT")
    assert [r.d for r in points.collect()] == ["2024-01-01", "NaT", "NaT"]


def test_missing_numbers_are_in_no_bin_and_no_box(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", y) for y in (0.0, 10.0, 20.0, nan, None, inf, -inf)], "x string, y double")
    bins = charts.histogram(df, "y", 2).collect()
    assert [tuple(b) for b in bins] == [(1, 0.0, 10.0, 1), (2, 10.0, 20.0, 2)]
    box = charts.box_summary(df.where("y IS NULL OR abs(y) < 100 OR isnan(y)"), "x", "y").first()
    assert (box.n, box.min, box.q1, box.median, box.q3, box.max) == (3, 0.0, 5.0, 10.0, 15.0, 20.0)
    assert (box.lower_whisker, box.upper_whisker) == (0.0, 20.0)


def test_value_counts_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert _rows(charts.value_counts(df, "x")) == [("c", 2), ("a", 1), ("b", 1)]


def test_histogram(spark, table):
    df = spark.createDataFrame([(float(v),) for v in [0, 0.9, 1, 19.5, 20, 10]], "v double")
    bins = charts.histogram(df, "v").collect()
    assert [r.bin for r in bins] == list(range(1, 21))
    counts = {r.bin: r["count"] for r in bins if r["count"]}
    assert counts == {1: 2, 2: 1, 11: 1, 20: 2}
    assert (bins[0].bin_start, bins[19].bin_end) == (0.0, 20.0)
    same = charts.histogram(table.select(F.lit(5).alias("i")), "i", bins=4)
    assert [r["count"] for r in same.collect()] == [6, 0, 0, 0]
    assert charts.histogram(table.where("false"), "i").count() == 0
    assert _rows(charts.histogram(table, "c")) == _rows(charts.value_counts(table, "c"))


def test_dispatch(table):
    same = lambda a, b: _rows(a) == _rows(b)
    assert same(charts.chart_data(table, "bar", "x", "y", "sum", "c"), charts.chart_agg(table, "x", "y", "sum", "c"))
    assert same(charts.chart_data(table, "line", "x", "y", "min"), charts.chart_agg(table, "x", "y", "min"))
    assert same(charts.chart_data(table, "line", "x", None, "sum"), charts.value_counts(table, "x"))
    assert same(charts.chart_data(table, "bar", "x", "y", "count", "c"), charts.chart_agg(table, "x", color="c"))
    assert same(charts.chart_data(table, "pie", "x", "y", "sum", "c"), charts.value_shares(table, "x"))
    assert same(charts.chart_data(table, "histogram", "i"), charts.histogram(table, "i"))
    assert charts.chart_data(table, "scatter", "i", "y", color="c").columns == ["i", "y", "c"]
    assert charts.chart_data(table, "box", "x", "y").count() == 1


@pytest.mark.parametrize(
    "arguments",
    [
        {"kind": "radar", "x": "x"},
        {"kind": "bar", "x": "x", "y": "c", "agg": "sum"},
        {"kind": "bar", "x": "x", "y": "t", "agg": "mean"},
        {"kind": "bar", "x": "x", "y": "y", "agg": "median"},
        {"kind": "box", "x": "x"},
        {"kind": "box", "x": "x", "y": "c"},
        {"kind": "scatter", "x": "x"},
    ],
)
def test_arguments_are_checked(table, arguments):
    with pytest.raises(ValueError):
        charts.chart_data(table, **arguments)


def test_table_page(table):
    sort = [("x", "desc"), ("i", "asc")]
    assert [r.i for r in charts.table_page(table, sort=sort, size=2).collect()] == [4, 5]
    assert [r.i for r in charts.table_page(table, sort=sort, page=2, size=2).collect()] == [3, 6]
    page = charts.table_page(table, filter="i > 4", sort=[("i", "desc")])
    assert [r.i for r in page.collect()] == [6, 5]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def _frame(spark):
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.concatenate([rng.normal(0, 1, 9_000), np.full(6_000, 0.25), rng.exponential(50, 2_000)]),
        "even": np.arange(1_000, dtype=float),
        "copies": np.full(5_000, 3.0),
        "two": np.array([1.0, 2.0]),
        "one": np.array([7.0]),
    }
    frame = pd.concat([pd.DataFrame({"g": g, "y": v}) for g, v in groups.items()])
    return frame, spark.createDataFrame(frame.sample(frac=1, random_state=1), "g string, y double")


@pytest.mark.parametrize("cells", [1, 7, 2**20])
def test_quantiles_are_exact(spark, cells):
    frame, df = _frame(spark)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df.repartition(8), ["g"], "y", probs, cells).collect()
    expected = frame.groupby("g").y.quantile(probs)
    assert len(got) == 5
    for row in got:
        for i, p in enumerate(probs):
            assert row[f"q{i}"] == pytest.approx(expected[row.g][p], abs=1e-12), (row.g, p)


def test_quantiles_of_any_doubles_are_exact(spark):
    """Signs, zeros, the least and greatest doubles, neighbours of a double, infinite values, ties."""
    rng = random.Random(6)
    close = [1.0]
    for _ in range(300):
        close.append(math.nextafter(close[-1], 2.0))
    groups = {
        "wide": [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1074, 1023) for _ in range(500)],
        "close": close * 3,
        "edges": [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308] * 5,
        "ends": [float("inf"), float("-inf"), 1.0, 2.0, 3.0],
        "one": [4.0],
        "ties": [2.5] * 1000 + [7.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, y double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "y", probs).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        values = sorted(values)
        for i, p in enumerate(probs):
            at = p * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            wanted = low if low == high else low + (high - low) * (at - math.floor(at))
            assert got[g][f"q{i}"] == wanted or (wanted != wanted and math.isnan(got[g][f"q{i}"])), (g, p)


def test_quantiles_sort_values_within_cells_only(spark):
    """Windows keyed by the group alone see totals of cells; values are sorted within a cell of a cell."""
    df = spark.range(1000).selectExpr("IF(id % 3 = 0, 'cool', 'hot') AS g", "CAST(id AS DOUBLE) AS y")
    plan = exact_quantiles(df, ["g"], "y", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[sum\((\w+)#\w+\) windowspecdefinition\((.*?), specifiedwindowframe", plan)
    assert {summed for summed, _ in windows} == {"n", "_n"}
    for summed, keys in windows:
        if summed == "n":
            assert "_c0" in keys and "_c1" in keys and re.search(r"\by#\d+ ASC", keys)
        else:
            assert not re.search(r"\by#\d+ ASC", keys)


def test_box_summary(spark):
    frame, df = _frame(spark)
    boxes = {r.g: r for r in charts.box_summary(df, "g", "y").collect()}
    for g, values in frame.groupby("g").y:
        q1, q3 = values.quantile(0.25), values.quantile(0.75)
        reach = 1.5 * (q3 - q1)
        box = boxes[g]
        assert (box.n, box["min"], box["max"]) == (len(values), values.min(), values.max())
        assert (box.q1, box.median, box.q3) == pytest.approx((q1, values.median(), q3))
        assert box.lower_whisker == values[values >= q1 - reach].min()
        assert box.upper_whisker == values[values <= q3 + reach].max()
    near = charts.box_summary(df, "g", "y", approximate=True).where("g = 'even'").first()
    assert near.median == pytest.approx(500, abs=2)


def test_box_summary_of_awkward_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0)], "y int, `the n` string, i double")
    box = charts.box_summary(df, "y", "i", color="the n").first()
    assert (box["y"], box["the n"], box.n, box.median) == (1, "a", 2, 3.0)


def test_box_summary_of_labelled_and_missing_groups(table):
    boxes = charts.box_summary(table, "x", "y", color="c")
    assert [(r.x, r.c, r.n, r.median) for r in boxes.collect()] == [("a", "red", 2, 2.0)]
    boxes = charts.box_summary(table, "x", "y", null_label="None")
    assert [(r.x, r.n) for r in boxes.collect()] == [("None", 1), ("a", 2)]


def test_entries_of_all_and_one(spark):
    rows = [("A", dt.datetime(2024, 1, 1)), ("A", dt.datetime(2024, 1, 7, 23)), ("B", None), ("B", dt.datetime(2024, 1, 8))]
    df = spark.createDataFrame(rows, "geofence string, entry_time timestamp")
    assert _rows(entries_per_period(df, "W", by=("geofence",)).drop("period_start")) == [
        ("A", "2024-01-01/2024-01-07", 2),
        ("B", "2024-01-08/2024-01-14", 1),
    ]
    assert _rows(entries_per_period(df, "M").drop("period_start")) == [("2024-01", 3)]


def test_gaps_are_filled_within_each_group(spark):
    rows = [("A", dt.datetime(2024, 1, 1)), ("A", dt.datetime(2024, 1, 4, 5)), (None, dt.datetime(2024, 2, 29)),
            (None, dt.datetime(2024, 3, 2)), ("B", None), ("C", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "geofence string, entry_time timestamp")
    filled = entries_per_period(df, "D", by=("geofence",), fill_gaps=True)
    assert [(r.geofence, r.period_label, r["count"]) for r in filled.collect()] == [
        (None, "2024-02-29", 1), (None, "2024-03-01", 0), (None, "2024-03-02", 1),
        ("A", "2024-01-01", 1), ("A", "2024-01-02", 0), ("A", "2024-01-03", 0), ("A", "2024-01-04", 1), ("C", "2024-01-02", 1),
    ]
    months = entries_per_period(df, "M", fill_gaps=True)
    assert [(r.period_label, r["count"]) for r in months.collect()] == [("2024-01", 3), ("2024-02", 1), ("2024-03", 1)]
    weeks = entries_per_period(df.where("geofence IS NULL OR geofence = 'A'"), "W", fill_gaps=True)
    assert [r["count"] for r in weeks.collect()] == [2, 0, 0, 0, 0, 0, 0, 0, 2]
    assert entries_per_period(df.limit(0), "W", by=("geofence",), fill_gaps=True).collect() == []


@pytest.mark.parametrize("sort", [[("a", "asc"), ("b", "desc")], [("b", "desc")], []])
def test_pages_by_the_last_row_seen_equal_pages_by_number(spark, sort):
    """With ties, nulls and not a number, as often as a page begins among equal keys."""
    rng = random.Random(2)
    some = [None, 1.0, 2.0, 2.0, float("nan"), float("-inf")]
    rows = [(rng.choice(["x", "y", None]), rng.choice(some), i) for i in range(57)]
    df = spark.createDataFrame(rows, "a string, b double, i int")
    last, pages = None, []
    for number in range(9):
        page = charts.page_after(df, last, "i % 5 <> 0", sort, size=7).collect()
        assert repr(page) == repr(charts.table_page(df, "i % 5 <> 0", sort, number, 7).collect())
        pages += page
        last = page[-1] if page else last
    assert len(pages) == sum(i % 5 != 0 for i in range(57))
    assert charts.page_after(df.limit(0), None, sort=sort).collect() == []


def test_a_far_page_is_filtered_before_it_is_ordered(spark, tmp_path):
    spark.range(1000).selectExpr("id AS a", "id % 7 AS b").write.parquet(str(tmp_path / "t"))
    page = charts.page_after(spark.read.parquet(str(tmp_path / "t")), {"a": 899, "b": 3}, sort=[("a", "asc")])
    assert [r.a for r in page.collect()] == list(range(900, 910))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan and "GreaterThanOrEqual(a,899)" in plan.split("PushedFilters")[1]


def test_shares_and_histograms_read_their_table_once(spark):
    df = spark.range(100).selectExpr("CAST(id % 7 AS STRING) AS x", "CAST(id AS DOUBLE) AS y")
    for result in (charts.value_shares(df, "x"), charts.histogram(df, "y")):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Range (") == 1 and "scalar-subquery" not in plan
        assert "SinglePartition" not in result._jdf.queryExecution().executedPlan().toString()
