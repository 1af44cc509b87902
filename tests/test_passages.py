import datetime as dt

import pytest

from passagekit.operators.passages import events_for, passages, with_passage_date
from passagekit.sinks.registry import write_events_by_date

EVENTS = "vessel_key bigint, imo bigint, geofence string, entry_time {t}, exit_time {t}, exit_heading double"


def _time(text):
    return dt.datetime.fromisoformat(text) if text else None


@pytest.fixture(params=["timestamp", "timestamp_ntz"])
def events(spark, request):
    rows = [
        (1, 1, "A", "2024-01-01 00:00", "2024-01-01 23:59:59", 10.0),
        (1, 1, "A", "2024-01-02 10:00", None, None),
        (2, 2, "B", "2024-01-02 23:59:59", "2024-01-03 00:00", 90.0),
        (3, 3, "B", "2024-01-01 00:00", "2024-01-02 00:00", 180.0),
        (4, 4, "A", None, None, 270.0),
        (None, None, "A", "2024-01-02 10:00", None, 0.0),
    ]
    parsed = [(k, i, g, _time(a), _time(b), h) for k, i, g, a, b, h in rows]
    return spark.createDataFrame(parsed, EVENTS.format(t=request.param))


@pytest.fixture
def vessels(spark):
    rows = [(1, "LPG"), (2, "LPG"), (2, "LPG"), (3, None), (4, "Oil")]
    return spark.createDataFrame(rows, "imo bigint, vessel_type string")


def _keys(df):
    return sorted((r.vessel_key, r.geofence, str(r.passage_time)) for r in df.collect())


def test_passage_time_and_duplicate_registrations(events, vessels):
    result = passages(events, vessels)
    assert _keys(result) == [
        (1, "A", "2024-01-01 23:59:59"),
        (1, "A", "2024-01-02 10:00:00"),
        (2, "B", "2024-01-03 00:00:00"),
        (2, "B", "2024-01-03 00:00:00"),
        (3, "B", "2024-01-02 00:00:00"),
        (4, "A", "None"),
    ]
    assert result.columns == [
        "vessel_key", "geofence", "exit_heading", "exit_direction", "passage_time",
    ]


def test_dates_are_inclusive_and_use_the_exit(events, vessels):
    assert _keys(passages(events, vessels, "2024-01-02", "2024-01-02")) == [
        (1, "A", "2024-01-02 10:00:00"),
        (3, "B", "2024-01-02 00:00:00"),
    ]
    assert len(_keys(passages(events, vessels, start="2024-01-02"))) == 4
    assert len(_keys(passages(events, vessels, end=dt.date(2024, 1, 1)))) == 1


def test_selections(spark, events, vessels):
    assert len(_keys(passages(events, vessels, vessel_types=["LPG"]))) == 4
    assert len(_keys(passages(events, vessels, geofences=["B"]))) == 3
    for nothing in (None, []):
        assert _keys(passages(events, vessels, vessel_types=nothing)) == []
        assert _keys(passages(events, vessels, geofences=nothing)) == []
    wanted = spark.createDataFrame([("LPG",), ("LPG",), (None,)], "vessel_type string")
    assert len(_keys(passages(events, vessels, vessel_types=wanted))) == 4
    assert events_for(events, "B").count() == 2


def test_filters_reach_the_scan(spark, events, vessels, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    stored = spark.read.parquet(path)
    result = passages(stored, vessels, "2024-01-02", "2024-01-02", geofences=["A", "B"])
    plan = result._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "In(geofence, [A,B])" in pushed
    assert "GreaterThanOrEqual(exit_time" in pushed and "LessThan(entry_time" in pushed
    assert _keys(result) == _keys(passages(events, vessels, "2024-01-02", "2024-01-02"))


def test_partitions_by_passage_date_are_pruned(spark, events, vessels, tmp_path):
    path = str(tmp_path / "dated")
    write_events_by_date(events, path)
    stored = spark.read.parquet(path)
    result = passages(stored, vessels, "2024-01-02", "2024-01-03")
    plan = result._jdf.queryExecution().executedPlan().toString()
    pruned = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "passage_date" in pruned.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert _keys(result) == _keys(passages(events, vessels, "2024-01-02", "2024-01-03"))
    assert with_passage_date(events).count() == stored.count()
