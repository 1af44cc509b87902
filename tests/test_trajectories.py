import datetime as dt
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagekit.operators.trajectories import (
    counted_positions,
    distinct_points,
    line_ends,
    line_headings,
    positions_near_passages,
    trajectory_lines,
)
from passagekit.plans.flows import recent_lines
from passagekit.sinks.exports import line_features, write_geojson

POSITIONS = "vessel_key bigint, latitude double, longitude double, dt_pos_utc timestamp"
PASSAGES = "vessel_key bigint, geofence string, passage_time timestamp"
BASE = dt.datetime(1970, 1, 5)


def _hours(hours):
    return BASE + dt.timedelta(hours=hours)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    positions=st.lists(st.tuples(st.integers(1, 2), st.integers(-900, 900)), max_size=25),
    passages=st.lists(st.tuples(st.integers(1, 2), st.integers(-900, 900)), max_size=10),
    max_days=st.integers(0, 20),
)
def test_band_join_equals_all_pairs(spark, positions, passages, max_days):
    traj = spark.createDataFrame(
        [(k, float(i), 0.0, _hours(h)) for i, (k, h) in enumerate(positions)], POSITIONS
    )
    psg = spark.createDataFrame([(k, f"G{i}", _hours(h)) for i, (k, h) in enumerate(passages)], PASSAGES)
    got = sorted((int(r.latitude), r.geofence) for r in positions_near_passages(traj, psg, max_days).collect())
    expected = sorted(
        (i, f"G{j}")
        for i, (k, h) in enumerate(positions)
        for j, (k2, h2) in enumerate(passages)
        if k == k2 and abs((_hours(h).date() - _hours(h2).date()).days) <= max_days
    )
    assert got == expected


    lines = trajectory_lines(positions_near_passages(traj, psg, max_days))
    counted = counted_positions(traj, psg, max_days=max_days)
    assert sorted(lines.collect()) == sorted(trajectory_lines(counted, copies="copies").collect())


def test_known_passage_dates_change_nothing(spark):
    hours = range(0, 24 * 90, 5)
    traj = spark.createDataFrame([(1, 0.0, 0.0, _hours(h)) for h in hours], POSITIONS)
    psg = spark.createDataFrame([(1, "A", _hours(24 * 40 + 3)), (1, "B", _hours(24 * 42))], PASSAGES)
    plain = positions_near_passages(traj, psg, 3)
    bounded = positions_near_passages(traj, psg, 3, between=("1970-02-14", "1970-02-16"))
    assert plain.count() > 0
    assert sorted(plain.collect()) == sorted(bounded.collect())
    counted = counted_positions(traj, psg, ("geofence", "vessel_key"), 3)
    bounded = counted_positions(
        traj, psg, ("geofence", "vessel_key"), 3, between=("1970-02-14", "1970-02-16")
    )
    assert counted.count() == plain.count()
    assert sorted(counted.collect()) == sorted(bounded.collect())


def test_a_hot_bucket_is_split_at_run_time(spark):
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings_}
    for key, value in settings_.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(0, 60_000, 1, 16)
        # Half of all positions belong to one vessel and one day.
        hot = F.col("id") % 2 == 0
        traj = ids.select(
            F.when(hot, 0).otherwise(F.col("id") % 500).cast("bigint").alias("vessel_key"),
            F.rand(1).alias("latitude"),
            F.rand(2).alias("longitude"),
            F.when(hot, F.lit(BASE))
            .otherwise(F.lit(BASE) + F.make_dt_interval((F.col("id") % 300).cast("int")))
            .alias("dt_pos_utc"),
        )
        psg = spark.range(500).select(
            F.col("id").alias("vessel_key"), F.lit("A").alias("geofence"), F.lit(BASE).alias("passage_time")
        )
        near = positions_near_passages(traj, psg)
        rows = near.count()
        expected = traj.where(F.date_diff("dt_pos_utc", F.lit(BASE)) <= 14).count()
        assert rows == expected
        near.collect()
        assert "SortMergeJoin(skew=true)" in near._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.fixture
def points(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        vessel = rng.choice([1, 1, 1, 2, 3, None])
        rows.append((vessel, rng.randint(0, 3) / 2, rng.randint(0, 3) / 2, _hours(rng.randint(0, 30) / 4)))
    rows += [(1, 0.5, 0.5, _hours(3))] * 95
    return spark.createDataFrame(rows, POSITIONS), rows


def _expected_lines(rows):
    lines = {}
    for vessel, lat, lon, time in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[3], r[2], r[1])):
        lines.setdefault(vessel, []).append(([lon, lat], time.strftime("%Y-%m-%d %H:%M:%S")))
    return lines


def test_short_lines_are_one_row(points):
    df, rows = points
    lines = trajectory_lines(df).collect()
    expected = _expected_lines(rows)
    assert {r.vessel_key: list(zip(r.coordinates, r.dates)) for r in lines} == expected
    assert all(r.part == 0 and r.n_points == len(r.dates) for r in lines)


@pytest.mark.parametrize("max_points", [2, 7, 50])
def test_long_lines_continue_in_bounded_parts(points, max_points):
    df, rows = points
    parts = trajectory_lines(df, max_points=max_points).orderBy("vessel_key", "part").collect()
    joined = {}
    for row in parts:
        line = joined.setdefault(row.vessel_key, [])
        found = list(zip(row.coordinates, row.dates))
        assert 2 <= len(found) == row.n_points <= max_points
        # Parts meet in one point.
        assert row.part == 0 or found[0] == line[-1]
        line += found[1:] if row.part else found
    assert joined == _expected_lines(rows)


@pytest.mark.parametrize("max_points", [2, 7, 100_000])
def test_headings_of_parts_are_those_of_the_line(points, max_points):
    df, rows = points
    ends = line_ends(trajectory_lines(df, max_points=max_points))
    got = line_headings(ends, "ends", "n_points").select("vessel_key", "heading", "start_text", "end_text", "total_points")
    whole = line_headings(trajectory_lines(df)).select(*got.columns)
    assert sorted(got.collect()) == sorted(whole.collect())
    assert {r.vessel_key: r.total_points for r in got.collect()} == {k: len(v) for k, v in _expected_lines(rows).items()}


def test_a_point_is_a_line_and_full_parts_leave_none_alone(spark):
    for n, max_points in ((1, 2), (2, 2), (3, 2), (3, 3), (5, 3), (7, 4)):
        df = spark.createDataFrame([(1, 1.0, float(i), _hours(i)) for i in range(n)], POSITIONS)
        sizes = [r.n_points for r in trajectory_lines(df, max_points=max_points).orderBy("part").collect()]
        assert sum(sizes) - len(sizes) + 1 == n and (n == 1 or min(sizes) > 1)
    with pytest.raises(ValueError, match="two points"):
        trajectory_lines(df, max_points=1)


def test_passages_outside_the_known_dates_take_no_part(spark):
    passages = spark.createDataFrame([(1, "A", _hours(0)), (1, "B", _hours(24 * 40))], PASSAGES)
    positions = spark.createDataFrame([(1, 1.0, 2.0, _hours(h)) for h in (1, 24 * 39)], POSITIONS)
    between = (_hours(0), _hours(24))
    near = positions_near_passages(positions, passages, between=between).collect()
    assert [r.geofence for r in near] == ["A"]
    counted = counted_positions(positions, passages, between=between).collect()
    assert [(r.dt_pos_utc, r.copies) for r in counted] == [(_hours(1), 1)]


def test_the_join_below_a_line_runs_once(spark, points):
    psg = spark.createDataFrame([(1, "A", _hours(2)), (2, "B", _hours(4))], PASSAGES)
    lines = trajectory_lines(positions_near_passages(points[0], psg), by=("geofence", "vessel_key"))
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_distinct_points(points):
    df, rows = points
    line = trajectory_lines(distinct_points(df)).where("vessel_key = 1").first()
    assert line.n_points == len({r for r in rows if r[0] == 1})


def test_points_without_a_time_come_first(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, _hours(1)), (1, 3.0, 4.0, None)], POSITIONS)
    row = trajectory_lines(df).first()
    assert row.coordinates == [[4.0, 3.0], [2.0, 1.0]]
    assert row.dates == [None, "1970-01-05 01:00:00"]


def test_line_features(points):
    features = line_features(trajectory_lines(points[0], max_points=200)).orderBy("vessel_key", "part")
    texts = [r.feature for r in features.where("vessel_key = 1").collect()]
    assert texts[0].startswith('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[')
    assert '"properties":{"name":1,"dates":["1970-01-05 ' in texts[0]
    assert all(text.endswith(f'"part":{i}}}}}') for i, text in enumerate(texts)) and len(texts) > 1


def test_lines_of_a_look_back_are_exported_per_geofence(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, 1, "A", _hours(0), None, None), (1, 1, "B", _hours(1), None, None), (2, 2, "A", _hours(2), None, None)],
        "vessel_key bigint, imo bigint, geofence string, entry_time timestamp,"
        " exit_time timestamp, exit_heading double",
    )
    vessels = spark.createDataFrame([(1, "LPG"), (2, "Oil")], "imo bigint, vessel_type string")
    traj = spark.createDataFrame([(k, 1.0, float(h), _hours(h)) for k in (1, 2) for h in (5, 3)], POSITIONS)
    lines = recent_lines(events, vessels, traj, _hours(30), vessel_types=["LPG"])
    path = str(tmp_path / "lines")
    write_geojson(lines, path)
    stored = {r.geofence: json.loads(r.value) for r in spark.read.text(path).collect()}
    assert sorted(stored) == ["A", "B"]
    assert stored["A"]["geometry"] == {"type": "LineString", "coordinates": [[3.0, 1.0], [5.0, 1.0]]}
    assert stored["A"]["properties"]["name"] == 1
    assert recent_lines(events, vessels, traj, _hours(30), vessel_types=[]).count() == 0


def test_line_headings(spark):
    lines = [
        ([[0.0, 0.0], [9.0, 9.0], [0.0, 10.0]],),
        ([[1.5, 2.25], [1.5, 2.25]],),
        ([[1.0, 2.0]],),
        ([],),
        (None,),
    ]
    df = spark.createDataFrame(lines, "coordinates array<array<double>>")
    rows = [tuple(r)[1:] for r in line_headings(df).collect()]
    assert rows[0] == (0.0, "0.0", "[0.000000, 0.000000]", "[0.000000, 10.000000]", 3)
    assert rows[1] == (0.0, "0.0", "[1.500000, 2.250000]", "[1.500000, 2.250000]", 2)
    assert rows[2:] == [(None,) * 5] * 3
