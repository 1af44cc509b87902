import datetime as dt
import re
import random

import pytest
from pyspark.sql import functions as F

from passagekit.operators.cargo import MATCHED_COLUMNS, match_cargo
from passagekit.schemas import CARGO_COLUMNS, CARGO_FLOWS

BASE = dt.datetime(2024, 1, 1)
PASSAGES = (
    "vessel_key bigint, geofence string, exit_heading double, exit_direction string,"
    " passage_time timestamp"
)


def _data(seed):
    rng = random.Random(seed)
    passages = []
    for _ in range(120):
        time = BASE + dt.timedelta(days=rng.randint(0, 200), hours=rng.choice([0, 11, 23]))
        heading = rng.choice([None, 10.0, 200.0])
        passages.append((rng.choice([1, 1, 1, 2, 3, 9]), rng.choice("AB"), heading, None, time))
    passages += passages[:20]
    passages.append((None, "A", None, None, BASE))
    passages.append((1, "A", None, None, None))
    cargo = []
    for i in range(60):
        unload = BASE + dt.timedelta(days=rng.randint(0, 200), hours=rng.randint(0, 23))
        row = dict.fromkeys(CARGO_COLUMNS)
        row.update(
            vessel_imo=rng.choice([1, 1, 2, 3, None]),
            load_date=unload - dt.timedelta(days=rng.randint(0, 20)),
            unload_date=rng.choice([unload, unload, None]),
            grade=rng.choice(["x", "y", None]),
            quantity=float(rng.randint(1, 5)),
        )
        cargo.append(tuple(row[name] for name in CARGO_FLOWS.fieldNames()))
    cargo += cargo[:15]
    return passages, cargo


def _nulls_first(value):
    return (value is not None, value)


def _brute_force(passages, cargo, date_col, max_days, partition_by):
    columns = CARGO_FLOWS.fieldNames()
    at = columns.index(date_col)
    best = {}
    for passage in passages:
        vessel, geofence, heading, direction, time = passage
        for row in [*cargo, None]:
            gap = None
            if row is not None:
                if None in (vessel, time, row[0], row[at]) or row[0] != vessel:
                    continue
                gap = abs((row[at].date() - time.date()).days)
                if gap > max_days:
                    continue
            values = (None,) * len(CARGO_COLUMNS) if row is None else row[1:]
            rank = (row is None, _nulls_first(gap), tuple(map(_nulls_first, values)),
                    (geofence, _nulls_first(heading)))
            key = (vessel, time) + ((geofence,) if "geofence" in partition_by else ())
            named = dict(zip(CARGO_COLUMNS, values), vessel_key=vessel, geofence=geofence, exit_heading=heading)
            named |= {"exit_direction": direction, "date_diff": gap, "passage_time": time}
            candidate = (rank, tuple(named[name] for name in MATCHED_COLUMNS))
            if key not in best or rank < best[key][0]:
                best[key] = candidate
    return sorted((row for _, row in best.values()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("date_col, max_days", [("unload_date", 39), ("load_date", 3)])
@pytest.mark.parametrize("extra", [(), ("geofence",)])
def test_match_equals_all_pairs(spark, seed, date_col, max_days, extra):
    passages, cargo = _data(seed)
    partition_by = ("vessel_key", "passage_time", *extra)
    matched = match_cargo(
        spark.createDataFrame(passages, PASSAGES),
        spark.createDataFrame(cargo, CARGO_FLOWS),
        date_col,
        max_days,
        partition_by=partition_by,
    )
    assert tuple(matched.columns) == MATCHED_COLUMNS
    got = sorted((tuple(r) for r in matched.collect()), key=repr)
    assert got == _brute_force(passages, cargo, date_col, max_days, partition_by)


def test_known_dates_and_order(spark):
    passages, cargo = _data(3)
    psg = spark.createDataFrame([p for p in passages if p[4]], PASSAGES)
    flows = spark.createDataFrame(cargo, CARGO_FLOWS)
    plain = match_cargo(psg, flows, ordered=True).collect()
    bounded = match_cargo(psg, flows, between=("2024-01-01", BASE + dt.timedelta(days=200)))
    assert sorted(map(repr, plain)) == sorted(map(repr, bounded.collect()))
    keys = [(r.vessel_key is not None, r.vessel_key, r.passage_time) for r in plain]
    assert keys == sorted(keys)


def test_passages_outside_the_known_dates_take_no_part(spark):
    passages, cargo = _data(3)
    psg, flows = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(cargo, CARGO_FLOWS)
    first, last = BASE, BASE + dt.timedelta(days=30)
    inside = psg.where((psg.passage_time >= first.replace(hour=0)) & (psg.passage_time < last.replace(hour=0) + dt.timedelta(days=1)))
    assert sorted(map(repr, match_cargo(psg, flows, between=(first, last)).collect())) == sorted(
        map(repr, match_cargo(inside, flows).collect())
    )


def test_cargo_is_moved_once_and_not_joined_again(spark):
    """Each vessel day's best row lies on the timeline, so cargo is read once and only passages are joined."""
    passages, cargo = _data(1)
    psg, flows = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(cargo, CARGO_FLOWS)
    plan = match_cargo(psg, flows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [vessel_imo") == 1
    assert "LeftSemi" not in plan and len(re.findall(r"Join \w+", plan)) == 1
    executed = match_cargo(psg, flows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", executed.split("== Initial Plan ==")[-1])) <= 8


def test_tolerance_is_inclusive_on_both_sides(spark):
    psg = spark.createDataFrame([(1, "A", None, None, BASE)], PASSAGES)
    for days, found in ((39, True), (-39, True), (40, False), (-40, False)):
        row = dict.fromkeys(CARGO_FLOWS.fieldNames())
        row.update(vessel_imo=1, unload_date=BASE + dt.timedelta(days=days, hours=1))
        flows = spark.createDataFrame([tuple(row.values())], CARGO_FLOWS)
        assert (match_cargo(psg, flows).first().date_diff is not None) is found


def test_wrong_arguments(spark):
    psg = spark.createDataFrame([], PASSAGES)
    flows = spark.createDataFrame([], CARGO_FLOWS)
    with pytest.raises(ValueError):
        match_cargo(psg, flows, "sail_date")
    with pytest.raises(ValueError):
        match_cargo(psg, flows, partition_by=("vessel_key",))
    assert match_cargo(psg, flows).count() == 0


def test_a_hot_vessel_is_reduced_before_the_window(spark):
    """The rows that reach the window per vessel are bounded by its days, not its rows."""
    hot = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("vessel_key"),
        F.lit("A").alias("geofence"),
        F.lit(None).cast("double").alias("exit_heading"),
        F.lit(None).cast("string").alias("exit_direction"),
        (F.lit(BASE) + F.make_dt_interval(days=(F.col("id") % 3).cast("int"))).alias("passage_time"),
    )
    row = dict.fromkeys(CARGO_FLOWS.fieldNames())
    row.update(vessel_imo=1, unload_date=BASE, quantity=1.0)
    flows = spark.createDataFrame([tuple(row.values())] * 50, CARGO_FLOWS)
    matched = match_cargo(hot, flows)
    assert sorted(r.date_diff for r in matched.collect()) == [0, 1, 2]
    plan = matched._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") >= 4
