"""Stored buckets: the same rows as the plain join, and no shuffle above the stored tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from passagekit.plans.bands import BUCKET, anchor_buckets, day_band_join, point_buckets, stored_band_join
from passagekit.sinks.bucketed import store_by_bucket

DAYS = 14


@pytest.fixture
def tables(spark):
    rng = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    at = lambda: base + dt.timedelta(hours=rng.randrange(24 * 400))
    positions = [(rng.choice([1, 1, 1, 2, 3, None]), float(i), at()) for i in range(800)]
    passages = [(rng.choice([1, 2, 3, 4, None]), f"G{i % 3}", at()) for i in range(60)]
    points = spark.createDataFrame(positions, "vessel_key long, latitude double, dt_pos_utc timestamp")
    anchors = spark.createDataFrame(passages, "vessel_key long, geofence string, passage_time timestamp")
    yield points, anchors
    for name in ("stored_points", "stored_anchors"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stored_tables_are_joined_without_a_shuffle(spark, tables):
    points, anchors = tables
    times = ("vessel_key", "dt_pos_utc", "passage_time", DAYS)
    store_by_bucket(point_buckets(points, "dt_pos_utc", DAYS), "stored_points", "vessel_key", 8, "overwrite")
    store_by_bucket(anchor_buckets(anchors, "passage_time", DAYS), "stored_anchors", "vessel_key", 8, "overwrite")
    stored = spark.table("stored_points"), spark.table("stored_anchors")
    assert stored[0].where(F.col("vessel_key") == 1).select(BUCKET).distinct().count() > 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = stored_band_join(*stored, *times)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        plain = day_band_join(points, anchors, *times)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert joined.columns == plain.columns
        rows = sorted(map(repr, joined.collect()))
        assert rows == sorted(map(repr, plain.collect())) and rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
