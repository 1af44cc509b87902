"""Join of rows that share a key and lie within some days of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.dates import day_gap

#: The column that stored tables carry.
BUCKET = "day_bucket_"


def _bucket(day_number: Column, width: int) -> Column:
    return F.floor(day_number / F.lit(width)).cast("int")


def day_band_join(
    points: DataFrame,
    anchors: DataFrame,
    key: str,
    point_time: str,
    anchor_time: str,
    max_days: int,
) -> DataFrame:
    """Inner join on ``key`` where the two times are at most ``max_days`` midnights apart.

    Time is cut into buckets of ``max_days + 1`` days. A point belongs to one
    bucket and an anchor is repeated for the two or three buckets its band
    touches, so every pair meets exactly once. A key with a long history is
    spread over its buckets instead of filling one task, and candidate pairs
    stay within a constant factor of the result. A bucket that is still hot is
    split at run time by adaptive execution, since nothing after the join
    relies on its partitioning.
    """
    left = point_buckets(points, point_time, max_days)
    right = anchor_buckets(anchors, anchor_time, max_days)
    return stored_band_join(left, right, key, point_time, anchor_time, max_days)


def point_buckets(points: DataFrame, point_time: str, max_days: int) -> DataFrame:
    """Points with their one bucket of ``max_days + 1`` days."""
    return points.withColumn(BUCKET, _bucket(F.unix_date(F.to_date(points[point_time])), max_days + 1))


def anchor_buckets(anchors: DataFrame, anchor_time: str, max_days: int) -> DataFrame:
    """Anchors, once for each of the two or three buckets that their band touches."""
    day, width = F.unix_date(F.to_date(anchors[anchor_time])), max_days + 1
    touched = F.sequence(_bucket(day - max_days, width), _bucket(day + max_days, width))
    return anchors.withColumn(BUCKET, F.explode(touched))


def stored_band_join(
    points: DataFrame, anchors: DataFrame, key: str, point_time: str, anchor_time: str, max_days: int
) -> DataFrame:
    """:func:`day_band_join` of two tables that have their buckets already.

    Tables that :func:`passagekit.sinks.bucketed.store_by_bucket` has written with the same number of files
    meet file by file, so neither is shuffled, however often they are joined. ``max_days``
    must be that of the buckets.
    """
    left, right = points.alias("left_rows"), anchors.alias("right_rows")
    near = day_gap(F.col(f"left_rows.{point_time}"), F.col(f"right_rows.{anchor_time}")) <= max_days
    return (
        left.join(
            right,
            (F.col(f"left_rows.{key}") == F.col(f"right_rows.{key}"))
            & (F.col(f"left_rows.{BUCKET}") == F.col(f"right_rows.{BUCKET}"))
            & near,
        )
        .select(
            *[F.col(f"left_rows.{name}") for name in points.columns if name != BUCKET],
            *[F.col(f"right_rows.{name}") for name in anchors.columns if name not in (key, BUCKET)],
        )
    )
