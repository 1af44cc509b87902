"""Tables stored by vessel and day bucket, for joins without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from passagekit.plans.bands import BUCKET


def store_by_bucket(df: DataFrame, table: str, key: str, files: int, mode: str = "error") -> None:
    """Store rows with buckets (``point_buckets``, ``anchor_buckets``) as a table, dealt by ``key`` and bucket.

    ``files`` is the number of buckets of the table; tables that are joined have the same. A long
    history is spread over its day buckets, so one vessel is no single file. Rows are sorted within a file,
    and brought together before they are written, so that a bucket is one file.
    """
    dealt = df.repartition(files, key, BUCKET)
    dealt.write.mode(mode).bucketBy(files, key, BUCKET).sortBy(key, BUCKET).saveAsTable(table)
