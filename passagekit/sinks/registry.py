"""Appends to and deletes from the geofence registry and its copy in the lake."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from passagekit.operators.geofences import acceptance_counts, checked_geofences, registry_rows, without_geofences
from passagekit.operators.passages import with_passage_date
from passagekit.schemas import to_lake_schema
from passagekit.sources import versions
from passagekit.sources.tables import read_table


def _known(spark: SparkSession, path: str, batch: str) -> dict | None:
    return next((b for b in versions.batches(spark, path) if b["name"] == batch), None)


def _add(spark: SparkSession, path: str, batch: str, counts: dict[str, int]) -> None:
    """Make the rows written for a batch part of the table."""
    others = [b for b in versions.batches(spark, path) if b["name"] != batch]
    versions.publish(spark, path, [*others, {"name": batch, "paths": [f"batch-{batch}"], "counts": counts}])


def _append_checked(geofences: DataFrame, path: str, to_rows, format: str, batch: str) -> dict[str, int]:
    """Write the accepted rows of a batch and publish them, once however often it is tried.

    The counts are observed while the rows are written, so the input is evaluated once.
    """
    spark = geofences.sparkSession
    done = _known(spark, path, batch)
    if done is not None:
        return done["counts"]
    seen = Observation()
    checked = checked_geofences(geofences).observe(seen, *acceptance_counts())
    rows = to_rows(checked.where(F.col("reason").isNull()).drop("reason"))
    # What an earlier try has left is replaced; it was not part of the table.
    rows.write.format(format).mode("overwrite").save(f"{path}/batch-{batch}")
    counts = dict(seen.get)
    _add(spark, path, batch, counts)
    return counts


def append_geofences(
    geofences: DataFrame, path: str, srid: int = 4326, format: str = "parquet", batch: str | None = None
) -> dict[str, int]:
    """Append valid geofences to the registry; return how many were accepted and rejected.

    A ``batch`` that the table already has adds nothing and returns its counts, so a job may
    be tried again under the same name.
    """
    batch = batch or uuid.uuid4().hex
    return _append_checked(geofences, path, lambda accepted: registry_rows(accepted, srid), format, batch)


def append_to_lake(
    geofences: DataFrame, path: str, reentry_hours: int = 0, format: str = "parquet", batch: str | None = None
) -> dict[str, int]:
    """Append valid geofences to the lake table, as :func:`append_geofences` does to the registry."""
    batch = batch or uuid.uuid4().hex
    return _append_checked(geofences, path, lambda accepted: to_lake_schema(accepted, reentry_hours), format, batch)


def deploy_geofences(
    geofences: DataFrame,
    registry_path: str,
    lake_path: str,
    srid: int = 4326,
    reentry_hours: int = 0,
    format: str = "parquet",
    batch: str | None = None,
) -> dict[str, int]:
    """Append to the registry and, once that has succeeded, the same rows to the lake.

    The lake's rows are read from the registry's files of this batch, so both have the same even if the
    input changes, or if a job that failed between them is tried again under its ``batch``.
    """
    spark = geofences.sparkSession
    batch = batch or uuid.uuid4().hex
    counts = append_geofences(geofences, registry_path, srid, format, batch)
    if _known(spark, lake_path, batch) is None:
        written = spark.read.format(format).load(f"{registry_path}/batch-{batch}")
        rows = to_lake_schema(written, reentry_hours)
        rows.write.format(format).mode("overwrite").save(f"{lake_path}/batch-{batch}")
        _add(spark, lake_path, batch, counts)
    return counts


def delete_geofences(
    spark: SparkSession,
    path: str,
    new_path: str | None,
    keys: DataFrame,
    key: str = "geofence_name",
    format: str = "parquet",
) -> dict[str, int]:
    """Publish the table at ``path`` without the given keys, in its place or, if given, at ``new_path``.

    The rows that stay are written to a folder of their own first, and then the manifest is replaced. Readers
    see the table before or after the delete; a job that fails before its end changes
    nothing. Old files stay until they are cleaned up. Both counts are observed while
    one reading of the table is written. Returns ``n_deleted`` and ``n_kept``.
    """
    before, after = Observation(), Observation()
    number = F.count(F.lit(1)).alias("n")
    current = read_table(spark, path, format).observe(before, number)
    target, name = new_path or path, uuid.uuid4().hex
    kept = without_geofences(current, keys, key).observe(after, number)
    kept.write.format(format).mode("error").save(f"{target}/batch-{name}")
    n_kept = after.get["n"]
    counts = {"n_deleted": before.get["n"] - n_kept, "n_kept": n_kept}
    versions.publish(spark, target, [{"name": name, "paths": [f"batch-{name}"], "counts": counts}])
    return counts


def delete_from_delta(
    spark: SparkSession, path: str, keys: DataFrame, key: str = "external_id"
) -> dict[str, int]:
    """Delete the given keys from a Delta table in place.

    Experimental: it needs Delta on the session and is not covered by the tests.
    """
    path, key = (name.replace("`", "``") for name in (path, key))
    doomed = keys.select(F.col(f"`{keys.columns[0]}`").alias("doomed")).distinct()
    result = spark.sql(
        f"MERGE INTO delta.`{path}` AS t USING {{doomed}} AS k ON t.`{key}` = k.doomed"
        " WHEN MATCHED THEN DELETE",
        doomed=doomed,
    ).first()
    return {"n_deleted": result["num_deleted_rows"]}


def write_events_by_date(events: DataFrame, path: str, mode: str = "error") -> None:
    """Write events partitioned by passage date, so that a look-back opens only its days.

    Rebalancing gives each date few files but splits a date that is too large
    for one task.
    """
    dated = with_passage_date(events).hint("rebalance", "passage_date")
    dated.write.mode(mode).partitionBy("passage_date").parquet(path)
