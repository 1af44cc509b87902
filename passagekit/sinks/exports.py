"""Exports as GeoJSON and CSV."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from passagekit.functions.geometry import feature_struct, geometry_struct

#: Fixed value: what the names of exported tables begin with.
EXPORT_STEM = "geofence_cargo_data"

def line_features(lines: DataFrame, name: str = "vessel_key") -> DataFrame:
    """Trajectory lines with ``feature``, a GeoJSON feature as JSON text.

    The properties are the vessel as ``name`` and the ``dates`` of the points.
    ``part`` says which part of the line a feature is, from 0.
    """
    feature = feature_struct(
        geometry_struct("LineString", F.col("coordinates")),
        name=F.col(name),
        dates=F.col("dates"),
        part=F.col("part"),
    )
    return lines.withColumn("feature", F.to_json(feature))


def write_geojson(
    features: DataFrame, path: str, partition_by: Sequence[str] = ("geofence",), mode: str = "error"
) -> None:
    """Write ``feature`` texts, one GeoJSON feature per line, in folders by ``partition_by``.

    Rows of a folder are brought together first, large folders in several files.
    """
    present = features.where(F.col("feature").isNotNull()).select(*partition_by, "feature")
    writer = (present.hint("rebalance", *partition_by) if partition_by else present).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode(mode).text(path)


def as_csv_table(df: DataFrame, null_time_label: str | None = None) -> DataFrame:
    """A table with its dates and times as plain text; null ones stay null, or become ``null_time_label``."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DateType, TimestampType, TimestampNTZType)):
            column = column.cast("string")
            if null_time_label is not None:
                column = F.coalesce(column, F.lit(null_time_label))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def csv_lines(df: DataFrame, null_time_label: str | None = None) -> DataFrame:
    """The rows of a table as ``line``, its CSV text without a line end; nulls are empty fields.

    Fields that hold a comma or a quote are quoted, and quotes in them are escaped by a backslash, as :func:`write_csv` does.
    """
    table = as_csv_table(df, null_time_label)
    return table.select(F.to_csv(F.struct(*[F.col(f"`{name}`") for name in table.columns])).alias("line"))


def write_csv(df: DataFrame, path: str, null_time_label: str | None = None, mode: str = "error") -> None:
    """Write a table as CSV with a header; times are plain text.

    Null times are empty, or ``null_time_label`` if that is given.
    """
    as_csv_table(df, null_time_label).write.mode(mode).option("header", True).csv(path)


def export_table(
    df: DataFrame, folder: str, at: dt.datetime, stem: str = EXPORT_STEM, null_time_label: str | None = None
) -> tuple[str, int]:
    """Write a table as CSV below ``folder``, named by ``stem`` and the moment; return its path and number of rows.

    The rows are counted while they are written. Two exports of one second have one name, and the second one
    raises an error rather than replace the first. A table without rows is written as well.
    """
    path = f"{folder.rstrip('/')}/{stem}_{at:%Y%m%d_%H%M%S}.csv"
    seen = Observation()
    write_csv(df.observe(seen, F.count(F.lit(1)).alias("n")), path, null_time_label)
    return path, seen.get["n"]
