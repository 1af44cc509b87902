"""Table reads and the filters on the event store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passagekit.schemas import WKT_KEY, conform
from passagekit.sources import versions


def read_table(
    spark: SparkSession,
    path: str | None = None,
    format: str = "parquet",
    schema: StructType | None = None,
    **options: str,
) -> DataFrame:
    """Read a table in any format the session knows, fitted to ``schema`` if given.

    A folder with a manifest (:mod:`passagekit.sources.versions`) is read as of that.
    For ``format="jdbc"`` leave out the path and pass ``url``, ``dbtable`` and,
    so that the read is split over tasks, ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions``.
    """
    reader = spark.read.format(format).options(**options)
    table = reader.load() if path is None else reader.load(versions.paths(spark, path))
    return table if schema is None else conform(table, schema)


def asset_events(events: DataFrame, type: str = "geofence_arrival", subtype: str | None = None) -> DataFrame:
    """Events of one type, and of one subtype if given (the geofence)."""
    chosen = events.where(F.col("type") == F.lit(type))
    return chosen if subtype is None else chosen.where(F.col("subtype") == F.lit(subtype))


def geofence_map(
    geofences: DataFrame, order_by: Sequence[str | Column], dedupe_by: str = "port_name"
) -> DataFrame:
    """The latest polygon per port from lake rows, by ``order_by``."""
    order = F.struct(*order_by)
    return geofences.groupBy(dedupe_by).agg(
        F.max_by(F.col("location")[WKT_KEY], order).alias("wkt")
    )
