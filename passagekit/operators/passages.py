"""Passages: geofence events with their passage time, for vessels of chosen types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.compass import compass_direction
from passagekit.functions.dates import as_date, within_dates
from passagekit.operators.selection import EVERYTHING, Selection, keep_selected


def events_for(events: DataFrame, geofence: str) -> DataFrame:
    """All events of one geofence."""
    return events.where(F.col("geofence") == F.lit(geofence))


def passage_time() -> Column:
    """When a vessel passed: exit time, else entry time."""
    return F.coalesce(F.col("exit_time"), F.col("entry_time"))


def with_passage_date(events: DataFrame) -> DataFrame:
    """Events with the calendar date of their passage, to partition a table by."""
    return events.withColumn("passage_date", F.to_date(passage_time()))


def passages(
    events: DataFrame,
    vessels: DataFrame,
    start=None,
    end=None,
    vessel_types: Selection = EVERYTHING,
    geofences: Selection = EVERYTHING,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Passages of registered vessels between two calendar dates, both inclusive.

    A vessel registered more than once yields its passages once per entry. An
    empty or missing list of vessel types or geofences selects nothing. Columns
    named in ``keep`` are carried along. If the events have a ``passage_date``
    column (see :func:`with_passage_date`) the dates also prune its partitions.
    """
    chosen = keep_selected(events, "geofence", geofences)
    if start is not None or end is not None:
        exit_type = events.schema["exit_time"].dataType
        entry_type = events.schema["entry_time"].dataType
        # The same as a range on coalesce(exit, entry), spelled so that both
        # columns' row-group statistics can be used.
        chosen = chosen.where(
            within_dates(F.col("exit_time"), exit_type, start, end)
            | (
                F.col("exit_time").isNull()
                & F.col("entry_time").isNotNull()
                & within_dates(F.col("entry_time"), entry_type, start, end)
            )
        )
        if "passage_date" in events.columns:
            if start is not None:
                chosen = chosen.where(F.col("passage_date") >= F.lit(as_date(start)))
            if end is not None:
                chosen = chosen.where(F.col("passage_date") <= F.lit(as_date(end)))
    registered = keep_selected(vessels, "vessel_type", vessel_types).select(
        F.col("imo").alias("_registered_imo")
    )
    return chosen.join(registered, chosen["imo"] == registered["_registered_imo"]).select(
        "vessel_key",
        "geofence",
        "exit_heading",
        compass_direction(F.col("exit_heading")).alias("exit_direction"),
        passage_time().alias("passage_time"),
        *keep,
    )
