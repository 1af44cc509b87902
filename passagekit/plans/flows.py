"""The query flows from a selection to its result, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from passagekit.functions.dates import DEFAULT_LOOKBACK_DAYS, lookback_range
from passagekit.operators.cargo import match_cargo
from passagekit.operators.passages import passages
from passagekit.operators.selection import EVERYTHING, Selection
from passagekit.operators.trajectories import (
    counted_positions,
    positions_near_passages,
    trajectory_lines,
)
from passagekit.sinks.exports import line_features


def recent_positions(
    events: DataFrame,
    vessels: DataFrame,
    positions: DataFrame,
    as_of,
    days: int | None = DEFAULT_LOOKBACK_DAYS,
    vessel_types: Selection = EVERYTHING,
    geofences: Selection = EVERYTHING,
) -> DataFrame:
    """Positions around the passages of a look-back."""
    start, end = lookback_range(as_of, days)
    chosen = passages(events, vessels, start, end, vessel_types, geofences)
    return positions_near_passages(positions, chosen, between=(start, end))


def recent_lines(
    events: DataFrame,
    vessels: DataFrame,
    positions: DataFrame,
    as_of,
    days: int | None = DEFAULT_LOOKBACK_DAYS,
    vessel_types: Selection = EVERYTHING,
    geofences: Selection = EVERYTHING,
) -> DataFrame:
    """Trajectory lines around the passages of a look-back, per geofence and vessel.

    The lines carry their GeoJSON ``feature``, ready to be written with one
    folder per geofence.
    """
    start, end = lookback_range(as_of, days)
    chosen = passages(events, vessels, start, end, vessel_types, geofences)
    by = ("geofence", "vessel_key")
    points = counted_positions(positions, chosen, by, between=(start, end))
    return line_features(trajectory_lines(points, by, copies="copies"))


def recent_cargo(
    events: DataFrame,
    vessels: DataFrame,
    cargo: DataFrame,
    as_of,
    days: int | None = DEFAULT_LOOKBACK_DAYS,
    vessel_types: Selection = EVERYTHING,
    geofences: Selection = EVERYTHING,
    date_col: str = "unload_date",
    **options,
) -> DataFrame:
    """Passages of a look-back with their nearest cargo."""
    start, end = lookback_range(as_of, days)
    chosen = passages(events, vessels, start, end, vessel_types, geofences)
    return match_cargo(chosen, cargo, date_col, between=(start, end), **options)
