"""Headings: compass octants and great-circle bearings."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where one octant ends and the next begins, and the octants in
# that order. North lies on both ends.
OCTANT_EDGES = (22.5, 67.5, 112.5, 157.5, 202.5, 247.5, 292.5, 337.5)
OCTANTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW", "N")


def compass_direction(heading: Column) -> Column:
    """Octant of a heading in degrees, by how many edges it has reached.

    Both ends are open: anything below the first edge or from the last edge on
    is north, out-of-range values included. Null stays null.
    """
    edges_reached = reduce(add, [(heading >= F.lit(edge)).cast("int") for edge in OCTANT_EDGES])
    octants = F.array(*[F.lit(name) for name in OCTANTS])
    return F.when(heading.isNotNull(), F.element_at(octants, edges_reached + 1))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing from point 1 to point 2, 0 to 360 with north 0."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    east = F.radians(lon2) - F.radians(lon1)
    angle = F.atan2(
        F.sin(east) * F.cos(phi2),
        F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(east),
    )
    return (F.degrees(angle) + 360) % 360
