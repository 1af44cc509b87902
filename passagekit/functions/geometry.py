"""WKT polygons, coordinate arrays and GeoJSON structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spacing that compact WKT drops, in the order it is dropped.
COMPACT_WKT_STEPS = ((" (", "("), (") ", ")"), (" ,", ","), (", ", ","))

# Outer brackets of a polygon text; group 1 holds its bracketed rings.
POLYGON_TEXT = r"(?is)^\s*POLYGON\s*(?:Z\s*)?\(\s*(\(.*\))\s*\)\s*$"
# The same of a multipolygon; group 1 holds its bracketed polygons.
MULTIPOLYGON_TEXT = r"(?is)^\s*MULTIPOLYGON\s*(?:Z\s*)?\(\s*(\(\s*\(.*\)\s*\))\s*\)\s*$"

# Rings of points of numbers.
RINGS_TYPE = "array<array<array<double>>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact_wkt(wkt: Column) -> Column:
    """WKT without spaces around brackets and commas, one literal pass per step."""
    for spaced, tight in COMPACT_WKT_STEPS:
        wkt = F.replace(wkt, F.lit(spaced), F.lit(tight))
    return wkt


def _rings(body: Column) -> Column:
    """Rings of a text of bracketed rings; what is not a number is null."""
    ring_texts = F.split(F.regexp_replace(body, r"^\s*\(|\)\s*$", ""), r"\)\s*,\s*\(")
    return F.transform(
        ring_texts,
        lambda ring: F.transform(
            F.split(ring, ","),
            lambda point: F.transform(
                F.split(F.trim(F.regexp_replace(point, r"\s+", " ")), " "),
                lambda number: number.try_cast("double"),
            ),
        ),
    )


def _fault(rings: Column) -> Column:
    """What is wrong with rings, null if nothing is."""
    pointed = F.forall(
        rings,
        lambda ring: F.forall(
            ring,
            lambda point: F.size(point).between(2, 3)
            & F.forall(point, lambda number: number.isNotNull()),
        ),
    )
    long_enough = F.forall(rings, lambda ring: F.size(ring) >= 4)
    closed = F.forall(
        rings, lambda ring: F.get(ring, F.lit(0)).eqNullSafe(F.get(ring, F.size(ring) - 1))
    )
    return (
        F.when(~pointed, F.lit("a point does not have two or three numbers"))
        .when(~long_enough, F.lit("a ring has fewer than four points"))
        .when(~closed, F.lit("a ring is not closed"))
    )


def _polygons(wkt: Column) -> Column:
    """The polygons of a multipolygon text, each an array of rings."""
    body = F.regexp_replace(F.regexp_extract(wkt, MULTIPOLYGON_TEXT, 1), r"^\s*\(|\)\s*$", "")
    return F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), _rings)


def polygon_rings(wkt: Column) -> Column:
    """Rings of a WKT polygon as array<array<array<double>>>, outer ring first.

    Null for anything that is not a polygon of closed rings whose points all have two
    or three numbers; :func:`wkt_fault` says why.
    """
    rings = _rings(F.regexp_extract(wkt, POLYGON_TEXT, 1))
    return bound(rings, lambda rings: F.when(_fault(rings).isNull(), rings))


def multipolygon_rings(wkt: Column) -> Column:
    """Polygons of a WKT multipolygon, each an array of rings; null for anything else."""
    return bound(
        _polygons(wkt), lambda polygons: F.when(_fault(F.flatten(polygons)).isNull(), polygons)
    )


def wkt_shape(wkt: Column) -> Column:
    """What a WKT text is, read once: a struct of ``polygon``, ``multipolygon`` and ``fault``.

    One of them is known: the rings of a polygon, the polygons of a multipolygon, each as
    :func:`polygon_rings` and :func:`multipolygon_rings` give them, or why the text is neither.
    """

    def shape(fault: Column, polygon: Column | None = None, multipolygon: Column | None = None) -> Column:
        def sound(value: Column | None, kind: str) -> Column:
            return F.lit(None).cast(kind) if value is None else F.when(fault.isNull(), value)

        return F.struct(
            sound(polygon, RINGS_TYPE).alias("polygon"),
            sound(multipolygon, f"array<{RINGS_TYPE}>").alias("multipolygon"),
            fault.alias("fault"),
        )

    one = bound(
        _rings(F.regexp_extract(wkt, POLYGON_TEXT, 1)),
        lambda rings: bound(_fault(rings), lambda fault: shape(fault, polygon=rings)),
    )
    several = bound(
        _polygons(wkt),
        lambda polygons: bound(_fault(F.flatten(polygons)), lambda fault: shape(fault, multipolygon=polygons)),
    )
    return (
        F.when(wkt.isNull() | (F.trim(wkt) == ""), shape(F.lit("it is empty")))
        .when(F.rlike(wkt, F.lit(POLYGON_TEXT)), one)
        .when(F.rlike(wkt, F.lit(MULTIPOLYGON_TEXT)), several)
        .otherwise(shape(F.lit("it is neither POLYGON nor MULTIPOLYGON")))
    )


def wkt_fault(wkt: Column) -> Column:
    """Why a WKT text is not read as a polygon or multipolygon, null if it is."""
    return wkt_shape(wkt)["fault"]


def number_text(number: Column) -> Column:
    """Shortest plain decimal text of a coordinate: ``10``, ``-47.47``, ``0.0001``."""
    # Between these the text of a double has no exponent.
    plain = (
        F.when((F.abs(number) >= 1e-3) & (F.abs(number) < 1e7) | (number == 0), number.cast("string"))
        .when(F.abs(number) < 1, F.regexp_replace(number.cast("decimal(38,30)").cast("string"), "0+$", ""))
        .otherwise(F.regexp_replace(number.cast("decimal(38,15)").cast("string"), "0+$", ""))
    )
    return F.regexp_replace(F.regexp_replace(plain, r"\.0*$", ""), "^-0$", "0")


def rings_to_wkt(rings: Column) -> Column:
    """WKT polygon of an array of rings, in its spaced form."""
    ring_texts = F.transform(
        rings,
        lambda ring: F.concat(
            F.lit("("),
            F.array_join(
                F.transform(ring, lambda point: F.array_join(F.transform(point, number_text), " ")),
                ", ",
            ),
            F.lit(")"),
        ),
    )
    return F.concat(F.lit("POLYGON ("), F.array_join(ring_texts, ", "), F.lit(")"))


def geometry_struct(kind: str, coordinates: Column) -> Column:
    """GeoJSON geometry, null where the coordinates are."""
    return bound(
        coordinates,
        lambda known: F.when(
            known.isNotNull(), F.struct(F.lit(kind).alias("type"), known.alias("coordinates"))
        ),
    )


def feature_struct(geometry: Column, **properties: Column) -> Column:
    """GeoJSON feature with the given properties."""
    return F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        F.struct(*[value.alias(name) for name, value in properties.items()]).alias("properties"),
    )
