"""Jobs over the geofence registry: conversion, validation and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.geometry import (
    compact_wkt,
    feature_struct,
    geometry_struct,
    polygon_rings,
    rings_to_wkt,
    wkt_fault,
    wkt_shape,
)
from passagekit.plans.parts import bounded_parts
from passagekit.sources.geojson import geofence_payload

REQUIRED_FIELDS = ("geofence_name", "port_name", "wkt_coordinates")
IDLE_SRID = 5326
# Bytes of features after which a collection ends.
COLLECTION_BYTES = 64 * 2**20
# Hexadecimal digits of a digest that make a cell.
_CELL_DIGITS = 3


def wkt_to_geojson(
    geofences: DataFrame, wkt: str = "wkt_coordinates", exterior_only: bool = False
) -> DataFrame:
    """Add ``geometry``, the GeoJSON polygon of a WKT column, null if it is not one."""
    rings = polygon_rings(F.col(wkt))
    if exterior_only:
        rings = F.slice(rings, 1, 1)
    return geofences.withColumn("geometry", geometry_struct("Polygon", rings))


def geojson_to_wkt(features: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """Add ``wkt_coordinates``, the compact WKT of polygon coordinates."""
    return features.withColumn("wkt_coordinates", compact_wkt(rings_to_wkt(F.col(coordinates))))


def with_payload(geofences: DataFrame) -> DataFrame:
    """Add ``payload``, the JSON text that a geofence is deployed from."""
    return geofences.withColumn(
        "payload", geofence_payload(*[F.col(name) for name in REQUIRED_FIELDS])
    )


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def checked_geofences(geofences: DataFrame) -> DataFrame:
    """Trim the required fields and add ``reason``, null where nothing is wrong.

    A row is rejected if a field is missing, or if its polygon cannot be read.
    """
    for name in REQUIRED_FIELDS:
        geofences = geofences.withColumn(name, strip(F.col(name)))
    empty = [
        F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name)) for name in REQUIRED_FIELDS
    ]
    missing = F.concat_ws(", ", *empty)
    fault = wkt_fault(F.col("wkt_coordinates"))
    return geofences.withColumn(
        "reason",
        F.when(missing != "", F.concat(F.lit("Missing required fields: "), missing)).otherwise(
            F.concat(F.lit("Unreadable polygon: "), fault)
        ),
    )


def validate_geofences(geofences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their ``reason``."""
    checked = checked_geofences(geofences)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(
        F.col("reason").isNotNull()
    )


def acceptance_counts() -> tuple[Column, Column]:
    """Numbers of ``accepted`` and ``rejected`` rows of a checked table, to aggregate or to observe."""
    reason = F.col("reason")
    return F.count_if(reason.isNull()).alias("accepted"), F.count_if(reason.isNotNull()).alias("rejected")


def registry_rows(accepted: DataFrame, srid: int = 4326) -> DataFrame:
    """Accepted geofences as registry rows."""
    return accepted.select(*REQUIRED_FIELDS, F.lit(srid).cast("int").alias("srid"))


def without_geofences(geofences: DataFrame, keys: DataFrame, key: str = "geofence_name") -> DataFrame:
    """Rows whose ``key`` is not in the first column of ``keys``; null keys stay."""
    doomed = keys.select(F.col(f"`{keys.columns[0]}`").alias("_doomed"))
    return geofences.join(doomed, geofences[key] == doomed["_doomed"], "left_anti")


def geofence_features(geofences: DataFrame, wkt: str = "wkt_coordinates") -> DataFrame:
    """Registry rows with ``feature``, a GeoJSON feature as JSON text.

    Its properties are the port as ``name`` and ``tooltip``, and the geofence
    name. Polygons and multipolygons are drawn; other rows have a null feature and
    say in ``feature_fault`` why.
    """
    port, name = F.col("port_name"), F.col("geofence_name")

    def text(geometry: Column) -> Column:
        feature = feature_struct(geometry, name=port, tooltip=port, geofence_name=name)
        return F.when(geometry.isNotNull(), F.to_json(feature, {"ignoreNullFields": "false"}))

    shape = F.col("_shape")
    drawn = geofences.withColumn("_shape", wkt_shape(F.col(wkt))).withColumns(
        {
            "geometry": geometry_struct("Polygon", shape["polygon"]),
            "_several": geometry_struct("MultiPolygon", shape["multipolygon"]),
        }
    )
    feature = F.coalesce(text(F.col("geometry")), text(F.col("_several")))
    return drawn.withColumns({"feature": feature, "feature_fault": shape["fault"]}).drop("_shape", "_several")


def feature_collections(
    features: DataFrame, max_features: int | None = None, max_bytes: int = COLLECTION_BYTES
) -> DataFrame:
    """Pack ``feature`` texts into feature collections, one JSON document per row.

    Output columns are ``part``, ``parts``, ``n_features`` and ``collection``. Features are taken in the
    order of their MD5 digest. A collection ends with the feature that brings it to
    ``max_bytes`` of feature text, whatever their number, or after ``max_features`` features if that is given. ``part`` counts from 0
    and ``parts`` is the last part plus one; a feature that is longer than ``max_bytes`` has a part of its own
    and leaves the numbers unused that it spans.
    """
    present = features.where(F.col("feature").isNotNull()).select(F.md5("feature").alias("_digest"), "feature")
    size = F.lit(1) if max_features is not None else F.octet_length("feature")
    placed = bounded_parts(
        present,
        by=(),
        order=("_digest", "feature"),
        # Most significant digits, so that cells follow the order.
        cell=F.conv(F.substring("_digest", 1, _CELL_DIGITS), 16, 10).cast("int"),
        max_rows=max_bytes if max_features is None else max_features,
        size=size,
    )
    in_order = F.array_sort(F.collect_list(F.struct("_digest", "feature", "copies")))
    texts = F.flatten(F.transform(in_order, lambda f: F.array_repeat(f["feature"], f["copies"])))
    return placed.groupBy("part", "parts").agg(texts.alias("_features")).select(
        "part",
        "parts",
        F.size("_features").alias("n_features"),
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.array_join("_features", ","),
            F.lit("]}"),
        ).alias("collection"),
    )
