"""GeoJSON documents: files, features, geometry kinds and geofence payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The file endings of an upload.
UPLOAD_ENDINGS = (".geojson", ".json")
# The same endings in any letter case, as a listing pattern.
UPLOAD_GLOB = "*.{[gG][eE][oO][jJ][sS][oO][nN],[jJ][sS][oO][nN]}"

# Coordinates stay raw JSON here; their nesting depends on the geometry kind.
_GEOMETRY = "struct<type: string, coordinates: string>"
_FEATURE = f"struct<type: string, geometry: {_GEOMETRY}, properties: map<string, string>>"
# A root may be a collection, one feature or one geometry.
ROOT_SCHEMA = (
    f"type string, features array<{_FEATURE}>,"
    f" geometry {_GEOMETRY}, properties map<string, string>, coordinates string"
)
# The kinds of geometry.
GEOMETRY_KINDS = (
    "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection",
)
PAYLOAD_SCHEMA = "geofence_name string, port_name string, wkt_coordinates string"
LINE_SCHEMA = "array<array<double>>"
POLYGON_SCHEMA = "array<array<array<double>>>"


def is_upload(name: Column) -> Column:
    """Whether a file name has one of the accepted endings, in any letter case."""
    lowered = F.lower(name)
    return F.endswith(lowered, F.lit(UPLOAD_ENDINGS[0])) | F.endswith(
        lowered, F.lit(UPLOAD_ENDINGS[1])
    )


def parse_collections(documents: DataFrame, text: str = "text", on_error: str = "drop") -> DataFrame:
    """Add ``collection``, the parsed feature collection of a document.

    A document that is one feature or one geometry is a collection of that. A document that is not a valid JSON object is dropped, or kept with a null
    collection for ``on_error="keep"``.
    """
    if on_error not in ("drop", "keep"):
        raise ValueError(f"unknown on_error {on_error!r}, expected 'drop' or 'keep'")
    root = F.col("_root")
    geometry = F.struct(root["type"].alias("type"), root["coordinates"].alias("coordinates"))
    alone = F.when(
        root["type"] == "Feature", F.struct(root["type"].alias("type"), root["geometry"].alias("geometry"),
                                            root["properties"].alias("properties"))
    ).when(
        root["type"].isin(*GEOMETRY_KINDS),
        F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                 F.lit(None).cast("map<string, string>").alias("properties")),
    )
    parsed = F.struct(
        root["type"].alias("type"),
        F.coalesce(root["features"], F.when(alone.isNotNull(), F.array(alone))).alias("features"),
    )
    valid = F.startswith(F.get_json_object(F.col(text), "$"), F.lit("{"))
    if on_error == "drop":
        documents, valid = documents.where(valid), F.lit(True)
    rooted = documents.withColumn("_root", F.from_json(F.col(text), ROOT_SCHEMA))
    return rooted.withColumn("collection", F.when(valid, parsed)).drop("_root")


def read_geojson(spark: SparkSession, path: str, on_error: str = "drop") -> DataFrame:
    """All uploaded documents of a folder as ``file_name``, ``text``, ``collection``.

    Other files are skipped when the folder is listed and never opened. A document is one
    value, so it must fit a task; :func:`read_collection_features` reads large ones.
    """
    files = (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", UPLOAD_GLOB)
        .text(path)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    )
    return parse_collections(files, on_error=on_error)


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of files with one JSON feature or geometry in a line, as this library writes them.

    Lines of one file are read by several tasks. The folders' partition columns come first, then the columns of
    :func:`explode_features`. Lines that are not valid are left out.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "_line")
    return explode_features(parse_collections(lines, "_line")).drop("_line", "feature_no")


def read_collection_features(spark: SparkSession, path: str, opening: str = '{"type":"Feature",') -> DataFrame:
    """Features of the uploaded collections of a folder, read in pieces, a feature at a time.

    A collection is split where a feature opens, which must be spelled as ``opening`` throughout, as writers of compact JSON
    do; inside a text it cannot stand, since quotes are escaped there. A file of any size is
    so read by several tasks, and no more than a feature is in memory at once. Columns are ``file_name``
    and those of :func:`explode_features` but for the number. Pieces that are not valid are left out.
    """
    pieces = (
        spark.read.option("lineSep", opening)
        .option("pathGlobFilter", UPLOAD_GLOB)
        .text(path)
        .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("_piece"))
    )
    # What follows a feature, such as the comma before the next one, is not looked at.
    parsed = F.from_json(F.concat(F.lit(opening), F.col("_piece")), _FEATURE)
    return (
        pieces.withColumn("_parsed", parsed)
        .where(F.col("_parsed.geometry").isNotNull() | F.col("_parsed.properties").isNotNull())
        .select("file_name", F.struct(F.array("_parsed").alias("features")).alias("collection"))
        .transform(explode_features)
        .drop("feature_no")
    )


def explode_features(documents: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per feature with ``feature_no``, ``geometry_type``, ``coordinates``, ``properties``."""
    if first_only:
        rows = documents.select(
            "*",
            F.lit(0).alias("feature_no"),
            F.get(F.col("collection.features"), F.lit(0)).alias("_feature"),
        ).where(F.col("_feature").isNotNull())
    else:
        rows = documents.select("*", F.posexplode("collection.features").alias("feature_no", "_feature"))
    return rows.select(
        *[F.col(f"`{name}`") for name in documents.columns if name != "collection"],
        "feature_no",
        F.coalesce(F.col("_feature.geometry.type"), F.lit("")).alias("geometry_type"),
        F.col("_feature.geometry.coordinates").alias("coordinates"),
        F.col("_feature.properties").alias("properties"),
    )


def classify_geometry(features: DataFrame) -> DataFrame:
    """Add ``handling``: what can be done with a feature of this geometry.

    ``line`` has a heading, ``short line`` has too few points for one,
    ``polygon`` can become a geofence and ``unsupported`` is neither.
    """
    points = F.size(F.from_json("coordinates", LINE_SCHEMA))
    return features.withColumn(
        "handling",
        F.when(
            F.col("geometry_type") == "LineString",
            F.when(points >= 2, F.lit("line")).otherwise(F.lit("short line")),
        )
        .when(F.col("geometry_type") == "Polygon", F.lit("polygon"))
        .otherwise(F.lit("unsupported")),
    )


def line_coordinates(features: DataFrame) -> DataFrame:
    """The line features with ``coordinates`` as an array of points."""
    return features.where(F.col("geometry_type") == "LineString").withColumn(
        "coordinates", F.from_json("coordinates", LINE_SCHEMA)
    )


def polygon_coordinates(features: DataFrame) -> DataFrame:
    """The polygon features with ``coordinates`` as an array of rings."""
    return features.where(F.col("geometry_type") == "Polygon").withColumn(
        "coordinates", F.from_json("coordinates", POLYGON_SCHEMA)
    )


def parse_geofence_payload(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Add ``geofence_name``, ``port_name`` and ``wkt_coordinates`` from a JSON payload.

    A field that is absent is null, or ``missing`` if that is given.
    """
    payload = F.from_json(F.col(column), PAYLOAD_SCHEMA)
    names = [field.split()[0] for field in PAYLOAD_SCHEMA.split(", ")]
    fields = df.withColumn("_payload", payload)
    for name in names:
        value = F.col(f"_payload.{name}")
        fields = fields.withColumn(name, value if missing is None else F.coalesce(value, F.lit(missing)))
    return fields.drop("_payload")


def geofence_payload(name: Column, port: Column, wkt: Column) -> Column:
    """JSON payload of a geofence; missing names become empty text."""
    return F.to_json(
        F.struct(
            F.coalesce(name, F.lit("")).alias("geofence_name"),
            F.coalesce(port, F.lit("")).alias("port_name"),
            wkt.alias("wkt_coordinates"),
        ),
        {"ignoreNullFields": "false"},
    )
