"""Table shapes, and the mapping between the two geofence vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


GEOFENCES = _struct(
    geofence_name=StringType(),
    port_name=StringType(),
    wkt_coordinates=StringType(),
    srid=IntegerType(),
)

LAKE_GEOFENCES = _struct(
    external_id=StringType(),
    port_name=StringType(),
    location=MapType(StringType(), StringType()),
    reentry_forbidden_hours=LongType(),
)

GEOFENCE_EVENTS = _struct(
    vessel_key=LongType(),
    imo=LongType(),
    geofence=StringType(),
    entry_time=TimestampType(),
    exit_time=TimestampType(),
    exit_heading=DoubleType(),
)

VESSEL_POSITIONS = _struct(imo=LongType(), vessel_type=StringType())

TRAJECTORIES = _struct(
    vessel_key=LongType(),
    latitude=DoubleType(),
    longitude=DoubleType(),
    dt_pos_utc=TimestampType(),
)

CARGO_FLOWS = _struct(
    vessel_imo=LongType(),
    load_date=TimestampType(),
    unload_date=TimestampType(),
    load_region=StringType(),
    load_country=StringType(),
    load_port=StringType(),
    load_terminal=StringType(),
    unload_region=StringType(),
    unload_country=StringType(),
    unload_port=StringType(),
    unload_terminal=StringType(),
    group=StringType(),
    group_product=StringType(),
    category=StringType(),
    grade=StringType(),
    quantity=DoubleType(),
    vessel_type=StringType(),
    vessel_class=StringType(),
    cargo_status=StringType(),
    via_geofence=StringType(),
)

ASSET_EVENTS = _struct(type=StringType(), subtype=StringType(), start_time=TimestampType())

# Columns of the cargo table that a matched passage carries, in output order.
CARGO_COLUMNS = tuple(name for name in CARGO_FLOWS.fieldNames() if name != "vessel_imo")

WKT_KEY = "wkt"


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select and cast ``df`` to ``schema``; names match in any letter case.

    Timestamps keep the flavour they have (with or without time zone), because
    a cast between the two would shift values by the session time zone.
    """
    present = {field.name.lower(): field for field in df.schema.fields}
    missing = [name for name in schema.fieldNames() if name.lower() not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def fitted(want: StructField) -> Column:
        have = present[want.name.lower()]
        column = F.col(f"`{have.name}`")
        both_times = want.dataType.typeName() == "timestamp" and have.dataType.typeName() in (
            "timestamp",
            "timestamp_ntz",
        )
        return (column if both_times else column.cast(want.dataType)).alias(want.name)

    return df.select(*[fitted(field) for field in schema.fields])


def to_lake_schema(geofences: DataFrame, reentry_hours: int = 0) -> DataFrame:
    """Registry rows in the lake's vocabulary; a null polygon stays a null map."""
    wkt = F.col("wkt_coordinates")
    return geofences.select(
        F.col("geofence_name").alias("external_id"),
        "port_name",
        F.when(wkt.isNotNull(), F.create_map(F.lit(WKT_KEY), wkt)).alias("location"),
        F.lit(reentry_hours).cast("bigint").alias("reentry_forbidden_hours"),
    )


def from_lake_schema(lake: DataFrame, srid: int = 4326) -> DataFrame:
    """Lake rows in the registry's vocabulary."""
    return lake.select(
        F.col("external_id").alias("geofence_name"),
        "port_name",
        F.col("location")[WKT_KEY].alias("wkt_coordinates"),
        F.lit(srid).cast("int").alias("srid"),
    )
