"""Tables of the library's shapes, derived from the TPC-H-like test parquet.

Each text runs unchanged on Spark and on DuckDB, so that a query and its check
start from the same rows. Column ``row_id`` identifies a row and only settles
ties.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VESSEL_TYPE = """CASE s_nationkey % 4 WHEN 0 THEN 'LPG Carriers' WHEN 1 THEN 'Oil Tankers'
            WHEN 2 THEN 'LNG Carriers' ELSE 'Dry Bulk' END"""

_LINE_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
    " || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
)

# South-west corner of a customer's polygon.
_WEST = "(c_custkey % 340 - 170)"
_SOUTH = "(c_custkey % 160 - 80)"


def _text(number: str) -> str:
    return f"CAST({number} AS STRING)"


def _ring(inset: int, size: int, between: str, after: str, left: str, right: str) -> str:
    """SQL text of a closed square ring, spelled in WKT or JSON brackets."""
    west, south = f"{_WEST} + {inset}", f"{_SOUTH} + {inset}"
    east, north = f"{west} + {size}", f"{south} + {size}"
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    points = f" || '{after}' || ".join(
        f"'{left}' || {_text(x)} || '{between}' || {_text(y)} || '{right}'" for x, y in corners
    )
    return points


_WKT_OUTER = _ring(0, 6, " ", ", ", "", "")
_WKT_HOLE = _ring(2, 2, " ", ", ", "", "")
_JSON_OUTER = _ring(0, 6, ",", ",", "[", "]")

SQL = {
    "geofence_events": f"""
SELECT l_suppkey AS vessel_key, l_suppkey AS imo,
       'GF_' || CAST(l_partkey % 5 AS STRING) AS geofence,
       l_shipdate + INTERVAL '1' HOUR * l_linenumber AS entry_time,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL
            ELSE l_shipdate + INTERVAL '1' HOUR * (l_linenumber + 6) END AS exit_time,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL
            ELSE CAST((l_orderkey * 37 + l_partkey) % 3600 AS DOUBLE) / 10 END AS exit_heading,
       {_LINE_ID} AS row_id
FROM lineitem WHERE l_returnflag = 'R'""",
    "current_vessel_positions": f"""
SELECT s_suppkey AS imo, {_VESSEL_TYPE} AS vessel_type
FROM supplier""",
    "trajectories": f"""
SELECT l_suppkey AS vessel_key,
       CAST(l_partkey % 1800 AS DOUBLE) / 10 - 90 AS latitude,
       CAST(l_orderkey % 3600 AS DOUBLE) / 10 - 180 AS longitude,
       l_shipdate + INTERVAL '1' HOUR * l_linenumber AS dt_pos_utc,
       {_LINE_ID} AS row_id
FROM lineitem WHERE l_returnflag = 'N'""",
    "cargoflow": f"""
SELECT l.l_suppkey AS vessel_imo,
       l.l_shipdate - INTERVAL '1' DAY * (l.l_orderkey % 30) AS load_date,
       CASE WHEN l.l_orderkey % 13 = 0 THEN NULL ELSE l.l_shipdate END AS unload_date,
       lr.r_name AS load_region, ln.n_name AS load_country,
       'PORT_' || CAST(l.l_partkey % 20 AS STRING) AS load_port,
       'TERM_' || CAST(l.l_partkey % 50 AS STRING) AS load_terminal,
       ur.r_name AS unload_region, un.n_name AS unload_country,
       'PORT_' || CAST(l.l_orderkey % 20 AS STRING) AS unload_port,
       'TERM_' || CAST(l.l_orderkey % 50 AS STRING) AS unload_terminal,
       p.p_type AS cargo_group, p.p_brand AS group_product,
       p.p_type AS category, p.p_name AS grade,
       l.l_quantity AS quantity,
       {_VESSEL_TYPE} AS vessel_type,
       'CLASS_' || CAST(s.s_suppkey % 3 AS STRING) AS vessel_class,
       l.l_linestatus AS cargo_status,
       CASE WHEN l.l_orderkey % 3 = 0 THEN NULL
            ELSE 'GF_' || CAST(l.l_orderkey % 5 AS STRING) END AS via_geofence,
       {_LINE_ID} AS row_id
FROM lineitem l
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation ln ON ln.n_nationkey = s.s_nationkey
JOIN region lr ON lr.r_regionkey = ln.n_regionkey
JOIN nation un ON un.n_nationkey = l.l_orderkey % 25
JOIN region ur ON ur.r_regionkey = un.n_regionkey
WHERE l.l_returnflag = 'A'""",
    "asset_events": """
SELECT 'geofence_arrival' AS type, event_type AS subtype, ts AS start_time, user_id AS asset_id, value
FROM events""",
    # One geofence per customer; those of one market segment have a hole.
    "geofences": f"""
SELECT 'GF_' || CAST(c_custkey AS STRING) AS geofence_name, n_name AS port_name,
       'POLYGON ((' || {_WKT_OUTER} || ')'
         || CASE WHEN c_mktsegment = 'BUILDING' THEN ', (' || {_WKT_HOLE} || ')' ELSE '' END
         || ')' AS wkt_coordinates,
       4326 AS srid, c_mktsegment AS segment, c_custkey AS row_id
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    # Geofences as typed in: padded, and some without a name, a port or a polygon.
    "geofence_uploads": f"""
SELECT CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN '  '
            ELSE '  GF_' || CAST(c_custkey AS STRING) || ' ' END AS geofence_name,
       CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 0 THEN NULL
            ELSE n_name || ' ' END AS port_name,
       CASE WHEN c_acctbal < -900 THEN ''
            ELSE 'POLYGON((' || {_WKT_OUTER} || '))' END AS wkt_coordinates
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    # One GeoJSON document per customer with a line, a polygon and a point; the
    # documents of indebted customers are cut short.
    "geojson_documents": f"""
SELECT c_custkey AS doc_id,
       '{{"type":"FeatureCollection","features":['
         || '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[['
         || {_text(_WEST)} || ',' || {_text(_SOUTH)} || '],['
         || {_text(_WEST + " + 1")} || ',' || {_text(_SOUTH + " + 3")} || '],['
         || {_text(_WEST + " + 5")} || ',' || {_text(_SOUTH + " + 2")}
         || ']]}},"properties":{{"name":"leg ' || {_text("c_custkey")} || '"}}}},'
         || '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[['
         || {_JSON_OUTER} || ']]}},"properties":{{"name":"' || c_name || '"}}}},'
         || '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['
         || {_text(_WEST)} || ',' || {_text(_SOUTH)} || ']}},"properties":{{}}}}'
         || CASE WHEN c_acctbal < 0 THEN '' ELSE ']}}' END AS text
FROM customer""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem", "events")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the parquet files in ``sf_dir``."""
    sql = SQL[name]
    for table in TABLES:
        if re.search(rf"(FROM|JOIN) {table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    df = spark.sql(sql)
    return df.withColumnRenamed("cargo_group", "group")
