"""The registered queries over the test tables, each with the SQL that checks it.

A query takes the session and a folder of parquet tables. Its check is plain SQL
over the same tables, written without the library's rewrites; ``{name}`` stands
for the fixture of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passagekit import fixtures
from passagekit.functions.dates import lookback_range
from passagekit.operators import charts, geofences
from passagekit.operators.cargo import match_cargo
from passagekit.operators.frequency import entries_per_period
from passagekit.operators.passages import events_for, passages
from passagekit.operators.quantiles import exact_quantiles
from passagekit.operators.trajectories import (
    counted_positions,
    distinct_points,
    line_ends,
    line_headings,
    positions_near_passages,
    trajectory_lines,
)
from passagekit.plans.flows import recent_cargo, recent_lines, recent_positions
from passagekit.plans.stored import saved
from passagekit.schemas import CARGO_COLUMNS, from_lake_schema, to_lake_schema
from passagekit.sinks.exports import csv_lines, line_features
from passagekit.sources import geojson
from passagekit.sources.tables import asset_events, geofence_map, read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

START, END = "1998-01-01", "1998-12-31"
VESSEL_TYPES = ["LPG Carriers", "Oil Tankers"]
GEOFENCES = ["GF_1", "GF_2"]


def report(name: str, check: str | None = None):
    """Register a query under ``name`` with its check."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if check is not None:
            CHECKS[name] = _fill(check)
        return query

    return register


def _fill(sql: str) -> str:
    for name, text in fixtures.SQL.items():
        sql = sql.replace("{" + name + "}", f"({text})")
    return sql


def _events(spark, sf_dir):
    return fixtures.fixture(spark, sf_dir, "geofence_events")


def _vessels(spark, sf_dir):
    return fixtures.fixture(spark, sf_dir, "current_vessel_positions")


def _positions(spark, sf_dir):
    return fixtures.fixture(spark, sf_dir, "trajectories")


def _cargo(spark, sf_dir):
    return fixtures.fixture(spark, sf_dir, "cargoflow")


def _geofences(spark, sf_dir):
    return fixtures.fixture(spark, sf_dir, "geofences")


def _all_passages(spark, sf_dir):
    return passages(_events(spark, sf_dir), _vessels(spark, sf_dir), keep=("row_id",))


def _filtered_passages(spark, sf_dir):
    return passages(
        _events(spark, sf_dir),
        _vessels(spark, sf_dir),
        START,
        END,
        VESSEL_TYPES,
        GEOFENCES,
        keep=("row_id",),
    )


# ---------------------------------------------------------------- frequency


def _frequency_check(start: str, label: str, source: str, time: str, key: str) -> str:
    return f"""
        SELECT {key}, {start} AS period_start, {label} AS period_label, COUNT(*) AS "count"
        FROM (SELECT {key}, CAST({time} AS DATE) AS d FROM {source} t WHERE {time} IS NOT NULL) x
        GROUP BY {key}, {start}"""


_WEEK = "CAST(date_trunc('week', d) AS DATE)"
_MONTH = "CAST(date_trunc('month', d) AS DATE)"
_PERIODS = {
    "D": ("d", "strftime(d, '%Y-%m-%d')"),
    "W": (
        _WEEK,
        f"strftime({_WEEK}, '%Y-%m-%d') || '/' || strftime({_WEEK} + INTERVAL '6' DAY, '%Y-%m-%d')",
    ),
    "M": (_MONTH, f"strftime({_MONTH}, '%Y-%m')"),
}


def _register_frequencies() -> None:
    for name, period in (("entries_daily", "D"), ("entries_weekly", "W"), ("entries_monthly", "M")):
        check = _frequency_check(*_PERIODS[period], "{geofence_events}", "entry_time", "geofence")

        @report(name, check)
        def entries(spark, sf_dir, period=period):
            return entries_per_period(_events(spark, sf_dir), period, by=("geofence",))

        step = {"D": "1 DAY", "W": "7 DAY", "M": "1 MONTH"}[period]
        label = _PERIODS[period][1].replace(_PERIODS[period][0], "start") if period != "D" else "strftime(start, '%Y-%m-%d')"

        @report(f"{name}_filled", f"""
            WITH counted AS ({check}),
            days AS (SELECT geofence, CAST(unnest(generate_series(MIN(period_start), MAX(period_start), INTERVAL {step})) AS DATE) AS start
                     FROM counted GROUP BY geofence)
            SELECT days.geofence, start AS period_start, {label} AS period_label, coalesce("count", 0) AS "count"
            FROM days LEFT JOIN counted ON counted.geofence = days.geofence AND period_start = start""")
        def filled(spark, sf_dir, period=period):
            return entries_per_period(_events(spark, sf_dir), period, by=("geofence",), fill_gaps=True)

    for name, period in (("asset_entries_daily", "D"), ("asset_entries_weekly", "W")):
        check = _frequency_check(*_PERIODS[period], "{asset_events}", "start_time", "subtype")

        @report(name, check)
        def asset_entries(spark, sf_dir, period=period):
            events = asset_events(fixtures.fixture(spark, sf_dir, "asset_events"))
            return entries_per_period(events, period, "start_time", by=("subtype",))


_register_frequencies()


@report(
    "geofence_event_rows",
    "SELECT * FROM {geofence_events} t WHERE geofence = 'GF_1'",
)
def geofence_event_rows(spark, sf_dir):
    return events_for(_events(spark, sf_dir), "GF_1")


@report(
    "entries_of_one_geofence",
    """SELECT CAST(entry_time AS DATE) AS period_start,
              strftime(CAST(entry_time AS DATE), '%Y-%m-%d') AS period_label, COUNT(*) AS "count"
       FROM {geofence_events} t WHERE geofence = 'GF_1' GROUP BY ALL""",
)
def entries_of_one_geofence(spark, sf_dir):
    return entries_per_period(events_for(_events(spark, sf_dir), "GF_1"), "D")


@report(
    "asset_events_of_one_subtype",
    "SELECT * FROM {asset_events} t WHERE type = 'geofence_arrival' AND subtype = 'view'",
)
def asset_events_of_one_subtype(spark, sf_dir):
    return asset_events(fixtures.fixture(spark, sf_dir, "asset_events"), subtype="view")


# ----------------------------------------------------------------- passages

# A heading belongs to the eighth of the circle whose middle is nearest, from north clockwise.
_PASSAGES = """
    SELECT visit.vessel_key, visit.geofence, visit.exit_heading,
           ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW']
               [1 + CAST(floor(visit.exit_heading / 45 + 0.5) AS INTEGER) % 8] AS exit_direction,
           CASE WHEN visit.exit_time IS NULL THEN visit.entry_time ELSE visit.exit_time END AS passage_time,
           visit.row_id, fleet.vessel_type
    FROM {current_vessel_positions} fleet INNER JOIN {geofence_events} visit USING (imo)"""

_PASSAGE_COLUMNS = "vessel_key, geofence, exit_heading, exit_direction, passage_time, row_id"

_FILTERED_PASSAGES = f"""
    SELECT * FROM ({_PASSAGES}) every_passage
    WHERE CAST(passage_time AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
      AND vessel_type IN ('LPG Carriers', 'Oil Tankers') AND geofence IN ('GF_1', 'GF_2')"""

_LOOKBACK_PASSAGES = f"""
    SELECT * FROM ({_PASSAGES}) every_passage
    WHERE CAST(passage_time AS DATE) BETWEEN DATE '1998-06-23' AND DATE '1998-06-30'"""


@report("passages_all", f"SELECT {_PASSAGE_COLUMNS} FROM ({_PASSAGES}) p")
def passages_all(spark, sf_dir):
    return _all_passages(spark, sf_dir)


@report("passages_filtered", f"SELECT {_PASSAGE_COLUMNS} FROM ({_FILTERED_PASSAGES}) p")
def passages_filtered(spark, sf_dir):
    return _filtered_passages(spark, sf_dir)


@report("passages_lookback", f"SELECT {_PASSAGE_COLUMNS} FROM ({_LOOKBACK_PASSAGES}) p")
def passages_lookback(spark, sf_dir):
    start, end = lookback_range("1998-06-30", None)
    return passages(
        _events(spark, sf_dir), _vessels(spark, sf_dir), start, end, keep=("row_id",)
    )


@report(
    "passage_directions",
    f"""SELECT exit_direction, COUNT(*) AS passages, MIN(exit_heading) AS least_heading,
               MAX(exit_heading) AS greatest_heading
        FROM ({_PASSAGES}) p GROUP BY exit_direction""",
)
def passage_directions(spark, sf_dir):
    return (
        _all_passages(spark, sf_dir)
        .groupBy("exit_direction")
        .agg(
            F.count(F.lit(1)).alias("passages"),
            F.min("exit_heading").alias("least_heading"),
            F.max("exit_heading").alias("greatest_heading"),
        )
    )


# ------------------------------------------------------------- trajectories


def _near(passages_sql: str) -> str:
    # From 14 days before the day of the passage to the end of the 14th day after it.
    return f"""
        WITH windows AS (
            SELECT vessel_key, geofence, passage_time,
                   date_trunc('day', passage_time) - INTERVAL 14 DAY AS opens,
                   date_trunc('day', passage_time) + INTERVAL 15 DAY AS closes
            FROM ({passages_sql}) every_passage)
        SELECT windows.vessel_key, geofence, passage_time, latitude, longitude, dt_pos_utc
        FROM windows INNER JOIN {{trajectories}} report
          ON report.vessel_key = windows.vessel_key AND dt_pos_utc >= opens AND dt_pos_utc < closes"""


@report("positions_near_passages", _near(_PASSAGES))
def near_all(spark, sf_dir):
    return positions_near_passages(_positions(spark, sf_dir), _all_passages(spark, sf_dir))


@report("positions_near_filtered_passages", _near(_FILTERED_PASSAGES))
def near_filtered(spark, sf_dir):
    return positions_near_passages(
        _positions(spark, sf_dir), _filtered_passages(spark, sf_dir), between=(START, END)
    )


@report(
    "position_copies",
    f"""SELECT geofence, vessel_key, latitude, longitude, dt_pos_utc,
               CAST(COUNT(*) AS BIGINT) AS copies
        FROM ({_near(_PASSAGES)}) n GROUP BY ALL""",
)
def position_copies(spark, sf_dir):
    counted = _counted(spark, sf_dir, ("geofence", "vessel_key"))
    # The check cannot tell equal position reports apart.
    keys = [name for name in counted.columns if name != "copies"]
    return counted.groupBy(*keys).agg(F.sum("copies").alias("copies"))


@report("positions_of_lookback", _near(_LOOKBACK_PASSAGES))
def near_lookback(spark, sf_dir):
    return recent_positions(
        _events(spark, sf_dir), _vessels(spark, sf_dir), _positions(spark, sf_dir), "1998-06-30"
    )


_POINT_TEXT = (
    "CAST(CAST(round(longitude * 10) AS BIGINT) AS VARCHAR) || ' '"
    " || CAST(CAST(round(latitude * 10) AS BIGINT) AS VARCHAR)"
)


def _lines_check(points: str, keys: str) -> str:
    order = "ORDER BY dt_pos_utc, longitude, latitude"
    return f"""
        SELECT {keys}, CAST(0 AS BIGINT) AS part, COUNT(*) AS n_points,
               string_agg({_POINT_TEXT}, ',' {order}) AS path,
               string_agg(strftime(dt_pos_utc, '%Y-%m-%d %H:%M:%S'), ',' {order}) AS dates
        FROM ({points}) points GROUP BY {keys}"""


def _counted(spark, sf_dir, by):
    return counted_positions(_positions(spark, sf_dir), _all_passages(spark, sf_dir), by)


def _lines(spark, sf_dir, by=("vessel_key",)):
    return trajectory_lines(_counted(spark, sf_dir, by), by, copies="copies")


def _lines_as_text(lines: DataFrame, *keys: str) -> DataFrame:
    tenths = lambda number: F.round(number * 10).cast("bigint").cast("string")
    return lines.select(
        *keys,
        "part",
        F.col("n_points").cast("bigint").alias("n_points"),
        F.array_join(
            F.transform(
                "coordinates", lambda p: F.concat(tenths(p[0]), F.lit(" "), tenths(p[1]))
            ),
            ",",
        ).alias("path"),
        F.array_join("dates", ",").alias("dates"),
    )


@report("trajectory_lines", _lines_check(_near(_PASSAGES), "vessel_key"))
def lines_per_vessel(spark, sf_dir):
    return _lines_as_text(_lines(spark, sf_dir), "vessel_key")


@report("trajectory_lines_by_geofence", _lines_check(_near(_PASSAGES), "geofence, vessel_key"))
def lines_per_geofence(spark, sf_dir):
    keys = ("geofence", "vessel_key")
    return _lines_as_text(_lines(spark, sf_dir, keys), *keys)


@report(
    "trajectory_lines_of_lookback", _lines_check(_near(_LOOKBACK_PASSAGES), "geofence, vessel_key")
)
def lines_of_lookback(spark, sf_dir):
    lines = recent_lines(
        _events(spark, sf_dir), _vessels(spark, sf_dir), _positions(spark, sf_dir), "1998-06-30"
    )
    return _lines_as_text(lines, "geofence", "vessel_key")


@report(
    "trajectory_lines_distinct_points",
    _lines_check(
        f"SELECT DISTINCT vessel_key, dt_pos_utc, longitude, latitude FROM ({_near(_PASSAGES)}) n",
        "vessel_key",
    ),
)
def lines_of_distinct_points(spark, sf_dir):
    points = distinct_points(_counted(spark, sf_dir, ("vessel_key",)))
    return _lines_as_text(trajectory_lines(points), "vessel_key")


@report(
    "trajectory_lines_geojson",
    f"""SELECT vessel_key,
               '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":['
               || string_agg('[' || CAST(longitude AS VARCHAR) || ',' || CAST(latitude AS VARCHAR) || ']',
                             ',' ORDER BY dt_pos_utc, longitude, latitude)
               || ']}},"properties":{{"name":' || CAST(vessel_key AS VARCHAR) || ',"dates":['
               || string_agg('"' || strftime(dt_pos_utc, '%Y-%m-%d %H:%M:%S') || '"',
                             ',' ORDER BY dt_pos_utc, longitude, latitude)
               || '],"part":0}}}}' AS feature
        FROM ({_near(_PASSAGES)}) points GROUP BY vessel_key""",
)
def lines_as_geojson(spark, sf_dir):
    return line_features(_lines(spark, sf_dir)).select("vessel_key", "feature")


@report(
    "line_headings",
    """
    WITH corners AS (
        SELECT c_custkey AS doc_id,
               radians(c_custkey % 340 - 170) AS lon1, radians(c_custkey % 160 - 80) AS lat1,
               radians(c_custkey % 340 - 165) AS lon2, radians(c_custkey % 160 - 78) AS lat2
        FROM customer WHERE c_acctbal >= 0),
    angles AS (
        SELECT *, degrees(atan2(sin(lon2 - lon1) * cos(lat2),
                   cos(lat1) * sin(lat2) - sin(lat1) * cos(lat2) * cos(lon2 - lon1))) AS angle
        FROM corners)
    SELECT doc_id, round(CASE WHEN angle < 0 THEN angle + 360 ELSE angle END, 6) AS heading,
           printf('%.1f', CASE WHEN angle < 0 THEN angle + 360 ELSE angle END) AS heading_text,
           printf('[%.6f, %.6f]', degrees(lon1), degrees(lat1)) AS start_text,
           printf('[%.6f, %.6f]', degrees(lon2), degrees(lat2)) AS end_text,
           CAST(3 AS BIGINT) AS total_points
    FROM angles""",
)
def headings_of_lines(spark, sf_dir):
    lines = geojson.line_coordinates(_features(spark, sf_dir))
    return line_headings(lines).select(
        "doc_id",
        F.round("heading", 6).alias("heading"),
        "heading_text",
        "start_text",
        "end_text",
        F.col("total_points").cast("bigint").alias("total_points"),
    )


# -------------------------------------------------------------------- cargo

_CARGO_COLUMNS_SQL = ", ".join(
    'flow.cargo_group AS "group"' if name == "group" else f"flow.{name}" for name in CARGO_COLUMNS
)


def _matched(passages_sql: str, date_col: str) -> str:
    """One row for each moment of a vessel: its first passage, and the cargo row it is nearest to.

    The least pair of distance in days and row finds the cargo.
    """
    return f"""
        WITH moments AS (
            SELECT vessel_key, passage_time, CAST(passage_time AS DATE) AS passage_day,
                   arg_min(struct_pack(geofence, exit_heading, exit_direction), row_id) AS passage
            FROM ({passages_sql}) every_passage GROUP BY vessel_key, passage_time),
        reached AS (
            SELECT vessel_key, passage_time,
                   min(struct_pack(gap := abs(CAST({date_col} AS DATE) - passage_day), flow_row := row_id)) AS nearest
            FROM moments INNER JOIN {{cargoflow}} every_flow
              ON vessel_imo = vessel_key
             AND CAST({date_col} AS DATE) BETWEEN passage_day - 39 AND passage_day + 39
            GROUP BY vessel_key, passage_time)
        SELECT moments.vessel_key, passage.geofence AS geofence, passage.exit_heading AS exit_heading,
               passage.exit_direction AS exit_direction, CAST(nearest.gap AS BIGINT) AS date_diff,
               moments.passage_time, {_CARGO_COLUMNS_SQL}
        FROM moments
        LEFT JOIN reached ON reached.vessel_key = moments.vessel_key AND reached.passage_time = moments.passage_time
        LEFT JOIN {{cargoflow}} flow ON flow.row_id = nearest.flow_row AND flow.vessel_imo = moments.vessel_key"""


def _match(passages_df: DataFrame, cargo: DataFrame, date_col: str, **options) -> DataFrame:
    matched = match_cargo(
        passages_df, cargo, date_col, cargo_tie=("row_id",), passage_tie=("row_id",), **options
    )
    return matched.withColumn("date_diff", F.col("date_diff").cast("bigint"))


@report("cargo_by_unload", _matched(_PASSAGES, "unload_date"))
def cargo_by_unload(spark, sf_dir):
    return _match(_all_passages(spark, sf_dir), _cargo(spark, sf_dir), "unload_date", ordered=True)


@report("cargo_by_load", _matched(_PASSAGES, "load_date"))
def cargo_by_load(spark, sf_dir):
    return _match(_all_passages(spark, sf_dir), _cargo(spark, sf_dir), "load_date", ordered=True)


@report("cargo_filtered", _matched(_FILTERED_PASSAGES, "unload_date"))
def cargo_filtered(spark, sf_dir):
    return _match(
        _filtered_passages(spark, sf_dir),
        _cargo(spark, sf_dir),
        "unload_date",
        between=(START, END),
        ordered=True,
    )


@report("cargo_of_lookback", _matched(_LOOKBACK_PASSAGES, "load_date"))
def cargo_of_lookback(spark, sf_dir):
    return recent_cargo(
        _events(spark, sf_dir),
        _vessels(spark, sf_dir),
        _cargo(spark, sf_dir),
        "1998-06-30",
        date_col="load_date",
        cargo_tie=("row_id",),
    ).withColumn("date_diff", F.col("date_diff").cast("bigint"))


# ------------------------------------------------------------------- charts

_TABLE = _matched(_PASSAGES, "unload_date")


def _table(spark, sf_dir):
    return _match(_all_passages(spark, sf_dir), _cargo(spark, sf_dir), "unload_date")


@report(
    "cargo_sum_by_region",
    f"""SELECT unload_region, COALESCE(SUM(quantity), 0) AS value
        FROM ({_TABLE}) m WHERE unload_region IS NOT NULL GROUP BY unload_region""",
)
def cargo_sum_by_region(spark, sf_dir):
    return charts.chart_agg(_table(spark, sf_dir), "unload_region", "quantity", "sum")


@report(
    "cargo_mean_by_region",
    f"""SELECT load_region, round(AVG(quantity), 6) AS value
        FROM ({_TABLE}) m WHERE load_region IS NOT NULL GROUP BY load_region""",
)
def cargo_mean_by_region(spark, sf_dir):
    means = charts.chart_agg(_table(spark, sf_dir), "load_region", "quantity", "mean")
    return means.withColumn("value", F.round("value", 6))


@report(
    "cargo_min_by_grade",
    f"""SELECT grade, MIN(quantity) AS value
        FROM ({_TABLE}) m WHERE grade IS NOT NULL GROUP BY grade""",
)
def cargo_min_by_grade(spark, sf_dir):
    return charts.chart_agg(_table(spark, sf_dir), "grade", "quantity", "min")


@report(
    "cargo_max_by_grade",
    f"""SELECT grade, MAX(unload_country) AS value
        FROM ({_TABLE}) m WHERE grade IS NOT NULL GROUP BY grade""",
)
def cargo_max_by_grade(spark, sf_dir):
    return charts.chart_agg(_table(spark, sf_dir), "grade", "unload_country", "max")


@report(
    "cargo_sum_by_region_color",
    f"""SELECT unload_region, exit_direction, COALESCE(SUM(quantity), 0) AS value
        FROM ({_TABLE}) m WHERE unload_region IS NOT NULL AND exit_direction IS NOT NULL
        GROUP BY ALL""",
)
def cargo_sum_by_region_color(spark, sf_dir):
    return charts.chart_agg(
        _table(spark, sf_dir), "unload_region", "quantity", "sum", "exit_direction"
    )


@report(
    "cargo_mean_by_date_color",
    f"""SELECT coalesce(strftime(unload_date, '%Y-%m-%d %H:%M:%S'), 'NaT') AS unload_date,
               vessel_type, round(AVG(date_diff), 6) AS value
        FROM ({_TABLE}) m WHERE vessel_type IS NOT NULL GROUP BY ALL""",
)
def cargo_mean_by_date_color(spark, sf_dir):
    means = charts.chart_data(
        _table(spark, sf_dir), "line", "unload_date", "date_diff", "mean", "vessel_type", null_label="NaT"
    )
    return means.withColumn("value", F.round("value", 6))


@report(
    "cargo_count_by_country_color",
    f"""SELECT unload_country, vessel_class, COUNT(*) AS "count"
        FROM ({_TABLE}) m WHERE unload_country IS NOT NULL AND vessel_class IS NOT NULL
        GROUP BY ALL""",
)
def cargo_count_by_country_color(spark, sf_dir):
    return charts.chart_data(
        _table(spark, sf_dir), "bar", "unload_country", "quantity", "count", "vessel_class"
    )


@report(
    "cargo_value_counts",
    f"""SELECT category, COUNT(*) AS "count"
        FROM ({_TABLE}) m WHERE category IS NOT NULL GROUP BY category""",
)
def cargo_value_counts(spark, sf_dir):
    return charts.chart_data(_table(spark, sf_dir), "bar", "category")


@report(
    "cargo_value_counts_with_nulls",
    f"""SELECT coalesce(via_geofence, 'None') AS via_geofence, COUNT(*) AS "count"
        FROM ({_TABLE}) m GROUP BY ALL""",
)
def cargo_value_counts_with_nulls(spark, sf_dir):
    return charts.value_counts(_table(spark, sf_dir), "via_geofence", null_label="None")


@report(
    "cargo_value_shares",
    f"""SELECT cargo_status, COUNT(*) AS "count",
               round(COUNT(*) / SUM(COUNT(*)) OVER (), 9) AS share
        FROM ({_TABLE}) m WHERE cargo_status IS NOT NULL GROUP BY cargo_status""",
)
def cargo_value_shares(spark, sf_dir):
    shares = charts.chart_data(_table(spark, sf_dir), "pie", "cargo_status")
    return shares.withColumn("share", F.round("share", 9))


def _histogram_check(x: str) -> str:
    return f"""
        WITH v AS (SELECT CAST({x} AS DOUBLE) AS v FROM ({_TABLE}) m WHERE {x} IS NOT NULL),
        span AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v),
        placed AS (SELECT CAST(least(floor((v - lo) * 20 / (hi - lo)) + 1, 20) AS INTEGER) AS bin,
                          COUNT(*) AS n FROM v, span GROUP BY 1),
        bins AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS bin)
        SELECT bin, round(lo + (hi - lo) * (bin - 1) / 20, 9) AS bin_start,
               round(lo + (hi - lo) * bin / 20, 9) AS bin_end, coalesce(n, 0) AS "count"
        FROM bins LEFT JOIN placed USING (bin), span"""


def _rounded_bins(bins: DataFrame) -> DataFrame:
    return bins.withColumns(
        {name: F.round(name, 9) for name in ("bin_start", "bin_end")}
    )


@report("quantity_histogram", _histogram_check("quantity"))
def quantity_histogram(spark, sf_dir):
    return _rounded_bins(charts.chart_data(_table(spark, sf_dir), "histogram", "quantity"))


@report("heading_histogram", _histogram_check("exit_heading"))
def heading_histogram(spark, sf_dir):
    return _rounded_bins(charts.histogram(_table(spark, sf_dir), "exit_heading"))


def _box_check(keys: str, y: str) -> str:
    using = f"USING ({keys})"
    nonnull = " AND ".join(f"{key.strip()} IS NOT NULL" for key in keys.split(","))
    return f"""
        WITH m AS (SELECT {keys}, CAST({y} AS DOUBLE) AS y FROM ({_TABLE}) t
                   WHERE {nonnull} AND {y} IS NOT NULL),
        q AS (SELECT {keys}, COUNT(*) AS n, MIN(y) AS lo, MAX(y) AS hi,
                     quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS q2,
                     quantile_cont(y, 0.75) AS q3 FROM m GROUP BY {keys})
        SELECT {keys}, n, lo AS "min", round(q1, 6) AS q1, round(q2, 6) AS median,
               round(q3, 6) AS q3, hi AS "max",
               MIN(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END) AS lower_whisker,
               MAX(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END) AS upper_whisker
        FROM m JOIN q {using} GROUP BY {keys}, n, lo, hi, q1, q2, q3"""


def _rounded_box(box: DataFrame) -> DataFrame:
    return box.withColumns({name: F.round(name, 6) for name in ("q1", "median", "q3")})


@report("quantity_box", _box_check("unload_region", "quantity"))
def quantity_box(spark, sf_dir):
    return _rounded_box(
        charts.chart_data(_table(spark, sf_dir), "box", "unload_region", "quantity")
    )


@report("quantity_box_color", _box_check("unload_region, vessel_type", "quantity"))
def quantity_box_color(spark, sf_dir):
    return _rounded_box(
        charts.chart_data(
            _table(spark, sf_dir), "box", "unload_region", "quantity", color="vessel_type"
        )
    )


@report("heading_box", _box_check("load_country", "exit_heading"))
def heading_box(spark, sf_dir):
    return _rounded_box(charts.box_summary(_table(spark, sf_dir), "load_country", "exit_heading"))


@report(
    "scatter_points",
    f"SELECT date_diff, quantity, exit_direction FROM ({_TABLE}) m",
)
def scatter_points(spark, sf_dir):
    return charts.chart_data(
        _table(spark, sf_dir), "scatter", "date_diff", "quantity", color="exit_direction"
    )


@report(
    "cargo_series_values",
    f"SELECT DISTINCT vessel_type FROM ({_TABLE}) m WHERE vessel_type IS NOT NULL",
)
def cargo_series_values(spark, sf_dir):
    return charts.series_values(_table(spark, sf_dir), "vessel_type")


@report(
    "cargo_page",
    f"""SELECT vessel_key, passage_time, quantity, grade FROM ({_TABLE}) m
        WHERE quantity >= 10
        ORDER BY quantity DESC NULLS LAST, vessel_key ASC NULLS LAST, passage_time ASC NULLS LAST
        LIMIT 10 OFFSET 20""",
)
def cargo_page(spark, sf_dir):
    return charts.table_page(
        _table(spark, sf_dir),
        filter="quantity >= 10",
        sort=[("quantity", "desc"), ("vessel_key", "asc"), ("passage_time", "asc")],
        page=2,
    ).select("vessel_key", "passage_time", "quantity", "grade")


@report(
    "cargo_page_after",
    f"""SELECT vessel_key, passage_time, quantity, grade FROM ({_TABLE}) m
        WHERE quantity >= 10
        ORDER BY quantity DESC NULLS LAST, vessel_key ASC NULLS LAST, passage_time ASC NULLS LAST
        LIMIT 10 OFFSET 20""",
)
def cargo_page_after(spark, sf_dir):
    """The page of ``cargo_page``, found from the last row of the page before."""
    # A vessel has one row a moment, so these columns order the whole table. Both pages read it, and it is matched once.
    table = saved(_table(spark, sf_dir).select("vessel_key", "passage_time", "quantity", "grade"))
    order = {"filter": "quantity >= 10", "sort": [("quantity", "desc"), ("vessel_key", "asc"), ("passage_time", "asc")]}
    before = charts.table_page(table, page=1, **order).collect()
    return charts.page_after(table, before[-1] if before else None, **order)


@report(
    "cargo_export",
    f"""SELECT concat_ws(',', CAST(vessel_key AS VARCHAR), geofence, CAST(passage_time AS VARCHAR),
                         coalesce(CAST(load_date AS VARCHAR), 'NaT'), coalesce(CAST(unload_date AS VARCHAR), 'NaT'),
                         coalesce(CAST(quantity AS VARCHAR), ''), coalesce(grade, '')) AS line
        FROM ({_TABLE}) m""",
)
def cargo_export(spark, sf_dir):
    columns = ("vessel_key", "geofence", "passage_time", "load_date", "unload_date", "quantity", "grade")
    return csv_lines(_table(spark, sf_dir).select(*columns), null_time_label="NaT")


# ---------------------------------------------------------------- geofences


@report(
    "geofence_wkt_compact",
    """SELECT geofence_name, replace(replace(replace(replace(
              wkt_coordinates, ' (', '('), ') ', ')'), ' ,', ','), ', ', ',') AS wkt
       FROM {geofences} g""",
)
def geofence_wkt_compact(spark, sf_dir):
    return _geofences(spark, sf_dir).select(
        "geofence_name", geofences.compact_wkt(F.col("wkt_coordinates")).alias("wkt")
    )


_RING_POINTS = """
    SELECT c_custkey AS k, 0 AS ring, i AS pos,
           (c_custkey % 340 - 170) + [0, 6, 6, 0, 0][i + 1] AS x,
           (c_custkey % 160 - 80) + [0, 0, 6, 6, 0][i + 1] AS y
    FROM customer, range(5) AS corners(i)
    UNION ALL
    SELECT c_custkey, 1, i, (c_custkey % 340 - 170) + [2, 4, 4, 2, 2][i + 1],
           (c_custkey % 160 - 80) + [2, 2, 4, 4, 2][i + 1]
    FROM customer, range(5) AS corners(i) WHERE c_mktsegment = 'BUILDING'"""


def _ring_points_check(where: str = "") -> str:
    return f"""
        SELECT 'GF_' || CAST(k AS VARCHAR) AS geofence_name, CAST(ring AS INTEGER) AS ring,
               CAST(pos AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y
        FROM ({_RING_POINTS}) points {where}"""


def _ring_points(converted: DataFrame) -> DataFrame:
    return (
        converted.select(
            "geofence_name", F.posexplode("geometry.coordinates").alias("ring", "points")
        )
        .select("geofence_name", "ring", F.posexplode("points").alias("pos", "point"))
        .select("geofence_name", "ring", "pos", F.get("point", F.lit(0)).alias("x"),
                F.get("point", F.lit(1)).alias("y"))
    )


@report("geofence_rings", _ring_points_check())
def geofence_rings(spark, sf_dir):
    return _ring_points(geofences.wkt_to_geojson(_geofences(spark, sf_dir)))


@report("geofence_outer_rings", _ring_points_check("WHERE ring = 0"))
def geofence_outer_rings(spark, sf_dir):
    return _ring_points(geofences.wkt_to_geojson(_geofences(spark, sf_dir), exterior_only=True))


@report(
    "geofence_wkt_roundtrip",
    """SELECT geofence_name, replace(replace(wkt_coordinates, ' (', '('), ', ', ',') AS wkt_coordinates
       FROM {geofences} g""",
)
def geofence_wkt_roundtrip(spark, sf_dir):
    converted = geofences.wkt_to_geojson(_geofences(spark, sf_dir))
    return geofences.geojson_to_wkt(converted, "geometry.coordinates").select(
        "geofence_name", "wkt_coordinates"
    )


_FEATURES_SQL = f"""
    SELECT g.geofence_name, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":['
           || rings || ']}},"properties":{{"name":"' || port_name || '","tooltip":"' || port_name
           || '","geofence_name":"' || g.geofence_name || '"}}}}' AS feature
    FROM {{geofences}} g JOIN (
        SELECT k, string_agg(ring_text, ',' ORDER BY ring) AS rings FROM (
            SELECT k, ring, '[' || string_agg('[' || CAST(CAST(x AS DOUBLE) AS VARCHAR) || ','
                   || CAST(CAST(y AS DOUBLE) AS VARCHAR) || ']', ',' ORDER BY pos) || ']' AS ring_text
            FROM ({_RING_POINTS}) points GROUP BY k, ring) texts GROUP BY k) r ON r.k = g.row_id
    """


@report("geofence_features", _FEATURES_SQL)
def geofence_features(spark, sf_dir):
    return geofences.geofence_features(_geofences(spark, sf_dir)).select("geofence_name", "feature")


def _collections_check(max_bytes: int) -> str:
    """Features in the order of their digests; a part holds those that begin within its bytes."""
    return f"""
        WITH placed AS (
            SELECT feature, md5(feature) AS digest, SUM(strlen(feature)) OVER whole AS total,
                   SUM(strlen(feature)) OVER so_far - strlen(feature) AS begins
            FROM ({_FEATURES_SQL}) f
            WINDOW whole AS (), so_far AS (ORDER BY md5(feature), geofence_name ROWS UNBOUNDED PRECEDING))
        SELECT CAST(begins // {max_bytes} AS BIGINT) AS part, CAST((MIN(total) - 1) // {max_bytes} + 1 AS BIGINT) AS parts,
               COUNT(*) AS n_features,
               md5('{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY digest) || ']}}') AS document_md5
        FROM placed GROUP BY begins // {max_bytes}"""


def _register_collections() -> None:
    for name, max_bytes in (
        ("geofence_feature_collections", geofences.COLLECTION_BYTES),
        ("geofence_small_collections", 20_000),
    ):

        @report(name, _collections_check(max_bytes))
        def collections(spark, sf_dir, max_bytes=max_bytes):
            features = geofences.geofence_features(_geofences(spark, sf_dir))
            return geofences.feature_collections(features, max_bytes=max_bytes).select(
                "part",
                "parts",
                F.col("n_features").cast("bigint").alias("n_features"),
                F.md5("collection").alias("document_md5"),
            )


_register_collections()


_TRIMMED = """
    SELECT trim(geofence_name) AS geofence_name, trim(port_name) AS port_name,
           trim(wkt_coordinates) AS wkt_coordinates FROM {geofence_uploads} u"""


@report(
    "geofence_validation",
    f"""SELECT geofence_name, port_name, wkt_coordinates,
               CASE WHEN missing <> '' THEN 'Missing required fields: ' || missing END AS reason
        FROM (SELECT *, concat_ws(', ',
                 CASE WHEN coalesce(geofence_name, '') = '' THEN 'geofence_name' END,
                 CASE WHEN coalesce(port_name, '') = '' THEN 'port_name' END,
                 CASE WHEN coalesce(wkt_coordinates, '') = '' THEN 'wkt_coordinates' END) AS missing
              FROM ({_TRIMMED}) t) x""",
)
def geofence_validation(spark, sf_dir):
    return geofences.checked_geofences(fixtures.fixture(spark, sf_dir, "geofence_uploads"))


@report(
    "geofence_upload_counts",
    f"""SELECT count(*) FILTER (valid) AS accepted, count(*) FILTER (NOT valid) AS rejected
        FROM (SELECT coalesce(geofence_name, '') <> '' AND coalesce(port_name, '') <> ''
                     AND coalesce(wkt_coordinates, '') <> '' AS valid
              FROM ({_TRIMMED}) t) x""",
)
def geofence_upload_counts(spark, sf_dir):
    checked = geofences.checked_geofences(fixtures.fixture(spark, sf_dir, "geofence_uploads"))
    return checked.agg(*geofences.acceptance_counts())


_ACCEPTED = f"""
    SELECT * FROM ({_TRIMMED}) t
    WHERE geofence_name <> '' AND port_name <> '' AND wkt_coordinates <> ''"""


def _accepted(spark, sf_dir):
    return geofences.validate_geofences(fixtures.fixture(spark, sf_dir, "geofence_uploads"))[0]


def _register_appends() -> None:
    for name, srid in (("geofence_after_append", 4326), ("idle_geofence_rows", geofences.IDLE_SRID)):
        check = f"""
            SELECT geofence_name, port_name, wkt_coordinates, srid FROM {{geofences}} g
            UNION ALL
            SELECT geofence_name, port_name, wkt_coordinates, {srid} AS srid FROM ({_ACCEPTED}) a"""

        @report(name, check)
        def appended(spark, sf_dir, srid=srid):
            new = geofences.registry_rows(_accepted(spark, sf_dir), srid)
            return _geofences(spark, sf_dir).select(*new.columns).unionByName(new)


_register_appends()


@report(
    "geofence_after_delete",
    """SELECT geofence_name, port_name, wkt_coordinates, srid FROM {geofences} g
       WHERE segment <> 'BUILDING'""",
)
def geofence_after_delete(spark, sf_dir):
    current = _geofences(spark, sf_dir)
    doomed = current.where("segment = 'BUILDING'").select("geofence_name")
    return geofences.without_geofences(current, doomed).select(
        "geofence_name", "port_name", "wkt_coordinates", "srid"
    )


@report(
    "geofence_lake_schema",
    f"""SELECT geofence_name AS external_id, port_name, wkt_coordinates AS wkt,
               CAST(12 AS BIGINT) AS reentry_forbidden_hours FROM ({_ACCEPTED}) a""",
)
def geofence_lake_schema(spark, sf_dir):
    lake = to_lake_schema(_accepted(spark, sf_dir), 12)
    return lake.select(
        "external_id", "port_name", F.col("location")["wkt"].alias("wkt"), "reentry_forbidden_hours"
    )


@report(
    "geofence_from_lake",
    "SELECT geofence_name, port_name, wkt_coordinates, 4326 AS srid FROM {geofences} g",
)
def geofence_from_lake(spark, sf_dir):
    return from_lake_schema(to_lake_schema(_geofences(spark, sf_dir)))


@report(
    "geofence_map_latest",
    """SELECT port_name, arg_max(wkt_coordinates, row_id) AS wkt FROM {geofences} g
       GROUP BY port_name""",
)
def geofence_map_latest(spark, sf_dir):
    registry = _geofences(spark, sf_dir)
    lake = registry.select(
        "port_name", "row_id", F.create_map(F.lit("wkt"), "wkt_coordinates").alias("location")
    )
    return geofence_map(lake, order_by=("row_id",))


# ------------------------------------------------------------------ geojson


def _features(spark, sf_dir, first_only=False):
    documents = geojson.parse_collections(fixtures.fixture(spark, sf_dir, "geojson_documents"))
    return geojson.explode_features(documents, first_only)


_KINDS = """
    SELECT c_custkey AS doc_id, kind.no AS feature_no, kind.geometry_type, kind.handling
    FROM customer,
         (VALUES (0, 'LineString', 'line'), (1, 'Polygon', 'polygon'), (2, 'Point', 'unsupported'))
         AS kind(no, geometry_type, handling)
    WHERE c_acctbal >= 0"""


@report("geometry_classes", _KINDS)
def geometry_classes(spark, sf_dir):
    return geojson.classify_geometry(_features(spark, sf_dir)).select(
        "doc_id", "feature_no", "geometry_type", "handling"
    )


@report("geojson_first_features", f"SELECT * FROM ({_KINDS}) k WHERE feature_no = 0")
def geojson_first_features(spark, sf_dir):
    return geojson.classify_geometry(_features(spark, sf_dir, first_only=True)).select(
        "doc_id", "feature_no", "geometry_type", "handling"
    )


@report(
    "geojson_features",
    """SELECT doc_id, 1 AS feature_no, c_name AS name,
              json_extract(text, '$.features[1].geometry.coordinates')::VARCHAR AS coordinates
       FROM {geojson_documents} d JOIN customer ON c_custkey = doc_id WHERE c_acctbal >= 0""",
)
def geojson_polygon_features(spark, sf_dir):
    return _features(spark, sf_dir).where("geometry_type = 'Polygon'").select(
        "doc_id", "feature_no", F.col("properties")["name"].alias("name"), "coordinates"
    )


@report(
    "geojson_to_wkt",
    f"""SELECT k AS doc_id, 'POLYGON((' || string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR),
                                                      ',' ORDER BY pos) || '))' AS wkt_coordinates
        FROM ({_RING_POINTS}) points JOIN customer ON c_custkey = k
        WHERE ring = 0 AND c_acctbal >= 0 GROUP BY k""",
)
def geojson_polygons_to_wkt(spark, sf_dir):
    polygons = geojson.polygon_coordinates(_features(spark, sf_dir))
    return geofences.geojson_to_wkt(polygons).select("doc_id", "wkt_coordinates")


@report(
    "payload_fields",
    """SELECT row_id, geofence_name, port_name, wkt_coordinates FROM {geofences} g""",
)
def payload_fields(spark, sf_dir):
    drawn = geofences.with_payload(_geofences(spark, sf_dir)).select("row_id", "payload")
    return geojson.parse_geofence_payload(drawn, "payload", missing="").drop("payload")


@report(
    "payload_missing_fields",
    """SELECT coalesce(geofence_name, '') AS geofence_name, coalesce(port_name, '') AS port_name,
              coalesce(wkt_coordinates, '') AS wkt_coordinates FROM {geofence_uploads} u""",
)
def payload_missing_fields(spark, sf_dir):
    uploads = fixtures.fixture(spark, sf_dir, "geofence_uploads")
    # Null fields are absent from this text.
    sent = uploads.select(F.to_json(F.struct(*uploads.columns)).alias("payload"))
    return geojson.parse_geofence_payload(sent, "payload", missing="").drop("payload")


@report(
    "geojson_roots",
    """SELECT geofence_name, root, CAST(0 AS INTEGER) AS feature_no, 'Polygon' AS geometry_type,
              CASE root WHEN 'Feature' THEN port_name END AS name
       FROM {geofences} g, (VALUES ('Feature'), ('Polygon')) AS roots(root)""",
)
def geojson_roots(spark, sf_dir):
    drawn = geofences.geofence_features(_geofences(spark, sf_dir))
    texts = F.array(F.col("feature"), F.get_json_object("feature", "$.geometry"))
    documents = drawn.select("geofence_name", F.explode(texts).alias("text"))
    documents = documents.withColumn("root", F.get_json_object("text", "$.type"))
    return geojson.explode_features(geojson.parse_collections(documents)).select(
        "geofence_name", "root", "feature_no", "geometry_type", F.col("properties")["name"].alias("name")
    )


@report(
    "uploads_by_ending",
    """SELECT doc_id, 'area-' || CAST(doc_id AS VARCHAR) || ['.GeoJSON', '.json'][CAST(doc_id % 3 AS INTEGER) + 1] AS file_name
       FROM {geojson_documents} d WHERE doc_id % 3 < 2""",
)
def uploads_by_ending(spark, sf_dir):
    names = fixtures.fixture(spark, sf_dir, "geojson_documents").select(
        "doc_id",
        F.concat(
            F.lit("area-"),
            F.col("doc_id").cast("string"),
            F.get(F.array(F.lit(".GeoJSON"), F.lit(".json"), F.lit(".json.bak")), (F.col("doc_id") % 3).cast("int")),
        ).alias("file_name"),
    )
    return names.where(geojson.is_upload(F.col("file_name")))


# Polygons as they should not be: in several parts, open, of another kind, with a word for a number.
_SPOILT = """CASE row_id % 5
    WHEN 0 THEN 'MULTIPOLYGON (' || substring(wkt_coordinates, 9) || ')'
    WHEN 1 THEN replace(wkt_coordinates, '))', ', 0.5 0.5))')
    WHEN 2 THEN replace(wkt_coordinates, 'POLYGON', 'POINT')
    WHEN 3 THEN replace(wkt_coordinates, ', ', ', x ')
    ELSE wkt_coordinates END"""


@report(
    "geofence_faults",
    """SELECT geofence_name,
              CASE row_id % 5 WHEN 0 THEN 'MultiPolygon' WHEN 4 THEN 'Polygon' END AS drawn_as,
              CASE row_id % 5 WHEN 1 THEN 'a ring is not closed'
                   WHEN 2 THEN 'it is neither POLYGON nor MULTIPOLYGON'
                   WHEN 3 THEN 'a point does not have two or three numbers' END AS feature_fault,
              CASE WHEN row_id % 5 IN (0, 4) THEN 'accepted' ELSE 'rejected' END AS verdict
       FROM {geofences} g""",
)
def geofence_faults(spark, sf_dir):
    spoilt = _geofences(spark, sf_dir).withColumn("wkt_coordinates", F.expr(_SPOILT))
    drawn = geofences.geofence_features(geofences.checked_geofences(spoilt))
    return drawn.select(
        "geofence_name",
        F.get_json_object("feature", "$.geometry.type").alias("drawn_as"),
        "feature_fault",
        F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("verdict"),
    )


# ------------------------------------------------- table reads and selections


@report(
    "suppliers_conformed",
    """SELECT CAST(s_suppkey AS BIGINT) AS "IMO_KEY", CAST(s_nationkey AS VARCHAR) AS nation
       FROM supplier""",
)
def suppliers_conformed(spark, sf_dir):
    wanted = StructType([StructField("S_SUPPKEY", LongType()), StructField("s_nationkey", StringType())])
    read = read_table(spark, f"{sf_dir}/supplier.parquet", schema=wanted)
    return read.withColumnsRenamed({"S_SUPPKEY": "IMO_KEY", "s_nationkey": "nation"})


@report(
    "empty_selections",
    f"""SELECT 'everything' AS selection, COUNT(*) AS passages FROM ({_PASSAGES}) p
        UNION ALL SELECT selection, 0 FROM (VALUES ('no vessel type'), ('no geofence')) AS s(selection)""",
)
def empty_selections(spark, sf_dir):
    def counted(selection: str, **chosen) -> DataFrame:
        found = passages(_events(spark, sf_dir), _vessels(spark, sf_dir), **chosen)
        return found.agg(F.count(F.lit(1)).alias("passages")).select(F.lit(selection).alias("selection"), "passages")

    return (
        counted("everything")
        .union(counted("no vessel type", vessel_types=[]))
        .union(counted("no geofence", geofences=None))
    )


# ------------------------------------------------------------ lines in parts

_SMALL_PART = 50
_NUMBERED = f"""
    SELECT *, row_number() OVER (PARTITION BY vessel_key ORDER BY dt_pos_utc, longitude, latitude) - 1 AS r
    FROM ({_near(_PASSAGES)}) near_passages"""


def _short_lines(spark, sf_dir):
    counted = _counted(spark, sf_dir, ("vessel_key",))
    return trajectory_lines(counted, max_points=_SMALL_PART, copies="copies")


@report(
    "trajectory_lines_in_short_parts",
    f"""WITH numbered AS ({_NUMBERED}),
        placed AS (SELECT *, r // {_SMALL_PART - 1} AS part FROM numbered
                   UNION ALL
                   SELECT *, r // {_SMALL_PART - 1} - 1 FROM numbered WHERE r > 0 AND r % {_SMALL_PART - 1} = 0)
        SELECT vessel_key, CAST(part AS BIGINT) AS part, COUNT(*) AS n_points,
               string_agg({_POINT_TEXT}, ',' ORDER BY r) AS path,
               string_agg(strftime(dt_pos_utc, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY r) AS dates
        FROM placed GROUP BY vessel_key, part HAVING part = 0 OR COUNT(*) > 1""",
)
def lines_in_short_parts(spark, sf_dir):
    return _lines_as_text(_short_lines(spark, sf_dir), "vessel_key")


@report(
    "trajectory_headings",
    f"""WITH ends AS (
            SELECT vessel_key, COUNT(*) AS total_points,
                   arg_min([longitude, latitude], r) AS a, arg_max([longitude, latitude], r) AS b
            FROM ({_NUMBERED}) numbered GROUP BY vessel_key HAVING COUNT(*) > 1),
        angles AS (
            SELECT *, degrees(atan2(sin(radians(b[1] - a[1])) * cos(radians(b[2])),
                       cos(radians(a[2])) * sin(radians(b[2]))
                       - sin(radians(a[2])) * cos(radians(b[2])) * cos(radians(b[1] - a[1])))) AS angle
            FROM ends)
        SELECT vessel_key, total_points, round(CASE WHEN angle < 0 THEN angle + 360 ELSE angle END, 6) AS heading,
               printf('[%.6f, %.6f]', a[1], a[2]) AS start_text, printf('[%.6f, %.6f]', b[1], b[2]) AS end_text
        FROM angles""",
)
def trajectory_headings(spark, sf_dir):
    ends = line_ends(_short_lines(spark, sf_dir)).where("n_points > 1")
    return line_headings(ends, "ends", "n_points").select(
        "vessel_key",
        F.col("total_points").cast("bigint").alias("total_points"),
        F.round("heading", 6).alias("heading"),
        "start_text",
        "end_text",
    )


# ------------------------------------------- charts with nulls and odd numbers


@report(
    "unload_date_histogram",
    f"""SELECT coalesce(strftime(unload_date, '%Y-%m-%d %H:%M:%S'), 'NaT') AS unload_date, COUNT(*) AS "count"
        FROM ({_TABLE}) m GROUP BY ALL""",
)
def unload_date_histogram(spark, sf_dir):
    return charts.chart_data(_table(spark, sf_dir), "histogram", "unload_date", null_label="NaT")


@report(
    "scatter_points_with_null_label",
    f"""SELECT coalesce(strftime(unload_date, '%Y-%m-%d %H:%M:%S'), 'NaT') AS unload_date, quantity,
               via_geofence FROM ({_TABLE}) m""",
)
def scatter_points_with_null_label(spark, sf_dir):
    return charts.chart_data(
        _table(spark, sf_dir), "scatter", "unload_date", "quantity", color="via_geofence", null_label="NaT"
    )


_SOME_QUANTITIES = "(CASE WHEN via_geofence IS NOT NULL THEN quantity END)"


def _with_nan(spark, sf_dir):
    """The matched table; a quantity that came by no geofence is not a number."""
    quantity = F.when(F.col("via_geofence").isNotNull(), F.col("quantity")).otherwise(F.lit(float("nan")))
    return _table(spark, sf_dir).withColumn("quantity", quantity)


@report("quantity_histogram_with_nan", _histogram_check(_SOME_QUANTITIES))
def quantity_histogram_with_nan(spark, sf_dir):
    return _rounded_bins(charts.histogram(_with_nan(spark, sf_dir), "quantity"))


@report("quantity_box_with_nan", _box_check("unload_region", _SOME_QUANTITIES))
def quantity_box_with_nan(spark, sf_dir):
    return _rounded_box(charts.box_summary(_with_nan(spark, sf_dir), "unload_region", "quantity"))


@report(
    "headings_by_bracket",
    f"""SELECT geofence, round(quantile_cont(exit_heading, 0.25), 6) AS q1,
               round(quantile_cont(exit_heading, 0.5), 6) AS median,
               round(quantile_cont(exit_heading, 0.9), 6) AS q9
        FROM ({_PASSAGES}) p WHERE exit_heading IS NOT NULL GROUP BY geofence""",
)
def headings_by_bracket(spark, sf_dir):
    # Few cells, so that every cut leaves several values.
    found = exact_quantiles(_all_passages(spark, sf_dir), ["geofence"], "exit_heading", (0.25, 0.5, 0.9), cells=3)
    return found.select("geofence", *[F.round(q, 6).alias(name) for q, name in (("q0", "q1"), ("q1", "median"), ("q2", "q9"))])
