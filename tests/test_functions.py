import datetime as dt

import pytest
from pyspark.sql import functions as F

from passagekit.functions.compass import bearing, compass_direction
from passagekit.functions.dates import (
    as_date,
    day_gap,
    lookback_range,
    period_label,
    period_start,
)
from passagekit.functions.geometry import (
    compact_wkt,
    multipolygon_rings,
    number_text,
    polygon_rings,
    rings_to_wkt,
    wkt_fault,
    wkt_shape,
)


def test_octants_at_their_edges(spark):
    expected = [
        (-400.0, "N"), (-1.0, "N"), (0.0, "N"), (22.499999999999996, "N"), (22.5, "NE"),
        (67.49, "NE"), (67.5, "E"), (112.5, "SE"), (157.5, "S"), (202.5, "SW"), (247.5, "W"),
        (292.5, "NW"), (337.49, "NW"), (337.5, "N"), (360.0, "N"), (725.0, "N"), (None, None),
    ]
    df = spark.createDataFrame(expected, "heading double, expected string")
    rows = df.select("*", compass_direction(F.col("heading")).alias("got")).collect()
    assert [(r.heading, r.got) for r in rows] == expected


def test_bearings(spark):
    points = [
        (0.0, 0.0, 0.0, 10.0, 0.0),
        (0.0, 0.0, 10.0, 0.0, 90.0),
        (0.0, 10.0, 0.0, 0.0, 180.0),
        (10.0, 0.0, 0.0, 0.0, 270.0),
        (5.0, 5.0, 5.0, 5.0, 0.0),
    ]
    df = spark.createDataFrame(points, "a double, b double, c double, d double, expected double")
    for row in df.select("*", bearing(*map(F.col, "abcd")).alias("got")).collect():
        assert row.got == pytest.approx(row.expected)


def test_day_gap_counts_midnights(spark):
    row = spark.sql(
        "SELECT timestamp'2024-01-01 23:59:00' a, timestamp'2024-01-02 00:01:00' b,"
        " timestamp_ntz'2024-01-02 23:00:00' c"
    ).select(
        day_gap(F.col("a"), F.col("b")).alias("ab"),
        day_gap(F.col("b"), F.col("a")).alias("ba"),
        day_gap(F.col("b"), F.col("c")).alias("bc"),
    ).first()
    assert tuple(row) == (1, 1, 0)


def test_lookback():
    assert lookback_range("2024-03-01 12:00", 2) == (dt.date(2024, 2, 28), dt.date(2024, 3, 1))
    assert lookback_range(dt.date(2024, 3, 8), 0) == (dt.date(2024, 3, 1), dt.date(2024, 3, 8))
    assert lookback_range(dt.datetime(2024, 3, 8, 5), None)[0] == dt.date(2024, 3, 1)
    assert as_date(dt.datetime(2024, 1, 2, 3)) == dt.date(2024, 1, 2)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_periods(spark, kind):
    df = spark.sql(f"SELECT {kind}'2024-03-03 23:30:00' t")  # a Sunday
    labels = {
        p: df.select(period_label(period_start(F.col("t"), p), p)).first()[0] for p in "DWM"
    }
    assert labels == {"D": "2024-03-03", "W": "2024-02-26/2024-03-03", "M": "2024-03"}
    with pytest.raises(ValueError):
        period_start(F.col("t"), "Q")


def test_compact_wkt(spark):
    texts = [
        ("POLYGON ((-47.47 59.21, -50.99 52.42), (1 2 , 3 4))", "POLYGON((-47.47 59.21,-50.99 52.42),(1 2,3 4))"),
        ("POLYGON  ((1 2))  ", "POLYGON ((1 2)) "),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame(texts, "wkt string, expected string")
    assert [r[0] for r in df.select(compact_wkt(F.col("wkt"))).collect()] == [e for _, e in texts]


def test_polygon_rings(spark):
    hole = [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 0.0]], [[1.0, 1.0], [2.5, 1.0], [2.0, 2.0], [1.0, 1.0]]]
    cases = [
        ("POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2.5 1, 2 2, 1 1))", hole),
        ("polygon((0 0,9 0,9 9,0 0),(1 1,2.5 1,2 2,1 1))", hole),
        ("  POLYGON( (\n0 0 ,\t9 0,9   9,0 0 ) , ( 1 1,2.5 1,2 2,1 1) ) ", hole),
        ("POLYGON Z ((0 0 1, 1e1 -2 3, 1 1 1, 0 0 1))", [[[0.0, 0.0, 1.0], [10.0, -2.0, 3.0], [1.0, 1.0, 1.0], [0.0, 0.0, 1.0]]]),
        ("POLYGON ((0 0, 9 0, 0 0))", None),
        ("POLYGON ((0 0, 9 0, 9 9, 0 1))", None),
        ("POINT (1 2)", None),
        ("POLYGON ((0 0, 1 x))", None),
        ("POLYGON ((0 0, 1))", None),
        ("POLYGON EMPTY", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "wkt string")
    assert [r[0] for r in df.select(polygon_rings(F.col("wkt"))).collect()] == [c[1] for c in cases]


def test_multipolygons_and_faults(spark):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    cases = [
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((0 0,1 0,1 1,0 0)))", [square, square], None),
        ("multipolygon(((0 0,1 0,1 1,0 0),(0 0,1 0,1 1,0 0)))", [square + square], None),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1)))", None, "a ring has fewer than four points"),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0))", None, None),
        ("POLYGON ((1 2))", None, "a ring has fewer than four points"),
        ("POLYGON ((0 0, 1 0, 1 1, 2 2))", None, "a ring is not closed"),
        ("POLYGON ((0 0, 1 x, 1 1, 0 0))", None, "a point does not have two or three numbers"),
        ("LINESTRING (0 0, 1 1)", None, "it is neither POLYGON nor MULTIPOLYGON"),
        (" ", None, "it is empty"),
        (None, None, "it is empty"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "wkt string")
    rows = df.select(multipolygon_rings(F.col("wkt")), wkt_fault(F.col("wkt"))).collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in cases]
    text = F.col("wkt")
    apart = df.select(polygon_rings(text), multipolygon_rings(text), wkt_fault(text)).collect()
    assert [tuple(r) for r in df.select(wkt_shape(text).alias("s")).select("s.*").collect()] == [tuple(r) for r in apart]


def test_long_polygon(spark):
    points = ", ".join(f"{i % 180} {i % 90}.5" for i in range(199_999)) + ", 0 0.5"
    df = spark.createDataFrame([(f"POLYGON (({points}))",)], "wkt string")
    rings = df.select(F.size(F.get(polygon_rings(F.col("wkt")), F.lit(0)))).first()[0]
    assert rings == 200_000


def test_number_text(spark):
    numbers = [
        (10.0, "10"), (-47.47, "-47.47"), (0.0001, "0.0001"), (-0.00025, "-0.00025"),
        (0.0, "0"), (-0.0, "0"), (100.0, "100"), (179.89999999999998, "179.89999999999998"),
        (1e7, "10000000"), (-12345678.9, "-12345678.9"), (123456789012.25, "123456789012.25"),
    ]
    df = spark.createDataFrame([(n,) for n, _ in numbers], "n double")
    assert [r[0] for r in df.select(number_text(F.col("n"))).collect()] == [t for _, t in numbers]


def test_wkt_round_trip_is_stable(spark):
    wkt = "POLYGON((0 0,9.25 0,9 -9,0 0),(1 1,2.5 1,2 2,1 1))"
    df = spark.createDataFrame([(wkt,)], "wkt string")
    again = compact_wkt(rings_to_wkt(polygon_rings(F.col("wkt"))))
    assert df.select(again).first()[0] == wkt
