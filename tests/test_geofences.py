import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from passagekit.operators import geofences
from passagekit.plans.parts import bounded_parts
from passagekit.schemas import (
    CARGO_FLOWS,
    GEOFENCES,
    LAKE_GEOFENCES,
    conform,
    from_lake_schema,
    to_lake_schema,
)
from passagekit.sinks import registry
from passagekit.sinks.exports import csv_lines, export_table, write_csv, write_geojson
from passagekit.sources import geojson
from passagekit.sources.tables import asset_events, geofence_map, read_table

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 0))"
HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
UPLOADS = "geofence_name string, port_name string, wkt_coordinates string"


@pytest.fixture
def uploads(spark):
    rows = [
        (" G1\t", "Port 1\n", SQUARE),
        ("G2", "Port 2", HOLED),
        ("   ", "Port 3", SQUARE),
        ("G4", None, ""),
    ]
    return spark.createDataFrame(rows, UPLOADS)


def test_validation_trims_before_it_checks(uploads):
    accepted, rejected = geofences.validate_geofences(uploads)
    assert [(r.geofence_name, r.port_name) for r in accepted.collect()] == [
        ("G1", "Port 1"),
        ("G2", "Port 2"),
    ]
    assert [r.reason for r in rejected.collect()] == [
        "Missing required fields: geofence_name",
        "Missing required fields: port_name, wkt_coordinates",
    ]


def test_append_deploy_and_delete(spark, uploads, tmp_path):
    table, lake = str(tmp_path / "registry"), str(tmp_path / "lake")
    counts = registry.deploy_geofences(uploads, table, lake, reentry_hours=6)
    assert counts == {"accepted": 2, "rejected": 2}
    stored = read_table(spark, table, schema=GEOFENCES)
    assert sorted((r.geofence_name, r.srid) for r in stored.collect()) == [("G1", 4326), ("G2", 4326)]
    in_lake = read_table(spark, lake, schema=LAKE_GEOFENCES)
    assert sorted((r.external_id, r.location["wkt"], r.reentry_forbidden_hours) for r in in_lake.collect()) == [
        ("G1", SQUARE, 6),
        ("G2", HOLED, 6),
    ]
    registry.append_geofences(uploads.limit(1), table, geofences.IDLE_SRID)
    assert {r.srid for r in read_table(spark, table).collect()} == {4326, 5326}

    keys = spark.createDataFrame([("G1",), ("G1",), ("nobody",), (None,)], "name string")
    smaller = str(tmp_path / "registry_v2")
    assert registry.delete_geofences(spark, table, smaller, keys) == {"n_deleted": 2, "n_kept": 1}
    assert read_table(spark, smaller).first().geofence_name == "G2"
    assert read_table(spark, table).count() == 3
    lake_2 = str(tmp_path / "lake_v2")
    deleted = registry.delete_geofences(spark, lake, lake_2, keys, key="external_id")
    assert deleted == {"n_deleted": 1, "n_kept": 1}
    registry.append_geofences(uploads.limit(1), smaller)
    assert {r.geofence_name for r in read_table(spark, smaller).collect()} == {"G1", "G2"}


def test_registry_and_lake_get_the_same_rows(spark, uploads, tmp_path):
    # Names that differ each time that the input is evaluated.
    changing = uploads.where("port_name <> ''").withColumn("geofence_name", F.expr("uuid()"))
    table, lake = str(tmp_path / "registry"), str(tmp_path / "lake")
    counts = registry.deploy_geofences(changing, table, lake)
    names = {r.geofence_name for r in read_table(spark, table).collect()}
    assert names == {r.external_id for r in read_table(spark, lake).collect()}
    assert len(names) == counts["accepted"] > 0


def test_a_batch_that_is_tried_again_adds_nothing_twice(spark, uploads, tmp_path):
    table, lake = str(tmp_path / "registry"), str(tmp_path / "lake")
    changing = uploads.where("port_name <> ''").withColumn("geofence_name", F.expr("uuid()"))
    first = registry.append_geofences(changing, table, batch="monday")
    # The registry has the batch, the lake has not: as after a failure between the two.
    assert registry.deploy_geofences(changing, table, lake, batch="monday") == first
    assert registry.deploy_geofences(changing, table, lake, batch="monday") == first
    names = sorted(r.geofence_name for r in read_table(spark, table).collect())
    assert names == sorted(r.external_id for r in read_table(spark, lake).collect())
    assert len(names) == first["accepted"]
    registry.deploy_geofences(changing, table, lake, batch="tuesday")
    assert read_table(spark, table).count() == read_table(spark, lake).count() == 2 * first["accepted"]


def test_what_a_failed_append_has_left_is_not_seen(spark, uploads, tmp_path):
    table = str(tmp_path / "registry")
    registry.append_geofences(uploads, table, batch="a")
    broken = uploads.withColumn("port_name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        registry.append_geofences(broken, table, batch="b")
    uploads.write.parquet(f"{table}/batch-c")
    assert read_table(spark, table).count() == 2
    assert registry.append_geofences(uploads, table, batch="b") == {"accepted": 2, "rejected": 2}
    assert read_table(spark, table).count() == 4


def test_a_delete_is_seen_at_once_or_not_at_all(spark, uploads, tmp_path):
    table = str(tmp_path / "registry")
    registry.append_geofences(uploads, table)
    before = read_table(spark, table)
    keys = spark.createDataFrame([("G1",)], "name string")
    failing = keys.withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        registry.delete_geofences(spark, table, None, failing)
    assert read_table(spark, table).count() == 2
    assert registry.delete_geofences(spark, table, None, keys) == {"n_deleted": 1, "n_kept": 1}
    assert [r.geofence_name for r in read_table(spark, table).collect()] == ["G2"]
    # A reader that resolved the old version can finish.
    assert before.count() == 2
    assert registry.delete_geofences(spark, table, None, keys) == {"n_deleted": 0, "n_kept": 1}
    registry.append_geofences(uploads, table)
    assert sorted(r.geofence_name for r in read_table(spark, table).collect()) == ["G1", "G2", "G2"]


def test_a_folder_without_a_manifest_keeps_its_rows(spark, uploads, tmp_path):
    table = str(tmp_path / "plain")
    accepted, _ = geofences.validate_geofences(uploads)
    geofences.registry_rows(accepted).write.parquet(table)
    registry.append_geofences(uploads, table)
    assert read_table(spark, table, schema=GEOFENCES).count() == 4


def test_sinks_use_no_checkpoint():
    import inspect

    assert "checkpoint" not in inspect.getsource(registry) and "tempfile" not in inspect.getsource(registry)


def test_any_root_is_a_collection(spark):
    texts = [
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":"b"}}',
        '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',
        '{"type":"GeometryCollection","geometries":[]}',
        '{"other":1}',
        "[1]",
    ]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = geojson.explode_features(geojson.parse_collections(documents)).orderBy("id").collect()
    assert [(r.id, r.geometry_type, r.coordinates, r.properties) for r in rows] == [
        (0, "Point", "[1,2]", {"a": "b"}),
        (1, "Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]", None),
        (2, "GeometryCollection", None, None),
    ]
    kept = geojson.parse_collections(documents, on_error="keep").where("collection IS NULL")
    assert [r.id for r in kept.collect()] == [4]


def test_rows_with_a_null_key_are_kept(spark):
    rows = spark.createDataFrame([("a",), (None,)], "geofence_name string")
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r[0] for r in geofences.without_geofences(rows, keys).collect()] == [None]


def test_lake_mapping_keeps_nulls(spark):
    rows = spark.createDataFrame([("a", "p", SQUARE, 1), ("b", None, None, 1)], GEOFENCES)
    lake = to_lake_schema(rows)
    assert lake.schema["location"].dataType.simpleString() == "map<string,string>"
    assert [r.location for r in lake.collect()] == [{"wkt": SQUARE}, None]
    back = from_lake_schema(lake, srid=7).collect()
    assert [tuple(r) for r in back] == [("a", "p", SQUARE, 7), ("b", None, None, 7)]


def test_conform(spark):
    df = spark.createDataFrame([("x", 7, "5")], "GEOFENCE_NAME string, Port_Name int, srid string")
    with pytest.raises(ValueError, match="wkt_coordinates"):
        conform(df, GEOFENCES)
    fitted = conform(df.withColumn("WKT_coordinates", F.lit(SQUARE)), GEOFENCES)
    assert tuple(fitted.first()) == ("x", "7", SQUARE, 5)
    assert fitted.schema.fieldNames() == GEOFENCES.fieldNames()
    ntz = spark.sql("SELECT " + ", ".join(
        f"timestamp_ntz'2024-01-01' AS {f.name}" if f.dataType.typeName() == "timestamp"
        else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in CARGO_FLOWS.fields
    ))
    assert conform(ntz, CARGO_FLOWS).schema["load_date"].dataType.typeName() == "timestamp_ntz"


def test_features(spark):
    rows = spark.createDataFrame([("a", 'P "x"', HOLED, 1), ("b", None, SQUARE, 1), ("c", "p", "LINE", 1)], GEOFENCES)
    texts = [r.feature for r in geofences.geofence_features(rows).collect()]
    assert json.loads(texts[0]) == {
        "type": "Feature",
        "geometry": {
            "type": "Polygon",
            "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]],
        },
        "properties": {"name": 'P "x"', "tooltip": 'P "x"', "geofence_name": "a"},
    }
    assert json.loads(texts[1])["properties"] == {"name": None, "tooltip": None, "geofence_name": "b"}
    assert texts[2] is None
    several = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((0 0, 4 0, 4 4, 0 0)))"
    rows = spark.createDataFrame([("m", "p", several, 1), ("o", "p", "POLYGON ((0 0, 4 0, 4 4))", 1)], GEOFENCES)
    multi, broken = geofences.geofence_features(rows).collect()
    square = [[[0, 0], [4, 0], [4, 4], [0, 0]]]
    assert json.loads(multi.feature)["geometry"] == {"type": "MultiPolygon", "coordinates": [square, square]}
    assert multi.feature_fault is None and multi.geometry is None
    assert (broken.feature, broken.feature_fault) == (None, "a ring has fewer than four points")
    checked = geofences.checked_geofences(rows).orderBy("geofence_name").collect()
    assert [r.reason for r in checked] == [None, "Unreadable polygon: a ring has fewer than four points"]
    rows = spark.createDataFrame([("a", 'P "x"', HOLED, 1)], GEOFENCES)
    outer = geofences.wkt_to_geojson(rows.limit(1), exterior_only=True).first().geometry
    assert outer.coordinates == [[[0, 0], [4, 0], [4, 4], [0, 0]]]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_collections_are_bounded_and_complete(spark, size):
    names = [f"g{i % 13}" for i in range(40)] + ["hot"] * 45
    rows = spark.createDataFrame([(n, n, SQUARE, 1) for n in names], GEOFENCES)
    packed = geofences.feature_collections(geofences.geofence_features(rows), size).collect()
    documents = [json.loads(r.collection) for r in packed]
    assert all(d["type"] == "FeatureCollection" for d in documents)
    assert [len(d["features"]) for d in documents] == [r.n_features for r in packed]
    assert max(r.n_features for r in packed) <= size and len(packed) == -(-len(names) // size)
    found = [f["properties"]["geofence_name"] for d in documents for f in d["features"]]
    assert sorted(found) == sorted(names)


@pytest.mark.parametrize("limit", [1, 30, 100, 10_000])
def test_collections_end_with_the_feature_that_fills_them(spark, limit):
    features = ["a" * 10, "b" * 25, "c" * 250, "é" * 9] + ["same text"] * 40
    df = spark.createDataFrame([(f,) for f in features] + [(None,)], "feature string")
    packed = geofences.feature_collections(df, max_bytes=limit).orderBy("part").collect()
    wanted, begins = {}, 0
    for text in sorted(features, key=lambda f: (hashlib.md5(f.encode()).hexdigest(), f)):
        wanted.setdefault(begins // limit, []).append(text)
        begins += len(text.encode())
    frame = '{"type":"FeatureCollection","features":[%s]}'
    assert [(r.part, r.n_features, r.collection) for r in packed] == [
        (part, len(texts), frame % ",".join(texts)) for part, texts in wanted.items()
    ]
    assert {r.parts for r in packed} == {(begins - 1) // limit + 1}
    assert geofences.feature_collections(df.limit(0)).collect() == []


def test_bounded_parts_number_rows_in_order(spark):
    values = [i * 37 % 101 for i in range(300)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    parts = bounded_parts(df, ["k"], ["v"], F.floor(F.col("v") / 10), 40).collect()
    ordered = []
    for row in sorted(parts, key=lambda r: (r.part, r.v)):
        ordered += [(row.part, row.v)] * row.copies
    assert ordered == [(i // 40, v) for i, v in enumerate(sorted(values))]


def _collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def _feature(kind, coordinates, **properties):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


@pytest.fixture
def folder(tmp_path):
    line, polygon = [[0, 0], [0, 5.5]], [[[0, 0], [4, 0], [4, 4.25], [0, 0]]]
    (tmp_path / "a.geojson").write_text(
        _collection(_feature("LineString", line), _feature("Polygon", polygon, name="p", n=3))
    )
    (tmp_path / "b.JSON").write_text(
        _collection(_feature("LineString", [[1, 1]]), {"type": "Feature", "geometry": None, "properties": {}})
    )
    (tmp_path / "c.GeoJson").write_text('{"type": "FeatureCollection", "features": [')
    (tmp_path / "d.json").write_text(_collection())
    (tmp_path / "e.txt").write_text(_collection(_feature("Point", [1, 1])))
    return str(tmp_path)


def test_read_geojson(spark, folder):
    assert sorted(r.file_name for r in geojson.read_geojson(spark, folder).collect()) == [
        "a.geojson", "b.JSON", "d.json",
    ]
    kept = geojson.read_geojson(spark, folder, on_error="keep").collect()
    assert {r.file_name for r in kept if r.collection is None} == {"c.GeoJson"}
    with pytest.raises(ValueError):
        geojson.read_geojson(spark, folder, on_error="ignore")
    names = spark.createDataFrame([("x.JSON",), ("x.geojson",), ("json",), ("x.json.gz",)], "n string")
    assert [r[0] for r in names.select(geojson.is_upload(F.col("n"))).collect()] == [True, True, False, False]


def test_written_lines_are_read_back_by_several_tasks(spark, tmp_path):
    features = spark.range(3000).selectExpr(
        "CONCAT('G', id % 2) AS geofence",
        """to_json(named_struct('type', 'Feature',
           'geometry', named_struct('type', 'LineString', 'coordinates', array(array(double(id), 1.5D), array(2D, 3D))),
           'properties', named_struct('name', CONCAT('v"', id)))) AS feature""",
    )
    write_geojson(features.coalesce(1), str(tmp_path / "lines"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        read = geojson.read_feature_lines(spark, str(tmp_path / "lines"))
        tasks = read.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 4
    rows = geojson.line_coordinates(read).collect()
    assert sorted((r.geofence, r.coordinates[0][0], r.properties["name"]) for r in rows) == sorted(
        (f"G{i % 2}", float(i), f'v"{i}') for i in range(3000)
    )
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.txt").write_text('{"type":"Point","coordinates":[1,2]}\n\n{"type":"Fea\n{"other":1}\n')
    odd = geojson.read_feature_lines(spark, str(tmp_path / "odd"))
    assert [(r.geometry_type, r.coordinates) for r in odd.collect()] == [("Point", "[1,2]")]


def test_a_large_collection_is_read_feature_by_feature(spark, tmp_path):
    texts = [
        json.dumps(_feature("Point", [i, 2.5], name=f'{{"type":"Feature",{i}', nested={"a": [1]}), separators=(",", ":"))
        for i in range(2000)
    ]
    frame = '{"type":"FeatureCollection","name":"x","features":[%s],"after":{"type":"Feature"}}'
    (tmp_path / "big.geojson").write_text(frame % ",\n".join(texts))
    (tmp_path / "none.json").write_text(frame % "")
    (tmp_path / "skipped.txt").write_text(frame % texts[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        read = geojson.read_collection_features(spark, str(tmp_path))
        tasks = read.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 4
    rows = read.collect()
    assert sorted((r.coordinates, r.properties["name"]) for r in rows) == sorted(
        (f"[{i},2.5]", f'{{"type":"Feature",{i}') for i in range(2000)
    )
    assert {(r.file_name, r.geometry_type) for r in rows} == {("big.geojson", "Point")}


def test_features_of_files(spark, folder):
    features = geojson.explode_features(geojson.read_geojson(spark, folder))
    classes = geojson.classify_geometry(features).orderBy("file_name", "feature_no")
    assert [(r.file_name, r.feature_no, r.geometry_type, r.handling) for r in classes.collect()] == [
        ("a.geojson", 0, "LineString", "line"),
        ("a.geojson", 1, "Polygon", "polygon"),
        ("b.JSON", 0, "LineString", "short line"),
        ("b.JSON", 1, "", "unsupported"),
    ]
    first = geojson.explode_features(geojson.read_geojson(spark, folder), first_only=True)
    assert sorted(r.file_name for r in first.collect()) == ["a.geojson", "b.JSON"]
    polygons = geofences.geojson_to_wkt(geojson.polygon_coordinates(features))
    assert polygons.first().wkt_coordinates == "POLYGON((0 0,4 0,4 4.25,0 0))"
    assert polygons.first().properties == {"name": "p", "n": "3"}
    lines = geojson.line_coordinates(features).orderBy("file_name").collect()
    assert lines[0].coordinates == [[0.0, 0.0], [0.0, 5.5]]


def test_payloads(spark):
    df = spark.createDataFrame(
        [('{"geofence_name":"a","port_name":"p","wkt_coordinates":"w"}',), ('{"port_name":null}',), ("{",), (None,)],
        "payload string",
    )
    parsed = geojson.parse_geofence_payload(df, "payload").drop("payload").collect()
    assert [tuple(r) for r in parsed] == [("a", "p", "w")] + [(None,) * 3] * 3
    filled = geojson.parse_geofence_payload(df, "payload", missing="").drop("payload").collect()
    assert tuple(filled[1]) == ("", "", "")
    drawn = spark.createDataFrame([(None, "p", None)], UPLOADS)
    text = geofences.with_payload(drawn).first().payload
    assert json.loads(text) == {"geofence_name": "", "port_name": "p", "wkt_coordinates": None}


def test_event_store_reads(spark):
    events = spark.createDataFrame(
        [("geofence_arrival", "A"), ("geofence_arrival", "B"), ("other", "A")], "type string, subtype string"
    )
    assert asset_events(events).count() == 2
    assert asset_events(events, subtype="A").count() == 1
    lake = spark.createDataFrame(
        [("p", {"wkt": "old"}, 1), ("p", {"wkt": "new"}, 2), ("q", {"wkt": "only"}, 1)],
        "port_name string, location map<string,string>, version int",
    )
    assert dict(map(tuple, geofence_map(lake, ["version"]).collect())) == {"p": "new", "q": "only"}


def test_exports(spark, tmp_path):
    df = spark.sql("SELECT 'A' geofence, timestamp'2024-01-01 02:03:04' t, 1.5 q UNION ALL SELECT 'B', NULL, NULL")
    write_csv(df, str(tmp_path / "csv"), null_time_label="NaT")
    stored = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("geofence")
    assert [tuple(r) for r in stored.collect()] == [("A", "2024-01-01 02:03:04", "1.5"), ("B", "NaT", None)]
    features = df.select("geofence", F.to_json(F.struct("q")).alias("feature"))
    write_geojson(features, str(tmp_path / "geojson"))
    text = spark.read.text(str(tmp_path / "geojson")).where("geofence = 'A'").first().value
    assert json.loads(text) == {"q": 1.5}
    write_geojson(features, str(tmp_path / "flat"), partition_by=())
    assert spark.read.text(str(tmp_path / "flat")).count() == 2


def test_csv_lines_are_those_of_the_written_file(spark, tmp_path):
    rows = [('a, "b"', 1.5, None), ("", None, dt.datetime(2024, 1, 2, 3, 4, 5)), (None, float("nan"), None)]
    df = spark.createDataFrame(rows, "`a name` string, q double, t timestamp_ntz").coalesce(1)
    path, n = export_table(df, f"{tmp_path}/", dt.datetime(2024, 5, 6, 7, 8, 9))
    assert (path, n) == (f"{tmp_path}/geofence_cargo_data_20240506_070809.csv", 3)
    written = [r.value for r in spark.read.text(path).collect()]
    assert written[0] == "a name,q,t"
    assert sorted(written[1:]) == sorted(r.line for r in csv_lines(df).collect())
    with pytest.raises(Exception, match="already exists"):
        export_table(df, str(tmp_path), dt.datetime(2024, 5, 6, 7, 8, 9))


def test_a_table_without_rows_is_exported(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, t date")
    path, n = export_table(empty, str(tmp_path), dt.datetime(2024, 1, 1), stem="none", null_time_label="NaT")
    assert n == 0 and path.endswith("/none_20240101_000000.csv")
    assert spark.read.option("header", True).schema("a string, t string").csv(path).count() == 0
