import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from geolith.functions import codec
from geolith.functions import columns as C
from geolith.functions import udfs as U
from geolith.sources import geojson, gpkg, validate


@pytest.fixture
def places(spark):
    df = spark.createDataFrame([("POINT (1 2)", 1, "a", True, float("inf")), ("POINT (4 5)", 2, "b", False, 1.5), (None, 3, None, None, None)], "w string, id long, b string, c boolean, inf double")
    return df.select(U.from_wkt("w").alias("geometry"), "id", "b", "c", "inf").coalesce(1)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def text(g="geom"):
    return U.to_wkt(g).alias("w")


def test_round_trip(spark, places, tmp_path):
    path = str(tmp_path / "a.gpkg")
    gpkg.write(places, path, "pts", spatial_index=True)
    back = gpkg.read(spark, path, "pts")
    assert plain(back, text(), "id", "b", "c", "inf", "table", "crs") == plain(places.withColumn("t", F.lit("pts")).withColumn("k", F.lit("EPSG:27700")), text("geometry"), "id", "b", "c", "inf", "t", "k")
    conn = sqlite3.connect(path)
    assert conn.execute("select min_x, min_y, max_x, max_y from gpkg_contents").fetchone() == (1, 2, 4, 5)
    assert conn.execute("select count(*) from rtree_pts_geometry").fetchone() == (2,)
    assert gpkg.table_names(path) == ["pts"] and gpkg.primary_key(path, "pts") == "fid"
    assert [r["extension_name"] for r in gpkg.extensions(path)] == ["gpkg_rtree_index"]
    conn.close()
    with gpkg.reading(path) as c:
        assert gpkg.rows(c, "pragma user_version") == [{"user_version": 10200}]
    conn = gpkg.writing(path)
    conn.execute("update pts set geometry = ? where id = 1", (codec.encode_blob(("Point", (100.0, 200.0)), 27700),))
    assert conn.execute("select minx, miny from rtree_pts_geometry order by id").fetchone()[0] == 100
    conn.close()


def test_append_rewrite_drop(spark, places, tmp_path):
    path = str(tmp_path / "a.gpkg")
    gpkg.write(places, path, "pts", spatial_index=True)
    gpkg.write(places.limit(1), path, "pts")
    assert gpkg.read(spark, path, "pts").count() == 4
    gpkg.write(places.limit(1), path, "pts", if_exists="delete-rows")
    assert gpkg.read(spark, path, "pts").count() == 1
    gpkg.write(places.select("geometry", "id"), path, "pts", if_exists="drop-table")
    assert gpkg.column_names(path, "pts") == ["fid", "geometry", "id"]
    gpkg.drop_table(path, "pts")
    assert gpkg.table_names(path) == [] and gpkg.geometry_columns(path) == {}


def test_reprojected_renamed_and_mixed(spark, places, tmp_path):
    path = str(tmp_path / "a.gpkg")
    os_point = spark.range(1).select(C.point(F.lit(651409.903), F.lit(313177.270)).alias("geometry"), F.col("id"))
    gpkg.write(os_point, path, "p")
    gpkg.write(places.select("id", "b"), path, "notes", schema={"id": {"primary_key": True}, "b": {}})
    gpkg.write(places.limit(0), path, "hollow")
    there = gpkg.read(spark, path, "p", to_crs="EPSG:4326", key_transform=lambda k: None if k == "id" else k)
    assert there.columns == ["geom", "table", "crs"]
    p = there.select(C.first_coordinate("geom").alias("c"), "crs").first()
    assert abs(p.c.x - 1.7179) < 0.01 and abs(p.c.y - 52.6576) < 0.01 and p.crs == "EPSG:4326"
    assert {r.table for r in gpkg.read(spark, path).collect()} == {"p", "notes"}
    assert gpkg.table_names(path, spatial_only=True) == ["hollow", "p"]
    with pytest.raises(ValueError, match="missing table"):
        gpkg.read(spark, path, "nowhere")
    with pytest.raises(FileNotFoundError):
        gpkg.read(spark, str(tmp_path / "none.gpkg"), "p")


def test_filters_reach_the_file(spark, places, tmp_path):
    path = str(tmp_path / "a.gpkg")
    gpkg.write(places, path, "pts")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [r.b for r in gpkg.read(spark, path, "pts").where("id >= 2 and b is not null").select("b").collect()] == ["b"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_plain_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    conn = sqlite3.connect(path)
    conn.execute('create table "odd "" name" (a integer, b text)')
    conn.execute('insert into "odd "" name" values (1, null), (2, \'x\')')
    conn.commit()
    conn.close()
    assert gpkg.quote('a"b', "c") == '"a""b"."c"'
    assert plain(gpkg.read(spark, path, 'odd " name'), "a", "b", "crs") == [(1, None, None), (2, "x", None)]


def amended(spark, tmp_path, method, if_exists):
    path = str(tmp_path / f"{method}-{if_exists}.gpkg")
    base = spark.createDataFrame([("POINT (1 1)", 1, "a"), ("POINT (2 2)", 2, "b"), ("POINT (3 3)", 3, "c")], "w string, id long, b string").select(U.from_wkt("w").alias("geometry"), "id", "b").coalesce(1)
    gpkg.write(base, path, "t", spatial_index=True)
    twice = [] if method == "update-set" else [(1, "y")]
    new = spark.createDataFrame([(1, "x"), *twice, (2, "z"), (99, "new"), (None, "void")], "fid long, b string")
    gpkg.amend(path, "t", new, method=method, if_exists=if_exists)
    assert validate.is_valid(spark, path)
    return plain(gpkg.read(spark, path, "t", with_key=True), "fid", text(), "id", "b")


def test_amend(spark, tmp_path):
    assert amended(spark, tmp_path, "update-set", "preserve") == [(1, "POINT (1 1)", 1, "x"), (2, "POINT (2 2)", 2, "z"), (3, "POINT (3 3)", 3, "c")]
    assert amended(spark, tmp_path, "update-set", "set-null")[2] == (3, "POINT (3 3)", 3, None)
    left = amended(spark, tmp_path, "left-join", "preserve")
    assert sorted(r[3] for r in left) == ["c", "x", "y", "z"] and {r[0] for r in left} >= {2, 3} and 1 not in {r[0] for r in left}
    outer = amended(spark, tmp_path, "outer-join", "drop-column")
    assert sorted((r[2], r[3]) for r in outer if r[2]) == [(1, "x"), (1, "y"), (2, "z"), (3, None)] and sorted(r[3] for r in outer if not r[2]) == ["new", "void"]
    right = amended(spark, tmp_path, "right-join", "preserve")
    assert sorted(r[3] for r in right) == ["new", "void", "x", "y", "z"]


def test_amend_refuses_doubles(spark, places, tmp_path):
    path = str(tmp_path / "a.gpkg")
    gpkg.write(places, path, "t")
    with pytest.raises(ValueError, match="Multiple matched rows"):
        gpkg.amend(path, "t", spark.createDataFrame([(1, "x"), (1, "y")], "fid long, b string"))
    assert gpkg.read(spark, path, "t").count() == 3


def test_schema_extension(spark, places, tmp_path):
    path = str(tmp_path / "a.gpkg")
    df = places.select("geometry", "id", F.lit(5).alias("pop"), F.lit("red").alias("colour"))
    constraints = {"low": {"type": "range", "min": 0, "max": 100, "max_inclusive": False}, "hue": {"type": "enum", "values": ["red", "green", "blue"]}, "g": {"type": "glob", "value": "a*"}}
    gpkg.write(df, path, "t", schema={"geometry": {"type": "point"}, "id": {}, "pop": {"title": "Population", "constraint": "low"}, "colour": {"constraint": "hue"}}, constraints=constraints)
    assert gpkg.column_metadata(path, "t") == {"pop": {"title": "Population", "constraint_name": "low"}, "colour": {"constraint_name": "hue"}}
    found = gpkg.column_constraints(path)
    assert len(found["hue"]) == 3 and found["low"] == [{"constraint_type": "range", "min": 0, "min_is_inclusive": True, "max": 100, "max_is_inclusive": False}]
    assert gpkg.geometry_column(path, "t") == {"column_name": "geometry", "geometry_type": "POINT", "srid": 27700}
    assert validate.is_valid(spark, path)


def test_validator_finds_damage(spark, places, tmp_path):
    path = tmp_path / "a.gpkg"
    gpkg.write(places, str(path), "t", spatial_index=True)
    found = validate.validate(spark, str(path))
    assert len(found) == 41 and not [r for r in found if r["status"] == "fail"]
    conn = gpkg.writing(str(path))
    conn.execute("drop trigger rtree_t_geometry_update1")
    conn.execute("drop trigger rtree_t_geometry_update2")
    conn.execute("update t set geometry = x'58580001346c000000' where id = 2")
    gpkg._close(conn)
    assert {r["req"] for r in validate.failures(spark, str(path))} >= {19, 20}
    raw = bytearray(path.read_bytes())
    raw[68:72] = b"\0\0\0\0"
    path.write_bytes(raw)
    assert 2 in {r["req"] for r in validate.failures(spark, str(path))}
    assert validate.report(spark, str(path)).count() == 41


def test_geojson(spark, tmp_path):
    one = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[100, 0], [101, 0], [101, 1], [100, 1], [100, 0]]]}, "properties": {"prop0": "v", "prop1": {"this": "that"}}}
    (tmp_path / "f.json").write_text(json.dumps(one, indent=1))
    r = geojson.read(spark, str(tmp_path / "f.json")).select(text(), "prop0", "prop1").first()
    assert r.w == "POLYGON ((100 0, 101 0, 101 1, 100 1, 100 0))" and r.prop0 == "v" and r.prop1.this == "that"
    many = {"type": "FeatureCollection", "features": [one, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [102, 0.5, 9]}, "properties": {"prop0": "w", "prop1": 0.0}}, {"type": "Feature", "geometry": None, "properties": None}]}
    (tmp_path / "c.json").write_text(json.dumps(many))
    df = geojson.read(spark, str(tmp_path / "c.json"), key_transform=lambda k: None if k == "prop1" else k.upper())
    assert plain(df, text(), "PROP0") == [("POINT (102 0.5)", "w"), ("POLYGON ((100 0, 101 0, 101 1, 100 1, 100 0))", "v"), (None, None)]
    (tmp_path / "g.json").write_text('{"type": "GeometryCollection", "geometries": [{"type": "MultiPoint", "coordinates": [[1, 2]]}]}')
    assert geojson.read(spark, str(tmp_path / "g.json")).select(text()).first().w == "GEOMETRYCOLLECTION (MULTIPOINT ((1 2)))"
