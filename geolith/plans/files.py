"""Queries of sources, sinks, catalogue and validator: tables are written to files in the shared folder and read from there.

Files lie in `spark.checkpoint.dir`, which driver and executors see, each run in a folder of its own.
"""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs as U
from ..shared import local_folder
from ..sources import geojson, gpkg, validate
from .catalogue import WITH, ORACLES, QUERIES, boxes, customers, query, r6


def _file(spark, name: str = "a.gpkg") -> str:
    return f"{local_folder(spark, 'files-' + uuid.uuid4().hex)}/{name}"


def _layer(spark, sf, path: str, **how) -> None:
    gpkg.write(boxes(spark, sf).select("k", "brand", "geom"), path, "boxes", **how)


@query("select k, brand, (x1-x0)*(y1-y0) as area, 'boxes' as \"table\", 'EPSG:27700' as crs, 27700 as srid from part_box")
def gpkg_round_trip(spark, sf):
    path = _file(spark)
    _layer(spark, sf, path)
    return gpkg.read(spark, path, "boxes").select("k", "brand", C.area("geom").alias("area"), "table", "crs", C.srid("geom").alias("srid"))


@query("select round(x0 * 20 + 300000, 1) as x, round(y0 * 20 + 200000, 1) as y, k, 'EPSG:27700' as crs from part_box")
def gpkg_reprojected(spark, sf):
    """Written in degrees, read in the national grid, a column renamed and one left out."""
    from ..operators import crs

    path = _file(spark)
    moved = boxes(spark, sf).select("k", "brand", C.point(F.col("x0") * 20 + 300000, F.col("y0") * 20 + 200000).alias("g")).select("k", "brand", crs.reproject("g", 27700, 4326).alias("geom"))
    gpkg.write(moved, path, "spots", srid=4326)
    got = gpkg.read(spark, path, "spots", to_crs="EPSG:27700", key_transform=lambda n: None if n == "brand" else n.upper())
    p = C.first_coordinate("geom")
    return got.select(F.round(p["x"], 1).alias("x"), F.round(p["y"], 1).alias("y"), F.col("K").alias("k"), "crs")


@query("""select 'tables' as what, 'boxes' as value union all select 'columns', 'fid,geom,k,brand' union all select 'geometry', 'geom POLYGON 27700' union all select 'key', 'fid'
  union all select 'extensions', 'gpkg_rtree_index' union all select 'spatial', 'boxes' union all select 'index', cast(count(*) as varchar) from part_box
  union all select 'extent', cast(min(x0)::bigint as varchar) || ',' || cast(min(y0)::bigint as varchar) || ',' || cast(max(x1)::bigint as varchar) || ',' || cast(max(y1)::bigint as varchar) from part_box
  union all select 'srs', '-1,0,4326,27700' union all select 'ids', '1196444487,10200' union all select 'triggers', '6'""")
def gpkg_catalogue(spark, sf):
    """What the metadata of a written file says: tables, columns, key, extensions, the spatial index and its triggers, extent and systems."""
    path = _file(spark)
    _layer(spark, sf, path, schema={"geom": {"type": "polygon"}, "k": {}, "brand": {}}, spatial_index=True)
    g = gpkg.geometry_column(path, "boxes")
    with gpkg.reading(path) as conn:
        one = lambda sql: list(gpkg.rows(conn, sql)[0].values())
        extent = ",".join(str(int(v)) for v in one("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents"))
        index, triggers = one("SELECT count(*) FROM rtree_boxes_geom")[0], one("SELECT count(*) FROM sqlite_master WHERE type = 'trigger'")[0]
        srs = ",".join(str(r["srs_id"]) for r in gpkg.rows(conn, "SELECT srs_id FROM gpkg_spatial_ref_sys ORDER BY srs_id"))
        ids = f"{one('PRAGMA application_id')[0]},{one('PRAGMA user_version')[0]}"
    found = {
        "tables": ",".join(gpkg.table_names(path)), "columns": ",".join(gpkg.column_names(path, "boxes")), "geometry": f"{g['column_name']} {g['geometry_type']} {g['srid']}".replace("-", "").upper().replace("GEOM ", "geom ", 1),
        "key": gpkg.primary_key(path, "boxes"), "extensions": ",".join(e["extension_name"] for e in gpkg.extensions(path)), "spatial": ",".join(gpkg.geometry_columns(path)), "index": str(index), "extent": extent,
        "srs": srs, "ids": ids, "triggers": str(triggers),
    }
    return spark.createDataFrame(list(found.items()), "what string, value string")


@query("select 'k' as \"column\", 'Key' as title, 'keys' as constraint_name, 'range' as kind, 1 as rows union all select 'brand', 'Brand', 'brands', 'enum', 2")
def gpkg_column_schema(spark, sf):
    """Titles and constraints of columns, written and read back."""
    path = _file(spark)
    schema = {"geom": {}, "k": {"title": "Key", "constraint": "keys"}, "brand": {"title": "Brand", "constraint": "brands"}}
    _layer(spark, sf, path, schema=schema, constraints={"keys": {"type": "range", "min": 0, "max": 1e9}, "brands": {"type": "enum", "values": ["Brand#11", "Brand#12"]}})
    meta, rules = gpkg.column_metadata(path, "boxes"), gpkg.column_constraints(path)
    rows = [(n, m["title"], m["constraint_name"], rules[m["constraint_name"]][0]["constraint_type"], len(rules[m["constraint_name"]])) for n, m in meta.items()]
    return spark.createDataFrame(rows, "column string, title string, constraint_name string, kind string, rows int")


@query("select 'boxes' as \"table\", count(*) as n, round(sum((x1-x0)*(y1-y0)), 6) as area from part_box union all select 'notes', count(*), null from customer")
def gpkg_all_tables(spark, sf):
    """All tables of a file at once, one of them without geometry; an empty one is skipped."""
    path = _file(spark)
    _layer(spark, sf, path)
    gpkg.write(customers(spark, sf).select("c"), path, "notes", schema={"c": {"primary_key": True}})
    gpkg.write(boxes(spark, sf).limit(0).select("k", "geom"), path, "hollow")
    got = gpkg.read(spark, path)
    return got.groupBy("table").agg(F.count("*").alias("n"), r6(F.sum(C.area("geom")), "area"))


@query("select k % 2 as half, count(*) as n from part_box where k % 2 = 0 or k % 3 = 0 group by k % 2")
def gpkg_appended(spark, sf):
    """Rows deleted and written anew, then others appended; a dropped table is gone."""
    path = _file(spark)
    df = boxes(spark, sf).select("k", "geom")
    gpkg.write(df, path, "boxes", spatial_index=True)
    gpkg.write(df.where("k % 2 = 0"), path, "boxes", if_exists="delete-rows")
    gpkg.write(df.where("k % 2 = 1 and k % 3 = 0"), path, "boxes")
    gpkg.write(df, path, "other", spatial_index=True)
    gpkg.drop_table(path, "other")
    return gpkg.read(spark, path).groupBy((F.col("k") % 2).alias("half")).agg(F.count("*").alias("n"))


@query("select c as id, case when c % 2 = 0 then -x else x end as x, case when c % 2 = 0 then 'new' end as note from cust_pt")
def gpkg_amended(spark, sf):
    """Half the rows of a table in a file get new values and a new column."""
    path = _file(spark)
    p = C.first_coordinate("geom")
    df = customers(spark, sf).select("geom", F.col("c").alias("id"), p["x"].alias("x"))
    gpkg.write(df, path, "spots")
    gpkg.amend(path, "spots", df.where("id % 2 = 0").select("id", (-F.col("x")).alias("x"), F.lit("new").alias("note")), key="id", if_exists="preserve")
    return gpkg.read(spark, path, "spots").select("id", "x", "note")


@query("select 1 as id, '12' as n, 1.0::double as r union all select 2, 'twelve', 2.5 union all select 3, null, null")
def sqlite_values(spark, sf):
    """A plain SQLite table whose columns hold other kinds than they declare: values come as they are stored."""
    path = _file(spark, "plain.db")
    conn = sqlite3.connect(path)
    conn.execute("CREATE TABLE loose (id INTEGER, n INTEGER, r INTEGER)")
    conn.executemany("INSERT INTO loose VALUES (?, ?, ?)", [(1, 12, 1), (2, "twelve", 2.5), (3, None, None)])
    conn.commit()
    conn.close()
    return gpkg.read(spark, path, "loose").select(F.col("id").cast("int").alias("id"), "n", "r")


@query("select 0 as failed, 1 as broken, 'application-id' as broken_id")
def gpkg_validated(spark, sf):
    """A written file passes every check; one whose application id is wiped fails that one."""
    path = _file(spark)
    _layer(spark, sf, path, spatial_index=True)
    good = validate.failures(spark, path)
    conn = sqlite3.connect(path)
    conn.execute("PRAGMA application_id = 7")
    conn.close()
    bad = validate.failures(spark, path)
    name = "application-id" if [r["req"] for r in bad] == [2] else ",".join(str(r["req"]) for r in bad)
    return spark.createDataFrame([(len(good), len(bad), name)], "failed int, broken int, broken_id string")


def _collections(batches):
    """Lines of a file that is one feature collection, so that no task and no row holds all features."""
    import pyarrow as pa

    first = True
    yield pa.RecordBatch.from_pydict({"value": ['{"type":"FeatureCollection","features":[']})
    for b in batches:
        if b.num_rows:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [*(texts[:1] if first else ["," + texts[0]]), *("," + t for t in texts[1:])]})
            first = False
    yield pa.RecordBatch.from_pydict({"value": ["]}"]})


@query("select k, brand, (x1-x0)*(y1-y0) as area, 4326 as srid from part_box")
def geojson_features(spark, sf):
    """Feature collections that Spark writes, one a task, read back with their properties."""
    folder = f"{local_folder(spark, 'files-' + uuid.uuid4().hex)}/json"
    n = lambda v: F.col(v).cast("string")
    ring = F.concat_ws(",", *(F.concat(F.lit("["), n(x), F.lit(","), n(y), F.lit("]")) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"), ("x0", "y0"))))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit(']]},"properties":'), F.to_json(F.struct("k", "brand")), F.lit("}"))
    U.spread(boxes(spark, sf).select(feature.alias("f"))).mapInArrow(_collections, "value string").write.text(f"file://{folder}")
    got = geojson.read(spark, f"file://{folder}")
    return got.select(F.col("k").cast("long").alias("k"), "brand", C.area("geom").alias("area"), C.srid("geom").alias("srid"))


@query("select c, x, y, false as empty from cust_pt")
def blob_headers(spark, sf):
    """The header of a blob read by built-in expressions, without a kernel."""
    b = U.spread(customers(spark, sf)).withColumn("blob", U.gpkg_encode("geom", F.lit(27700)))
    h = gpkg.header(F.col("blob"))
    p = C.first_coordinate("geom")
    return b.where(h["magic"] & (h["srid"] == 27700) & h["little"] & (h["envelope_code"] == 0) & (h["version"] == 0)).select("c", p["x"].alias("x"), p["y"].alias("y"), h["empty"].alias("empty"))


__all__ = ["ORACLES", "QUERIES", "WITH"]
