"""What queries at size rest on: plans that hold neither Python per pair nor guessed broadcasts, and short cuts that change nothing."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from geolith.functions import columns as C
from geolith.functions import rectangles
from geolith.functions import topology as tp
from geolith.functions.shapes import from_row, to_row
from geolith.operators import joins
from geolith.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["brand_hits", "point_in_box", "box_contains_point", "box_overlaps_box", "box_covered_by", "envelope_query", "radius_query", "box_union_area"])
def test_pairs_of_boxes_and_points_need_no_python_and_no_broadcast(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "EvalPython" not in text and "Broadcast" not in text


def test_centres_are_found_once_a_row_and_nothing_is_broadcast(spark):
    text = plan(catalogue.QUERIES["centroid_in_box"](spark, SF))
    assert text.count("EvalPython") == 1 and "Broadcast" not in text


@pytest.mark.parametrize("op", sorted(tp.OPS))
def test_boxes_are_laid_over_each_other_as_the_kernel_does(spark, op):
    ends = [(a0, a1, b0, b1) for a0, a1, b0, b1 in product((0.0, 1.5, 4.0, 11.0), repeat=4) if a0 < a1 and b0 < b1 and a0 < b1 and b0 < a1]
    rows = [(i, *x, *y) for i, (x, y) in enumerate(product(ends, ends))]
    df = spark.createDataFrame(rows, "i int, ax0 double, ax1 double, bx0 double, bx1 double, ay0 double, ay1 double, by0 double, by1 double")
    env = lambda s: F.struct(*(F.col(f"{s}{n}").alias(m) for n, m in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))))
    got = {r.i: r.g for r in df.select("i", env("a").alias("a"), env("b").alias("b")).select("i", rectangles.overlay(op, F.col("a"), F.col("b"), F.lit(7)).alias("g")).collect()}
    box = lambda x0, y0, x1, y1: ("Polygon", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])
    for i, ax0, ax1, bx0, bx1, ay0, ay1, by0, by1 in rows:
        want = tp.overlay(op, box(ax0, ay0, ax1, ay1), box(bx0, by0, bx1, by1))
        assert got[i].asDict(recursive=True) == to_row(want, 7) and from_row(got[i].asDict(recursive=True)) == want


def test_neighbours_where_points_are_dense_and_where_they_are_few(spark):
    places = [(i, float(i % 40) / 8, float(i // 40) / 8) for i in range(400)] + [(1000 + i, 300.0 + 40 * i, 5.0) for i in range(6)] + [(2000, None, None)]
    asked = [(1, 1.0, 1.0), (2, 310.0, 0.0), (3, 5000.0, 0.0), (4, 100.0, 3.0), (4, 2.0, 0.0), (5, None, 1.0)]
    index = spark.createDataFrame(places, "c int, x double, y double").select("c", C.point("x", "y").alias("geom"))
    queries = spark.createDataFrame(asked, "q int, x double, y double").select("q", C.point("x", "y").alias("geom"))
    got = sorted((r.q, r["rank"], r.c, r.distance) for r in joins.neighbours(queries, index, "q", 250.0, 5, "c").collect())
    want = []
    for q in {a[0] for a in asked}:
        far = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, c) for k, x, y in asked if k == q and x is not None for c, u, v in places if u is not None)
        want += [(q, k + 1, c, d) for k, (d, c) in enumerate([f for f in far if f[0] < 250.0][:5])]
    assert [w[:3] for w in sorted(want)] == [g[:3] for g in got]
    assert all(abs(w[3] - g[3]) < 1e-12 for w, g in zip(sorted(want), got, strict=True))


def test_mixed_shapes_meet_as_the_kernel_says(spark):
    """Boxes, points, triangles and lines on both sides: pairs that comparisons settle and pairs that the kernel does."""
    c = C.coordinate
    x, y = (F.col("id") * 3 % 7).cast("double"), (F.col("id") * 5 % 8).cast("double")
    shape = F.when(F.col("id") % 4 == 0, C.box(x, y, x + 2, y + 3)).when(F.col("id") % 4 == 1, C.point(x, y)).when(F.col("id") % 4 == 2, C.polygon(F.array(c(x, y), c(x + 3, y), c(x, y + 3), c(x, y)))).otherwise(C.line_string(F.array(c(x, y), c(x + 2, y + 2))))
    df = spark.range(40).select("id", shape.alias("geom")).localCheckpoint()
    gs = {r.id: from_row(r.geom.asDict(recursive=True)) for r in df.collect()}
    for name in joins.PREDICATES:
        got = sorted((r.id, r.id_right) for r in joins.spatial_join(df, df, name).select("id", "id_right").collect())
        assert got == [(i, j) for i in sorted(gs) for j in sorted(gs) if tp.predicate(name, gs[i], gs[j])]


def test_rows_of_a_geopackage_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """Rows in their order, ids and index as the trigger would have them, written again over old ones, and none at all."""
    from pyspark.sql.classic.dataframe import DataFrame

    from geolith.sources import gpkg

    def no(*_, **__):
        raise AssertionError("rows sent to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", no)
    path = str(tmp_path / "a.gpkg")
    df = spark.range(50).repartition(5).select("id", F.when(F.col("id") % 7 > 0, C.box(F.col("id"), F.col("id") * 2, F.col("id") + 3, F.col("id") * 2 + 1)).alias("geom"))
    for n, rows in ((1, 50), (2, 100)):
        gpkg.write(df, path, "boxes", spatial_index=True)
        with gpkg.reading(path) as conn:
            ids = [r["fid"] for r in gpkg.rows(conn, "SELECT fid FROM boxes ORDER BY rowid")]
            held = gpkg.rows(conn, "SELECT b.id, t.minx, t.maxx, t.miny, t.maxy, b.geom IS NULL AS none FROM boxes b LEFT JOIN rtree_boxes_geom t ON t.id = b.fid")
            assert ids == list(range(1, rows + 1)) and len(gpkg.rows(conn, "SELECT 1 FROM sqlite_master WHERE type = 'trigger'")) == 6
            assert not gpkg.rows(conn, "SELECT 1 FROM sqlite_master WHERE name LIKE 'geolith%'")
        assert all((r["minx"], r["maxx"], r["miny"], r["maxy"]) == ((None,) * 4 if r["none"] else (r["id"], r["id"] + 3, r["id"] * 2, r["id"] * 2 + 1)) for r in held)
    gpkg.write(df.limit(0), path, "hollow")
    assert gpkg.table_names(path) == ["boxes", "hollow"]


def test_features_are_written_and_read_by_all_tasks(spark, monkeypatch):
    """No row holds a whole collection when it is written, and one document's features are parsed by all tasks when it is read."""
    import glob

    from geolith.plans import files

    folders = []
    monkeypatch.setattr(files, "local_folder", lambda spark, name, f=files.local_folder: folders.append(f(spark, name)) or folders[-1])
    df = catalogue.QUERIES["geojson_features"](spark, SF)
    parts = glob.glob(f"{folders[0]}/json/part-*")
    assert len(parts) > 1 and max(len(line) for p in parts for line in open(p)) < 1000
    assert df.rdd.getNumPartitions() > 1 and df.count() == 200


@pytest.mark.parametrize("name", ["cut_rims", "normalized_wkt"])
def test_kernels_run_in_all_tasks(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert text.rindex("RoundRobinPartitioning") > text.rindex("EvalPython")  # dealt below the kernels
