"""Queries of constructors, accessors, kernels and networks, each with values that its SQL works out by itself.

Triangles, L-shapes, rings with holes and bow ties are built on the corners of the boxes, so that no envelope settles what the kernels are asked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs as U
from ..operators import crs, network
from .catalogue import boxes, corners, customers, query, r6, suppliers, tracks

c = C.coordinate


# columns are made when asked for, as they need a session
def width():
    return F.col("x1") - F.col("x0")


def height():
    return F.col("y1") - F.col("y0")


def middle():
    return (F.col("y0") + F.col("y1")) / 2


def _ring(*at):
    return F.array(*(c(x, y) for x, y in at))


def _triangle(a, b, d):
    return C.polygon(_ring(a, b, d, a))


P00, P10, P01, P11 = ("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1")


def lower_left():
    return _triangle(P00, P10, P01)


def upper_right():
    return _triangle(P11, P01, P10)


def lower_right():
    return _triangle(P00, P10, P11)


def rim():
    return _ring(P00, P01, P11, P10, P00)


def holed():
    x, y = F.col("x0") + 1, F.col("y0") + 1
    return C.polygon(rim(), F.array(_ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))))


# ---- kinds and parts ---------------------------------------------------------------------------------------------------


@query("""select k, case k % 5 when 0 then 'point' when 1 then 'polygon' when 2 then 'line-string' when 3 then 'multi-point' else 'geometry-collection' end as kind,
  k % 5 < 3 as single, k % 5 >= 3 as multi, k % 5 = 2 as is_line, k % 5 = 4 as empty from part_box""")
def kind_tests(spark, sf):
    m = F.col("k") % 5
    none = C.collect(F.array(C.point("x0", "y0")).cast(U.LIST))
    g = F.when(m == 0, C.point("x0", "y0")).when(m == 1, C.box("x0", "y0", "x1", "y1")).when(m == 2, C.line_string(_ring(P00, P11)))
    g = g.when(m == 3, C.collect(F.array(C.point("x0", "y0"), C.point("x1", "y1")), "MultiPoint")).otherwise(C.collect(F.filter(C.geometries(none), lambda x: F.lit(False))))
    df = corners(spark, sf).withColumn("g", g)
    return df.select("k", C.geometry_type("g").alias("kind"), C.is_single("g").alias("single"), C.is_multi("g").alias("multi"), C.is_kind("g", "LineString").alias("is_line"), C.is_empty("g").alias("empty"))


@query("select size, count(*) as n, round(sum((x1-x0)*(y1-y0)), 6) as area, round(sum(2*(x1-x0+y1-y0)), 6) as rims, 'multi-polygon' as kind, 'multi-line-string' as line_kind from part_box group by size")
def multi_kinds(spark, sf):
    df = corners(spark, sf).select("size", C.box("x0", "y0", "x1", "y1").alias("b"), C.line_string(rim()).alias("r"))
    g = df.groupBy("size").agg(C.collect(F.collect_list("b"), "MultiPolygon").alias("g"), C.collect(F.collect_list("r"), "MultiLineString").alias("l"))
    return g.select("size", F.size(C.polygons_of("g")).cast("long").alias("n"), r6(C.area("g"), "area"), r6(C.length("l"), "rims"), C.geometry_type("g").alias("kind"), C.geometry_type("l").alias("line_kind"))


@query("select k, 2 as children, 'point' as first, 'geometry-collection' as second, 2 as parts_of_second, 2 as points, 1 as polygons, 0 as lines from part_box")
def nested_children(spark, sf):
    inner = C.collect(F.array(C.box("x0", "y0", "x1", "y1"), C.point("x1", "y1")))
    df = corners(spark, sf).withColumn("g", C.collect(F.array(C.point("x0", "y0"), inner))).withColumn("kids", C.geometries("g"))
    a, b = F.get("kids", F.lit(0)), F.get("kids", F.lit(1))
    return df.select("k", F.size("kids").alias("children"), C.geometry_type(a).alias("first"), C.geometry_type(b).alias("second"), F.size(b["parts"]).alias("parts_of_second"), F.size(C.points_of("g")).alias("points"), F.size(C.polygons_of("g")).alias("polygons"), F.size(C.line_strings_of("g")).alias("lines"))


@query("select k, brand, t.x, t.y from part_box, lateral (values (x0, y0), (x1, y1)) t(x, y)")
def exploded_parts(spark, sf):
    """A row for each point of a collection; the other columns come along."""
    df = corners(spark, sf).withColumn("geom", C.collect(F.array(C.point("x0", "y0"), C.box("x0", "y0", "x1", "y1"), C.point("x1", "y1"))))
    p = C.first_coordinate("geom")
    return C.explode_parts(df, "geom", "Point").select("k", "brand", p["x"].alias("x"), p["y"].alias("y"))


@query("select k, 'linear-ring' as kind, 5 as n, 2*(x1-x0+y1-y0) as length from part_box")
def exterior_rings(spark, sf):
    g = C.exterior_ring("g")
    df = corners(spark, sf).withColumn("g", C.box("x0", "y0", "x1", "y1")).withColumn("r", g).withColumn("made", C.linear_ring(rim()))
    same = C.length("r") + C.length("made")
    return df.select("k", C.geometry_type("r").alias("kind"), F.size(C.coordinates("r")).alias("n"), (same / 2).alias("length"))


@query("select user_id, round((max(x)-min(x))*(max(y)-min(y)), 6) as area from vertex group by user_id")
def envelope_polygons(spark, sf):
    return tracks(spark, sf).withColumn("e", C.envelope("geom")).select("user_id", r6(C.area(C.envelope_polygon("e")), "area"))


@query("select k, 1 + (x1-x0 > 4)::int as lines, 2*(x1-x0+y1-y0) + case when x1-x0 > 4 then 4 else 0 end as length from part_box")
def linearized(spark, sf):
    """Rims of polygons as lines: of one ring, and of a shell with a hole."""
    df = corners(spark, sf).withColumn("g", F.when(width() > 4, holed()).otherwise(C.box("x0", "y0", "x1", "y1")))
    df = U.spread(df.select("k", "g")).withColumn("l", F.get(U.linearize("g"), F.lit(0)))
    return df.select("k", F.size(C.line_strings_of("l")).alias("lines"), C.length("l").alias("length"))


# ---- text and bytes ----------------------------------------------------------------------------------------------------

WKT = "'POLYGON ((' || x0::bigint || ' ' || y0::bigint || ', ' || x0::bigint || ' ' || y1::bigint || ', ' || x1::bigint || ' ' || y1::bigint || ', ' || x1::bigint || ' ' || y0::bigint || ', ' || x0::bigint || ' ' || y0::bigint || '))'"


@query(f"select k, {WKT} as wkt, (x1-x0)*(y1-y0) as area from part_box")
def wkt_polygon(spark, sf):
    """A text that Spark makes, parsed and written again."""
    n = lambda v: F.col(v).cast("long").cast("string")
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(F.concat_ws(" ", n(x), n(y)) for x, y in (P00, P01, P11, P10, P00))), F.lit("))"))
    return U.spread(corners(spark, sf)).withColumn("g", U.from_wkt(text)).select("k", U.to_wkt("g").alias("wkt"), C.area("g").alias("area"))


@query("select k, (x1-x0)*(y1-y0) - case when x1-x0 > 4 then 1 else 0 end as area, 3 as points, 27700 as srid from part_box")
def binary_codecs(spark, sf):
    """Polygons with and without holes, and multi-points, through WKB and GeoPackage blobs."""
    g = F.when(width() > 4, holed()).otherwise(C.box("x0", "y0", "x1", "y1"))
    m = C.collect(F.array(C.point("x0", "y0"), C.point("x1", "y0"), C.point("x1", "y1")), "MultiPoint")
    df = U.spread(corners(spark, sf).withColumn("g", g).withColumn("m", m)).withColumn("w", U.from_wkb(U.to_wkb("g"))).withColumn("b", U.gpkg_decode(U.gpkg_encode("m", F.lit(27700))))
    return df.select("k", C.area("w").alias("area"), F.size(C.points_of("b")).alias("points"), C.srid("b").alias("srid"))


@query(f"select k, {WKT} as wkt from part_box")
def normalized_wkt(spark, sf):
    """Boxes that start anywhere and turn either way, in the one normal form."""
    ring = _ring(P00, P01, P11, P10)
    at = (F.col("k") % 4).cast("int")
    turned = F.concat(F.slice(ring, at + 1, 4), F.slice(ring, F.lit(1), at + 1))
    turned = F.slice(turned, 1, 5)
    df = corners(spark, sf).withColumn("r", turned).withColumn("r", F.when(F.col("k") % 3 == 0, F.reverse("r")).otherwise(F.col("r"))).withColumn("g", C.polygon(F.col("r")))
    return U.spread(df.select("k", "g")).select("k", U.to_wkt(U.normalized("g")).alias("wkt"))


# ---- predicates and overlay by the kernels -----------------------------------------------------------------------------


@query("""select k, u + v <= 1 as meets, u + v <= 1 and (u = 0 or v = 0 or u + v = 1) as touch, u + v <= 1 as covered, u + v < 1 and u > 0 and v > 0 as contained, false as overlap
  from (select k, (k % 5) / 4.0 as u, (k // 5 % 3) / 2.0 as v from part_box)""")
def triangle_and_point(spark, sf):
    """Points in, on and beside a triangle that fill its envelope."""
    u, v = (F.col("k") % 5) / 4, F.expr("k div 5 % 3") / 2
    df = U.spread(corners(spark, sf).withColumn("p", C.point(F.col("x0") + width() * u, F.col("y0") + height() * v)).withColumn("t", lower_left()))
    return df.select("k", U.intersects("t", "p").alias("meets"), U.touches("t", "p").alias("touch"), U.covers("t", "p").alias("covered"), U.contains("t", "p").alias("contained"), U.overlaps("t", "p").alias("overlap"))


@query("select k, true as touch, false as touch_overlap, true as overlap, false as overlap_touch, true as covered, true as contained, 'FF2F11212' as beside, '212F11FF2' as within, '1FFF0F212' as line, true as pattern from part_box")
def triangle_relations(spark, sf):
    """Triangles that share a side, that overlap, that lie in a box, and a diagonal."""
    df = U.spread(corners(spark, sf).withColumn("a", lower_left()).withColumn("b", upper_right()).withColumn("d", lower_right()).withColumn("box", C.box("x0", "y0", "x1", "y1")).withColumn("l", C.line_string(_ring(P00, P11))))
    return df.select(
        "k", U.touches("a", "b").alias("touch"), U.overlaps("a", "b").alias("touch_overlap"), U.overlaps("a", "d").alias("overlap"), U.touches("a", "d").alias("overlap_touch"), U.covers("box", "a").alias("covered"),
        U.contains("box", "a").alias("contained"), U.relate("a", "b").alias("beside"), U.relate("box", "a").alias("within"), U.relate("l", "box").alias("line"), U.relates("a", "b", "F***1****").alias("pattern"),
    )


@query("select k, round(w*h/4, 6) as both, round(3*w*h/4, 6) as either, round(w*h/4, 6) as less, round(w*h/2, 6) as one from (select k, x1-x0 as w, y1-y0 as h from part_box)")
def triangle_overlay(spark, sf):
    df = U.spread(corners(spark, sf).withColumn("a", lower_left()).withColumn("b", lower_right()))
    made = df.select("k", U.intersection("a", "b").alias("i"), U.union("a", "b").alias("u"), U.difference("a", "b").alias("d"), U.sym_difference("a", "b").alias("s"))
    return made.select("k", r6(C.area("i"), "both"), r6(C.area("u"), "either"), r6(C.area("d"), "less"), r6(C.area("s"), "one"))


# ---- measures ----------------------------------------------------------------------------------------------------------


@query("""select k, round(sqrt((px-qx)*(px-qx)+(py-qy)*(py-qy)), 6) as distance, qx, qy from (select k, px, py, least(greatest(px, x0), x1) as qx, least(greatest(py, y0), y1) as qy
  from (select *, x0 + (k % 7 - 3) * (x1-x0) as px, y0 + (k // 7 % 5 - 2) * (y1-y0) as py from part_box)) where px <> qx or py <> qy""")
def closest_points_of_boxes(spark, sf):
    """The point of a box that is closest to one beside it, and how far that is."""
    df = corners(spark, sf).withColumn("px", F.col("x0") + (F.col("k") % 7 - 3) * width()).withColumn("py", F.col("y0") + (F.expr("k div 7 % 5") - 2) * height())
    df = df.where("px < x0 or px > x1 or py < y0 or py > y1")
    df = U.spread(df.withColumn("p", C.point("px", "py")).withColumn("b", C.box("x0", "y0", "x1", "y1")))
    q = C.first_coordinate(F.get("two", F.lit(0)))
    return df.select("k", U.distance("b", "p").alias("d"), U.closest_points("b", "p").alias("two")).select("k", r6(F.col("d"), "distance"), q["x"].alias("qx"), q["y"].alias("qy"))


@query("select k, true as inside, true as in_triangle from part_box")
def interior_points(spark, sf):
    """Points strictly inside, told by coordinates and not by a predicate."""
    df = U.spread(corners(spark, sf).withColumn("g", C.box("x0", "y0", "x1", "y1")).withColumn("t", lower_left())).withColumn("p", U.interior_point("g")).withColumn("q", U.interior_point("t"))
    p, q = C.first_coordinate("p"), C.first_coordinate("q")
    box = (p["x"] > F.col("x0")) & (p["x"] < F.col("x1")) & (p["y"] > F.col("y0")) & (p["y"] < F.col("y1"))
    u, v = (q["x"] - F.col("x0")) / width(), (q["y"] - F.col("y0")) / height()
    return df.select("k", box.alias("inside"), ((u > 0) & (v > 0) & (u + v < 1)).alias("in_triangle"))


@query("select k, round((x0+x1)/2, 6) as cx, round((y0+y1)/2, 6) as cy, round(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/2, 6) as r from part_box")
def bounding_circles(spark, sf):
    df = U.spread(corners(spark, sf)).withColumn("c", U.bounding_circle(C.box("x0", "y0", "x1", "y1")))
    return df.select("k", r6(F.col("c.cx"), "cx"), r6(F.col("c.cy"), "cy"), r6(F.col("c.r"), "r"))


@query("select k, 'linear-ring' as kind, 2*(x1-x0+y1-y0) as length, 'multi-point' as line_kind, x0 as xmin, y1 as ymax, 2 as ends from part_box")
def boundaries(spark, sf):
    df = U.spread(corners(spark, sf)).withColumn("b", U.boundary(C.box("x0", "y0", "x1", "y1"))).withColumn("e", U.boundary(C.line_string(_ring(P00, P10, P11))))
    return df.select("k", C.geometry_type("b").alias("kind"), C.length("b").alias("length"), C.geometry_type("e").alias("line_kind"), C.min_x("e").alias("xmin"), C.max_y("e").alias("ymax"), F.size(C.points_of("e")).alias("ends"))


# ---- shapes ------------------------------------------------------------------------------------------------------------


@query("select k, round(w*h - w*h/8, 6) as hull, round(w*h, 6) as concave from (select k, x1-x0 as w, y1-y0 as h from part_box)")
def hull_areas(spark, sf):
    """The hull of an L bridges its notch; the four corners of a box have only the box."""
    mx = (F.col("x0") + F.col("x1")) / 2
    ell = C.polygon(_ring(P00, P10, ("x1", middle()), (mx, middle()), (mx, "y1"), P01, P00))
    four = C.collect(F.array(*(C.point(x, y) for x, y in (P00, P10, P11, P01))), "MultiPoint")
    df = U.spread(corners(spark, sf).withColumn("l", ell).withColumn("f", four)).withColumn("h", U.convex_hull("l")).withColumn("v", U.concave_hull("f", F.lit(0.5)))
    return df.select("k", r6(C.area("h"), "hull"), r6(C.area("v"), "concave"))


@query("select k, round(16*sin(pi()/16)*100, 6) as round_area, round((x1-x0)*10, 6) as flat, round((x1-x0+10)*10, 6) as square from part_box")
def buffer_caps(spark, sf):
    """A disc of 32 sides; a level line with flat and with square ends."""
    df = U.spread(corners(spark, sf).withColumn("p", C.point("x0", "y0")).withColumn("l", C.line_string(_ring(P00, P10))))
    df = df.withColumn("a", U.buffer("p", 10.0)).withColumn("b", U.buffer("l", 5.0, cap="flat")).withColumn("d", U.buffer("l", 5.0, cap="square"))
    return df.select("k", r6(C.area("a"), "round_area"), r6(C.area("b"), "flat"), r6(C.area("d"), "square"))


@query("select k, false as was_valid, true as now_valid, round((x1-x0)*(y1-y0)/2, 6) as area, 2 as polygons from part_box")
def mended_bow_ties(spark, sf):
    df = U.spread(corners(spark, sf).withColumn("g", C.polygon(_ring(P00, P11, P10, P01, P00)))).withColumn("m", U.make_valid("g"))
    return df.select("k", U.is_valid("g").alias("was_valid"), U.is_valid("m").alias("now_valid"), r6(C.area("m"), "area"), F.size(C.polygons_of("m")).alias("polygons"))


@query("select k, (floor(x1/8+0.5)-floor(x0/8+0.5))*8 * (floor(y1/8+0.5)-floor(y0/8+0.5))*8 as area from part_box")
def precision_boxes(spark, sf):
    """Corners on a grid of eight; what collapses has no area."""
    df = U.spread(corners(spark, sf).withColumn("g", U.change_precision(C.box("x0", "y0", "x1", "y1"), F.lit(0.125))))
    return df.select("k", C.area("g").alias("area"))


@query("select k, 2 as n, round(w + h/2, 6) as first, round(h/2, 6) as second from (select k, x1-x0 as w, y1-y0 as h from part_box)")
def split_lines(spark, sf):
    df = U.spread(corners(spark, sf)).withColumn("s", U.split_line(C.line_string(_ring(P00, P10, P11)), C.point("x1", middle())))
    return df.select("k", F.size("s").alias("n"), r6(C.length(F.get("s", F.lit(0))), "first"), r6(C.length(F.get("s", F.lit(1))), "second"))


@query("select k, 2 as n, w + h as longest, 5.0::double as shortest from (select k, x1-x0 as w, y1-y0 as h from part_box)")
def merged_lines(spark, sf):
    """Two lines that meet become one; a third is left alone."""
    line = lambda a, b: C.line_string(_ring(a, b))
    df = U.spread(corners(spark, sf).withColumn("g", C.collect(F.array(line(P10, P00), line(P10, P11), line(P01, (F.col("x0") - 5, "y1")))))).withColumn("m", U.line_merge("g"))
    long = F.transform("m", lambda g: C.length(g))
    return df.select("k", F.size("m").alias("n"), F.array_max(long).alias("longest"), F.array_min(long).alias("shortest"))


@query("""select k, 3 as line_pieces, h/2 as first, w+h as second, w+h/2 as third, 2 as ring_pieces, w+h as wrap, w+h as rest, x1 as wrap_x, 1 as untouched, x0 as back_x, 'linear-ring' as whole
  from (select *, x1-x0 as w, y1-y0 as h from part_box)""")
def cut_rims(spark, sf):
    """A closed line is cut as a line, a ring as a ring: the piece around its start is one. Uncut, a line comes back backwards and a ring as it is."""
    level, away = C.line_string(_ring((F.col("x0") - 1, middle()), (F.col("x1") + 1, middle()))), C.line_string(_ring((F.col("x0") - 9, "y0"), (F.col("x0") - 9, "y1")))
    df = corners(spark, sf).withColumn("l", C.line_string(rim())).withColumn("r", C.linear_ring(rim())).withColumn("c", level).withColumn("f", away)
    df = U.spread(df).select("*", U.cut_line("l", "c").alias("a"), U.cut_line("r", "c").alias("b"), U.cut_line("l", "f").alias("d"), U.cut_line("r", "f").alias("e"))
    part = lambda g, n: C.length(F.get(g, F.lit(n)))
    return df.select(
        "k", F.size("a").alias("line_pieces"), part("a", 0).alias("first"), part("a", 1).alias("second"), part("a", 2).alias("third"), F.size("b").alias("ring_pieces"), part("b", 0).alias("wrap"), part("b", 1).alias("rest"),
        C.first_coordinate(F.get("b", F.lit(0)))["x"].alias("wrap_x"), F.size("d").alias("untouched"), F.get(C.coordinates(F.get("d", F.lit(0))), F.lit(3))["x"].alias("back_x"), C.geometry_type(F.get("e", F.lit(0))).alias("whole"),
    )


@query("select k, 2 as faces, round((x1-x0)*(y1-y0), 6) as area, round((x1-x0)*(y1-y0)/2, 6) as largest from part_box")
def polygonized(spark, sf):
    lines = C.collect(F.array(C.line_string(rim()), C.line_string(_ring(("x0", middle()), ("x1", middle())))))
    df = U.spread(corners(spark, sf).withColumn("g", lines)).withColumn("f", U.polygonize("g"))
    areas = F.transform("f", lambda g: C.area(g))
    return df.select("k", F.size("f").alias("faces"), r6(F.aggregate(areas, F.lit(0.0), lambda s, a: s + a), "area"), r6(F.array_max(areas), "largest"))


# ---- networks ----------------------------------------------------------------------------------------------------------


def _apart(spark, sf):
    """A thousand units for each supplier, so that what belongs to one is far from the rest."""
    return suppliers(spark, sf).select("s", (F.col("s") * 1000.0).alias("x"))


@query("select s_suppkey as s, 2 as edges, 20.0::double as length, 1 as joined from supplier")
def node_snapped(spark, sf):
    """Two lines whose ends miss each other by less than the tolerance are noded as one path."""
    a, b = F.col("x"), F.lit(0.0)
    one = C.line_string(F.array(c(a, b), c(a + 10, b)))
    two = C.line_string(F.array(c(a + 10.06, b + 0.06), c(a + 20, b)))
    df = _apart(spark, sf).select("s", F.explode(F.array(F.struct((F.col("s") * 2).alias("id"), one.alias("geom")), F.struct((F.col("s") * 2 + 1).alias("id"), two.alias("geom")))).alias("l")).select("l.id", "l.geom")
    edges = network.node(df, "id", snap=True)
    at = F.floor((C.min_x("geom") + 1) / 1000)
    ends = C.coordinates("geom")
    met = F.exists(ends, lambda p: p["x"] - F.floor((p["x"] + 1) / 1000) * 1000 == 10)
    return edges.groupBy(at.alias("s")).agg(F.count("*").cast("int").alias("edges"), r6(F.sum(C.length("geom")), "length"), (F.sum(met.cast("int")) == 2).cast("int").alias("joined"))


@query("select s_suppkey as s, 3 as edges, 15.0::double as length, 5.0::double as connector from supplier")
def node_with_points(spark, sf):
    """A point beside a line is joined to the nearest place of it."""
    lines = _apart(spark, sf).select(F.col("s").alias("id"), C.line_string(F.array(c("x", F.lit(0)), c(F.col("x") + 10, F.lit(0)))).alias("geom"))
    points = _apart(spark, sf).select(F.col("s").alias("pid"), C.point(F.col("x") + 3, F.lit(5.0)).alias("geom"))
    got = network.node_with_others(lines, points, "id", "pid", "pid", reach=100.0, snap=False)
    return got.groupBy(F.floor(C.min_x("geom") / 1000).alias("s")).agg(F.count("*").cast("int").alias("edges"), r6(F.sum(C.length("geom")), "length"), r6(F.max(F.when(F.col("other_id").isNotNull(), C.length("geom"))), "connector"))


def _faces(how):
    def run(spark, sf):
        x = F.col("x")
        lines = _apart(spark, sf).select(F.col("s").alias("id"), C.line_string(F.array(c(x, F.lit(0)), c(x + 10, F.lit(1)))).alias("geom"))
        squares = _apart(spark, sf).select(F.col("s").alias("pid"), C.box(x + 4, F.lit(1), x + 6, F.lit(3)).alias("geom"))
        got = network.node_with_others(lines, squares, "id", "pid", "pid", reach=100.0, how=how, snap=False).where("other_id is not null")
        end = F.element_at(C.coordinates("geom"), -1)
        return got.select(F.col("other_id").cast("long").alias("s"), (end["x"] - F.col("other_id").cast("long") * 1000).alias("x"), end["y"].alias("y"))

    return run


@query("select s_suppkey as s, 6.0::double as x, 1.0::double as y from supplier")
def connect_nearest(spark, sf):
    return _faces(network.nearest)(spark, sf)


@query("select s_suppkey as s, 5.0::double as x, 1.0::double as y from supplier")
def connect_faces(spark, sf):
    """The middle of a long face is preferred while hardly farther."""
    return _faces(network.face_connector(2, 1))(spark, sf)


# ---- reference systems -------------------------------------------------------------------------------------------------


@query("select c, round(radians(x / 10007 * 360 - 180) * 6378137, 3) as x, round(ln(tan(pi() / 4 + radians(y / 10009 * 170 - 85) / 2)) * 6378137, 3) as y, 3857 as srid from cust_pt")
def reproject_mercator(spark, sf):
    df = customers(spark, sf).select("c", C.map_coordinates("geom", lambda x, y: x / 10007 * 360 - 180, lambda x, y: y / 10009 * 170 - 85).alias("g")).select("c", crs.reproject("g", 4326, 3857).alias("m"))
    p = C.first_coordinate("m")
    return df.select("c", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"), C.srid("m").alias("srid"))


@query("select 'national grid' as what, 1.72::double as x, 52.66::double as y, 4326 as srid union all select 'utm', 500000.0, 0.0, 32631")
def reproject_known(spark, sf):
    """Published points: one of the national grid in degrees, and a zone's origin."""
    grid = spark.range(1).select(F.lit("national grid").alias("what"), C.point(F.lit(651409.903), F.lit(313177.27)).alias("g")).select("what", crs.reproject("g", 27700, crs.srid_of("EPSG:4326")).alias("g"))
    zone = spark.range(1).select(F.lit("utm").alias("what"), C.point(F.lit(3.0), F.lit(0.0)).alias("g")).select("what", crs.reproject("g", 4326, 32631).alias("g"))
    p = C.first_coordinate("g")
    return grid.unionByName(zone).select("what", F.round(p["x"], 2).alias("x"), (F.round(p["y"], 2) + 0.0).alias("y"), C.srid("g").alias("srid"))
