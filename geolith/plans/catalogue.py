"""Every query of the spatial engine by name, with its SQL where SQL can say it.

Geometry is derived from the relational tables by integer lattice arithmetic, so that coordinates are exact: boxes from part, points from customer
and supplier, tracks from events. Floats are rounded to six places in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs as U
from ..operators import crs, joins, merge, network

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH + sql
        return f

    return keep


# ---- derived geometry --------------------------------------------------------------------------------------------------

WITH = """
with part_box as (select p_partkey as k, p_brand as brand, p_size as size, cast((p_partkey * 7919) % 10007 as double) as x0, cast((p_partkey * 104729) % 10009 as double) as y0,
  cast((p_partkey * 7919) % 10007 + p_size * 4 as double) as x1, cast((p_partkey * 104729) % 10009 + p_size * 4 as double) as y1 from part),
cust_pt as (select c_custkey as c, cast((c_custkey * 6151) % 10007 as double) as x, cast((c_custkey * 3571) % 10009 as double) as y from customer),
supp_pt as (select s_suppkey as s, cast((s_suppkey * 8191) % 10007 as double) as x, cast((s_suppkey * 127) % 10009 as double) as y from supplier),
vertex as (select user_id, ts, value as x, cast(event_id % 1009 as double) as y from events),
step as (select *, lead(x) over w as nx, lead(y) over w as ny, lag(x) over w as px, lag(y) over w as py, row_number() over w as i, count(*) over (partition by user_id) as n from vertex window w as (partition by user_id order by ts))
"""


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corners(spark, sf) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 7919) % 10007, (k * 104729) % 10009
    d = lambda c: c.cast("double")
    return _read(spark, sf, "part").select(k.alias("k"), F.col("p_brand").alias("brand"), s.alias("size"), d(x).alias("x0"), d(y).alias("y0"), d(x + s * 4).alias("x1"), d(y + s * 4).alias("y1"))


def boxes(spark, sf) -> DataFrame:
    return corners(spark, sf).withColumn("geom", C.box("x0", "y0", "x1", "y1", 27700))


def customers(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    return _read(spark, sf, "customer").select(c.alias("c"), C.point((c * 6151) % 10007, (c * 3571) % 10009).alias("geom"))


def suppliers(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return _read(spark, sf, "supplier").select(s.alias("s"), C.point((s * 8191) % 10007, (s * 127) % 10009).alias("geom"))


def tracks(spark, sf) -> DataFrame:
    v = _read(spark, sf, "events").select("user_id", F.struct("ts", F.col("value").alias("x"), (F.col("event_id") % 1009).cast("double").alias("y")).alias("v"))
    line = F.transform(F.sort_array(F.collect_list("v")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return v.groupBy("user_id").agg(line.alias("coords")).select("user_id", C.line_string("coords").alias("geom"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that customers fall in, by brand."""
    hits = joins.spatial_join(boxes(spark, sf).withColumn("area", C.area("geom")), customers(spark, sf), "intersects")  # once a box, not once a hit
    return hits.groupBy("brand").agg(F.count("*").alias("hits"), r6(F.sum("area"), "area"))


# ---- measures and accessors --------------------------------------------------------------------------------------------


@query("select brand, count(*) as hits, round(sum((x1 - x0) * (y1 - y0)), 6) as area from part_box join cust_pt on x between x0 and x1 and y between y0 and y1 group by brand")
def brand_hits(spark, sf):
    return flagship(spark, sf)


@query("""select k, (x1-x0)*(y1-y0) as area, 2*(x1-x0+y1-y0) as length, x0 as xmin, y0 as ymin, x1 as xmax, y1 as ymax,
  round(4*pi()*((x1-x0)*(y1-y0))/power(2*(x1-x0+y1-y0), 2), 6) as thinness, round((x0+x1)/2, 6) as cx, round((y0+y1)/2, 6) as cy from part_box""")
def box_measures(spark, sf):
    e, c = C.envelope("geom"), C.first_coordinate(C.centroid("geom"))
    return boxes(spark, sf).select("k", C.area("geom").alias("area"), C.length("geom").alias("length"), *(e[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")), r6(C.thinness_ratio("geom"), "thinness"), r6(c["x"], "cx"), r6(c["y"], "cy"))


@query("select user_id, round(coalesce(sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))), 0), 6) as length from step group by user_id")
def track_length(spark, sf):
    return tracks(spark, sf).select("user_id", r6(C.length("geom"), "length"))


@query("select user_id, arg_min(x, ts) as sx, arg_min(y, ts) as sy, arg_max(x, ts) as ex, arg_max(y, ts) as ey from vertex group by user_id")
def track_endpoints(spark, sf):
    e = C.endpoints("geom")
    a, b = C.first_coordinate(F.get(F.col("e"), F.lit(0))), C.first_coordinate(F.get(F.col("e"), F.lit(1)))
    return tracks(spark, sf).withColumn("e", e).select("user_id", a["x"].alias("sx"), a["y"].alias("sy"), b["x"].alias("ex"), b["y"].alias("ey"))


@query("select user_id, min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from vertex group by user_id")
def track_bbox(spark, sf):
    return tracks(spark, sf).select("user_id", C.min_x("geom").alias("xmin"), C.min_y("geom").alias("ymin"), C.max_x("geom").alias("xmax"), C.max_y("geom").alias("ymax"))


@query("""select user_id, round(case when sum(l) > 0 then sum(l*(x+nx)/2)/sum(l) else avg(x) end, 6) as cx, round(case when sum(l) > 0 then sum(l*(y+ny)/2)/sum(l) else avg(y) end, 6) as cy
  from (select *, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) as l from step) group by user_id""")
def track_centroid(spark, sf):
    c = C.first_coordinate(C.centroid("geom"))
    return tracks(spark, sf).select("user_id", r6(c["x"], "cx"), r6(c["y"], "cy"))


@query("select k, (x1-x0)*(y1-y0)/2 as area from part_box")
def triangle_area(spark, sf):
    c = C.coordinate
    return corners(spark, sf).select("k", C.area(C.polygon(F.array(c("x0", "y0"), c("x1", "y0"), c("x0", "y1"), c("x0", "y0")))).alias("area"))


@query("select k, (x1-x0)*(y1-y0) - 1 as area, 1 as n_holes, (x1-x0)*(y1-y0) as filled, 1.0::double as hole_area from part_box where x1-x0 > 4")
def holes_filled(spark, sf):
    x, y, c = F.col("x0") + 1, F.col("y0") + 1, C.coordinate
    hole = F.array(F.array(c(x, y), c(x + 1, y), c(x + 1, y + 1), c(x, y + 1), c(x, y)))
    shell = F.array(c("x0", "y0"), c("x0", "y1"), c("x1", "y1"), c("x1", "y0"), c("x0", "y0"))
    df = corners(spark, sf).where("x1 - x0 > 4").withColumn("g", C.polygon(shell, hole))
    return df.select("k", C.area("g").alias("area"), F.size(C.holes("g")).cast("long").alias("n_holes"), C.area(C.fill_holes("g")).alias("filled"), C.area(F.get(C.holes("g"), F.lit(0))).alias("hole_area"))


@query("select size, count(*) as n_parts, min(x0) as xmin, max(y0) as ymax, 'multi-point' as kind from part_box group by size")
def multipoint_bbox(spark, sf):
    pts = corners(spark, sf).select("size", C.point("x0", "y0").alias("p")).groupBy("size").agg(C.collect(F.collect_list("p"), "MultiPoint").alias("g"))
    return pts.select("size", F.size(C.points_of("g")).cast("long").alias("n_parts"), C.min_x("g").alias("xmin"), C.max_y("g").alias("ymax"), C.geometry_type("g").alias("kind"))


@query("select k, t.kind, t.area from part_box, lateral (values ('point', 0.0), ('polygon', (x1-x0)*(y1-y0)), ('point', 0.0)) t(kind, area)")
def single_parts(spark, sf):
    inner = C.collect(F.array(C.box("x0", "y0", "x1", "y1"), C.point("x1", "y1")))
    df = corners(spark, sf).withColumn("g", C.collect(F.array(C.point("x0", "y0"), inner)))
    parts = df.select("k", F.explode(C.single_geometries("g")).alias("p"))
    return parts.select("k", C.geometry_type("p").alias("kind"), C.area("p").alias("area"))


@query("select min(x0) as xmin, min(y0) as ymin, max(x1) as xmax, max(y1) as ymax from part_box")
def layer_extent(spark, sf):
    return boxes(spark, sf).agg(C.extent("geom").alias("e")).select("e.*")


# ---- joins -------------------------------------------------------------------------------------------------------------


def _pairs(df, a="k", b="k_right"):
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"))


@query("select k as a, c as b from part_box join cust_pt on x between x0 and x1 and y between y0 and y1")
def point_in_box(spark, sf):
    return _pairs(joins.spatial_join(boxes(spark, sf), customers(spark, sf)), "k", "c")


@query("select k as a, c as b from part_box join cust_pt on x > x0 and x < x1 and y > y0 and y < y1")
def box_contains_point(spark, sf):
    return _pairs(joins.spatial_join(boxes(spark, sf), customers(spark, sf), "contains"), "k", "c")


@query("select a.k as a, b.k as b from part_box a join part_box b on a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1 where not (a.x0 >= b.x0 and a.x1 <= b.x1 and a.y0 >= b.y0 and a.y1 <= b.y1) and not (b.x0 >= a.x0 and b.x1 <= a.x1 and b.y0 >= a.y0 and b.y1 <= a.y1)")
def box_overlaps_box(spark, sf):
    return _pairs(joins.spatial_join(boxes(spark, sf), boxes(spark, sf), "overlaps"))


@query("select a.k as a, b.k as b from part_box a join part_box b on b.x0 >= a.x0 and b.x1 <= a.x1 and b.y0 >= a.y0 and b.y1 <= a.y1")
def box_covered_by(spark, sf):
    return _pairs(joins.spatial_join(boxes(spark, sf), boxes(spark, sf), "covers"))


@query("select a.k as a, b.k as b from part_box a join part_box b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1 where a.x0 = b.x1 or a.x1 = b.x0 or a.y0 = b.y1 or a.y1 = b.y0")
def box_touches(spark, sf):
    return _pairs(joins.spatial_join(boxes(spark, sf), boxes(spark, sf), "touches"))


@query("select a.k as a, b.k as b from part_box a join part_box b on (b.x0+b.x1)/2 between a.x0 and a.x1 and (b.y0+b.y1)/2 between a.y0 and a.y1")
def centroid_in_box(spark, sf):
    return _pairs(joins.centroid_join(boxes(spark, sf), boxes(spark, sf)))


@query("select a.k as a, b.k as b from part_box a join part_box b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1")
def envelope_query(spark, sf):
    return _pairs(joins.envelope_join(boxes(spark, sf), boxes(spark, sf)))


@query("select s as a, c as b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) as distance from supp_pt a join cust_pt b on sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 250")
def radius_query(spark, sf):
    got = joins.radius_join(suppliers(spark, sf), customers(spark, sf), 250.0)
    return got.select(F.col("s").alias("a"), F.col("c").alias("b"), r6(F.col("envelope_distance"), "distance"))


@query("select s, c, rank, distance from (select s, c, row_number() over (partition by s order by d, c) as rank, round(d, 6) as distance from (select s, c, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as d from supp_pt a cross join cust_pt b) where d < 1500) where rank <= 5")
def knn_supplier_customer(spark, sf):
    got = joins.neighbours(suppliers(spark, sf), customers(spark, sf), "s", 1500.0, 5, "c")
    return got.select("s", "c", "rank", r6(F.col("distance"), "distance"))


@query("select k from part_box where k % 3 <> 0")
def index_maintenance(spark, sf):
    df = boxes(spark, sf).select("k", "geom")
    hollow = df.limit(0).unionByName(df.where("k % 3 = 1").select("k", F.lit(None).cast(df.schema["geom"].dataType).alias("geom")))
    entries = joins.index_entries(joins.index_add(df.where("k % 2 = 0"), df.where("k % 2 = 1")).unionByName(hollow))
    return joins.index_delete(entries, df.where("k % 3 = 0"), "k").select("k")


# ---- overlay of boxes -------------------------------------------------------------------------------------------------

PAIR_SQL = """select a.k as a, b.k as b, round({0}, 6) as area from part_box a join part_box b on a.k < b.k and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"""
BOTH = "((least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)))"
A, B = "((a.x1-a.x0)*(a.y1-a.y0))", "((b.x1-b.x0)*(b.y1-b.y0))"


def _overlay(op):
    def run(spark, sf):
        made = joins.overlay_join(boxes(spark, sf).select("k", "geom"), boxes(spark, sf).select("k", "geom"), op).where("k < k_right")
        return made.select(F.col("k").alias("a"), F.col("k_right").alias("b"), r6(C.area("overlay"), "area"))

    return run


for _name, _op, _sql in (
    ("box_intersection", "intersection", BOTH),
    ("box_union_area", "union", f"{A} + {B} - {BOTH}"),
    ("box_difference_area", "difference", f"{A} - {BOTH}"),
    ("box_symdiff_area", "symdifference", f"{A} + {B} - 2 * {BOTH}"),
):
    QUERIES[_name], ORACLES[_name] = _overlay(_op), WITH + PAIR_SQL.format(_sql)


@query(""", xs as (select distinct brand, x from (select brand, x0 as x from part_box union all select brand, x1 from part_box)), strip as (select brand, x, lead(x) over (partition by brand order by x) as nx from xs),
 cover as (select s.brand, s.x, s.nx, b.y0, b.y1, max(b.y1) over (partition by s.brand, s.x order by b.y0, b.y1, b.k rows between unbounded preceding and 1 preceding) as before from strip s join part_box b on b.brand = s.brand and b.x0 <= s.x and b.x1 >= s.nx where s.nx is not null)
 select brand, round(sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(before, y0)))), 6) as area, true as ok from cover group by brand""")
def brand_union(spark, sf):
    """Union of each brand's boxes; the SQL sweeps over strips between neighbouring edges."""
    df = boxes(spark, sf)
    whole = U.union_all(df.select("brand", "geom"), ["brand"])
    return whole.select("brand", r6(C.area("geom"), "area"), U.is_valid("geom").alias("ok"))


# ---- shapes ------------------------------------------------------------------------------------------------------------


@query("""select user_id, round(coalesce(sum(sqrt((dx)*(dx)+(dy)*(dy))), 0), 6) as length, (sum(1) + 1)::bigint as n_coords from (
 select user_id, lead(cx) over (partition by user_id order by i, j) - cx as dx, lead(cy) over (partition by user_id order by i, j) - cy as dy from (
  select user_id, i, t.j, t.cx, t.cy from step, lateral (values (0, case when i = 1 or i = n then x else px + (x - px) * 0.75 end, case when i = 1 or i = n then y else py + (y - py) * 0.75 end, true),
   (1, x + (nx - x) * 0.25, y + (ny - y) * 0.25, i > 1 and i < n)) t(j, cx, cy, there) where t.there)) where dx is not null group by user_id""")
def smooth_1(spark, sf):
    df = tracks(spark, sf).where(F.size(C.coordinates("geom")) > 1).withColumn("g", C.smooth("geom", 1))
    return df.select("user_id", r6(C.length("g"), "length"), F.size(C.coordinates("g")).cast("long").alias("n_coords"))


@query("select user_id, round(sum(l), 6) as length, cast(sum(greatest(1, ceil(l / 100.0))) + 1 as bigint) as n_coords from (select user_id, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) as l from step where nx is not null) group by user_id")
def densify_track(spark, sf):
    df = tracks(spark, sf).where(F.size(C.coordinates("geom")) > 1).withColumn("g", C.densify("geom", 100.0))
    return df.select("user_id", r6(C.length("g"), "length"), F.size(C.coordinates("g")).cast("long").alias("n_coords"))


@query("select k, x0 + (x1 - x0) * 0.25 as x, y0 + (y1 - y0) * 0.25 as y from part_box")
def interpolate_quarter(spark, sf):
    c = C.interpolate(C.coordinate("x0", "y0"), C.coordinate("x1", "y1"), 0.25)
    return corners(spark, sf).select("k", c["x"].alias("x"), c["y"].alias("y"))


@query("select k, x0 - 100 + i * 100 as xmin, y0 - 100 + j * 100 as ymin from part_box, range(0, cast(ceil((x1-x0+200)/100) as bigint)) r(i), range(0, cast(ceil((y1-y0+200)/100) as bigint)) q(j)")
def make_grid(spark, sf):
    return boxes(spark, sf).select("k", F.explode(C.boxes_of_grid(C.envelope("geom"), 100.0)).alias("cell")).select("k", F.col("cell.xmin"), F.col("cell.ymin"))


@query("select c, 'POINT (' || cast(cast(x as bigint) as varchar) || ' ' || cast(cast(y as bigint) as varchar) || ')' as wkt, x, y from cust_pt")
def wkt_point(spark, sf):
    p = C.first_coordinate("back")
    return U.spread(customers(spark, sf)).withColumn("wkt", U.to_wkt("geom")).withColumn("back", U.from_wkt("wkt")).select("c", "wkt", p["x"].alias("x"), p["y"].alias("y"))


@query("select c, '47500001' || lpad(hex(27700 % 256), 2, '0') || lpad(hex(27700 // 256), 2, '0') || '0000' as header, x, y, 27700 as srid from cust_pt")
def gpkg_blob(spark, sf):
    b = U.spread(customers(spark, sf)).withColumn("blob", U.gpkg_encode("geom", F.lit(27700))).withColumn("back", U.gpkg_decode("blob"))
    p = C.first_coordinate("back")
    return b.select("c", F.hex(F.substring("blob", 1, 8)).alias("header"), p["x"].alias("x"), p["y"].alias("y"), C.srid("back").alias("srid"))


@query("select k, round((x1-x0+20)*(y1-y0+20), 6) as grown, round(greatest(x1-x0-2, 0)*greatest(y1-y0-2, 0), 6) as shrunk from part_box")
def mitre_buffer(spark, sf):
    df = U.spread(boxes(spark, sf)).withColumn("g", U.buffer("geom", 10.0, join="mitre")).withColumn("s", U.buffer("geom", -1.0, join="mitre"))
    return df.select("k", r6(C.area("g"), "grown"), r6(C.area("s"), "shrunk"))


@query("select user_id, 1 as ok from vertex group by user_id having count(*) >= 3")
def track_hulls(spark, sf):
    """Hulls, circles and inner points hold what they should."""
    df = U.spread(tracks(spark, sf).where(F.size(C.coordinates("geom")) >= 3)).withColumn("h", U.convex_hull("geom")).withColumn("p", U.interior_point("h")).withColumn("c", U.bounding_circle("geom"))
    df = df.withColumn("holds", U.covers("h", "geom")).withColumn("inside", U.intersects("h", "p"))
    return df.where(F.col("holds") & F.col("inside") & (F.col("c.r") > 0)).select("user_id", F.lit(1).alias("ok"))


@query("select k, 'FF2F11212' as matrix, true as valid from part_box where false union all select k, '2FFF1FFF2', true from part_box")
def relate_self(spark, sf):
    return U.spread(boxes(spark, sf)).withColumn("matrix", U.relate("geom", "geom")).withColumn("valid", U.is_valid("geom")).select("k", "matrix", "valid")


@query("select k, 2 as pieces, round(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), 6) as length from part_box")
def cut_diagonal(spark, sf):
    """Each box's diagonal cut by the other one."""
    c = C.coordinate
    df = U.spread(corners(spark, sf)).withColumn("a", C.line_string(F.array(c("x0", "y0"), c("x1", "y1")))).withColumn("b", C.line_string(F.array(c("x0", "y1"), c("x1", "y0"))))
    cut = df.withColumn("pieces", U.cut_line("a", "b"))
    return cut.select("k", F.size("pieces").alias("pieces"), r6(F.aggregate("pieces", F.lit(0.0), lambda s, p: s + C.length(p)), "length"))


@query("select k, 2 as n, round((x1-x0)*(y1-y0), 6) as area from part_box")
def cut_box(spark, sf):
    """Each box cut by its diagonal."""
    c = C.coordinate
    df = U.spread(boxes(spark, sf)).withColumn("d", C.line_string(F.array(c("x0", "y0"), c("x1", "y1")))).withColumn("parts", U.cut_polygon("geom", "d"))
    return df.select("k", F.size("parts").alias("n"), r6(F.aggregate("parts", F.lit(0.0), lambda s, p: s + C.area(p)), "area"))


# ---- amend -------------------------------------------------------------------------------------------------------------


def _target(spark, sf):
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))


def _updates(spark, sf, twice: bool):
    u = _read(spark, sf, "orders").select((F.col("o_orderkey") / 10).cast("long").alias("id"), F.col("o_totalprice").alias("bal"), F.col("o_orderpriority").alias("pri"))
    return u if twice else u.groupBy("id").agg(F.max("bal").alias("bal"), F.max("pri").alias("pri"))


UPD = "upd as (select cast(o_orderkey // 10 as bigint) as id, o_totalprice as bal, o_orderpriority as pri from orders){0}, tgt as (select c_custkey as id, c_acctbal as bal, c_mktsegment as seg from customer) "
ONCE = ", upd1 as (select id, max(bal) as bal, max(pri) as pri from upd group by id)"
for _method, _join in (("update-set", "left join"), ("left-join", "left join"), ("outer-join", "full join"), ("right-join", "right join")):
    for _policy in ("set-null", "preserve", "drop-column"):

        def _run(spark, sf, _method=_method, _policy=_policy):
            got = merge.amend(_target(spark, sf), _updates(spark, sf, _method != "update-set"), "id", _method, _policy)
            return got.select("id", "seg", F.round("bal", 6).alias("bal"), "pri")

        _name = f"amend_{_method}_{_policy}".replace("-", "_")
        _twice = _method != "update-set"
        _new = "case when u.id is not null then u.bal else t.bal end" if _policy == "preserve" else "u.bal"
        QUERIES[_name] = _run
        ORACLES[_name] = WITH + ", " + UPD.format("" if _twice else ONCE) + f"select coalesce(t.id, u.id) as id, t.seg, round({_new}, 6) as bal, u.pri from tgt t {_join} {'upd' if _twice else 'upd1'} u on t.id = u.id"


@query(", " + UPD.format("") + "select id, count(*) as n from upd where id is not null group by id having count(*) > 1")
def amend_duplicates(spark, sf):
    return merge.duplicate_keys(_updates(spark, sf, True), "id")


# ---- networks, reference systems ---------------------------------------------------------------------------------------


@query(""", h as (select k, y0 as c, x0 as lo, x1 as hi from part_box union all select k, y1, x0, x1 from part_box), v as (select k, x0 as c, y0 as lo, y1 as hi from part_box union all select k, x1, y0, y1 from part_box),
 ends as (select 0 as flat, c, lo as p from v union all select 0, c, hi from v union all select 1, c, lo from h union all select 1, c, hi from h),
 met as (select v.c as x, h.c as y from v join h on h.c between v.lo and v.hi and v.c between h.lo and h.hi),
 cuts as (select * from ends union select 0, x, y from met union select 1, y, x from met),
 steps as (select s.flat, s.c, s.k, s.lo, q.p, lead(q.p) over (partition by s.flat, s.c, s.k, s.lo order by q.p) as nx
  from (select 0 as flat, k, c, lo, hi from v union all select 1, k, c, lo, hi from h) s join cuts q on q.flat = s.flat and q.c = s.c and q.p between s.lo and s.hi),
 e as (select distinct flat, c, p, nx from steps where nx is not null)
 select count(*) as n_edges, round(sum(nx - p), 6) as length from e""")
def node_boxes(spark, sf):
    """The rims of all boxes, noded and dissolved. Along a line of the lattice, edges between neighbouring nodes."""
    rims = boxes(spark, sf).select(F.col("k").alias("line_id"), C.line_string(F.col("geom.parts")[0]["rings"][0]).alias("geom"))
    edges = network.node(rims, "line_id", scale=1.0, snap=False)
    return edges.agg(F.count("*").alias("n_edges"), r6(F.sum(C.length("geom")), "length"))


@query()
def reproject_points(spark, sf):
    df = customers(spark, sf).select("c", C.map_coordinates("geom", lambda x, y: x * 20 + 300000, lambda x, y: y * 20 + 200000).alias("g")).select("c", "g", crs.reproject("g", 27700, 4326).alias("w"))
    p = C.first_coordinate("w")
    return df.select("c", r6(p["x"], "lon"), r6(p["y"], "lat"), C.srid("w").alias("srid"))


@query("select c, true as close from cust_pt")
def reproject_round_trip(spark, sf):
    """National grid to longitude and latitude and back, to the centimetre."""
    df = customers(spark, sf).select("c", C.map_coordinates("geom", lambda x, y: x * 20 + 300000, lambda x, y: y * 20 + 200000).alias("g"))
    df = df.withColumn("b", crs.reproject(crs.reproject("g", 27700, 4326), 4326, 27700))
    return df.select("c", (C.point_distance("g", "b") < 0.01).alias("close"))


# the other queries register themselves
from . import files, shapes  # noqa: E402, F401
