"""Geometry functions as built-in expressions: constructors, accessors, measures and reshaping, with no Python per row."""

from __future__ import annotations

from functools import wraps
from types import FunctionType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import GEOM, MULTI, PART

NO_PATH = "cast(array() as array<struct<i:int,kind:string>>)"
NO_RINGS = "cast(array() as array<array<struct<x:double,y:double>>>)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _geom(kind: str, srid, *rings: Column) -> Column:
    part = F.struct(F.expr(NO_PATH).alias("path"), F.lit(kind).alias("kind"), F.array(*rings).alias("rings"))
    return F.struct(F.lit(kind).alias("kind"), F.lit(srid).cast("int").alias("srid"), F.array(part).alias("parts")).cast(GEOM)


# ---- constructors ------------------------------------------------------------------------------------------------------


def coordinate(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def point(x, y, srid: int = 0) -> Column:
    """Null where a coordinate is null."""
    x, y = _col(x), _col(y)
    return F.when(x.isNotNull() & y.isNotNull(), _geom("Point", srid, F.array(coordinate(x, y))))


def line_string(coords, srid: int = 0) -> Column:
    """From an array of coordinates."""
    return F.when(_col(coords).isNotNull(), _geom("LineString", srid, _col(coords)))


def linear_ring(coords, srid: int = 0) -> Column:
    """Must be closed."""
    c = _col(coords)
    closed = F.element_at(c, 1).eqNullSafe(F.element_at(c, -1)) & (F.size(c) > 3)
    return F.when(closed, _geom("LinearRing", srid, c)).when(c.isNotNull(), F.raise_error(F.lit("a linear ring is closed and has four coordinates or more")).cast(GEOM))


def polygon(shell, holes=None, srid: int = 0) -> Column:
    rings = F.array(_col(shell)) if holes is None else F.concat(F.array(_col(shell)), _col(holes))
    part = F.struct(F.expr(NO_PATH).alias("path"), F.lit("Polygon").alias("kind"), rings.alias("rings"))
    return F.when(_col(shell).isNotNull(), F.struct(F.lit("Polygon").alias("kind"), F.lit(srid).alias("srid"), F.array(part).alias("parts")).cast(GEOM))


def box(x0, y0, x1, y1, srid: int = 0) -> Column:
    """Five vertices, clockwise from the least corner."""
    x0, y0, x1, y1 = map(_col, (x0, y0, x1, y1))
    c = coordinate
    whole = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(whole, _geom("Polygon", srid, F.array(c(x0, y0), c(x0, y1), c(x1, y1), c(x1, y0), c(x0, y0))))


def envelope_polygon(env) -> Column:
    e = _col(env)
    return box(e["xmin"], e["ymin"], e["xmax"], e["ymax"])


def square(x, y, edge, srid: int = 0) -> Column:
    """By centre and edge."""
    x, y, h = _col(x), _col(y), _col(edge) / 2
    return box(x - h, y - h, x + h, y + h, srid)


def circle(x, y, r, quad_segments: int = 8, srid: int = 0) -> Column:
    x, y, r, n = _col(x), _col(y), _col(r), 4 * quad_segments
    at = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.pmod(k, F.lit(n)) * (-2 * 3.141592653589793 / n))
    return polygon(F.transform(at, lambda a: coordinate(x + r * F.cos(a), y + r * F.sin(a))), srid=srid)


def collect(geoms, kind: str = "GeometryCollection", srid: int = 0) -> Column:
    """One collection of an array of geometries (empty and null members have no parts). A group's: collect(F.collect_list(g), kind)."""
    if kind not in MULTI:
        raise ValueError(f"not a collection: {kind}")
    nested = F.transform(
        _col(geoms),
        lambda g, i: F.transform(
            g["parts"],
            lambda p: F.struct(F.concat(F.array(F.struct(i.cast("int").alias("i"), g["kind"].alias("kind"))), p["path"]).alias("path"), p["kind"].alias("kind"), p["rings"].alias("rings")),
        ),
    )
    return F.struct(F.lit(kind).alias("kind"), F.lit(srid).alias("srid"), F.flatten(F.filter(nested, lambda x: x.isNotNull())).alias("parts")).cast(GEOM)


# ---- accessors ---------------------------------------------------------------------------------------------------------


def geometry_type(g) -> Column:
    """point, multi-line-string and so on; unknown for any other kind."""
    names = {"Point": "point", "LineString": "line-string", "LinearRing": "linear-ring", "Polygon": "polygon", "MultiPoint": "multi-point", "MultiLineString": "multi-line-string", "MultiPolygon": "multi-polygon", "GeometryCollection": "geometry-collection"}
    kind = _col(g)["kind"]
    return F.when(kind.isNotNull(), F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[kind], F.lit("unknown")))


def is_kind(g, *kinds: str) -> Column:
    """False for null."""
    return F.coalesce(_col(g)["kind"].isin(*kinds), F.lit(False))


def is_single(g) -> Column:
    return is_kind(g, "Point", "Polygon", "LineString", "LinearRing")


def is_multi(g) -> Column:
    return is_kind(g, *MULTI)


def srid(g) -> Column:
    return _col(g)["srid"]


def is_empty(g) -> Column:
    return ~F.exists(_col(g)["parts"], lambda p: F.exists(p["rings"], lambda r: F.size(r) > 0))


def coordinates(g) -> Column:
    return F.flatten(F.flatten(_col(g)["parts"]["rings"]))


def first_coordinate(g) -> Column:
    return F.get(coordinates(g), F.lit(0))


def endpoints(g) -> Column:
    """First and last point of a LineString; null for anything else."""
    r = F.get(F.get(_col(g)["parts"], F.lit(0))["rings"], F.lit(0))
    two = F.array(F.element_at(r, 1), F.element_at(r, -1))
    return F.when(is_kind(g, "LineString") & ~is_empty(g), F.transform(two, lambda c: point(c["x"], c["y"])))


def _one(kind, part: Column, g: Column) -> Column:
    return F.struct(kind.alias("kind"), g["srid"].alias("srid"), F.array(F.struct(F.expr(NO_PATH).alias("path"), part["kind"].alias("kind"), part["rings"].alias("rings"))).alias("parts"))


def single_geometries(g, *kinds: str) -> Column:
    """Simple parts, however deep, of the given kinds or all."""
    g = _col(g)
    parts = F.filter(g["parts"], lambda p: (F.size(p["rings"]) > 0) & (p["kind"].isin(*kinds) if kinds else F.lit(True)))
    return F.transform(parts, lambda p: _one(p["kind"], p, g))


def polygons_of(g) -> Column:
    return single_geometries(g, "Polygon")


def line_strings_of(g) -> Column:
    return single_geometries(g, "LineString", "LinearRing")


def points_of(g) -> Column:
    return single_geometries(g, "Point")


def geometries(g) -> Column:
    """Direct children, which may themselves have parts; a simple geometry is its own child."""
    g = _col(g)
    numbers = F.array_distinct(F.transform(g["parts"], lambda p: F.get(p["path"], F.lit(0))["i"]))

    def child(i):
        own = F.filter(g["parts"], lambda p: F.get(p["path"], F.lit(0))["i"] == i)
        kind = F.get(F.get(own, F.lit(0))["path"], F.lit(0))["kind"]
        less = F.transform(own, lambda p: F.struct(F.slice(p["path"], 2, F.greatest(F.size(p["path"]), F.lit(1))).alias("path"), p["kind"].alias("kind"), p["rings"].alias("rings")))
        return F.struct(kind.alias("kind"), g["srid"].alias("srid"), less.alias("parts"))

    return F.when(is_multi(g), F.transform(numbers, child)).otherwise(F.array(F.struct(g["kind"].alias("kind"), g["srid"].alias("srid"), g["parts"].alias("parts"))))


def explode_parts(df: DataFrame, geom: str = "geom", *kinds: str) -> DataFrame:
    """A copy of the row for each simple part of the kinds."""
    return df.withColumn(geom, F.explode(single_geometries(geom, *kinds)))


def exterior_ring(g) -> Column:
    g = _col(g)
    ring = F.get(F.get(g["parts"], F.lit(0))["rings"], F.lit(0))
    return F.when(is_kind(g, "Polygon") & ~is_empty(g), _geom("LinearRing", 0, ring)).when(is_kind(g, "Polygon"), F.lit(None).cast(GEOM)).otherwise(F.when(g.isNotNull(), F.raise_error(F.lit("exterior_ring takes a polygon")).cast(GEOM)))


def holes(g) -> Column:
    """Inner rings of every polygon part, as polygons."""
    g = _col(g)
    rings = F.flatten(F.transform(F.filter(g["parts"], lambda p: p["kind"] == "Polygon"), lambda p: F.slice(p["rings"], 2, F.greatest(F.size(p["rings"]), F.lit(1)))))
    part = lambda r: F.struct(F.expr(NO_PATH).alias("path"), F.lit("Polygon").alias("kind"), F.array(r).alias("rings"))
    return F.transform(rings, lambda r: F.struct(F.lit("Polygon").alias("kind"), g["srid"].alias("srid"), F.array(part(r)).alias("parts")))


def map_parts(g, f) -> Column:
    """The geometry with f(rings, kind) for the rings of each part."""
    g = _col(g)
    parts = F.transform(g["parts"], lambda p: F.struct(p["path"].alias("path"), p["kind"].alias("kind"), f(p["rings"], p["kind"]).alias("rings")))
    return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), g["srid"].alias("srid"), parts.alias("parts")))


def fill_holes(g) -> Column:
    return map_parts(g, lambda rings, kind: F.when(kind == "Polygon", F.slice(rings, 1, 1)).otherwise(rings))


def map_coordinates(g, fx, fy) -> Column:
    return map_parts(g, lambda rings, _: F.transform(rings, lambda r: F.transform(r, lambda c: F.struct(fx(c["x"], c["y"]).alias("x"), fy(c["x"], c["y"]).alias("y")))))


def with_srid(g, srid: int) -> Column:
    return _col(g).withField("srid", F.lit(srid))


# ---- envelopes and measures --------------------------------------------------------------------------------------------


def envelope(g) -> Column:
    """Null for empty geometries."""
    c = coordinates(g)
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    whole = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return F.when(F.size(c) > 0, whole)


def min_x(g) -> Column:
    return envelope(g)["xmin"]


def min_y(g) -> Column:
    return envelope(g)["ymin"]


def max_x(g) -> Column:
    return envelope(g)["xmax"]


def max_y(g) -> Column:
    return envelope(g)["ymax"]


def _fold(ring: Column, f) -> Column:
    """Sum of f(start, end) over a ring's segments, in order."""
    zero = F.lit(0.0)
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.when(F.size(ring) > 1, F.aggregate(steps, zero, lambda acc, i: acc + f(F.get(ring, i - 1), F.get(ring, i)))).otherwise(zero)


def _total(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x))


def _segment(a, b) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def length(g) -> Column:
    """Of lines, and of the rims of polygons, holes too; 0 for points."""
    return _total(_col(g)["parts"], lambda p: F.when(p["kind"] == "Point", F.lit(0.0)).otherwise(_total(p["rings"], lambda r: _fold(r, _segment))))


def _ring_area(r: Column) -> Column:
    """Signed; about the first vertex."""
    o = F.get(r, F.lit(0))
    return _fold(r, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])) / 2


def area(g) -> Column:
    """Shells less holes; 0 for lines and points."""
    own = lambda p: _total(p["rings"], lambda r: -F.abs(_ring_area(r)))
    return _total(_col(g)["parts"], lambda p: F.when(p["kind"] == "Polygon", own(p) + 2 * F.abs(_ring_area(F.get(p["rings"], F.lit(0))))).otherwise(F.lit(0.0)))


def thinness_ratio(g) -> Column:
    p = length(g)
    return F.when(p > 0, 4 * 3.141592653589793 * area(g) / (p * p))


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def centroid(g) -> Column:
    """Of the parts of the highest dimension, weighted by area, length or number; null if empty."""
    g = _col(g)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc, w, x, y):
        return F.struct((acc["w"] + w).alias("w"), (acc["x"] + w * x).alias("x"), (acc["y"] + w * y).alias("y"))

    def over(rings, f):
        return F.aggregate(
            rings, zero,
            lambda acc, s: F.when(F.size(s["r"]) > 1, F.aggregate(F.sequence(F.lit(1), F.size(s["r"]) - 1), acc, lambda a, i: f(a, s, F.get(s["r"], i - 1), F.get(s["r"], i)))).otherwise(acc),
        )

    def of(origin):
        # signed rings: shells count as counter-clockwise, holes as clockwise
        ringed = F.flatten(F.transform(F.filter(g["parts"], lambda p: p["kind"] == "Polygon"), lambda p: F.transform(p["rings"], lambda r, i: F.struct(r.alias("r"), (F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(_ring_area(r))).alias("s")))))

        def triangle(acc, s, a, b):
            w = s["s"] * ((a["x"] - origin["x"]) * (b["y"] - origin["y"]) - (b["x"] - origin["x"]) * (a["y"] - origin["y"])) / 2
            return add(acc, w, (a["x"] + b["x"] - 2 * origin["x"]) / 3, (a["y"] + b["y"] - 2 * origin["y"]) / 3)

        lines = F.transform(F.flatten(F.filter(g["parts"], lambda p: p["kind"] != "Point")["rings"]), lambda r: F.struct(r.alias("r"), F.lit(1.0).alias("s")))
        by_length = over(lines, lambda acc, s, a, b: add(acc, _segment(a, b), (a["x"] + b["x"]) / 2 - origin["x"], (a["y"] + b["y"]) / 2 - origin["y"]))
        by_count = F.aggregate(coordinates(g), zero, lambda acc, c: add(acc, F.lit(1.0), c["x"] - origin["x"], c["y"] - origin["y"]))
        # the next kind of weight is worked out only where the last one is nothing
        best = _let(over(ringed, triangle), lambda x: F.when(x["w"] > 0, x).otherwise(_let(by_length, lambda y: F.when(y["w"] > 0, y).otherwise(by_count))))
        return _let(best, lambda m: point(origin["x"] + m["x"] / m["w"], origin["y"] + m["y"] / m["w"]))

    return F.when(~is_empty(g), _let(first_coordinate(g), of))


def interpolate(a, b, share) -> Column:
    """Between two coordinates; the very ends at 0 and 1."""
    a, b, t = _col(a), _col(b), _col(share) if not isinstance(share, int | float) else F.lit(float(share))
    mid = coordinate(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)
    return F.when(t == 0, a).when(t == 1, b).otherwise(mid)


def point_distance(a, b) -> Column:
    """Of two points."""
    return _segment(first_coordinate(a), first_coordinate(b))


def envelope_distance(a, b) -> Column:
    """Of two envelopes; 0 where they meet."""
    a, b = _col(a), _col(b)
    dx = F.greatest(a["xmin"] - b["xmax"], b["xmin"] - a["xmax"], F.lit(0.0))
    dy = F.greatest(a["ymin"] - b["ymax"], b["ymin"] - a["ymax"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


# ---- reshaping ---------------------------------------------------------------------------------------------------------


def densify(g, most: float) -> Column:
    """No segment longer than `most`."""

    def dense(r):
        def cut(i):
            a, b = F.get(r, i - 1), F.get(r, i)
            n = F.greatest(F.lit(1), F.ceil(_segment(a, b) / most))
            inner = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.when(k == n, b).otherwise(coordinate(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n)))
            return inner

        return F.when(F.size(r) > 1, F.concat(F.slice(r, 1, 1), F.flatten(F.transform(F.sequence(F.lit(1), F.size(r) - 1), cut)))).otherwise(r)

    return map_parts(g, lambda rings, _: F.transform(rings, dense))


def smooth(g, iterations: int = 1) -> Column:
    """Corner cutting of LineStrings that keeps both ends: each inner vertex gives way to points three quarters along the segment
    before it and one quarter along the one after it. Two points stay as they are."""

    def once(r):
        n = F.size(r)

        def corner(i):
            a, b, c = F.get(r, i - 1), F.get(r, i), F.get(r, i + 1)
            return F.array(coordinate(a["x"] + (b["x"] - a["x"]) * 0.75, a["y"] + (b["y"] - a["y"]) * 0.75), coordinate(b["x"] + (c["x"] - b["x"]) * 0.25, b["y"] + (c["y"] - b["y"]) * 0.25))

        return F.when(n > 2, F.concat(F.slice(r, 1, 1), F.flatten(F.transform(F.sequence(F.lit(1), n - 2), corner)), F.slice(r, -1, 1))).otherwise(r)

    g = _col(g)
    out = g
    for _ in range(iterations):
        out = map_parts(out, lambda rings, _k: F.transform(rings, once))
    return F.when(is_kind(g, "LineString") | is_empty(g), out).otherwise(F.when(g.isNotNull(), F.raise_error(F.lit("smooth takes a LineString")).cast(GEOM)))


def boxes_of_grid(env, size: float) -> Column:
    """Cells of `size` over an envelope that is first widened by `size` on every side; by x, then y, while below the upper edge."""
    e = _col(env)

    def starts(lo, hi):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((hi - lo + 2 * size) / size) - 1)), lambda k: lo - size + k * size)

    xs, ys = starts(e["xmin"], e["xmax"]), starts(e["ymin"], e["ymax"])
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("xmin"), y.alias("ymin"), (x + size).alias("xmax"), (y + size).alias("ymax")))))


def extent(g) -> Column:
    """Aggregate: the envelope of a group, null and empty geometries skipped."""
    e = envelope(g)
    whole = F.struct(F.min(e["xmin"]).alias("xmin"), F.min(e["ymin"]).alias("ymin"), F.max(e["xmax"]).alias("xmax"), F.max(e["ymax"]).alias("ymax"))
    return F.when(F.count(e["xmin"]) > 0, whole)


def part_type():
    return PART


# ---- text --------------------------------------------------------------------------------------------------------------


def point_wkt(g) -> Column:
    """WKT of a point with whole coordinates within 2^53; other numbers go through the general writer."""
    c = first_coordinate(g)
    text = lambda v: v.cast("long").cast("string")
    return F.when(is_kind(g, "Point"), F.when(is_empty(g), F.lit("POINT EMPTY")).otherwise(F.concat(F.lit("POINT ("), text(c["x"]), F.lit(" "), text(c["y"]), F.lit(")"))))


def _named(f):
    """Results carry the function's name, as Spark can't make one up for nested struct expressions."""

    @wraps(f)
    def call(*args, **how):
        out = f(*args, **how)
        return out.alias(f.__name__) if isinstance(out, Column) else out

    return call


for _name, _f in list(globals().items()):
    if not _name.startswith("_") and isinstance(_f, FunctionType) and _f.__module__ == __name__ and _name not in ("map_parts", "map_coordinates"):
        globals()[_name] = _named(_f)
