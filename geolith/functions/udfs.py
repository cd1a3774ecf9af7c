"""Geometry functions that need the kernels, as Arrow functions over the geometry column, and their SQL names.

Each takes and gives whole Arrow batches. All are deterministic; null in, null out. Give them columns of a table or the
results of other kernels; Spark cannot yet plan a Python function over nested folds (columns.centroid, densify, smooth), so write
those to a table or use the kernels of the same names here.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from . import codec, columns
from . import construct as cs
from . import topology as tp
from .shapes import from_row, is_empty, normalize, to_row
from .types import GEOM

_REGISTRY: dict = {}


def _column(c):
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def _make(name: str, result: T.DataType, geoms: int, f, give=None):
    """A function of `geoms` geometry columns and then plain ones; f gets plain geometries and values."""
    import pyarrow as pa

    kind = to_arrow_type(result)
    give = give or (lambda x, srid: x)

    def run(*arrays: pa.Array) -> pa.Array:
        out, rows = [], [a.to_pylist() for a in arrays]
        for values in zip(*rows, strict=True):
            if any(v is None for v in values):
                out.append(None)
                continue
            args = [from_row(v) for v in values[:geoms]] + list(values[geoms:])
            out.append(give(f(*args), values[0]["srid"] if geoms else 0))
        return pa.array(out, kind)

    made = _arrow(run, result)
    _REGISTRY[name] = made

    def call(*args) -> Column:
        return made(*map(_column, args)).alias(name)

    call.__name__ = name
    call.__doc__ = f.__doc__
    return call


def _arrow(run, result):
    import warnings

    from pyspark.sql.functions import ArrowUDFType

    with warnings.catch_warnings():  # hints can't say "any number of arrays"
        warnings.simplefilter("ignore", UserWarning)
        return arrow_udf(run, result, ArrowUDFType.SCALAR)


def _geom(g, srid):
    return to_row(g, srid)


def _geoms(gs, srid):
    return [to_row(g, srid) for g in gs]


BOOL, DOUBLE, STRING, BINARY, LIST = T.BooleanType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.ArrayType(GEOM)
CIRCLE = T.StructType([T.StructField(n, DOUBLE) for n in ("cx", "cy", "r")])
PAIR = T.ArrayType(GEOM)

# ---- codecs ------------------------------------------------------------------------------------------------------------
from_wkt = _make("st_fromwkt", GEOM, 0, codec.from_wkt, lambda g, _: to_row(g, 0))
to_wkt = _make("st_towkt", STRING, 1, codec.to_wkt)
from_wkb = _make("st_fromwkb", GEOM, 0, lambda b: codec.from_wkb(bytes(b)), lambda g, _: to_row(g, 0))
to_wkb = _make("st_towkb", BINARY, 1, codec.to_wkb)
gpkg_encode = _make("gpkg_encode", BINARY, 1, codec.encode_blob)
gpkg_decode = _make("gpkg_decode", GEOM, 0, lambda b: codec.decode_blob(bytes(b)), lambda x, _: to_row(*x))

# ---- predicates --------------------------------------------------------------------------------------------------------
relate = _make("st_relate", STRING, 2, tp.relate)
is_valid = _make("st_isvalid", BOOL, 1, tp.valid)


def _predicate(name):
    exact = _make(f"st_{name}", BOOL, 2, lambda a, b: tp.predicate(name, a, b))

    def call(a, b) -> Column:
        """Geometries whose envelopes are apart never reach the kernel; nor do pairs of points, boxes and such that envelopes settle."""
        a, b = _column(a), _column(b)
        ea, eb = columns.envelope(a), columns.envelope(b)
        meet = (ea["xmin"] <= eb["xmax"]) & (eb["xmin"] <= ea["xmax"]) & (ea["ymin"] <= eb["ymax"]) & (eb["ymin"] <= ea["ymax"])
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(F.coalesce(meet, F.lit(False)), exact(a, b)).otherwise(F.lit(False)).alias(name)

    call.__name__, call.exact = name, exact
    return call


intersects, touches, covers, overlaps, contains = map(_predicate, ("intersects", "touches", "covers", "overlaps", "contains"))


def relates(a, b, pattern: str) -> Column:
    """Does the nine-intersection matrix match the pattern (T, F, *, 0, 1, 2)?"""
    rule = "".join({"T": "[012]", "*": ".", "F": "F"}.get(p, p) for p in pattern)
    return relate(a, b).rlike(f"^{rule}$")


# ---- measures ----------------------------------------------------------------------------------------------------------
distance = _make("st_distance", DOUBLE, 2, cs.distance)
closest_points = _make("st_closestpoints", PAIR, 2, cs.closest_points, lambda x, s: x and [to_row(("Point", p), s) for p in x[1:]])
bounding_circle = _make("st_minimumboundingcircle", CIRCLE, 1, cs.bounding_circle, lambda c, _: c and dict(zip(("cx", "cy", "r"), c, strict=True)))

# ---- shapes ------------------------------------------------------------------------------------------------------------
centroid = _make("st_centroid", GEOM, 1, cs.centroid, _geom)
densify = _make("st_densify", GEOM, 1, cs.densify, _geom)
convex_hull = _make("st_convexhull", GEOM, 1, cs.convex_hull, _geom)
concave_hull = _make("st_concavehull", GEOM, 1, cs.concave_hull, _geom)
interior_point = _make("st_pointonsurface", GEOM, 1, cs.interior_point, _geom)
boundary = _make("st_boundary", GEOM, 1, cs.boundary, _geom)
linearize = _make("st_linearize", LIST, 1, cs.linearize, _geoms)
make_valid = _make("st_makevalid", GEOM, 1, tp.make_valid, _geom)
change_precision = _make("st_changeprecision", GEOM, 1, cs.change_precision, _geom)
normalized = _make("st_normalize", GEOM, 1, normalize, _geom)
_buffer = _make("st_buffer", GEOM, 1, cs.buffer, _geom)


def buffer(g, radius, quad_segments: int = 8, cap: str = "round", join: str = "round", mitre: float = 5.0) -> Column:
    return _buffer(g, _column(radius).cast("double"), F.lit(quad_segments), F.lit(cap), F.lit(join), F.lit(float(mitre)))


# ---- overlay -----------------------------------------------------------------------------------------------------------
union = _make("st_union", GEOM, 2, lambda a, b: tp.overlay("union", a, b), _geom)
intersection = _make("st_intersection", GEOM, 2, lambda a, b: tp.overlay("intersection", a, b), _geom)
difference = _make("st_difference", GEOM, 2, lambda a, b: tp.overlay("difference", a, b), _geom)
sym_difference = _make("st_symdifference", GEOM, 2, lambda a, b: tp.overlay("symdifference", a, b), _geom)
OVERLAYS = {"union": union, "intersection": intersection, "difference": difference, "symdifference": sym_difference}
unary_union = _make("st_unaryunion", GEOM, 1, tp.unary_union, _geom)

# ---- lines and faces ---------------------------------------------------------------------------------------------------
line_merge = _make("st_linemerge", LIST, 1, cs.line_merge, _geoms)
cut_line = _make("st_cutline", LIST, 2, cs.cut_line, _geoms)
split_line = _make("st_splitline", LIST, 2, cs.split_line, _geoms)
_polygonize = _make("st_polygonize", LIST, 1, lambda g, scale: cs.polygonize([g], scale), _geoms)
_cut_polygon = _make("st_cutpolygon", LIST, 2, lambda g, paths, scale: cs.cut_polygon(g, [] if is_empty(paths) else [paths], scale), _geoms)


def polygonize(paths, scale: float = 10.0) -> Column:
    """Faces of a geometry's (or collection's) linework, noded on a grid of 1 / scale."""
    return _polygonize(paths, F.lit(float(scale)))


def cut_polygon(g, paths, scale: float = 10.0) -> Column:
    return _cut_polygon(g, paths, F.lit(float(scale)))


def tasks(spark) -> int:
    """Tasks for what costs far more than its bytes tell adaptive execution, which would put a small table in one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df):
    """The rows over all cores, for kernels."""
    return df.repartition(tasks(df.sparkSession))


def union_all(df, keys: list[str], geom: str = "geom", fan: int = 64):
    """Union of each group: geometries are united in sub-groups by a hash first, so that no task holds a whole large group; repeated
    until a group is one geometry. -> keys, geom."""
    out = T.StructType([*(f for f in df.schema.fields if f.name in keys), T.StructField(geom, GEOM)])
    names = [f.name for f in out.fields]

    def unite(table):
        import pyarrow as pa

        gs = [from_row(r) for r in table.column(geom).to_pylist() if r is not None]
        srid = next((r["srid"] for r in table.column(geom).to_pylist() if r is not None), 0)
        whole = tp.unary_union(("GeometryCollection", gs)) if gs else None
        cols = [pa.array([table.column(n)[0].as_py()], table.schema.field(n).type) for n in names if n != geom]
        return pa.table([*cols, pa.array([to_row(whole, srid)], to_arrow_type(GEOM))], names=[*(n for n in names if n != geom), geom])

    rows = df.select(*names)
    size = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    rows = spread(rows)
    while size > fan:
        groups = -(-size // fan)
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(geom), F.lit(groups)))
        rows = salted.groupBy(*keys, "_salt").applyInArrow(unite, out)
        size = groups
    return rows.groupBy(*keys).applyInArrow(unite, out)


def register(spark: SparkSession) -> list[str]:
    """All kernels as SQL functions of the session, and the built-in expressions that SQL can call by name."""
    for name, f in _REGISTRY.items():
        spark.udf.register(name, f)
    return sorted(_REGISTRY)

