"""Overlays of two boxes by built-in expressions.

What an overlay of two boxes looks like depends only on the order of their four abscissas and of their four ordinates, and all its
vertices lie on those. So the kernel is asked once for each of the orders in which boxes share area, on small numbers, and its answers
are kept as rings of numbers of abscissa and ordinate; a pair of boxes picks its answer and puts its own coordinates in.
"""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import topology as tp
from .types import GEOM

#: Ends a0 < a1 and b0 < b1 of two intervals that share length, by a0 to b0 and a1 to b1: less, equal, greater.
ORDERS = {(i, j): ((1, 4), (1 - i, 4 - j)) for i, j in product((-1, 0, 1), repeat=2)}


def _ring(ax: tuple, ay: tuple):
    return [(ax[0], ay[0]), (ax[0], ay[1]), (ax[1], ay[1]), (ax[1], ay[0]), (ax[0], ay[0])]


@cache
def answers(op: str) -> str:
    """SQL: for each of 81 orders the polygons, in the order in which the kernel comes upon them, as rings of 4 * abscissa + ordinate, numbered a0, a1, b0, b1."""
    out = []
    for (ax, bx), (ay, by) in product(ORDERS.values(), repeat=2):
        (ax, bx), (ay, by) = (tuple(tuple(map(float, v)) for v in pair) for pair in ((ax, bx), (ay, by)))
        border, _, _ = tp.borders(op, tp.Arrangement(("Polygon", [_ring(ax, ay)]), ("Polygon", [_ring(bx, by)])))
        xs, ys = [*ax, *bx], [*ay, *by]
        polygons = tp.polygons_of(border, by_area=False)
        out.append([[[4 * xs.index(x) + ys.index(y) for x, y in r] for r in p] for p in polygons])
    array = lambda v: f"array({','.join(map(array, v))})" if isinstance(v, list) else f"{v}Y"
    return f"array({','.join(array(p) if p else 'cast(array() as array<array<array<tinyint>>>)' for p in out)})"


def overlay(op: str, a: Column, b: Column, srid) -> Column:
    """The geometry for two envelopes that share area."""
    order = lambda p, q: F.when(p < q, 0).when(p == q, 1).otherwise(2)
    number = 27 * order(a["xmin"], b["xmin"]) + 9 * order(a["xmax"], b["xmax"]) + 3 * order(a["ymin"], b["ymin"]) + order(a["ymax"], b["ymax"])
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def made(v):
        at = lambda c: F.struct(F.get(v["xs"], F.shiftright(c, 2)).alias("x"), F.get(v["ys"], c.bitwiseAND(3)).alias("y"))
        rings = F.transform(F.get(F.expr(answers(op)), v["n"]), lambda p: F.transform(p, lambda r: F.transform(r, lambda c: at(c.cast("int")))))
        return F.when(F.size(rings) > 1, _by_area(rings)).otherwise(rings)

    def whole(polygons):
        many = F.size(polygons) > 1
        step = lambda i: F.when(many, F.array(F.struct(i.alias("i"), F.lit("Polygon").alias("kind")))).otherwise(F.expr("cast(array() as array<struct<i:int,kind:string>>)"))
        parts = F.transform(polygons, lambda p, i: F.struct(step(i).alias("path"), F.lit("Polygon").alias("kind"), p.alias("rings")))
        return F.struct(F.when(many, F.lit("MultiPolygon")).otherwise(F.lit("Polygon")).alias("kind"), srid.cast("int").alias("srid"), parts.alias("parts"))

    e = F.struct(number.alias("n"), F.array(a["xmin"], a["xmax"], b["xmin"], b["xmax"]).alias("xs"), F.array(a["ymin"], a["ymax"], b["ymin"], b["ymax"]).alias("ys"))
    return let(let(e, made), whole).cast(GEOM)


def _by_area(polygons: Column) -> Column:
    """The smallest first, as the kernel has them; several polygons of two boxes have no holes."""
    def area(p):
        r = F.get(p, F.lit(0))
        o = F.get(r, F.lit(0))
        return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, i: s + ((F.get(r, i - 1)["x"] - o["x"]) * (F.get(r, i)["y"] - o["y"]) - (F.get(r, i)["x"] - o["x"]) * (F.get(r, i - 1)["y"] - o["y"])))

    return F.transform(F.sort_array(F.transform(polygons, lambda p, i: F.struct(area(p).alias("area"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
