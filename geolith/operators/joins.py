"""Spatial joins: by envelope, radius, predicate, centre and nearest neighbours, and overlays of pairs.

Envelopes meet through a grid of many levels: an object's own level is the power of two over its longer side, so that it covers at
most two by two cells there (three by three of half the size where all others are points), whatever its size. It is also filed at
the coarser levels that occur among the others. Two objects meet on the coarser of their levels, in the one cell that holds the
greater of their least corners, so each pair comes once without a distinct. The join itself is a plain merge join on (level, cell)
with the envelope test as residual. Nothing is broadcast: sizes are guessed before rows are filed in their cells, far too low. Columns
stay apart, so those that nobody asks for are not shuffled. Pairs that envelopes settle never see Python: rows are told apart before
the join, and only pairs with others in them are made for the kernels. Null and empty geometries never meet anything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rectangles
from ..functions import udfs as U

#: Objects without extent are filed here, at cells of 2^-20; larger ones never go below it.
LEAST = -20


def _level(env: Column, margin: Column) -> Column:
    side = F.greatest(env["xmax"] - env["xmin"], env["ymax"] - env["ymin"]) + 2 * margin
    return F.greatest(F.lit(LEAST), F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(LEAST))).cast("int")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are worked out once a row: filters on them are not pushed below, where each mention would be worked out again."""
    made = df.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.select(*df.columns, *(F.col(f"_once.{n}").alias(n) for n in columns))


def _boxed(df: DataFrame, geom: str, side: str, margin: Column | float = 0.0, spot: Column | None = None, shapes: bool = False) -> DataFrame:
    """Columns by number (l0, l1 and so on), the envelope, its shape if asked for, and what to file by: a margin around the envelope, its level,
    and for `spot` a place instead."""
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    cols = [F.col(f"`{c}`").alias(f"{side}{k}") for k, c in enumerate(df.columns)]
    named = df.select(*cols, margin.alias(f"{side}margin"), *([spot.alias(f"{side}spot")] if spot is not None else []))
    g = F.col(f"{side}{df.columns.index(geom)}")
    named, e = _once(named, **{f"{side}env": C.envelope(g)}), F.col(f"{side}env")
    named = named.where(e.isNotNull())
    if shapes:
        named = _once(named, **{f"{side}shape": F.when(g["kind"] == "Point", F.lit("point")).when(is_box(g), F.lit("box"))})
    return named.withColumn(f"{side}level", _level(e, F.col(f"{side}margin")) if spot is None else F.lit(LEAST))


def _box(df: DataFrame, side: str) -> dict[str, Column]:
    """What a row is filed by."""
    e, m = F.col(f"{side}env"), F.col(f"{side}margin")
    if f"{side}spot" in df.columns:
        s = F.col(f"{side}spot")
        return {"xmin": s["x"], "ymin": s["y"], "xmax": s["x"], "ymax": s["y"]}
    return {"xmin": e["xmin"] - m, "ymin": e["ymin"] - m, "xmax": e["xmax"] + m, "ymax": e["ymax"] + m}


def _filed(df: DataFrame, side: str, others: list[int]) -> DataFrame:
    """A row for its own level, if any of the others is as small, and for each level above it that occurs among the others; there, for each cell of its box."""
    own, box = F.col(f"{side}level"), F.struct(*(v.alias(n) for n, v in _box(df, side).items()))
    above = F.filter(F.array(*(F.lit(k) for k in others)), lambda k: k > own)
    df = df.withColumn("_box", box).withColumn("_at", F.concat(F.when(own >= min(others), F.array(own)).otherwise(F.array().cast("array<int>")), above))
    box = F.col("_box")

    def cells(k):
        size = F.pow(F.lit(2.0), k)
        lo = lambda v: F.floor(v / size)
        xs = F.sequence(lo(box["xmin"]), lo(box["xmax"]))
        ys = F.sequence(lo(box["ymin"]), lo(box["ymax"]))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(k.alias("level"), x.alias("cx"), y.alias("cy")))))

    return df.withColumn("_cell", F.explode(F.flatten(F.transform("_at", cells)))).select("*", "_cell.level", "_cell.cx", "_cell.cy").drop("_cell", "_at", "_box")


def _seen(a: DataFrame, b: DataFrame, simple: dict[str, Column] | None = None) -> dict[tuple[str, bool], list[int]]:
    """(side, simple or not) -> the levels that occur: a few dozen numbers at most."""
    ask = lambda df, side: df.select(F.lit(side), (simple[side] if simple else F.lit(True)).alias("simple"), F.col(f"{side}level"))
    out: dict = {}
    for side, kind, level in ask(a, "l").union(ask(b, "r")).distinct().collect():
        out.setdefault((side, kind), []).append(level)
    return {k: sorted(v) for k, v in out.items()}


def _met(a: DataFrame, b: DataFrame, llevels: list[int], rlevels: list[int]) -> DataFrame:
    """Pairs of filed rows, each once."""
    for_points = lambda levels: int(levels == [LEAST])
    ldown, rdown = for_points(rlevels), for_points(llevels)  # against points, smaller cells have fewer of them beside the box
    down = lambda df, side, n: df.withColumn(f"{side}level", F.greatest(F.col(f"{side}level") - n, F.lit(LEAST))) if n else df
    a, b = down(a, "l", ldown), down(b, "r", rdown)
    llevels, rlevels = (sorted({max(k - n, LEAST) for k in levels}) for levels, n in ((llevels, ldown), (rlevels, rdown)))
    n, cell = U.tasks(a.sparkSession), ("level", "cx", "cy")
    left, right = _filed(a, "l", rlevels).repartition(n, *cell), _filed(b, "r", llevels).repartition(n, *cell)
    pairs = left.join(right.hint("merge"), list(cell))
    lb, rb, size = _box(a, "l"), _box(b, "r"), F.pow(F.lit(2.0), F.col("level"))
    meet = (lb["xmin"] <= rb["xmax"]) & (rb["xmin"] <= lb["xmax"]) & (lb["ymin"] <= rb["ymax"]) & (rb["ymin"] <= lb["ymax"])
    once = (F.col("level") == F.greatest("llevel", "rlevel")) & (F.floor(F.greatest(lb["xmin"], rb["xmin"]) / size) == F.col("cx")) & (F.floor(F.greatest(lb["ymin"], rb["ymin"]) / size) == F.col("cy"))
    return pairs.where(meet & once)


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    seen = _seen(a, b)
    return _met(a, b, seen.get(("l", True), [LEAST]), seen.get(("r", True), [LEAST]))


def _flat(pairs: DataFrame, left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
    """Both rows' columns; those of the right that clash get `_right`."""
    cols = [F.col(f"l{k}").alias(c) for k, c in enumerate(left.columns)]
    cols += [F.col(f"r{k}").alias(f"{c}_right" if c in left.columns else c) for k, c in enumerate(right.columns)]
    return pairs.select(*cols, *more)


def _split(a: DataFrame, b: DataFrame, lsimple: Column, rsimple: Column, settle, kernel) -> DataFrame:
    """settle(pairs) of the pairs of simple rows, and kernel(pairs) of those in which one row at least is not simple. What doesn't occur isn't planned."""
    seen = _seen(a, b, {"l": lsimple, "r": rsimple})
    keep = lambda df, simple, kind: df.where(simple if kind else ~simple)
    out = None
    for lkind, rkind in ((True, True), (True, False), (False, True), (False, False)):
        if ("l", lkind) in seen and ("r", rkind) in seen:
            met = _met(keep(a, lsimple, lkind), keep(b, rsimple, rkind), seen["l", lkind], seen["r", rkind])
            got = settle(met) if lkind and rkind else kernel(met)
            out = got if out is None else out.unionByName(got)
    return settle(_met(a, b, [LEAST], [LEAST])) if out is None else out


def envelope_join(left: DataFrame, right: DataFrame, lgeom: str = "geom", rgeom: str = "geom") -> DataFrame:
    """Pairs whose envelopes meet (edges and corners count)."""
    return _flat(_together(_boxed(left, lgeom, "l"), _boxed(right, rgeom, "r")), left, right)


def radius_join(left: DataFrame, right: DataFrame, radius: float | Column, lgeom: str = "geom", rgeom: str = "geom") -> DataFrame:
    """Pairs whose envelopes are less than `radius` apart, a number or a column of the left; adds envelope_distance."""
    pairs = _together(_boxed(left, lgeom, "l", radius), _boxed(right, rgeom, "r"))
    pairs = pairs.withColumn("_d", C.envelope_distance("lenv", "renv")).where(F.col("_d") < F.col("lmargin"))
    return _flat(pairs, left, right, F.col("_d").alias("envelope_distance"))


PREDICATES = {"intersects": U.intersects, "touches": U.touches, "overlaps": U.overlaps, "covers": U.covers, "contains": U.contains}


def _within(p: Column, q: Column) -> Column:
    return (q["xmin"] <= p["xmin"]) & (p["xmax"] <= q["xmax"]) & (q["ymin"] <= p["ymin"]) & (p["ymax"] <= q["ymax"])


def spatial_join(left: DataFrame, right: DataFrame, predicate: str = "intersects", lgeom: str = "geom", rgeom: str = "geom") -> DataFrame:
    """Left is the subject: `covers` pairs a left row with the right rows it covers. Pairs of boxes and of a box and a point are
    settled by built-in comparisons; only the rest goes to the kernel."""
    a = _boxed(left, lgeom, "l", shapes=True)
    inner = predicate in ("covers", "contains")
    # what is covered has its least corner in the other's envelope: a place is filed in fewer cells, and meets fewer boxes
    corner = C.envelope(F.col(f"`{rgeom}`"))
    b = _boxed(right, rgeom, "r", spot=F.struct(corner["xmin"].alias("x"), corner["ymin"].alias("y")) if inner else None, shapes=True)
    lsimple = F.coalesce(F.col("lshape").isin("box", "point") if predicate == "intersects" else F.col("lshape") == "box", F.lit(False))
    le, re = F.col("lenv"), F.col("renv")
    near = lambda pairs: pairs.where(_within(re, le)) if inner else pairs
    g, h = F.col(f"l{left.columns.index(lgeom)}"), F.col(f"r{right.columns.index(rgeom)}")
    settle = lambda pairs: _flat(near(pairs).where(_by_envelope(predicate, F.col("rshape") == "point", le, re)), left, right)
    kernel = lambda pairs: _flat(near(pairs).where(PREDICATES[predicate].exact(g, h)), left, right)
    return _split(a, b, lsimple, F.col("rshape").isNotNull(), settle, kernel)


def is_box(g: Column) -> Column:
    """One ring of five corners with area: its four sides run along the axes in turn."""
    r = F.get(F.get(g["parts"], F.lit(0))["rings"], F.lit(0))
    p = [F.get(r, F.lit(k)) for k in range(5)]
    shape = (g["kind"] == "Polygon") & (F.size(F.get(g["parts"], F.lit(0))["rings"]) == 1) & (F.size(r) == 5)
    closed = (p[0]["x"] == p[4]["x"]) & (p[0]["y"] == p[4]["y"]) & (p[0]["x"] != p[2]["x"]) & (p[0]["y"] != p[2]["y"])
    turns = lambda u, v: (p[0][u] == p[1][u]) & (p[1][v] == p[2][v]) & (p[2][u] == p[3][u]) & (p[3][v] == p[4][v])
    return F.coalesce(shape & closed & (turns("x", "y") | turns("y", "x")), F.lit(False))


def _by_envelope(predicate: str, spot: Column, ea: Column, eb: Column) -> Column:
    """What holds of a box and a box, or a point (spot). Envelopes meet already; for `intersects` both may be points."""
    inside = (ea["xmin"] < eb["xmax"]) & (eb["xmin"] < ea["xmax"]) & (ea["ymin"] < eb["ymax"]) & (eb["ymin"] < ea["ymax"])
    strict = (ea["xmin"] < eb["xmin"]) & (eb["xmax"] < ea["xmax"]) & (ea["ymin"] < eb["ymin"]) & (eb["ymax"] < ea["ymax"])
    rules = {
        "intersects": F.lit(True),
        "covers": _within(eb, ea),
        "contains": F.when(spot, strict).otherwise(_within(eb, ea)),
        "touches": F.when(spot, ~strict).otherwise(~inside),
        "overlaps": ~spot & inside & ~_within(eb, ea) & ~_within(ea, eb),
    }
    return rules[predicate]


def centroid_join(left: DataFrame, right: DataFrame, lgeom: str = "geom", rgeom: str = "geom") -> DataFrame:
    """Left rows with the right rows whose envelope meets theirs and whose centroid they intersect."""
    # the centre once a row, by the kernel, and not once a pair
    centred = _once(U.spread(right).withColumn("_centre", U.centroid(rgeom)), _place=F.col("_centre.parts")[0]["rings"][0][0])
    a, b = _boxed(left, lgeom, "l", shapes=True), _boxed(centred, rgeom, "r", spot=F.col("_place"))
    g, c, le, re = F.col(f"l{left.columns.index(lgeom)}"), F.col(f"r{len(right.columns)}"), F.col("lenv"), F.col("renv")
    meet = (le["xmin"] <= re["xmax"]) & (re["xmin"] <= le["xmax"]) & (le["ymin"] <= re["ymax"]) & (re["ymin"] <= le["ymax"])
    settle = lambda pairs: _flat(pairs.where(meet), left, right)
    kernel = lambda pairs: _flat(pairs.where(meet).where(U.intersects.exact(g, c)), left, right)
    return _split(a, b, F.coalesce(F.col("lshape") == "box", F.lit(False)), F.lit(True), settle, kernel)


def overlay_join(left: DataFrame, right: DataFrame, op: str, lgeom: str = "geom", rgeom: str = "geom") -> DataFrame:
    """Pairs whose envelopes share area, with `overlay`: union, intersection, difference or symdifference. Two boxes are laid over each other by
    built-in expressions, to the same geometry that the kernel makes."""
    a, b = _boxed(left, lgeom, "l", shapes=True), _boxed(right, rgeom, "r", shapes=True)
    g, h, le, re = F.col(f"l{left.columns.index(lgeom)}"), F.col(f"r{right.columns.index(rgeom)}"), F.col("lenv"), F.col("renv")
    share = (le["xmin"] < re["xmax"]) & (re["xmin"] < le["xmax"]) & (le["ymin"] < re["ymax"]) & (re["ymin"] < le["ymax"])
    settle = lambda pairs: _flat(pairs.where(share), left, right, rectangles.overlay(op, le, re, g["srid"]).alias("overlay"))
    kernel = lambda pairs: _flat(pairs.where(share), left, right, U.OVERLAYS[op](g, h).alias("overlay"))
    box = lambda side: F.coalesce(F.col(f"{side}shape") == "box", F.lit(False))
    return _split(a, b, box("l"), box("r"), settle, kernel)


def _enough(queries: DataFrame, index: DataFrame, key: str, within: float, n: int, qgeom: str, igeom: str) -> DataFrame:
    """Queries with `_reach`: a distance within which n rows of index are, or `within`. Least corners are counted by cells of several sizes; n in
    one's own cell are no farther than its diagonal."""
    place = lambda df, g: df.select("*", C.envelope(F.col(f"`{g}`")).alias("_e")).where("_e is not null")
    spots = place(index.select(F.col(f"`{igeom}`").alias("_g")), "_g").select(F.col("_e.xmin").alias("x"), F.col("_e.ymin").alias("y"))
    e = spots.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max)))).first()
    top = math.floor(math.log2(within / math.sqrt(2)))
    side = math.sqrt(max(e.x1 - e.x0, within) * max(e.y1 - e.y0, within) * n / e.n) if e.n else within
    levels = list(range(max(min(math.floor(math.log2(side)) - 2, top), LEAST), top + 1))
    if not e.n or not levels:
        return queries.withColumn("_reach", F.lit(float(within)))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / 2.0**k).alias("cx"), F.floor(F.col("y") / 2.0**k).alias("cy")) for k in levels)))
    full = spots.select(cells.alias("c")).groupBy("c").count().where(F.col("count") >= n).select("c")
    asked = place(queries.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{qgeom}`").alias("_g")), "_g").select("_k", F.col("_e.xmin").alias("x"), F.col("_e.ymin").alias("y"))
    found = asked.select("_k", "x", "y", cells.alias("c")).join(full.hint("merge"), "c").groupBy("_k", "x", "y").agg(F.min("c.level").alias("level"))
    # one that no cell settles is asked for whole; rows that share a key share the greatest reach
    reach = asked.join(found.hint("merge"), ["_k", "x", "y"], "left").groupBy("_k").agg(F.max(F.coalesce(F.pow(F.lit(2.0), "level") * (math.sqrt(2) * (1 + 1e-9)), F.lit(float(within)))).alias("_reach"))
    return queries.join(reach.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("_reach", F.coalesce(F.least("_reach", F.lit(float(within))), F.lit(float(within))))


def neighbours(queries: DataFrame, index: DataFrame, key: str, within: float, n: int, tie: str, qgeom: str = "geom", igeom: str = "geom") -> DataFrame:
    """The n nearest rows of index to each query, by distance of envelopes under `within`; then ranked by true distance (by that of envelopes if n
    is 1). Ties go by the column `tie` of index. Adds envelope_distance, distance, rank."""
    near = radius_join(_enough(queries, index, key, within, n, qgeom, igeom), index, F.col("_reach"), qgeom, igeom).drop("_reach")
    tie = f"{tie}_right" if tie in queries.columns else tie
    other = f"{igeom}_right" if igeom in queries.columns else igeom
    first = Window.partitionBy(key).orderBy("envelope_distance", tie)
    picked = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r")
    points = C.is_kind(qgeom, "Point") & C.is_kind(other, "Point")
    # points reach the kernel as nulls, which it passes over
    exact = U.distance(F.when(~points, F.col(qgeom)), F.when(~points, F.col(other)))
    ranked = picked.withColumn("distance", F.when(points, F.col("envelope_distance")).otherwise(exact))
    again = Window.partitionBy(key).orderBy("envelope_distance" if n == 1 else "distance", tie)
    return ranked.withColumn("rank", F.row_number().over(again))


def index_entries(df: DataFrame, geom: str = "geom") -> DataFrame:
    """What an index of these rows would hold: no null and no empty geometries."""
    return df.where(F.col(geom).isNotNull() & ~C.is_empty(geom))


def index_add(index: DataFrame, more: DataFrame) -> DataFrame:
    return index.unionByName(more)


def index_delete(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")
