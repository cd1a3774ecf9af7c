"""Geometries as plain Python values, for the kernels: (kind, data).

data of a Point: (x, y) or None; of a LineString or LinearRing: list of (x, y); of a Polygon: list of rings, shell first; of the
rest: list of geometries. Conversions to and from the nested column are here.
"""

from __future__ import annotations

from .types import MULTI


def from_row(row: dict | None):
    """The column's value as a geometry; None stays None."""
    if row is None:
        return None
    kind = row["kind"]

    def simple(part):
        rings = [[(c["x"], c["y"]) for c in r] for r in part["rings"] or ()]
        if part["kind"] == "Point":
            return ("Point", rings[0][0] if rings and rings[0] else None)
        if part["kind"] == "Polygon":
            return ("Polygon", [r for r in rings if r])
        if part["kind"] in MULTI:
            return (part["kind"], [])
        return (part["kind"], rings[0] if rings else [])

    parts = row["parts"] or []
    if kind not in MULTI:
        return simple(parts[0]) if parts else (kind, None if kind == "Point" else [])

    def build(kind, items, depth):
        # items: parts under this container, in order; those of one child stand together
        children, k = [], 0
        while k < len(items):
            path = items[k]["path"] or []
            if depth >= len(path):
                children.append(simple(items[k]))
                k += 1
                continue
            step, e = path[depth], k
            while e < len(items) and len(items[e]["path"] or []) > depth and items[e]["path"][depth]["i"] == step["i"]:
                e += 1
            if step["kind"] in MULTI:
                inside = [p for p in items[k:e] if not (p["kind"] in MULTI and len(p["path"]) == depth + 1)]
                children.append(build(step["kind"], inside, depth + 1))
            else:
                children.extend(simple(p) for p in items[k:e])
            k = e
        return (kind, children)

    return build(kind, parts, 0)


def to_row(g, srid: int = 0) -> dict | None:
    if g is None:
        return None
    kind, data = g
    parts = []

    def ring(r):
        return [{"x": float(x), "y": float(y)} for x, y in r]

    def add(g, path):
        kind, data = g
        if kind in MULTI:
            if not data and path:
                parts.append({"path": path, "kind": kind, "rings": []})
            for i, child in enumerate(data):
                add(child, [*path, {"i": i, "kind": child[0]}])
        elif kind == "Point":
            parts.append({"path": path, "kind": kind, "rings": [ring([data])] if data is not None else []})
        elif kind == "Polygon":
            parts.append({"path": path, "kind": kind, "rings": [ring(r) for r in data]})
        else:
            parts.append({"path": path, "kind": kind, "rings": [ring(data)] if data else []})

    if kind in MULTI or not is_empty(g):
        add(g, [])
    return {"kind": kind, "srid": srid, "parts": parts}


def is_empty(g) -> bool:
    kind, data = g
    if kind == "Point":
        return data is None
    if kind in MULTI:
        return all(is_empty(c) for c in data)
    return not data or (kind == "Polygon" and not data[0])


def leaves(g):
    """Simple parts, in order."""
    kind, data = g
    if kind in MULTI:
        for c in data:
            yield from leaves(c)
    elif not is_empty(g):
        yield g


def points_lines_polygons(g):
    p, line, a = [], [], []
    for kind, data in leaves(g):
        (p if kind == "Point" else a if kind == "Polygon" else line).append(data)
    return p, line, a


def coordinates(g) -> list:
    p, lines, polygons = points_lines_polygons(g)
    return [*p, *(c for r in lines for c in r), *(c for a in polygons for r in a for c in r)]


def gather(points, lines, polygons, empty: str = "GeometryCollection"):
    """The plainest geometry that holds these."""
    kinds = [(k, x) for k, x in (("Point", points), ("LineString", lines), ("Polygon", polygons)) if x]
    if not kinds:
        return (empty, None if empty == "Point" else [])
    if len(kinds) == 1:
        kind, x = kinds[0]
        return (kind, x[0]) if len(x) == 1 else ("Multi" + kind, [(kind, y) for y in x])
    return ("GeometryCollection", [(k, y) for k, x in kinds for y in x])


def ring_area(r) -> float:
    """Signed, counter-clockwise positive; about the first vertex, for far-off coordinates."""
    if len(r) < 3:
        return 0.0
    x0, y0 = r[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(r, r[1:], strict=False)) / 2


def normalize(g):
    """Canonical form: shells clockwise, holes counter-clockwise, rings from their least vertex, lines from the lesser end,
    parts in descending order."""
    kind, data = g
    if is_empty(g) or kind == "Point":
        return g
    if kind in ("LineString", "LinearRing"):
        if kind == "LinearRing" or data[0] == data[-1] and len(data) > 3:
            return (kind, _turn(data, True)) if kind == "LinearRing" else (kind, min(list(data), list(data)[::-1]))
        return (kind, min(list(data), list(data)[::-1]))
    if kind == "Polygon":
        return (kind, [_turn(data[0], True), *sorted(_turn(h, False) for h in data[1:])])
    return (kind, sorted((normalize(c) for c in data), key=lambda c: (c[0], repr(coordinates(c))), reverse=True))


def _turn(r, clockwise: bool):
    body = list(r[:-1])
    if (ring_area(r) < 0) != clockwise:
        body.reverse()
    k = body.index(min(body))
    body = body[k:] + body[:k]
    return [*body, body[0]]
