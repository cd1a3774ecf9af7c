"""WKT, WKB and GeoPackage blobs, to and from plain geometries."""

from __future__ import annotations

import re
import struct
from decimal import Decimal

from .shapes import is_empty
from .types import MULTI

NAMES = {"POINT": "Point", "LINESTRING": "LineString", "LINEARRING": "LinearRing", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon", "GEOMETRYCOLLECTION": "GeometryCollection"}
CODES = {"Point": 1, "LineString": 2, "LinearRing": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
KIND_OF = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def number(x: float) -> str:
    """Shortest plain decimal: 10, 0.0000001, never an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Inf" if x > 0 else "-Inf"
    text = format(Decimal(repr(float(x))), "f")
    return text[:-2] if text.endswith(".0") else text


def to_wkt(g) -> str | None:
    if g is None:
        return None
    kind, data = g
    name = kind.upper()
    xy = lambda c: f"{number(c[0])} {number(c[1])}"
    ring = lambda r: "(" + ", ".join(map(xy, r)) + ")" if r else "EMPTY"
    if is_empty(g) and not (kind in MULTI and data):
        return f"{name} EMPTY"

    def body(g):
        k, d = g
        if k == "Point":
            return "EMPTY" if d is None else f"({xy(d)})"
        if k == "Polygon":
            return "(" + ", ".join(map(ring, d)) + ")" if d else "EMPTY"
        return ring(d)

    if kind == "GeometryCollection":
        return f"{name} ({', '.join(map(to_wkt, data))})"
    return f"{name} ({', '.join(map(body, data))})" if kind in MULTI else f"{name} {body(g)}"


def from_wkt(text: str | None):
    if text is None:
        return None
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not WKT: {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def take(what=None):
        if not tokens or (what and tokens[-1] != what):
            raise ValueError(f"not WKT: {what or 'more'} expected")
        return tokens.pop()

    def several(one):
        take("(")
        out = [one()]
        while tokens and tokens[-1] == ",":
            take()
            out.append(one())
        take(")")
        return out

    def empty():
        if tokens and tokens[-1].upper() == "EMPTY":
            take()
            return True
        return False

    def xy():
        x, y = float(take()), float(take())
        while tokens and tokens[-1] not in ",)":  # z and m are dropped
            float(take())
        return (x, y)

    def line():
        return [] if empty() else several(xy)

    def point():
        if empty():
            return None
        if tokens[-1] == "(":
            take()
            p = xy()
            take(")")
            return p
        return xy()

    def geometry():
        name = take().upper()
        kind = NAMES.get(name)
        if not kind:
            raise ValueError(f"not WKT: {name}")
        if tokens and tokens[-1].upper() in ("Z", "M", "ZM"):
            take()
        if kind == "Point":
            return (kind, point())
        if kind in ("LineString", "LinearRing"):
            return (kind, line())
        if empty():
            return (kind, [])
        if kind == "Polygon":
            return (kind, several(line))
        one = {"MultiPoint": lambda: ("Point", point()), "MultiLineString": lambda: ("LineString", line()), "MultiPolygon": lambda: ("Polygon", [] if empty() else several(line)), "GeometryCollection": geometry}[kind]
        return (kind, several(one))

    g = geometry()
    if tokens:
        raise ValueError(f"not WKT: {tokens[-1]!r} left over")
    return g


def to_wkb(g, little: bool = False) -> bytes:
    """Two-dimensional; big-endian by default."""
    o = "<" if little else ">"
    kind, data = g
    head = struct.pack(o + "BI", int(little), CODES[kind])
    xy = lambda r: b"".join(struct.pack(o + "dd", *c) for c in r)
    if kind == "Point":
        return head + struct.pack(o + "dd", *(data or (float("nan"), float("nan"))))
    if kind == "Polygon":
        return head + struct.pack(o + "I", len(data)) + b"".join(struct.pack(o + "I", len(r)) + xy(r) for r in data)
    if kind in MULTI:
        return head + struct.pack(o + "I", len(data)) + b"".join(to_wkb(c, little) for c in data)
    return head + struct.pack(o + "I", len(data)) + xy(data)


def from_wkb(blob: bytes, at: int = 0):
    g, end = _read(blob, at)
    return g


def _read(b: bytes, at: int):
    o = "<" if b[at] == 1 else ">"
    (code,) = struct.unpack_from(o + "I", b, at + 1)
    at += 5
    if code & 0x20000000:  # an SRID of the extended form
        at += 4
    flags, code = code >> 28, code & 0x0FFFFFFF
    extra = (1 if flags & 8 else 0) + (1 if flags & 4 else 0)
    base, high = code % 1000, code // 1000
    extra += {0: 0, 1: 1, 2: 1, 3: 2}.get(high, 0)
    kind = KIND_OF.get(base)
    if kind is None:
        raise ValueError(f"unknown WKB type {code}")
    step = 8 * (2 + extra)

    def coords(at, n):
        return [struct.unpack_from(o + "dd", b, at + k * step) for k in range(n)], at + n * step

    if kind == "Point":
        (c,), at = coords(at, 1)
        return (kind, None if c[0] != c[0] and c[1] != c[1] else c), at
    (n,) = struct.unpack_from(o + "I", b, at)
    at += 4
    if kind == "LineString":
        r, at = coords(at, n)
        return (kind, r), at
    out = []
    for _ in range(n):
        if kind == "Polygon":
            (k,) = struct.unpack_from(o + "I", b, at)
            c, at = coords(at + 4, k)
        else:
            c, at = _read(b, at)
        out.append(c)
    return (kind, out), at


ENVELOPE_DOUBLES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}


def encode_blob(g, srid: int) -> bytes | None:
    """GeoPackage blob: little-endian header, no envelope, the empty flag where empty; big-endian WKB."""
    if g is None:
        return None
    return b"GP" + struct.pack("<BBi", 0, 1 | (0x10 if is_empty(g) else 0), srid) + to_wkb(g)


def blob_header(blob: bytes) -> dict:
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage blob: bad magic")
    flags = blob[3]
    code = flags >> 1 & 7
    if code not in ENVELOPE_DOUBLES:
        raise ValueError(f"not a GeoPackage blob: envelope code {code}")
    (srid,) = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)
    n = ENVELOPE_DOUBLES[code]
    env = struct.unpack_from(("<" if flags & 1 else ">") + "d" * n, blob, 8)
    return {"version": blob[2], "srid": srid, "empty": bool(flags & 0x10), "extended": bool(flags & 0x20), "envelope_code": code, "envelope": env, "body": 8 + 8 * n}


def decode_blob(blob: bytes | None):
    """(geometry, srid), or (None, None)."""
    if blob is None:
        return None, None
    h = blob_header(bytes(blob))
    return from_wkb(bytes(blob), h["body"]), h["srid"]
