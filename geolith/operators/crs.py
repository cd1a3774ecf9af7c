"""Coordinate reference systems: a registry of public EPSG definitions and reprojection in built-in expressions.

Systems: 4326 (longitude, latitude), 3857, 27700, and UTM 326xx and 327xx. Others are unknown.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.types import GEOM

WGS84, AIRY = (6378137.0, 1 / 298.257223563), (6377563.396, 1 / 299.3249646)
#: OSGB36 to WGS84: metres, arc seconds, parts per million (EPSG 1314).
OSGB = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)


@lru_cache(maxsize=None)
def lookup(srid: int) -> dict | None:
    """Definition of a system, None if unknown."""
    if srid == 4326:
        return {"srid": srid, "kind": "geographic", "name": "WGS 84", "ellipsoid": WGS84, "definition": "+proj=longlat +datum=WGS84 +no_defs", "description": "longitude, latitude"}
    if srid == 3857:
        return {"srid": srid, "kind": "mercator", "name": "WGS 84 / Pseudo-Mercator", "ellipsoid": WGS84, "definition": "+proj=merc +a=6378137 +b=6378137 +units=m +no_defs", "description": "web mercator"}
    if srid == 27700:
        tm = dict(lat0=49.0, lon0=-2.0, k0=0.9996012717, x0=400000.0, y0=-100000.0)
        text = "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +towgs84=446.448,-125.157,542.06,0.15,0.247,0.842,-20.489 +units=m +no_defs"
        return {"srid": srid, "kind": "tm", "name": "OSGB36 / British National Grid", "ellipsoid": AIRY, "shift": OSGB, "tm": tm, "definition": text, "description": "national grid"}
    zone, south = srid % 100, srid // 100 == 327
    if srid // 100 in (326, 327) and 1 <= zone <= 60:
        tm = dict(lat0=0.0, lon0=zone * 6.0 - 183, k0=0.9996, x0=500000.0, y0=1e7 if south else 0.0)
        return {"srid": srid, "kind": "tm", "name": f"WGS 84 / UTM zone {zone}{'S' if south else 'N'}", "ellipsoid": WGS84, "tm": tm, "definition": f"+proj=utm +zone={zone}{' +south' if south else ''} +datum=WGS84 +units=m +no_defs", "description": "UTM"}
    return None


def srs_row(srid: int) -> dict:
    """The row of gpkg_spatial_ref_sys."""
    x = lookup(srid)
    base = {"srs_id": srid, "organization": "EPSG", "organization_coordsys_id": srid}
    return base | ({"srs_name": x["name"], "definition": x["definition"], "description": x["description"]} if x else {"srs_name": f"EPSG:{srid}", "definition": "undefined", "description": None})


def srid_of(value) -> int:
    """4326 and "EPSG:4326" alike."""
    return int(str(value).rpartition(":")[2])


class _Arrays:
    sin, cos, tan, atan, atan2, sqrt, asinh, sinh, cosh, atanh, exp, log = np.sin, np.cos, np.tan, np.arctan, np.arctan2, np.sqrt, np.arcsinh, np.sinh, np.cosh, np.arctanh, np.exp, np.log


def _series(f: float):
    n = f / (2 - f)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    b = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return n, (1 + n**2 / 4 + n**4 / 64) / (1 + n), a, b


def _meridian(lat: float, a: float, f: float) -> float:
    """xi * rectifying radius at a latitude, by the same series."""
    n, r, al, _ = _series(f)
    e = math.sqrt(f * (2 - f))
    t = math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat)))
    xi = math.atan(t)
    return r * a * (xi + sum(al[j] * math.sin(2 * (j + 1) * xi) for j in range(4)))


def _tm_forward(m, lon, lat, tm, ell):
    a, f = ell
    n, r, al, _ = _series(f)
    e = math.sqrt(f * (2 - f))
    dl = lon - math.radians(tm["lon0"])
    s = m.sin(lat)
    t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
    xi, eta = m.atan2(t, m.cos(dl)), m.atanh(m.sin(dl) / m.sqrt(t * t + 1))
    x, y = eta, xi
    for j in range(4):
        k = 2 * (j + 1)
        x = x + al[j] * m.cos(k * xi) * m.sinh(k * eta)
        y = y + al[j] * m.sin(k * xi) * m.cosh(k * eta)
    k0 = tm["k0"]
    return tm["x0"] + k0 * r * a * x, tm["y0"] + k0 * (r * a * y - _meridian(math.radians(tm["lat0"]), a, f))


def _tm_inverse(m, x, y, tm, ell):
    a, f = ell
    n, r, _, be = _series(f)
    e = math.sqrt(f * (2 - f))
    k0 = tm["k0"]
    xi = ((y - tm["y0"]) / k0 + _meridian(math.radians(tm["lat0"]), a, f)) / (r * a)
    eta = (x - tm["x0"]) / (k0 * r * a)
    p, q = xi, eta
    for j in range(4):
        k = 2 * (j + 1)
        p = p - be[j] * m.sin(k * xi) * m.cosh(k * eta)
        q = q - be[j] * m.cos(k * xi) * m.sinh(k * eta)
    s = m.sinh(q)
    c = m.cos(p)
    tau1 = m.sin(p) / m.sqrt(s * s + c * c)
    tau = tau1
    for _ in range(3):  # Newton's steps for the latitude
        sig = m.sinh(e * m.atanh(e * tau / m.sqrt(1 + tau * tau)))
        t1 = tau * m.sqrt(1 + sig * sig) - sig * m.sqrt(1 + tau * tau)
        tau = tau + (tau1 - t1) / m.sqrt(1 + t1 * t1) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * m.sqrt(1 + tau * tau))
    return math.radians(tm["lon0"]) + m.atan2(s, c), m.atan(tau)


def _datum(m, lon, lat, ell_from, ell_to, shift, back: bool):
    """Seven parameters between ellipsoids, position vectors; back is the exact inverse."""
    a, f = ell_from
    e2 = f * (2 - f)
    v = a / m.sqrt(1 - e2 * m.sin(lat) * m.sin(lat))
    x, y, z = v * m.cos(lat) * m.cos(lon), v * m.cos(lat) * m.sin(lon), v * (1 - e2) * m.sin(lat)
    tx, ty, tz, rx, ry, rz, ppm = shift
    rx, ry, rz, s = *(math.radians(r / 3600) for r in (rx, ry, rz)), 1 + ppm * 1e-6
    if back:
        x, y, z = (x - tx) / s, (y - ty) / s, (z - tz) / s
        x, y, z = x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z
    else:
        x, y, z = tx + s * (x - rz * y + ry * z), ty + s * (rz * x + y - rx * z), tz + s * (-ry * x + rx * y + z)
    a, f = ell_to
    e2 = f * (2 - f)
    p = m.sqrt(x * x + y * y)
    b = a * (1 - f)
    th = m.atan2(z * a, p * b)
    for _ in range(2):
        st, ct = m.sin(th), m.cos(th)
        phi = m.atan2(z + e2 / (1 - e2) * b * st * st * st, p - e2 * a * ct * ct * ct)
        th = m.atan((1 - f) * m.tan(phi))
    return m.atan2(y, x), phi


def transform_xy(m, x, y, source: int, target: int):
    """x, y in another system; m: `math` for numbers, `_Arrays` for whole arrays. Unknown systems raise."""
    a, b = lookup(source), lookup(target)
    for s, d in ((source, a), (target, b)):
        if d is None:
            raise ValueError(f"unknown coordinate system: {s}")
    if source == target:
        return x, y
    if a["kind"] == "geographic":
        lon, lat = x * (math.pi / 180), y * (math.pi / 180)
    elif a["kind"] == "mercator":
        lon, lat = x / WGS84[0], 2 * m.atan(m.exp(y / WGS84[0])) - math.pi / 2
    else:
        lon, lat = _tm_inverse(m, x, y, a["tm"], a["ellipsoid"])
    if a.get("shift"):
        lon, lat = _datum(m, lon, lat, a["ellipsoid"], WGS84, a["shift"], False)
    if b.get("shift"):
        lon, lat = _datum(m, lon, lat, WGS84, b["ellipsoid"], b["shift"], True)
    if b["kind"] == "geographic":
        return lon * (180 / math.pi), lat * (180 / math.pi)
    if b["kind"] == "mercator":
        return lon * WGS84[0], m.log(m.tan(math.pi / 4 + lat / 2)) * WGS84[0]
    return _tm_forward(m, lon, lat, b["tm"], b["ellipsoid"])


def reproject(g, source: int, target: int) -> Column:
    """Each coordinate in the target system, SRID set; the input stays as it is.

    An Arrow function over the flat coordinate buffers of a whole batch: the series use each intermediate several times, which
    as nested column expressions would be worked out anew at every use.
    """
    for s in (source, target):
        if lookup(s) is None:
            raise ValueError(f"unknown coordinate system: {s}")

    def run(geoms: pa.Array) -> pa.Array:
        return _with_coordinates(geoms, lambda x, y: transform_xy(_Arrays, x, y, source, target), target)

    return arrow_udf(run, GEOM)(F.col(g) if isinstance(g, str) else g)


def _with_coordinates(geoms, f, srid: int):
    """The geometries with f(x, y) for their coordinates; offsets and nulls stay as they are."""
    geoms = pa.concat_arrays([geoms])  # offsets from zero
    parts = geoms.field("parts")
    part = parts.values
    rings = part.field("rings")
    ring = rings.values
    x, y = (ring.values.field(n).to_numpy(zero_copy_only=False) for n in "xy")
    with np.errstate(all="ignore"):
        x, y = f(x, y)
    kind = ring.type.value_type
    coords = pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], fields=[kind.field(k) for k in range(kind.num_fields)])
    ring = pa.ListArray.from_arrays(ring.offsets, coords, type=ring.type)
    rings = pa.ListArray.from_arrays(rings.offsets, ring, type=rings.type)
    names = [part.type.field(k) for k in range(part.type.num_fields)]
    part = pa.StructArray.from_arrays([rings if n.name == "rings" else part.field(n.name) for n in names], fields=names)
    parts = pa.ListArray.from_arrays(parts.offsets, part, type=parts.type)
    names = [geoms.type.field(k) for k in range(geoms.type.num_fields)]
    whole = {"kind": geoms.field("kind"), "parts": parts, "srid": pa.array(np.full(len(geoms), srid), pa.int32())}
    return pa.StructArray.from_arrays([whole[n.name] for n in names], fields=names, mask=geoms.is_null())


def reproject_geometry(g, source: int, target: int):
    """The same for a plain geometry."""
    kind, data = g
    f = lambda c: transform_xy(math, c[0], c[1], source, target)
    if kind == "Point":
        return (kind, data and f(data))
    if kind in ("LineString", "LinearRing"):
        return (kind, [f(c) for c in data])
    if kind == "Polygon":
        return (kind, [[f(c) for c in r] for r in data])
    return (kind, [reproject_geometry(c, source, target) for c in data])
