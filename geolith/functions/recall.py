"""Kernels that remember: shapes often recur elsewhere, and what such a kernel makes of a shape moves along with it.

Arguments are moved to their least corner and looked up there; a result is moved back. Where moving would round any coordinate, the kernel
is asked itself, so results are the same to the last bit. What never recurs costs a look-up more.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import wraps

from .types import MULTI

#: Results kept by each kernel in each process, and coordinates of arguments worth keeping.
KEPT, MOST = 4096, 64


class _Rounds(Exception):
    pass


def _points(g):
    kind, data = g
    if kind in MULTI:
        for c in data:
            yield from _points(c)
    elif kind == "Point":
        if data is not None:
            yield data
    elif kind == "Polygon":
        for r in data:
            yield from r
    else:
        yield from data


def _moved(g, move):
    """A geometry in tuples, each point moved."""
    kind, data = g
    if kind in MULTI:
        return (kind, tuple(_moved(c, move) for c in data))
    if kind == "Point":
        return (kind, None if data is None else move(data))
    if kind == "Polygon":
        return (kind, tuple(tuple(map(move, r)) for r in data))
    return (kind, tuple(map(move, data)))


def _plain(g, move):
    """A kept geometry as new lists, each point moved."""
    kind, data = g
    if kind in MULTI:
        return (kind, [_plain(c, move) for c in data])
    if kind == "Point":
        return (kind, None if data is None else move(data))
    if kind == "Polygon":
        return (kind, [list(map(move, r)) for r in data])
    return (kind, list(map(move, data)))


def _less(v, o):
    u = v - o
    if u + o != v or v - u != o:
        raise _Rounds
    return u


def _more(u, o):
    v = u + o
    if v - o != u or v - u != o or abs(v) < abs(u):  # a sum that is as coarse as its part at least hides what the part was rounded by
        raise _Rounds
    return v


def moves(*where: int, geometry: bool = True):
    """Of a kernel that takes geometries at `where` and whose result, a geometry unless said otherwise, moves along with them. Not for kernels that round on
    their way, such as buffers: near the origin they round less, and find other vertices."""

    def wrap(f):
        kept: OrderedDict = OrderedDict()

        @wraps(f)
        def call(*args, **how):
            pts = [p for k in where for p in _points(args[k])]
            if not pts or len(pts) > MOST or not all(type(x) is float and type(y) is float for x, y in pts):
                return f(*args, **how)
            ox, oy = min(p[0] for p in pts), min(p[1] for p in pts)
            try:
                near = lambda p: (_less(p[0], ox), _less(p[1], oy))
                key = (tuple(_moved(a, near) if k in where else a for k, a in enumerate(args)), tuple(how.items()))
                if key in kept:
                    kept.move_to_end(key)
                    got = kept[key]
                else:
                    own = [_plain(a, lambda p: p) if k in where else a for k, a in enumerate(key[0])]
                    got = f(*own, **how)
                    got = _moved(got, lambda p: p) if geometry else got
                    kept[key] = got
                    if len(kept) > KEPT:
                        kept.popitem(last=False)
                return _plain(got, lambda p: (_more(p[0], ox), _more(p[1], oy))) if geometry else got
            except _Rounds:
                return f(*args, **how)

        call.kernel, call.kept = f, kept
        return call

    return wrap
