"""Every spatial query against its SQL, and geometry kernels against known results."""

import duckdb
import pytest

import __spark_entry__ as entry
from geolith.functions import construct as cs
from geolith.functions import topology as tp
from geolith.functions import udfs as U
from geolith.functions.codec import from_wkt, to_wkt
from geolith.operators import network
from geolith.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in found.description]
    want = sorted((tuple(map(cell, r)) for r in found.fetchall()), key=repr)
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(map(cell, r)) for r in df.select(*cols).collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def g(text):
    return from_wkt(text)


RIM = "0 0, 0 10, 10 10, 10 0, 0 0"


@pytest.mark.parametrize(
    "line, cutter, want",
    [
        ("LINESTRING (0 0, 10 0)", "LINESTRING (5 -1, 5 1)", ["LINESTRING (5 0, 0 0)", "LINESTRING (10 0, 5 0)"]),
        (f"LINESTRING ({RIM})", "LINESTRING (-1 -1, 10 -1)", ["LINESTRING (0 0, 10 0, 10 10, 0 10, 0 0)"]),
        (f"LINEARRING ({RIM})", "LINESTRING (-1 -1, 10 -1)", [f"LINEARRING ({RIM})"]),
        (f"LINESTRING ({RIM})", "LINESTRING (-1 -1, 1 5, 1 -1)", ["LINESTRING (0 2, 0 0)", "LINESTRING (1 0, 10 0, 10 10, 0 10, 0 2)", "LINESTRING (0 0, 1 0)"]),
        (f"LINEARRING ({RIM})", "LINESTRING (-1 -1, 1 5, 1 -1)", ["LINESTRING (1 0, 0 0, 0 2)", "LINESTRING (1 0, 10 0, 10 10, 0 10, 0 2)"]),
        (f"LINESTRING ({RIM})", "LINESTRING (-1 -1, 1 5, 1 -1, 3 5, 3 -1)", ["LINESTRING (0 2, 0 0)", "LINESTRING (3 0, 10 0, 10 10, 0 10, 0 2)", "LINESTRING (1.3333333333333333 0, 3 0)", "LINESTRING (1 0, 1.3333333333333333 0)", "LINESTRING (0 0, 1 0)"]),
        (f"LINEARRING ({RIM})", "LINESTRING (-1 -1, 1 5, 1 -1, 3 6, -1 6)", ["LINESTRING (1 0, 0 0, 0 2)", "LINESTRING (0 6, 0 2)", "LINESTRING (1.2857142857142858 0, 10 0, 10 10, 0 10, 0 6)", "LINESTRING (1 0, 1.2857142857142858 0)"]),
    ],
)
def test_cut_line(line, cutter, want):
    got = cs.cut_line(g(line), g(cutter))
    assert [k for k, _ in got] == [g(w)[0] for w in want]
    for (_, a), w in zip(got, want, strict=True):
        assert len(a) == len(g(w)[1]) and all(abs(p[k] - q[k]) < 1e-9 for p, q in zip(a, g(w)[1], strict=True) for k in (0, 1))


def test_noding_with_and_without_snapping(spark):
    """Ends that miss each other by less than the tolerance meet only if snapped."""
    rows = [(1, "LINESTRING (0 0, 10 0)"), (2, "LINESTRING (10.06 0.06, 20 0)"), (3, "LINESTRING (5 -5, 5 5)")]
    lines = spark.createDataFrame(rows, "id long, w string").select("id", U.from_wkt("w").alias("geom"))
    ends = lambda **how: {c for r in network.node(lines, "id", **how).collect() for c in map(tuple, r.geom.parts[0].rings[0])}
    assert ends() == {(0, 0), (5, 0), (10, 0), (20, 0), (5, -5), (5, 5)}
    assert (10.1, 0.1) in ends(snap=False)


def test_overlay_and_relate():
    a, b = g("POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))"), g("POLYGON ((5 5, 5 15, 15 15, 15 5, 5 5))")
    area = lambda x: abs(sum(tp.ring_area(r) for p in tp.leaves(x) for r in p[1]))
    assert [area(tp.overlay(op, a, b)) for op in ("union", "intersection", "difference", "symdifference")] == [175, 25, 75, 150]
    assert tp.relate(a, b) == "212101212" and tp.predicate("overlaps", a, b) and not tp.predicate("touches", a, b)
    assert tp.predicate("covers", a, g("LINESTRING (0 0, 10 10, 0 10)")) and not tp.predicate("covers", a, g("LINESTRING (0 0, 10 11)"))
    assert not tp.valid(g("POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))")) and tp.valid(tp.make_valid(g("POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))")))


def test_concave_shells_are_not_shortcut():
    hook = g("POLYGON ((0 0, 0 10, 10 10, 10 8, 2 8, 2 0, 0 0))")
    assert not tp.predicate("covers", hook, g("LINESTRING (1 1, 9 9)"))
    star = g("POLYGON ((0 3, 3 3, 4 0, 5 3, 8 3, 6 5, 7 8, 4 6, 1 8, 2 5, 0 3))")
    assert tp._convex(star) is None and tp._convex(hook) is None


def test_unions_of_far_apart_and_chained():
    boxes = "MULTIPOLYGON (((0 0, 0 2, 2 2, 2 0, 0 0)), ((1 1, 1 3, 3 3, 3 1, 1 1)), ((9 9, 9 10, 10 10, 10 9, 9 9)), ((10 10, 10 11, 11 11, 11 10, 10 10)))"
    u = tp.unary_union(g(boxes))
    assert tp.valid(u) and sum(abs(tp.ring_area(p[1][0])) for p in tp.leaves(u)) == 9


def test_circle_buffer():
    ring = cs.buffer(g("POINT (0 0)"), 1.0)[1][0]
    assert len(ring) == 33
