"""Overlay, buffers, repair, unions and faces against plain versions, on turned, concave and holed shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanlattice.functions import kernels as K
from urbanlattice.functions import overlay as O

QUARTER = 8 * math.sin(math.pi / 32)  # of the 64-gon with circumradius 1


def area(parts) -> float:
    return sum(K.ring_area(K.opened(r)) for p in parts for r in p)


def box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)


def star(rng, cx, cy, size, n):
    a = (np.arange(n) + rng.uniform(0, 0.8, n)) * 2 * math.pi / n
    r = rng.uniform(0.3 * size, size, n)
    p = np.column_stack([cx + r * np.cos(a), cy + r * np.sin(a)])
    return np.vstack([p, p[:1]])


def holed(rng, *at):
    out = [star(rng, *at)]
    hole = star(rng, *out[0][:-1].mean(0), 1.0, 5)
    fits = (K.inside(hole, out) > 0).all() and K.line_inside_length(K.segments([[hole]]), [out]) > 0.999 * np.hypot(*np.diff(hole, axis=0).T).sum()
    return [*out, hole] if fits else out


def size_of(p) -> float:
    return abs(K.ring_area(K.opened(p[0]))) - sum(abs(K.ring_area(K.opened(h))) for h in p[1:])


def test_overlay_of_holed_shapes():
    rng, holes = np.random.default_rng(3), 0
    for _ in range(80):
        a, b = [holed(rng, 0, 0, 10, rng.integers(3, 30))], [holed(rng, rng.uniform(-8, 8), rng.uniform(-8, 8), 10, rng.integers(3, 30))]
        holes += len(a[0]) - 1
        both, left, right, whole = O.intersection(a, b), O.difference(a, b), O.difference(b, a), O.union(a + b)
        assert area(both) == pytest.approx(K.overlap_area(a, b), abs=1e-3)
        assert area(both) + area(left) == pytest.approx(size_of(a[0]), abs=1e-3) and area(both) + area(right) == pytest.approx(size_of(b[0]), abs=1e-3)
        assert area(whole) == pytest.approx(area(both) + area(left) + area(right), abs=1e-3)
        for parts in (both, left, whole):
            assert not O.repaired(parts)[1] or len(parts) > 1
            assert all((K.ring_area(K.opened(r)) > 0) == (k == 0) for p in parts for k, r in enumerate(p))
    assert holes > 20


def test_pieces_that_touch():
    a = [[box(0, 0, 4, 4)]]
    assert O.intersection(a, [[box(4, 0, 8, 4)]]) == [] and O.intersection(a, [[box(4, 4, 5, 5)]]) == []
    assert area(O.difference(a, a)) == 0 and area(O.intersection(a, a)) == 16
    ring = O.difference(a, [[box(1, 1, 3, 3)]])
    assert [len(p) for p in ring] == [2] and area(ring) == 12
    assert [len(p) for p in O.difference(a, [[box(1, -1, 2, 5)]])] == [1, 1]


def near_enough(kind, parts, r, step=0.1) -> float:
    """Area of a buffer by counting points of a grid."""
    every = np.concatenate([x for p in parts for x in p])
    lo, hi = every.min(0) - abs(r) - 1, every.max(0) + abs(r) + 1
    at = np.stack(np.meshgrid(np.arange(lo[0], hi[0], step), np.arange(lo[1], hi[1], step)), -1).reshape(-1, 2)
    far = np.min([K.point_segment_distance(at, s[None])[:, 0] for s in K.segments(parts)], 0)
    inner = np.any([K.inside(at, p) > 0 for p in parts], 0) if kind != 2 else np.zeros(len(at), bool)
    return ((inner | (far <= r)) if r > 0 else (inner & (far >= -r))).sum() * step * step


def test_buffers_by_grid_count():
    rng = np.random.default_rng(4)
    for _ in range(6):
        cases = [(3, [[star(rng, 0, 0, 8, rng.integers(3, 25))]], (0.5, 6, -0.5)), (2, [[rng.uniform(0, 10, (rng.integers(2, 8), 2))]], (0.3, 1.5)), (3, [[box(-10, -10, 10, 10), star(rng, 0, 0, 8, 9)[::-1]]], (0.5, 4, -0.5, -2)), (6, [[star(rng, 0, 0, 5, 7)], [star(rng, 9, 0, 5, 9)]], (0.7,))]
        for kind, parts, sizes in cases:
            for r in sizes:
                want = near_enough(kind, parts, r)
                assert area(O.buffered(kind, parts, r)) == pytest.approx(want, rel=0.02, abs=1.0), (kind, r)


def test_buffers_in_closed_form():
    turn = np.array([[0.6, 0.8], [-0.8, 0.6]])
    for shape in (box(0, 0, 30, 20), box(1e6, 5e6, 1e6 + 30, 5e6 + 20), box(0, 0, 30, 20) @ turn):
        assert area(O.buffered(3, [[shape]], 5)) == pytest.approx(600 + 100 * 5 + 4 * QUARTER * 25, abs=1e-3)
        assert area(O.buffered(3, [[shape[::-1]]], -5)) == pytest.approx(200, abs=1e-3) and O.buffered(3, [[shape]], -10) == []
    ell = np.array([(0, 0), (10, 0), (10, 3), (4, 3), (4, 12), (0, 12), (0, 0)], float)
    assert area(O.buffered(3, [[ell]], 1)) == pytest.approx(66 + 44 + 5 * QUARTER - 1, abs=1e-4)
    assert area(O.buffered(3, [[ell]], -1)) == pytest.approx(66 - 44 + 5 - QUARTER, abs=1e-4)
    line = np.array([(0, 0), (10, 0), (20, 0)], float)
    assert area(O.buffered(2, [[line]], 2)) == pytest.approx(80 + 4 * QUARTER * 4, abs=1e-4)
    assert area(O.buffered(1, [[np.array([(3.0, 4.0)])]], 2)) == pytest.approx(4 * QUARTER * 4)
    road = O.buffered(2, [[box(0, 0, 20, 20)]], 1)  # a line that closes leaves its middle free
    assert [len(p) for p in road] == [2] and area(road) == pytest.approx(80 + 80 + 4 * QUARTER - 4, abs=1e-4)
    frame = [[box(0, 0, 10, 10), box(4, 4, 6, 6)]]
    assert [len(p) for p in O.buffered(3, frame, 0.5)] == [2] and [len(p) for p in O.buffered(3, frame, 1.5)] == [1]


def test_repair():
    cases = {
        "valid": ([box(0, 0, 4, 4)], False, 16, 1),
        "clockwise": ([box(0, 0, 4, 4)[::-1]], False, 16, 1),
        "repeated point": ([np.insert(box(0, 0, 4, 4), 1, (4, 0), 0)], False, 16, 1),
        "point on an edge": ([np.insert(box(0, 0, 4, 4), 1, (2, 0), 0)], False, 16, 1),
        "bow tie": ([np.array([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], float)], True, 8, 2),
        "spike": ([np.insert(box(0, 0, 4, 4), 2, [(4, 4), (9, 4)], 0)], True, 16, 1),
        "hole": ([box(0, 0, 9, 9), box(1, 1, 3, 3)], False, 77, 1),
        "ring in a hole": ([box(0, 0, 9, 9), box(1, 1, 8, 8), box(2, 2, 3, 3)], True, 33, 2),
        "hole outside": ([box(0, 0, 9, 9), box(10, 1, 12, 3)], True, 85, 2),
        "hole across": ([box(0, 0, 4, 4), box(2, 1, 6, 3)], True, 16 - 4 + 4, 2),
        "nothing": ([np.array([(0, 0), (4, 4), (0, 0)], float)], True, 0, 0),
    }
    for name, (rings, wrong, size, parts) in cases.items():
        made, was_wrong = O.repaired([rings])
        assert (was_wrong, len(made)) == (wrong, parts) and area(made) == pytest.approx(size, abs=1e-6), name
        assert not O.repaired(made)[1] or parts > 1


def plain_faces(lines) -> list[np.ndarray]:
    """Bounded faces of noded lines by walking; dead ends taken off first."""
    links: dict = {}
    for line in lines:
        for p, q in zip(map(tuple, line[:-1]), map(tuple, line[1:])):
            links.setdefault(p, set()).add(q)
            links.setdefault(q, set()).add(p)
    while loose := [v for v, n in links.items() if len(n) == 1]:
        for v in loose:
            for w in links.pop(v, ()):
                links[w].discard(v)
        links = {v: n for v, n in links.items() if n}
    turn = {v: sorted(n, key=lambda w: math.atan2(w[1] - v[1], w[0] - v[0])) for v, n in links.items()}
    seen, out = set(), []
    for v in turn:
        for w in turn[v]:
            ring, a, b = [v], v, w
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(b)
                a, b = b, turn[b][(turn[b].index(a) - 1) % len(turn[b])]
            if len(ring) > 1 and K.ring_area(np.array(ring[:-1], float)) > 0:
                out.append(np.array(ring, float))
    return out


def geometry(spark, lines):
    from urbanlattice.functions import geometry as G

    wkt = [(i, "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")") for i, line in enumerate(lines)]
    return spark.createDataFrame(wkt, "id bigint, wkt string").select("id", G.from_wkt(F.col("wkt")).alias("geom"))


def test_faces_of_networks(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.faces import faces

    rng = np.random.default_rng(6)
    n = 9
    grid = [((i, j), (i + 1, j)) for i in range(n) for j in range(n + 1)] + [((i, j), (i, j + 1)) for i in range(n + 1) for j in range(n)]
    grid = [g for g in grid if rng.random() < 0.8]
    skew = lambda p, at=(0, 0), k=10: (k * p[0] + 3 * p[1] + at[0], k * p[1] - 2 * p[0] + at[1])
    lines = [[skew(p) for p in g] for g in grid]
    lines += [[(500, 0), (600, 0), (600, 100), (500, 100), (500, 0)], [(500, 0), (450, -20)], [(540, 40), (560, 40), (560, 60), (540, 60), (540, 40)], [(550, 60), (555, 70), (545, 75)]]
    lines += [lines[0], lines[0][::-1], [(700, 0), (701, 0)], [(600, 100), (650, 150), (700, 150), (650, 200), (650, 150)]]
    got = [r["g"] for r in faces(geometry(spark, lines).repartition(5)).select(F.struct("id", G.area(F.col("geom")).alias("a"), F.size(F.col("geom.parts")[0]).alias("n")).alias("g")).collect()]
    want = sorted(K.ring_area(f[:-1]) for f in plain_faces([[tuple(map(float, p)) for p in line] for line in lines]))
    # the square in the square is a hole of the larger one
    want[want.index(10_000.0)] = 10_000.0 - 400.0
    assert sorted(g["a"] for g in got) == pytest.approx(sorted(want), abs=1e-3) and len({g["id"] for g in got}) == len(got)
    assert [g["n"] for g in got if g["a"] == pytest.approx(9600, abs=1e-3)] == [2]
    assert faces(geometry(spark, [[(0, 0), (1, 1)], [(5, 5), (5, 5)]])).count() == 0 and faces(geometry(spark, lines[:1]).limit(0)).count() == 0


def test_dissolve_of_many_tiles(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.graph import dissolve

    at = spark.range(10_000).select(F.lit(7).alias("k"), (F.col("id") % 100 * 10).cast("double").alias("x"), (F.floor(F.col("id") / 100) * 10).cast("double").alias("y"))
    many = at.select("k", G.rectangle(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10).alias("geom"))
    copies = spark.range(3000).select(F.lit(8).alias("k"), G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(2.0)).alias("geom"))
    lone = spark.sql("SELECT NULL AS k").select(F.col("k").cast("int").alias("k"), G.rectangle(F.lit(5.0), F.lit(5.0), F.lit(6.0), F.lit(7.0)).alias("geom"))
    got = {r["k"]: (r["a"], r["n"]) for r in dissolve(many.union(copies).union(lone), "k", 100.0).select("k", G.area(F.col("geom")).alias("a"), F.size(F.col("geom.parts")[0][0]).alias("n")).collect()}
    assert got == {7: (pytest.approx(1e6), 5), 8: (pytest.approx(6.0), 5), None: (pytest.approx(2.0), 5)}


def test_columns(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators import overlay as V

    rows = [(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), (2, "LINESTRING (0 0, 10 0)"), (3, "POINT (1 1)"), (4, None), (5, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((9 0, 11 0, 11 1, 9 1, 9 0)))"), (6, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")]
    df = spark.createDataFrame(rows, "id bigint, wkt string").select("id", G.from_wkt(F.col("wkt")).alias("geom"))
    got = {r["id"]: r for r in df.select("id", G.area(V.buffer(F.col("geom"), 1.0)).alias("a"), V.buffer(F.col("geom"), F.lit(-0.6)).alias("b"), V.repaired(F.col("geom")).alias("r"), V.intersection(F.col("geom"), V.buffer(F.col("geom"), 0.0)).alias("i")).collect()}
    assert got[1]["a"] == pytest.approx(16 + 16 + 4 * QUARTER) and got[2]["a"] == pytest.approx(20 + 4 * QUARTER) and got[3]["a"] == pytest.approx(4 * QUARTER) and got[4]["a"] is None
    assert got[6]["b"] is None and got[4]["b"] is None and got[1]["b"]["kind"] == 3 and got[2]["b"] is None
    assert got[4]["r"]["geom"] is None and got[4]["r"]["was_invalid"] is None and not got[1]["r"]["was_invalid"] and got[5]["i"]["kind"] == 6 and got[2]["i"] is None
    single, before = V.single_polygons(df)
    assert before == 1 and {r["id"]: r["k"] for r in single.select("id", F.col("geom.kind").alias("k")).collect()} == {1: 3, 2: 3, 3: 3, 4: None, 5: 3, 6: 3}
    none, before = V.single_polygons(df.where("id != 5"))
    assert before == 0 and none.count() == 5


def test_rows_inside_a_boundary(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators import overlay as V

    boundary = spark.createDataFrame([("POLYGON ((0 0, 40 0, 40 100, 0 100, 0 0))",)], "wkt string").select(G.from_wkt(F.col("wkt")).alias("geom"))
    at = spark.range(41).select("id", G.point(F.col("id").cast("double"), F.lit(50.0)).alias("geom"))
    assert sorted(r["id"] for r in V.inside_by(at, boundary, 5.0, 50.0).collect()) == list(range(6, 35))
    assert V.inside_by(at, boundary, 25.0, 50.0).count() == 0
