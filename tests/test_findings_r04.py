"""What the findings of round 4 were about, in the urban-form queries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from urbanlattice.functions import geometry as G
from urbanlattice.functions import kernels
from urbanlattice.operators import buildings as B
from urbanlattice.operators import spatial_join as J


def _table(spark, shapes):
    """id and geom of rings or lists of rings, all closed."""
    text = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    rows = [(i, "POLYGON (" + ", ".join(text(r) for r in rings) + ")") for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "id bigint, wkt string").select("id", G.from_wkt(F.col("wkt")).alias("geom"))


def _box(x, y, w, d):
    return [(x, y), (x + w, y), (x + w, y + d), (x, y + d), (x, y)]


def test_boxes_in_a_disc_as_the_kernel_cuts_them():
    r = np.random.default_rng(5)
    x, y, w, d = np.round(r.uniform([[-50], [-50], [0], [0]], [[50], [50], [40], [40]], (4, 600)) * 2) / 2
    for radius in (25.0, 40.0):
        turn = np.arange(64) * np.pi / 32
        disc = radius * np.column_stack([np.cos(turn), np.sin(turn)])
        want = [kernels.convex_overlap([[np.array(_box(*b))]], disc) for b in zip(x, y, w, d)]
        assert np.abs(kernels.box_in_disc(x, y, x + w, y + d, radius) - want).max() < 1e-9


def test_boxes_in_round_buffers_meet_no_kernel_pair_by_pair(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a kernel was reached")

    for name, kind in (("intersects", "boolean"), ("convex_overlap_area", "double")):
        monkeypatch.setattr(B, name, J._pairs(refused, kind))
    b = _table(spark, [[_box(10 * (k % 6), 9 * (k // 6), 4 + k % 5, 3 + k % 7)] for k in range(36)]).withColumn("footprint_area", G.area(F.col("geom")))
    got = B.buildings_distance_based(b, b, (9.0, 20.0), mode="round", same=True, means=("footprint_area",), deviations=()).collect()
    assert len(got) == 36 and all(r["total_ft_area_within_buffer_20"] > r["total_ft_area_within_buffer_9"] > 0 for r in got)


def test_round_buffers_over_boxes_and_other_shapes(spark):
    r = np.random.default_rng(6)
    shapes = []
    for k in range(50):
        x, y, w, d = (float(v) for v in (*r.integers(0, 60, 2), *r.integers(4, 14, 2)))
        ell = [(x, y), (x + w, y), (x + w, y + d / 2), (x + w / 2, y + d / 2), (x + w / 2, y + d), (x, y + d), (x, y)]
        shapes.append([[_box(x, y, w, d)], [ell], [_box(x, y, w, d), _box(x + 1, y + 1, 1.0, 2.0)]][k % 3])
    b = _table(spark, shapes).withColumn("footprint_area", G.area(F.col("geom")))
    sizes = (9.0, 16.0)
    got = {q["id"]: q for q in B.buildings_distance_based(b, b, sizes, mode="round", same=True, means=("footprint_area",), deviations=()).collect()}
    discs = {q["id"]: [np.array(G.to_parts(q[f"d{k}"])[0][0]) for k in range(2)] for q in b.select("id", F.explode(F.array(G.centroid(F.col("geom")))).alias("c")).select("id", *[B.disc(F.col("c"), s).alias(f"d{k}") for k, s in enumerate(sizes)]).collect()}
    parts = {i: [[np.array(q) for q in rings]] for i, rings in enumerate(shapes)}
    for i in parts:
        for k, s in enumerate(sizes):
            met = [j for j in parts if j != i and kernels.intersects(3, [[discs[i][k]]], 3, parts[j])]
            assert got[i][f"buildings_within_buffer_{s:g}"] == len(met)
            assert abs(got[i][f"total_ft_area_within_buffer_{s:g}"] - sum(kernels.convex_overlap(parts[j], discs[i][k][:-1]) for j in met)) < 1e-6


def _rings(r, n):
    """Turned boxes, stars with narrow necks, concave and crossed rings, some with vertices on their edges."""
    out = []
    for k in range(n):
        m = int(r.integers(3, 11))
        turn = np.sort(r.uniform(0, 2 * np.pi, m)) if k % 4 else np.arange(4) * np.pi / 2 + r.uniform(0, 1)
        far = r.uniform(2, 30, len(turn)) if k % 4 else np.full(4, r.uniform(2, 30))
        p = np.column_stack([far * np.cos(turn), far * np.sin(turn)]) + r.uniform(-1e5, 1e5, 2)
        p = r.permutation(p) if k % 7 == 6 else p
        p = np.insert(p, 1, (p[0] + p[1]) / 2, axis=0) if k % 5 == 4 else p
        p = np.round(p) if k % 3 == 0 else p
        p = p[::-1] if k % 2 else p
        out.append(np.vstack([p, p[:1]]))
    return out


def _same(one, two):
    assert [len(p) for p in one] == [len(p) for p in two]
    for a, b in ((a, b) for p, q in zip(one, two) for a, b in zip(p, q)):
        assert a.shape == b.shape and np.abs(a - b).max() < 1e-5


def test_rings_that_need_no_cutting_are_drawn_as_the_overlay_has_them():
    from urbanlattice.functions import overlay as O

    rings = _rings(np.random.default_rng(7), 400)
    for by in (3.0, 0.05, -0.5, -2.0):
        made = O.offsets(rings, np.full(len(rings), by))
        assert 40 < sum(m is not None for m in made) < len(rings)
        for ring, m in zip(rings, made):
            if m is None:
                continue
            (p,) = O.oriented([ring])
            d = np.diff(p, axis=0)
            turn = np.angle(np.exp(1j * np.diff(np.arctan2(d[:, 1], d[:, 0]), append=np.arctan2(*d[0][::-1]))))
            out = turn * np.sign(by) > 0
            steps = np.maximum(1, np.floor(np.abs(turn) / (np.pi / 32) + 0.5))
            # strips along the edges, arcs between them, what two strips share
            area = kernels.ring_area(p[:-1]) + by * np.hypot(*d.T).sum() + np.sign(by) * by * by * np.where(out, steps * np.sin(np.abs(turn) / steps) / 2, -np.tan(np.abs(turn) / 2)).sum()
            got, slack = kernels.ring_area(O.opened(m)), 1e-6 * np.hypot(*d.T).sum() + 1e-5
            assert abs(got - area) < slack
            if np.abs(turn).min() > 0.3:  # the overlay loses vertices that turn slightly
                (whole,) = O.buffered(3, [[ring]], by)
                assert len(whole) == 1 and abs(got - kernels.ring_area(O.opened(whole[0]))) < 2 * slack


def test_simple_buffers_need_no_overlay(monkeypatch):
    from urbanlattice.functions import overlay as O

    box = lambda x, y, w, d: np.array(_box(x, y, w, d), float)
    ell = np.array([(0, 0), (20, 0), (20, 20), (10, 20), (10, 40), (0, 40), (0, 0)], float)
    turned = box(0, 0, 25, 40) @ np.array([[0.6, 0.8], [-0.8, 0.6]])
    shapes = [(3, [[turned]]), (3, [[ell]]), (3, [[box(0, 0, 30, 40), box(3, 4, 6, 7)]]), (6, [[box(0, 0, 20, 40)], [box(60, 0, 20, 20)]])]
    # a hole that meets the outline, parts that meet, a neck that closes and a shape that is shrunk away need one
    hard = [(3, [[box(0, 0, 30, 40), box(1, 1, 6, 7)]], -1.0), (6, [[box(0, 0, 20, 40)], [box(21, 0, 20, 20)]], 2.0), (3, [[np.array([(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9), (0, 0)], float)]], 2.0), (3, [[box(0, 0, 3, 40)]], -2.0)]
    asked = [(k, p, by) for k, p in shapes for by in (2.0, -0.5)] + hard
    want = [O.buffered(*a) for a in asked]
    for one, two in zip(O.buffers(asked), want):
        _same(one, two)
    areas = [sum(abs(kernels.ring_area(O.opened(q))) * (1 if k == 0 else -1) for p in g for k, q in enumerate(p)) for g in want]
    assert np.abs(O.areas(want) - areas).max() < 1e-9
    monkeypatch.setattr(O, "noded", lambda *_: 1 / 0)
    for one, two in zip(O.buffers(asked[: -len(hard)]), want):
        _same(one, two)


def test_measures_of_buffers_are_those_of_their_geometries(spark):
    from urbanlattice.operators import overlay as P
    from urbanlattice.plans import views as V

    s = V.shapes(spark, "/root/testdata/sf0.001").select("id", G.from_wkt(F.when(F.col("id") % 9 > 0, F.col("wkt"))).alias("g")).unionByName(spark.range(1).selectExpr("id - 5 AS id", "NULL AS g"))
    s = s.select("id", "g", P.buffer_measures(F.col("g"), [2.0, -12.0]).alias("m"), P.buffer(F.col("g"), 2.0).alias("a"), P.buffer(F.col("g"), -12.0).alias("b"))
    n = 0
    for r in s.select("m", *[x for k in "ab" for x in (G.area(F.col(k)).alias(f"area_{k}"), F.size(F.col(f"{k}.parts")).alias(f"parts_{k}"), F.size(F.flatten(f"{k}.parts")).alias(f"rings_{k}"))]).collect():
        for i, k in enumerate("ab"):
            n += r[f"area_{k}"] is None
            assert (r["m"][f"area{i}"] is None) == (r[f"area_{k}"] is None) and abs((r["m"][f"area{i}"] or 0) - (r[f"area_{k}"] or 0)) < 1e-6
            assert r["m"][f"parts{i}"] == max(r[f"parts_{k}"] or 0, 0) and r["m"][f"rings{i}"] == max(r[f"rings_{k}"] or 0, 0)
    assert n > 2
