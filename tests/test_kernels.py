import math

import numpy as np
import pytest

from urbanlattice.functions import kernels as K
from urbanlattice.functions import overlay as O

RECT = np.array([(0, 0), (3, 0), (3, 8), (0, 8), (0, 0)], float)


def turned(ring, degrees):
    t = math.radians(degrees)
    return ring @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])


def test_rectangle_measures():
    assert K.circle_diameter(RECT) == pytest.approx(math.sqrt(73))
    short, long, _ = K.min_rectangle(RECT)
    assert short / long == pytest.approx(0.375)
    for degrees in (10, 30, 77):
        _, _, azimuth = K.min_rectangle(turned(RECT, degrees))
        assert K.fold_orientation(azimuth) == pytest.approx(45 - abs(degrees % 90 - 45))
        assert K.circle_diameter(turned(RECT, degrees)) == pytest.approx(math.sqrt(73))


def test_circle_holds_all_points():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 200):
        p = rng.normal(size=(n, 2))
        d = K.circle_diameter(p)
        far = max((math.dist(a, b) for a in p for b in p), default=0)
        assert far <= d * (1 + 1e-9) <= far * 2 / math.sqrt(3) * (1 + 1e-6) + 1e-9


def test_star_and_l():
    star = np.array([(5 + r * math.cos(k * math.pi / 5), 5 + r * math.sin(k * math.pi / 5)) for k in range(10) for r in [9 if k % 2 == 0 else 4]])
    ell = np.array([(0, 0), (10, 0), (10, 3), (4, 3), (4, 12), (0, 12)], float)
    assert K.overlap_area([[star]], [[ell]]) == pytest.approx(44.617321, abs=1e-6)


def test_hole_counts_off():
    outer = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    hole = np.array([(3, 3), (7, 3), (7, 7), (3, 7)], float)
    assert K.overlap_area([[outer, hole]], [[outer]]) == pytest.approx(84)
    assert K.inside(np.array([(5, 5), (1, 1), (3, 5), (11, 1)], float), [outer, hole]).tolist() == [-1, 1, 0, -1]


def test_touching_counts_as_meeting():
    one = [[np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)]]
    for dx, dy, meets in ((1, 0, True), (1, 1, True), (1.01, 0, False), (0.2, 0.2, True)):
        two = [[one[0][0] + (dx, dy)]]
        assert K.intersects(3, one, 3, two) is meets
    inner = [[one[0][0] * 0.5 + 0.25]]
    assert K.intersects(3, inner, 3, one) and K.intersects(3, one, 3, inner)


def test_shared_wall():
    one = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert K.line_inside_length(K.segments([[one]]), [[one + (1, 0)]]) == pytest.approx(1)
    assert K.line_inside_length(K.segments([[one]]), [[one + (1, 1)]]) == pytest.approx(0)


def test_union_of_a_row_is_one_rectangle():
    one = np.array([(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)], float)
    (row,) = O.union([[one], [one + (2, 0)], [one + (1, 0.5)]])
    length = np.hypot(*np.diff(row[0], axis=0).T).sum()
    assert (K.ring_area(K.opened(row[0])), length, len(row[0]) - 1, len(row)) == (pytest.approx(5), pytest.approx(11), 8, 1)
