"""Planar geometry on NumPy arrays: what column expressions can't say. Rings are (n, 2) arrays, closed or not."""

from __future__ import annotations

import math

import numpy as np


def opened(ring: np.ndarray) -> np.ndarray:
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def following(a: np.ndarray) -> np.ndarray:
    """Each row's next one, around a ring; ``np.roll`` costs several times as much on short ones."""
    return np.concatenate((a[1:], a[:1]))


def before(a: np.ndarray) -> np.ndarray:
    return np.concatenate((a[-1:], a[:-1]))


def ring_area(ring: np.ndarray) -> float:
    """Signed: positive if counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return 0.5 * float(np.dot(x, following(y)) - np.dot(following(x), y))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, open (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out: list = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def circle_diameter(points: np.ndarray) -> float:
    """Diameter of the least enclosing circle: the farthest point outside joins the support until none is left."""
    h = hull(points)
    if len(h) == 1:
        return 0.0
    if len(h) == 2:
        return float(math.dist(*h))
    # far from the origin, rounding would pass for a distance
    h = h - h[0]

    def through(idx):
        if len(idx) == 2:
            a, b = h[idx[0]], h[idx[1]]
            return (a + b) / 2, math.dist(a, b) / 2
        a, b, c = h[list(idx)]
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if d == 0:
            return None
        u, v = b - a, c - a
        o = a + np.array([v[1] * u.dot(u) - u[1] * v.dot(v), u[0] * v.dot(v) - v[0] * u.dot(u)]) / d
        return o, math.dist(o, a)

    from itertools import combinations

    support = (0, int(((h - h[0]) ** 2).sum(1).argmax()))
    for _ in range(10 * len(h) + 50):
        found = []
        # the least circle of at most four points, by its two or three supports; of slim triangles none may hold all of them
        # to the last digit: then the one that misses least
        for k in (2, 3):
            for idx in combinations(support, k):
                if got := through(idx):
                    over = max(math.dist(got[0], h[i]) for i in support) - got[1] * (1 + 1e-12) - 1e-12
                    found.append((max(over, 0.0), got[1], idx, got[0]))
        _, r, idx, o = min(found, key=lambda f: f[:2])
        far = np.hypot(*(h - o).T)
        i = int(far.argmax())
        if far[i] <= r * (1 + 1e-12) + 1e-12:
            return 2 * float(r)
        support = (*idx, i)
    return 2 * float(r)


def min_rectangle(points: np.ndarray) -> tuple[float, float, float] | None:
    """(short side, long side, azimuth of the long side in degrees from north, 0-180) of the rectangle of least area."""
    h = hull(points)
    if len(h) < 3:
        return None
    e = np.roll(h, -1, 0) - h
    e = e / np.hypot(e[:, 0], e[:, 1])[:, None]
    along, across = h @ e.T, h @ np.stack([-e[:, 1], e[:, 0]])
    w, d = np.ptp(along, 0), np.ptp(across, 0)
    i = int((w * d).argmin())
    t = e[i] if w[i] >= d[i] else np.array([-e[i][1], e[i][0]])
    return float(min(w[i], d[i])), float(max(w[i], d[i])), math.degrees(math.atan2(t[0], t[1])) % 180


def fold_orientation(azimuth: float) -> float:
    """Deviation from the cardinal directions, 0-45 degrees."""
    return 45 - abs(azimuth % 90 - 45)


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a ring inside a convex counter-clockwise window; its area is right for concave rings too."""
    out = opened(ring)
    w = opened(window)
    for a, b in zip(w, np.roll(w, -1, 0)):
        if not len(out):
            break
        n = np.array([a[1] - b[1], b[0] - a[0]])
        side = (out - a) @ n
        nxt, s2 = np.roll(out, -1, 0), np.roll(side, -1)
        parts = []
        for p, q, s, t in zip(out, nxt, side, s2):
            if s >= 0:
                parts.append(p)
            if (s > 0 > t) or (s < 0 < t):
                parts.append(p + (q - p) * (s / (s - t)))
        out = np.array(parts).reshape(-1, 2)
    return out


def triangles(rings: list[np.ndarray]):
    """Signed fan triangles of a polygon with holes: their signed areas sum to its area."""
    for k, ring in enumerate(rings):
        r = opened(ring)
        want = 1 if k == 0 else -1
        turn = 1 if ring_area(r) >= 0 else -1
        for i in range(1, len(r) - 1):
            t = r[[0, i, i + 1]]
            a = ring_area(t)
            if a:
                yield (t if a > 0 else t[::-1]), (1 if a > 0 else -1) * turn * want


def overlap_area(one: list[list[np.ndarray]], two: list[list[np.ndarray]]) -> float:
    """Area of the intersection of two (multi)polygons, each a list of parts, each a list of rings, the first its outline."""
    total = 0.0
    second = [(t, s, t.min(0), t.max(0)) for p in two for t, s in triangles(p)]
    for p in one:
        for t, s in triangles(p):
            lo, hi = t.min(0), t.max(0)
            for u, v, lo2, hi2 in second:
                if (lo < hi2).all() and (lo2 < hi).all():
                    total += s * v * ring_area(clip_convex(t, u))
    return max(0.0, total)


def convex_overlap(parts: list[list[np.ndarray]], window: np.ndarray) -> float:
    """Area of (multi)polygon parts inside a convex counter-clockwise window."""
    total = 0.0
    low, high = window.min(0), window.max(0)
    for p in parts:
        if (p[0].min(0) >= high).any() or (p[0].max(0) <= low).any():
            continue
        edge = np.roll(window, -1, 0) - window
        away = (edge[:, 0] * (p[0][:, None, 1] - window[:, 1]) - edge[:, 1] * (p[0][:, None, 0] - window[:, 0])).min()
        rings = p if away >= 0 else [clip_convex(r, window) for r in p]
        total += sum(abs(ring_area(r)) * (1 if k == 0 else -1) for k, r in enumerate(rings))
    return total


def box_in_disc(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, r: float) -> np.ndarray:
    """Areas of boxes inside the 64-gon of circumradius ``r`` around the origin."""
    turn = np.arange(17) * (math.pi / 32)
    # the boundary in the first quadrant, from the top down; it is its own mirror image in the diagonal
    x, y = r * np.sin(turn), r * np.cos(turn)
    y[-1] = 0.0
    under = np.concatenate([[0.0], np.cumsum((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2)])

    def below(t: np.ndarray) -> np.ndarray:
        """Area under the boundary from 0 to ``t``."""
        k = np.minimum(np.searchsorted(x, t, "right") - 1, 15)
        return under[k] + (t - x[k]) * (y[k] + np.interp(t, x, y)) / 2

    def corner(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Area between the origin and (u, v), negative in the second and fourth quadrant."""
        a, b = np.minimum(np.abs(u), r), np.minimum(np.abs(v), r)
        flat = np.minimum(a, np.interp(b, x, y))  # up to here the height is b
        return np.sign(u) * np.sign(v) * (b * flat + below(a) - below(flat))

    return np.maximum(0.0, corner(x1, y1) - corner(x0, y1) - corner(x1, y0) + corner(x0, y0))


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, for each point."""
    crossing, border = np.zeros(len(points), bool), np.zeros(len(points), bool)
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    for ring in rings:
        a = opened(ring)
        b = np.roll(a, -1, 0)
        x1, y1, x2, y2 = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        border |= ((cross == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))).any(1)
        straddle = (y1 > y) != (y2 > y)
        left = np.where(y2 > y1, cross > 0, cross < 0)
        crossing ^= (straddle & left).sum(1) % 2 == 1
    return np.where(border, 0, np.where(crossing, 1, -1))


def segments(parts: list[list[np.ndarray]]) -> np.ndarray:
    """(n, 2, 2) of all edges."""
    out = [np.stack([r[:-1], r[1:]], 1) for p in parts for r in p if len(r) > 1]
    return np.concatenate(out) if out else np.zeros((0, 2, 2))


def _orient(a, b, c):
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def segments_meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each pair of segments whether they share a point."""
    a, b, c, d = s[:, None, 0], s[:, None, 1], t[None, :, 0], t[None, :, 1]
    o1, o2, o3, o4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
    boxes = ((np.minimum(a, b) <= np.maximum(c, d)) & (np.minimum(c, d) <= np.maximum(a, b))).all(-1)
    return boxes & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def intersects(kind1: int, one, kind2: int, two) -> bool:
    """Whether two geometries share a point, boundaries included. Kinds: 1 point, 2 line, 3 polygon, 5 and 6 their multiples."""
    areal = lambda k: k in (3, 6)
    p1, p2 = (np.concatenate([r for p in g for r in p]) for g in (one, two))
    if kind1 == 1 and kind2 == 1:
        return bool((p1[0] == p2[0]).all())
    if areal(kind2) and any((inside(p1[:1] if not areal(kind1) or kind1 == 3 else np.array([p[0][0] for p in one]), p) >= 0).any() for p in two):
        return True
    if areal(kind1) and any((inside(np.array([p[0][0] for p in two]), p) >= 0).any() for p in one):
        return True
    s, t = (segments(g) if k != 1 else np.stack([p, p], 1) for g, k, p in ((one, kind1, p1), (two, kind2, p2)))
    return bool(len(s) and len(t) and segments_meet(s, t).any())


def point_segment_distance(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    a, d = s[:, 0], s[:, 1] - s[:, 0]
    n = (d * d).sum(1)
    t = np.clip(((p[:, None] - a) * d).sum(-1) / np.where(n == 0, 1, n), 0, 1)
    return np.hypot(*np.moveaxis(p[:, None] - a - t[..., None] * d, -1, 0))


def distance(kind1: int, one, kind2: int, two) -> float:
    if intersects(kind1, one, kind2, two):
        return 0.0
    p1, p2 = (np.concatenate([r for p in g for r in p]) for g in (one, two))
    s, t = (segments(g) if k != 1 else np.stack([p, p], 1) for g, k, p in ((one, kind1, p1), (two, kind2, p2)))
    return float(min(point_segment_distance(p1, t).min(), point_segment_distance(p2, s).min()))


def line_inside_length(edges: np.ndarray, parts: list[list[np.ndarray]]) -> float:
    """Length of the edges that lies in a closed polygon: edges are cut where they meet its boundary, middles are tested."""
    total, walls = 0.0, segments(parts)
    for a, b in edges:
        d = b - a
        length = float(np.hypot(*d))
        if not length:
            continue
        c, e = walls[:, 0], walls[:, 1] - walls[:, 0]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        ca = c - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ca[:, 0] * e[:, 1] - ca[:, 1] * e[:, 0]) / den
            u = (ca[:, 0] * d[1] - ca[:, 1] * d[0]) / den
        cuts = t[(den != 0) & (u >= 0) & (u <= 1) & (t > 0) & (t < 1)]
        flat = (den == 0) & (np.abs(ca[:, 0] * d[1] - ca[:, 1] * d[0]) <= 1e-9 * length)
        ends = np.concatenate([(walls[flat, 0] - a) @ d, (walls[flat, 1] - a) @ d]) / length**2
        cuts = np.unique(np.concatenate([[0.0, 1.0], cuts, ends[(ends > 0) & (ends < 1)]]))
        middles = a + ((cuts[:-1] + cuts[1:]) / 2)[:, None] * d
        ok = np.zeros(len(middles), bool)
        for p in parts:
            ok |= inside(np.round(middles, 9), [np.round(r, 9) for r in p]) >= 0
        total += float((cuts[1:] - cuts[:-1])[ok].sum()) * length
    return total
