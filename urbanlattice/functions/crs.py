"""Map projections as column expressions: transverse Mercator, Lambert conformal conic and Krovak, both ways.

Formulas are those of the public geodetic guidance notes: Krueger's series in the third flattening (good to a millimetre
within a zone), Lambert's conic with two parallels, and the oblique conic of Krovak. Datums that coincide with WGS84 within
a metre are taken as equal; others (Bessel, International) are shifted by seven parameters through geocentric coordinates, at
height 0, where ``transformed`` goes from one datum to another."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

GRS80, BESSEL, INTERNATIONAL = (6378137.0, 298.257222101), (6377397.155, 299.1528128), (6378388.0, 297.0)


@dataclass(frozen=True)
class Projection:
    """``kind``: tm, lcc or krovak; angles in degrees, lengths in metres."""

    kind: str
    ellipsoid: tuple[float, float]
    lon0: float
    lat0: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    parallels: tuple[float, float] = (0.0, 0.0)
    #: To WGS84, as rotations of position vectors: three metres, three seconds of arc, parts in a million.
    shift: tuple[float, ...] | None = None

    @property
    def e2(self) -> float:
        f = 1 / self.ellipsoid[1]
        return f * (2 - f)


#: Fixed values of the public registry: shifts of the datums of the Czech and of the Luxembourg grid to WGS84.
SHIFTS = {5514: (570.8, 85.7, 462.8, 4.998, 1.587, 5.261, 3.56), 2169: (-189.6806, 18.3463, -42.7695, -0.33746, -3.09264, 2.53861, 0.4598)}

#: By EPSG code: zones of the universal grid in Europe, and national grids.
PROJECTIONS = {25800 + z: Projection("tm", GRS80, 6 * z - 183, 0.0, 0.9996, 500_000.0) for z in range(28, 39)} | {
    32600 + z: Projection("tm", (6378137.0, 298.257223563), 6 * z - 183, 0.0, 0.9996, 500_000.0) for z in range(1, 61)
} | {
    7794: Projection("tm", GRS80, 12.0, 0.0, 0.9985, 7_000_000.0),
    2169: Projection("tm", INTERNATIONAL, 6 + 1 / 6, 49 + 5 / 6, 1.0, 80_000.0, 100_000.0, shift=SHIFTS[2169]),
    2154: Projection("lcc", GRS80, 3.0, 46.5, 1.0, 700_000.0, 6_600_000.0, (49.0, 44.0)),
    5514: Projection("krovak", BESSEL, 24 + 5 / 6, 49.5, 0.9999, shift=SHIFTS[5514]),
}


def projection(epsg: int) -> Projection:
    if epsg not in PROJECTIONS:
        raise ValueError(f"no formula for EPSG:{epsg}")
    return PROJECTIONS[epsg]


def _series(c: list[float], turn: Callable[[int], Column]) -> Column:
    out = F.lit(0.0)
    for j, x in enumerate(c, 1):
        out = out + x * turn(2 * j)
    return out


def _tm(p: Projection) -> tuple[float, list[float], list[float], list[float]]:
    f = 1 / p.ellipsoid[1]
    n = f / (2 - f)
    radius = p.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, alpha, beta, delta


def _meridian(p: Projection) -> float:
    """Northing of the origin's latitude, of scale 1."""
    radius, alpha, _, _ = _tm(p)
    e, lat = math.sqrt(p.e2), math.radians(p.lat0)
    xi = math.atan(math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))))
    return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


def _lcc(p: Projection) -> tuple[float, float, float]:
    e = math.sqrt(p.e2)
    t = lambda lat: math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)
    m = lambda lat: math.cos(lat) / math.sqrt(1 - p.e2 * math.sin(lat) ** 2)
    a, b, o = map(math.radians, (*p.parallels, p.lat0))
    n = (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b))) if a != b else math.sin(a)
    c = m(a) / (n * t(a) ** n)
    return n, c, p.ellipsoid[0] * c * t(o) ** n


def _krovak(p: Projection) -> tuple[float, ...]:
    e, lat = math.sqrt(p.e2), math.radians(p.lat0)
    b = math.sqrt(1 + p.e2 * math.cos(lat) ** 4 / (1 - p.e2))
    g = math.asin(math.sin(lat) / b)
    t0 = math.tan(math.pi / 4 + g / 2) * ((1 + e * math.sin(lat)) / (1 - e * math.sin(lat))) ** (e * b / 2) / math.tan(math.pi / 4 + lat / 2) ** b
    pole, tilt = math.radians(78.5), math.radians(30 + 17 / 60 + 17.30311 / 3600)
    r0 = p.scale * p.ellipsoid[0] * math.sqrt(1 - p.e2) / (1 - p.e2 * math.sin(lat) ** 2) / math.tan(pole)
    return b, t0, pole, tilt, r0, math.sin(pole)


def forward(epsg: int | Projection, lon: Column, lat: Column) -> Column:
    """struct<x, y> of longitude and latitude in degrees. Krovak: x is the westing with its sign turned, y the southing's."""
    p = epsg if isinstance(epsg, Projection) else projection(epsg)
    e = math.sqrt(p.e2)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def of(s):
        phi, lam = F.radians(s["lat"]), F.radians(s["lon"] - p.lon0)
        if p.kind == "tm":
            radius, alpha, _, _ = _tm(p)
            q = F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi))
            return G.let(F.struct(F.atan2(F.sinh(q), F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.cosh(q)).alias("eta")), lambda u: at(
                p.east + p.scale * radius * (u["eta"] + _series(alpha, lambda k: F.cos(k * u["xi"]) * F.sinh(k * u["eta"]))),
                p.north - p.scale * _meridian(p) + p.scale * radius * (u["xi"] + _series(alpha, lambda k: F.sin(k * u["xi"]) * F.cosh(k * u["eta"]))),
            ))
        if p.kind == "lcc":
            n, c, r0 = _lcc(p)
            t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
            return G.let(p.ellipsoid[0] * c * F.pow(t, F.lit(n)), lambda r: at(p.east + r * F.sin(n * lam), p.north + r0 - r * F.cos(n * lam)))
        b, t0, pole, tilt, r0, n = _krovak(p)
        u = 2 * (F.atan(t0 * F.pow(F.tan(phi / 2 + math.pi / 4), F.lit(b)) / F.pow((1 + e * F.sin(phi)) / (1 - e * F.sin(phi)), F.lit(e * b / 2))) - math.pi / 4)
        v = -b * lam
        t = F.asin(math.cos(tilt) * F.sin(u) + math.sin(tilt) * F.cos(u) * F.cos(v))
        d = F.asin(F.cos(u) * F.sin(v) / F.cos(t))
        r = r0 * math.tan(math.pi / 4 + pole / 2) ** n / F.pow(F.tan(t / 2 + math.pi / 4), F.lit(n))
        return at(-r * F.sin(n * d), -r * F.cos(n * d))

    return G.let(F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")), of)


def inverse(epsg: int | Projection, x: Column, y: Column) -> Column:
    """struct<lon, lat> in degrees of projected coordinates."""
    p = epsg if isinstance(epsg, Projection) else projection(epsg)
    e = math.sqrt(p.e2)
    at = lambda lon, lat: F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))

    def settled(first: Column, step: Callable[[Column], Column]) -> Column:
        """A latitude by rounds of ``step``; each gains over two digits."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(9)), first, lambda s, _: step(s))

    def of(s):
        if p.kind == "tm":
            radius, _, beta, delta = _tm(p)
            xi, eta = (s["y"] - p.north + p.scale * _meridian(p)) / (p.scale * radius), (s["x"] - p.east) / (p.scale * radius)
            a = xi - _series(beta, lambda k: F.sin(k * xi) * F.cosh(k * eta))
            b = eta - _series(beta, lambda k: F.cos(k * xi) * F.sinh(k * eta))
            return G.let(F.struct(a.alias("a"), b.alias("b")), lambda u: G.let(F.asin(F.sin(u["a"]) / F.cosh(u["b"])), lambda chi: at(math.radians(p.lon0) + F.atan2(F.sinh(u["b"]), F.cos(u["a"])), chi + _series(delta, lambda k: F.sin(k * chi)))))
        if p.kind == "lcc":
            n, c, r0 = _lcc(p)
            dx, dy = s["x"] - p.east, r0 - (s["y"] - p.north)
            t = F.pow(F.sqrt(dx * dx + dy * dy) / (p.ellipsoid[0] * c), F.lit(1 / n))
            lat = G.let(t, lambda t: settled(math.pi / 2 - 2 * F.atan(t), lambda f: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(f)) / (1 + e * F.sin(f)), F.lit(e / 2)))))
            return at(F.atan2(dx, dy) / n + math.radians(p.lon0), lat)
        b, t0, pole, tilt, r0, n = _krovak(p)
        r = F.sqrt(s["x"] * s["x"] + s["y"] * s["y"])
        d = F.atan2(-s["x"], -s["y"]) / n
        t = 2 * (F.atan(F.pow(r0 / r, F.lit(1 / n)) * math.tan(math.pi / 4 + pole / 2)) - math.pi / 4)
        u = F.asin(math.cos(tilt) * F.sin(t) - math.sin(tilt) * F.cos(t) * F.cos(d))
        v = F.asin(F.cos(t) * F.sin(d) / F.cos(u))
        lat = G.let(u, lambda u: settled(u, lambda f: 2 * (F.atan(t0 ** (-1 / b) * F.pow(F.tan(u / 2 + math.pi / 4), F.lit(1 / b)) * F.pow((1 + e * F.sin(f)) / (1 - e * F.sin(f)), F.lit(e / 2))) - math.pi / 4)))
        return at(math.radians(p.lon0) - v / b, lat)

    return G.let(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), of)


WGS84 = (6378137.0, 298.257223563)


def geocentric(ellipsoid: tuple[float, float], lon: Column, lat: Column, height: Column | float = 0.0) -> Column:
    """struct<x, y, z> of degrees and metres over an ellipsoid."""
    f = 1 / ellipsoid[1]
    e2, h = f * (2 - f), height if isinstance(height, Column) else F.lit(float(height))
    phi, lam = F.radians(lat), F.radians(lon)
    return G.let(ellipsoid[0] / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi)), lambda n: F.struct(((n + h) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + h) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - e2) + h) * F.sin(phi)).alias("z")))


def geographic(ellipsoid: tuple[float, float], p: Column) -> Column:
    """struct<lon, lat> in degrees of geocentric struct<x, y, z>, by Bowring's formula (exact to micrometres near the ground)."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    e2, b = f * (2 - f), ellipsoid[0] * (1 - 1 / ellipsoid[1])
    second = e2 / (1 - e2)
    r = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    return G.let(F.atan2(p["z"] * a, r * b), lambda t: F.struct(
        F.degrees(F.atan2(p["y"], p["x"])).alias("lon"),
        F.degrees(F.atan2(p["z"] + second * b * F.pow(F.sin(t), F.lit(3.0)), r - e2 * a * F.pow(F.cos(t), F.lit(3.0)))).alias("lat"),
    ))


def shifted(shift: tuple[float, ...], p: Column, back: bool = False) -> Column:
    """Geocentric struct<x, y, z> after a seven-parameter shift, or before it (``back``: the matrix is inverted exactly)."""
    dx, dy, dz, rx, ry, rz, ppm = shift
    rx, ry, rz = (math.radians(v / 3600) for v in (rx, ry, rz))
    m = 1 + ppm * 1e-6
    rows = [(1.0, -rz, ry), (rz, 1.0, -rx), (-ry, rx, 1.0)]
    names = ("x", "y", "z")
    if not back:
        return F.struct(*[(d + m * sum((c * p[k] for c, k in zip(row, names)), F.lit(0.0))).alias(n) for d, row, n in zip((dx, dy, dz), rows, names)])
    # the inverse of 1 + the cross product with r, times what is left without the offset
    det = 1 + rx * rx + ry * ry + rz * rz
    inverse_rows = [((1 + rx * rx) / det, (rx * ry + rz) / det, (rx * rz - ry) / det), ((rx * ry - rz) / det, (1 + ry * ry) / det, (ry * rz + rx) / det), ((rx * rz + ry) / det, (ry * rz - rx) / det, (1 + rz * rz) / det)]
    return F.struct(*[sum((c * (p[k] - d) / m for c, k, d in zip(row, names, (dx, dy, dz))), F.lit(0.0)).alias(n) for row, n in zip(inverse_rows, names)])


def to_wgs84(p: Projection, lon: Column, lat: Column) -> Column:
    """struct<lon, lat> on WGS84 of degrees on a projection's datum."""
    if not p.shift:
        return F.struct(lon.alias("lon"), lat.alias("lat"))
    return G.let(G.let(geocentric(p.ellipsoid, lon, lat), lambda x: shifted(p.shift, x)), lambda x: geographic(WGS84, x))


def from_wgs84(p: Projection, lon: Column, lat: Column) -> Column:
    """struct<lon, lat> on a projection's datum of degrees on WGS84."""
    if not p.shift:
        return F.struct(lon.alias("lon"), lat.alias("lat"))
    return G.let(G.let(geocentric(WGS84, lon, lat), lambda x: shifted(p.shift, x, True)), lambda x: geographic(p.ellipsoid, x))


def transformed(g: Column, source: int, target: int) -> Column:
    """A geometry in another system; 4326 stands for longitude and latitude on WGS84. Datums are shifted where they differ."""
    if source == target:
        return g

    def move(v):
        if source == 4326:
            ll = F.struct(v["x"].alias("lon"), v["y"].alias("lat"))
        else:
            ll = G.let(inverse(source, v["x"], v["y"]), lambda u: to_wgs84(projection(source), u["lon"], u["lat"]))

        def on(u):
            if target == 4326:
                return F.struct(u["lon"].alias("x"), u["lat"].alias("y"))
            return G.let(from_wgs84(projection(target), u["lon"], u["lat"]), lambda w: forward(target, w["lon"], w["lat"]))

        return G.let(ll, on)

    parts = F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, move)))
    return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), parts.alias("parts")).cast(G.GEOM))


def centroid_lat_lon(g: Column, source: int) -> Column:
    """struct<lat, lon> of the centroid of the geometry once in degrees."""
    return G.let(G.centroid(transformed(g, source, 4326)), lambda c: F.struct(c["y"].alias("lat"), c["x"].alias("lon")))


def look_up_positions(text: Column, source: int) -> Column:
    """struct<lat, lon> of the centroid of a polygon given as a list of positions, of three numbers each if their count is a
    multiple of three, else of two. Null for fewer than three positions."""
    n = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))

    def of(v):
        wide = F.when(F.size(v) % 3 == 0, F.lit(3)).otherwise(F.lit(2))
        last = F.floor(F.size(v) / wide).cast("int") - 1
        ring = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.get(v, i * wide).alias("x"), F.get(v, i * wide + 1).alias("y")))
        closed = F.when(F.get(ring, 0) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
        polygon = F.struct(F.lit(3).cast("tinyint").alias("kind"), F.array(F.array(closed)).alias("parts")).cast(G.GEOM)
        return F.when(last >= 2, centroid_lat_lon(polygon, source))

    return G.let(n, of)


def axes_confused(first: Column, source: int) -> Column:
    """Whether the first vertex, struct<x, y>, has its axes swapped: read as it is, its longitude would exceed its latitude.
    Holds in Europe, where latitudes are the larger numbers."""
    return G.let(inverse(source, first["x"], first["y"]), lambda u: u["lon"] > u["lat"])
