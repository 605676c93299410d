"""Geometry in a struct column: kind (1 point, 2 line, 3 polygon, 5 multi-line, 6 multi-polygon) and
parts -> rings -> vertices. Rings are closed. Folds over vertices are column expressions; hulls, circles and
rectangles are Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels

GEOM = "struct<kind:tinyint,parts:array<array<array<struct<x:double,y:double>>>>>"
ENV = "struct<minx:double,miny:double,maxx:double,maxy:double>"
#: Area of a 64-gon with circumradius 1, by which point buffers are measured.
BUFFER_AREA = 32 * math.sin(math.pi / 32)


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that the optimizer computes once a row: neither lambdas nor filters above inline it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _vertices(text: Column) -> Column:
    pairs = F.transform(F.split(text, ","), lambda s: F.split(F.trim(s), r"\s+"))
    return F.transform(pairs, lambda p: F.struct(F.get(p, 0).cast("double").alias("x"), F.get(p, 1).cast("double").alias("y")))


def from_wkt(wkt: Column) -> Column:
    """WKT to geometry, a third coordinate dropped; null for null, empty or unknown text."""
    body = F.regexp_replace(F.trim(wkt), r"(?i)^\s*(multi)?(point|linestring|linearring|polygon)\s*(z|m|zm)?\s*\(|\)\s*$", "")
    tag = F.upper(F.regexp_extract(wkt, r"(?i)^\s*((?:multi)?(?:point|linestring|linearring|polygon))\s*(?:z|m|zm)?\s*\(", 1))
    rings = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\(([^()]*)\)"), 1), _vertices)
    polygons = F.transform(F.regexp_extract_all(body, F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), 1), rings)
    make = lambda kind, parts: F.struct(F.lit(kind).cast("tinyint").alias("kind"), parts.alias("parts")).cast(GEOM)
    return (
        F.when(tag == "POINT", make(1, F.array(F.array(_vertices(body)))))
        .when(tag.isin("LINESTRING", "LINEARRING"), make(2, F.array(F.array(_vertices(body)))))
        .when(tag == "POLYGON", make(3, F.array(rings(body))))
        .when(tag == "MULTILINESTRING", make(5, F.transform(F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), 1), lambda s: F.array(_vertices(s)))))
        .when(tag == "MULTIPOLYGON", make(6, polygons))
    )


def wkt_heights(wkt: Column) -> Column:
    """The third coordinates of all vertices of WKT, an empty array without any."""
    points = F.split(F.regexp_replace(wkt, r"(?i)^[a-z\s]*", ""), ",")
    numbers = F.transform(points, lambda p: F.split(F.trim(F.regexp_replace(p, r"[()]", " ")), r"\s+"))
    return F.filter(F.transform(numbers, lambda n: F.get(n, 2).try_cast("double")), lambda z: z.isNotNull())


def as_wkt(g: Column) -> Column:
    points = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    ring = lambda r: F.concat(F.lit("("), points(r), F.lit(")"))
    poly = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    one, k = g["parts"][0], g["kind"]
    return (
        F.when(k == 1, F.concat(F.lit("POINT "), ring(one[0])))
        .when(k == 2, F.concat(F.lit("LINESTRING "), ring(one[0])))
        .when(k == 3, F.concat(F.lit("POLYGON "), poly(one)))
        .when(k == 5, F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(g["parts"], lambda p: ring(p[0])), ", "), F.lit(")")))
        .when(k == 6, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(g["parts"], poly), ", "), F.lit(")")))
    )


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def only(condition: Column, g: Column) -> Column:
    """``g`` where ``condition`` holds, else a geometry of kind 0 without parts, which kernels pass over.

    Not null: batches for Python are measured after each row, which for nested nulls walks back over all nulls before."""
    nothing = F.struct(F.lit(0).cast("tinyint").alias("kind"), F.array().cast("array<array<array<struct<x:double,y:double>>>>").alias("parts")).cast(GEOM)
    return F.when(condition, g).otherwise(nothing)


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit(1).cast("tinyint").alias("kind"), F.array(F.array(F.array(_vertex(x, y)))).alias("parts")).cast(GEOM)


def segment(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.lit(2).cast("tinyint").alias("kind"), F.array(F.array(F.array(_vertex(x0, y0), _vertex(x1, y1)))).alias("parts")).cast(GEOM)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise."""
    ring = F.array(_vertex(x0, y0), _vertex(x1, y0), _vertex(x1, y1), _vertex(x0, y1), _vertex(x0, y0))
    return F.struct(F.lit(3).cast("tinyint").alias("kind"), F.array(F.array(ring)).alias("parts")).cast(GEOM)


def _fold(ring: Column, term) -> Column:
    """Sum of term(vertex, next vertex) over a ring's edges."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), F.lit(0.0), lambda s, i: s + F.coalesce(term(F.get(ring, i), F.get(ring, i + 1)), F.lit(0.0)))


def ring_area(ring: Column) -> Column:
    return F.abs(_fold(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def area(g: Column) -> Column:
    """Planar; holes count off; 0 for points and lines."""
    part = lambda p: _total(F.transform(p, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))))
    return F.when(g["kind"].isin(3, 6), _total(F.transform(g["parts"], part))).when(g.isNotNull(), F.lit(0.0))


def length(g: Column) -> Column:
    """Of lines, or of all rings of polygons, holes included."""
    edge = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    return _total(F.transform(F.flatten(g["parts"]), lambda r: _fold(r, edge)))


KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 5: "MultiLineString", 6: "MultiPolygon"}


def kind_name(g: Column) -> Column:
    """The kind's usual name."""
    return F.element_at(F.create_map(*[F.lit(x) for k in KINDS for x in (k, KINDS[k])]), g["kind"].cast("int"))


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def envelope(g: Column) -> Column:
    bounds = lambda xs, ys: F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    return let(vertices(g), lambda v: let(F.transform(v, lambda p: p["x"]), lambda xs: let(F.transform(v, lambda p: p["y"]), lambda ys: bounds(xs, ys))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def centroid(g: Column) -> Column:
    """struct<x, y>: by area for polygons, by length for lines, the first vertex for points.

    Moments are relative to the first vertex and divided once at the end: whole and half coordinates come out exactly."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    triple = lambda a, x, y: F.struct(a.alias("a"), x.alias("x"), y.alias("y"))

    def of(o):
        def areal(s, p, q):
            px, py, qx, qy = p["x"] - o["x"], p["y"] - o["y"], q["x"] - o["x"], q["y"] - o["y"]
            c = px * qy - qx * py
            return triple(s["a"] + c, s["x"] + c * (px + qx), s["y"] + c * (py + qy))

        def linear(s, p, q):
            d = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
            return triple(s["a"] + d, s["x"] + d * (p["x"] + q["x"] - 2 * o["x"]), s["y"] + d * (p["y"] + q["y"] - 2 * o["y"]))

        def moments(ring, step):
            return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), zero, lambda s, i: step(s, F.get(ring, i), F.get(ring, i + 1)))

        def turned(m, i):
            # an outline counts as positive and a hole as negative, however they turn
            sign = F.when((m["a"] >= 0) == (i == 0), F.lit(1.0)).otherwise(F.lit(-1.0))
            return let(sign, lambda k: triple(m["a"] * k, m["x"] * k, m["y"] * k))

        add = lambda ms: F.aggregate(ms, zero, lambda s, m: triple(s["a"] + m["a"], s["x"] + m["x"], s["y"] + m["y"]))
        poly = lambda: add(F.flatten(F.transform(g["parts"], lambda p: F.transform(F.transform(p, lambda r: moments(r, areal)), turned))))
        line = lambda: add(F.transform(F.flatten(g["parts"]), lambda r: moments(r, linear)))
        mean = lambda total, k: let(total, lambda m: F.struct((o["x"] + F.try_divide(m["x"], k * m["a"])).alias("x"), (o["y"] + F.try_divide(m["y"], k * m["a"])).alias("y")))
        return F.when(g["kind"].isin(3, 6), mean(poly(), 3)).when(g["kind"].isin(2, 5), mean(line(), 2)).otherwise(F.struct(o["x"].alias("x"), o["y"].alias("y")))

    return let(F.get(F.get(F.get(g["parts"], 0), 0), 0), of)


def corners(g: Column) -> Column:
    """Vertices of outlines with an inner angle of at most 170 degrees; parts add up."""

    def of(ring):
        n = F.size(ring) - 1

        def is_corner(i):
            a, b, c = F.get(ring, i), F.get(ring, i + 1), F.get(ring, F.when(i + 2 > n, 1).otherwise(i + 2))
            ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
            cos = F.try_divide(ux * vx + uy * vy, F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))
            angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
            return F.coalesce((angle <= 170).cast("long"), F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, i: s + is_corner(i))

    return F.when(g["kind"].isin(3, 6), F.aggregate(F.transform(g["parts"], lambda p: of(p[0])), F.lit(0).cast("long"), lambda s, x: s + x))


def phi(g: Column, c: Column) -> Column:
    """Area over that of the 64-gon around the centroid ``c`` (a held column) through the farthest vertex."""
    r2 = F.array_max(F.transform(vertices(g), lambda p: (p["x"] - c["x"]) * (p["x"] - c["x"]) + (p["y"] - c["y"]) * (p["y"] - c["y"])))
    return F.try_divide(area(g), BUFFER_AREA * r2)


def largest_part(g: Column) -> Column:
    """The largest polygon of a multi-polygon (the first on ties); others as they are."""
    parts = F.transform(g["parts"], lambda p, i: F.struct((ring_area(p[0]) - _total(F.transform(F.slice(p, 2, 1_000_000), ring_area))).alias("a"), (-i).alias("i"), p.alias("p")))
    best = F.aggregate(parts, parts[0], lambda s, x: F.when((x["a"] > s["a"]), x).otherwise(s))
    return F.when(g["kind"] == 6, F.struct(F.lit(3).cast("tinyint").alias("kind"), F.array(best["p"]).alias("parts")).cast(GEOM)).otherwise(g)


def is_rectangle(g: Column, env: Column) -> Column:
    """Whether a polygon is an axis-aligned rectangle without holes, given its envelope."""
    ring = F.get(F.get(g["parts"], 0), 0)
    one = (g["kind"] == 3) & (F.size(g["parts"]) == 1) & (F.size(F.get(g["parts"], 0)) == 1) & (F.size(ring) == 5)
    side = lambda p, q: (p["x"] == q["x"]) != (p["y"] == q["y"])
    turns = [side(F.get(ring, k), F.get(ring, k + 1)) for k in range(4)]
    wide = (env["maxx"] > env["minx"]) & (env["maxy"] > env["miny"])
    corner = lambda p: p["x"].isin(env["minx"], env["maxx"]) & p["y"].isin(env["miny"], env["maxy"])
    return F.coalesce(one & wide & turns[0] & turns[1] & turns[2] & turns[3] & corner(F.get(ring, 0)) & corner(F.get(ring, 1)) & corner(F.get(ring, 2)) & corner(F.get(ring, 3)), F.lit(False))


class Shapes:
    """A batch's geometry column as NumPy: ``shapes[i]`` is the parts of row i, lists of rings, which are views of one array."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.column = column
        parts = pc.struct_field(column, "parts")
        rings = parts.values
        vertices = rings.values
        points = vertices.values
        self.kinds = pc.fill_null(pc.struct_field(column, "kind"), 0).to_numpy(zero_copy_only=False)
        self.known = parts.is_valid().to_numpy(zero_copy_only=False)
        self.parts, self.rings, self.vertices = (x.offsets.to_numpy() for x in (parts, rings, vertices))
        self.xy = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in range(2)]).astype(float, copy=False)

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> list[list[np.ndarray]] | None:
        if not self.known[i]:
            return None
        return [[self.xy[self.vertices[r] : self.vertices[r + 1]] for r in range(self.rings[p], self.rings[p + 1])] for p in range(self.parts[i], self.parts[i + 1])]

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, their sides (n, 2)) of the polygons that are rectangles along the axes: one ring of five vertices, edges turn by turn along x and y."""
        at = np.flatnonzero(self.known & (self.kinds == 3) & (np.diff(self.parts) == 1))
        at = at[np.diff(self.rings)[self.parts[:-1][at]] == 1]
        ring = self.rings[:-1][self.parts[:-1][at]]
        five = np.diff(self.vertices)[ring] == 5
        at, p = at[five], self.xy[self.vertices[:-1][ring[five]][:, None] + np.arange(5)]
        moves = np.diff(p, axis=1) != 0
        ok = (p[:, 0] == p[:, 4]).all(1) & (moves[:, :, 0] != moves[:, :, 1]).all(1) & (moves[:, 1:, 0] != moves[:, :-1, 0]).all(1) & np.isfinite(p).all((1, 2))
        return at[ok], np.ptp(p[ok], axis=1)

    def points(self, i: int) -> np.ndarray:
        """All vertices of row i."""
        first, last = (self.vertices[self.rings[self.parts[k]]] for k in (i, i + 1))
        return self.xy[first:last]


def column_of(rows: list[tuple[int, list[list[np.ndarray]]] | None]) -> pa.Array:
    """A geometry column from (kind, parts) of each row, null for None: vertices are copied as arrays, never one by one."""
    known = [r is not None for r in rows]
    parts = [r[1] if r is not None else [] for r in rows]
    rings = [p for ps in parts for p in ps]
    vertices = [v for rs in rings for v in rs]
    xy = np.concatenate([np.empty((0, 2)), *vertices])
    ends = lambda xs: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    nested = pa.ListArray.from_arrays(ends(vertices), points)
    for xs in (rings, parts):
        nested = pa.ListArray.from_arrays(ends(xs), nested)
    kinds = pa.array([r[0] if r is not None else 0 for r in rows], pa.int8())
    return pa.StructArray.from_arrays([kinds, nested], ["kind", "parts"], mask=pa.array([not k for k in known]))


def polygon_row(parts: list[list[np.ndarray]]) -> tuple[int, list[list[np.ndarray]]] | None:
    """Parts as a polygon or multi-polygon, null if there are none."""
    return (3 if len(parts) == 1 else 6, parts) if parts else None


def to_parts(g) -> list[list[np.ndarray]]:
    """A geometry value of pandas, as arrays."""
    return [[np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2) for ring in part] for part in g["parts"]]


def points_of(g) -> np.ndarray:
    return np.array([(v["x"], v["y"]) for part in g["parts"] for ring in part for v in ring], float).reshape(-1, 2)


def vectorized(kind: str):
    """A pandas function of columns; made on use, so that modules load without a session."""

    def make(f):
        return lambda *cols: F.pandas_udf(f, kind)(*cols)

    return make


def arrowed(kind: str):
    """An Arrow function of columns; made on use, so that modules load without a session."""

    def make(f):
        return lambda *cols: F.arrow_udf(f, kind)(*cols)

    return make


MEASURE_NAMES = ("longest_axis", "hull_area", "elongation", "orientation")


@arrowed("longest_axis double, hull_area double, elongation double, orientation double")
def shape_measures(g: pa.Array) -> pa.Array:
    """Least circle's diameter, hull area, short over long side of the least rectangle, its deviation from north."""
    shapes = Shapes(g)
    values, known = np.zeros((len(shapes), 4)), np.zeros((len(shapes), 4), bool)
    # rectangles along the axes, of which a table may have millions, need neither hull nor search
    boxes, sides = shapes.boxes()
    w, d = sides.T
    values[boxes] = np.column_stack([np.hypot(w, d), w * d, sides.min(1) / sides.max(1), np.zeros(len(boxes))])
    known[boxes] = True
    for i in np.setdiff1d(np.flatnonzero(shapes.known), boxes):
        if not len(p := shapes.points(i)):
            continue
        rect = kernels.min_rectangle(p)
        if shapes.kinds[i] in (2, 5):
            d = p[-1] - p[0]
            turn = math.degrees(math.atan2(d[0], d[1])) % 180
        else:
            turn = rect[2] if rect else None
        row = (kernels.circle_diameter(p), abs(kernels.ring_area(kernels.hull(p))), rect[0] / rect[1] if rect else None, None if turn is None else kernels.fold_orientation(turn))
        known[i] = [v is not None for v in row]
        values[i] = [0.0 if v is None else v for v in row]
    # a geometry without vertices has no measures
    columns = [pa.array(np.ascontiguousarray(values[:, k]), mask=~known[:, k]) for k in range(4)]
    return pa.StructArray.from_arrays(columns, list(MEASURE_NAMES), mask=pa.array(~known[:, 0]))
