"""Building features: shape, touching neighbours, window aggregates. Tables have ``id`` and ``geom``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels
from ..session import cut, spread
from .spatial_join import clipped_rectangle_area, convex_overlap_area, envelope_join, gap, intersects, is_box, ring_length_inside, spatial_join

MEASURES = ("footprint_area", "elongation", "convexity", "orientation")


def building_level(df: DataFrame) -> DataFrame:
    """id, FootprintArea, Perimeter, Phi, LongestAxisLength, Elongation, Convexity, Orientation, Corners, centroid."""
    g = F.col("geom")
    return G.hold(G.hold(spread(df), "_c", G.centroid(g)), "_m", G.shape_measures("geom")).select(
        *df.columns,
        G.area(g).alias("FootprintArea"),
        G.length(g).alias("Perimeter"),
        G.phi(g, F.col("_c")).alias("Phi"),
        F.col("_m.longest_axis").alias("LongestAxisLength"),
        F.col("_m.elongation").alias("Elongation"),
        F.try_divide(G.area(g), F.col("_m.hull_area")).alias("Convexity"),
        F.col("_m.orientation").alias("Orientation"),
        G.corners(g).alias("Corners"),
    )


def touches(df: DataFrame, size: float = 100.0) -> DataFrame:
    """id, CountTouches, SharedWallLength: other polygons that a building's outline meets, and the length of the outline in them."""
    a = df.select(F.col("id").alias("id"), F.col("geom").alias("_g"))
    b = df.select(F.col("id").alias("_o"), F.col("geom").alias("_h"))
    ring = F.struct(F.lit(2).cast("tinyint").alias("kind"), F.transform("_g.parts", lambda p: F.array(p[0])).alias("parts")).cast(G.GEOM)
    pairs = spatial_join(a, b, "_g", "_h", "envelope", size).where("id != _o").withColumn("_r", ring).where(intersects("_r", "_h"))
    got = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("CountTouches"), F.sum(ring_length_inside("_g", "_h")).alias("SharedWallLength"))
    return df.select("id").join(got, "id", "left").select("id", F.coalesce("CountTouches", F.lit(0).cast("long")).alias("CountTouches"), F.coalesce("SharedWallLength", F.lit(0.0)).alias("SharedWallLength"))


@G.arrowed("double")
def clipped_area(g: pa.Array, w: pa.Array) -> pa.Array:
    shapes, out = G.Shapes(g), []
    boxes = np.column_stack([pc.struct_field(w, c).to_numpy(zero_copy_only=False) for c in ("minx", "miny", "maxx", "maxy")])
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        if not shapes.kinds[i] or (parts := shapes[i]) is None:
            out.append(None)
            continue
        window = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
        out.append(float(sum(abs(kernels.ring_area(kernels.clip_convex(r, window))) * (1 if k == 0 else -1) for p in parts for k, r in enumerate(p))))
    return pa.array(out, pa.float64())


def _sides(left: DataFrame, right: DataFrame, buffer: float) -> tuple[DataFrame, DataFrame]:
    """Left rows (id, _cen, l_env: the square of ``buffer`` around the centroid) and right ones (r_*, r_env)."""
    a = G.hold(spread(left.select("id", "geom")), "_cen", G.centroid(F.col("geom"))).drop("geom")
    a = G.hold(a, "l_env", window_of(buffer))
    return a, G.hold(spread(right).select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_env", G.envelope(F.col("r_geom")))


def window_pairs(left: DataFrame, right: DataFrame, buffer: float) -> DataFrame:
    """Pairs of a left row (id, geom) and right rows whose envelope meets the square of ``buffer`` around its centroid.
    One row's own copy counts, as do edges that only touch. Adds _cen, the centroid."""
    return envelope_join(*_sides(left, right, buffer), 2.0 * buffer, small=True)


def _in_window(buffer: float) -> Column:
    c, e = F.col("_cen"), F.col("r_env")
    return (e["minx"] <= c["x"] + buffer) & (e["maxx"] >= c["x"] - buffer) & (e["miny"] <= c["y"] + buffer) & (e["maxy"] >= c["y"] - buffer)


def _within(sizes: list[float]):
    """Whether a pair of the largest buffer is in buffer b: in the largest all are."""
    return lambda b: F.lit(True) if b == max(sizes) else _in_window(b)


def window_of(buffer: float) -> Column:
    c = F.col("_cen")
    return F.struct((c["x"] - buffer).alias("minx"), (c["y"] - buffer).alias("miny"), (c["x"] + buffer).alias("maxx"), (c["y"] + buffer).alias("maxy"))


def window_stats(pairs: DataFrame, sizes: list[float], aggregates) -> DataFrame:
    """All buffer sizes from the pairs of the largest one. ``aggregates(condition, size, label)`` gives aliased columns."""
    aggs = [a for b in sizes for a in aggregates(_within(sizes)(b), b, f"{b:g}")]
    return pairs.groupBy("id").agg(*aggs)


def zero_filled(df: DataFrame, got: DataFrame) -> DataFrame:
    names = [c for c in got.columns if c != "id"]
    return df.select("id").join(got, "id", "left").select("id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in names])


def disc(c: Column, r: float) -> Column:
    """The 64-gon of circumradius ``r`` around a held centroid."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.struct((c["x"] + r * F.cos((k % 64) * (math.pi / 32))).alias("x"), (c["y"] + r * F.sin((k % 64) * (math.pi / 32))).alias("y")))
    return F.struct(F.lit(3).cast("tinyint").alias("kind"), F.array(F.array(turn)).alias("parts")).cast(G.GEOM)


#: Of a 64-gon with circumradius 1: the radius of the circle inside it.
INNER = math.cos(math.pi / 64)


def _from_centre() -> list[Column]:
    """An envelope's sides, seen from the centroid."""
    c, e = F.col("_cen"), F.col("r_env")
    return [e["minx"] - c["x"], e["miny"] - c["y"], e["maxx"] - c["x"], e["maxy"] - c["y"]]


def reach() -> Column:
    """Radius of the circle inside the least 64-gon around _cen that a box r_env meets: of the box's nearest point, folded into an
    eighth of the plane, the farthest that any of the eighth's sides has it. A side that it is beyond has the whole box beyond it."""
    x0, y0, x1, y1 = _from_centre()
    dx, dy = F.greatest(x0, -x1, F.lit(0.0)), F.greatest(y0, -y1, F.lit(0.0))
    angles = [(k + 0.5) * math.pi / 32 for k in range(8)]
    return F.greatest(*[F.greatest(dx, dy) * math.cos(t) + F.least(dx, dy) * math.sin(t) for t in angles])


def box_in_disc(r: float) -> Column:
    """Area of a box r_env inside the 64-gon of circumradius ``r`` around _cen, of many pairs at once."""

    @G.arrowed("double")
    def udf(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        return pa.array(kernels.box_in_disc(*[v.to_numpy(zero_copy_only=False) for v in (x0, y0, x1, y1)], r))

    return udf(*_from_centre())


def meets_disc(b: float) -> Column:
    """Whether r_geom, which is no box, meets the 64-gon of circumradius ``b`` around _cen, _gap away from its envelope: what lies
    outside the circle around it doesn't."""
    asked = F.col("_gap") <= b * (1 + 1e-12)
    return F.coalesce(intersects(G.only(asked, disc(F.col("_cen"), b)), G.only(asked, F.col("r_geom"))), F.lit(False))


def area_in_disc(b: float) -> Column:
    """Area of r_geom, which is no box, inside that 64-gon. What lies in the circle inside it is whole."""
    x0, y0, x1, y1 = _from_centre()
    x, y, near = F.greatest(F.abs(x0), F.abs(x1)), F.greatest(F.abs(y0), F.abs(y1)), F.col(f"`_meets_{b:g}`")
    whole = near & (F.sqrt(x * x + y * y) < b * INNER * (1 - 1e-12))
    cut_ = near & ~whole
    return F.when(whole, G.area(F.col("r_geom"))).otherwise(convex_overlap_area(G.only(cut_, disc(F.col("_cen"), b)), G.only(cut_, F.col("r_geom"))))


def _round_pairs(df: DataFrame, others: DataFrame, sizes: list[float], same: bool, areas: bool) -> DataFrame:
    """Pairs of the largest round buffer with _meets_b and, for ``areas``, _a_b of each size. Boxes have a join of their own, which
    carries no geometry and goes past no kernel that sees pairs one by one."""
    most = max(sizes)
    a, b = _sides(df, others, most)
    b = G.hold(b, "_rb", is_box(F.col("r_geom"), F.col("r_env")))
    # looked through for levels and for what is no box before it is joined
    b = cut(b.withColumn("r_geom", G.only(~F.col("_rb"), F.col("r_geom"))))
    own = [c for c in b.columns if c not in ("r_geom", "r_env", "_rb")]
    kept = ["id", "_cen", *own, *[f"`_meets_{s:g}`" for s in sizes]]

    def met(right: DataFrame) -> DataFrame:
        pairs = envelope_join(a, right, 2.0 * most, small=True)
        return pairs.where("id != r_id") if same else pairs

    out = met(b.where("_rb").drop("r_geom", "_rb")).withColumn("_reach", reach()).where(F.col("_reach") <= most * INNER)
    out = out.select("*", *[(F.col("_reach") <= s * INNER).alias(f"_meets_{s:g}") for s in sizes]).select(*kept, *[box_in_disc(s).alias(f"_a_{s:g}") for s in sizes if areas])
    if b.where("NOT _rb").isEmpty():
        return out
    c = F.col("_cen")
    rest = G.hold(met(b.where("NOT _rb")), "_gap", gap(F.struct(c["x"].alias("minx"), c["y"].alias("miny"), c["x"].alias("maxx"), c["y"].alias("maxy")), F.col("r_env")))
    for s in sizes:
        rest = G.hold(rest, f"_meets_{s:g}", meets_disc(s))
    rest = rest.where(F.col(f"`_meets_{most:g}`"))
    for s in sizes if areas else ():
        rest = G.hold(rest, f"_a_{s:g}", area_in_disc(s))
    return out.unionByName(rest.select(*kept, *[f"`_a_{s:g}`" for s in sizes if areas]))


def near_pairs(df: DataFrame, others: DataFrame, sizes: list[float], mode: str = "bbox", same: bool = False, areas: bool = False):
    """(pairs, near): pairs of the largest buffer, with the others' columns as r_*, and near(b), whether a pair is in buffer b.

    ``bbox``: the other's envelope meets the square around the centroid, one's own copy included. ``round``: the other meets
    the 64-gon around it, and its geometry is left out; ``same`` says that both tables are one, whose own copies are left out,
    ``areas`` adds _a_b, the other's area in buffer b."""
    if mode == "bbox":
        return window_pairs(df, others, max(sizes)), _within(sizes)
    if mode != "round":
        raise ValueError(mode)
    return _round_pairs(df, others, sizes, same, areas), lambda b: F.col(f"`_meets_{b:g}`")


def buildings_distance_based(df: DataFrame, others: DataFrame, sizes=(100.0, 500.0), rectangles: bool = False, mode: str = "bbox", same: bool = False, count: bool = True, total: bool = True, means=MEASURES, deviations=MEASURES) -> DataFrame:
    """Count, clipped area, mean and sample deviation of the others' measures within buffers, 0 where there's none.

    ``others``: id, geom and the measures. Parts of a building that a buffer cuts count by area; ``rectangles`` says that
    all footprints are axis-aligned rectangles, whose clipping by a square is an expression. ``mode``: ``bbox`` or ``round``
    (see ``near_pairs``)."""
    if mode == "round":
        others = others.select("id", "geom", *dict.fromkeys([*means, *deviations]))
    pairs, near_of = near_pairs(df, others, list(sizes), mode, same, total)
    area_of = lambda b: F.col(f"`_a_{b:g}`")
    if not total or mode == "round":
        pass
    elif rectangles:
        pairs = pairs.drop("r_geom")
        area_of = lambda b: clipped_rectangle_area(F.col("r_env"), window_of(b))
    else:
        # only footprints that a window cuts reach the kernel
        for b in sizes:
            w, e = window_of(b), F.col("r_env")
            whole = (e["minx"] >= w["minx"]) & (e["maxx"] <= w["maxx"]) & (e["miny"] >= w["miny"]) & (e["maxy"] <= w["maxy"])
            sliced = clipped_area(G.only(near_of(b) & ~whole, F.col("r_geom")), w)
            pairs = G.hold(pairs, f"_a_{b:g}", F.when(whole, F.col("r_footprint_area")).otherwise(sliced))

    def aggregates(b):
        near, label = near_of(b), f"{b:g}"
        out = [F.sum(near.cast("double")).alias(f"buildings_within_buffer_{label}")] if count else []
        out += [F.sum(F.when(near, area_of(b))).alias(f"total_ft_area_within_buffer_{label}")] if total else []
        out += [F.avg(F.when(near, F.col(f"r_{m}"))).alias(f"av_{m}_within_buffer_{label}") for m in means]
        return out + [F.stddev_samp(F.when(near, F.col(f"r_{m}"))).alias(f"std_{m}_within_buffer_{label}") for m in deviations]

    return zero_filled(df, pairs.groupBy("id").agg(*[a for b in sizes for a in aggregates(b)]))


def round_buffer_pairs(left: DataFrame, right: DataFrame, buffer: float, same: bool) -> DataFrame:
    """(id, r_id): right rows that meet the 64-gon of ``buffer`` around the left centroid; own copies dropped if ``same``."""
    return near_pairs(left, right.select("id", "geom"), [buffer], "round", same)[0].select("id", "r_id")
