"""Faces of planar networks as joins over half-edges: no network is walked in one task.

Each edge is two half-edges. Around every node a window by angle tells which half-edge follows
which with the face on its left; pointer doubling gives the half-edges of a cycle the least id
among them, in log2(longest cycle) rounds. Edges with one face on both sides (dead ends,
bridges) are dropped and the rest linked anew. Cycles that turn counter-clockwise are outlines;
of the others, which are outer borders, those inside a face are its holes. Areas and
envelopes of cycles are aggregates; only outlines and holes, each a city block's, are brought
together as rings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels
from ..session import cut, discard, spread
from .spatial_join import envelope_join

#: Metres of a step of the grid that vertices are snapped to.
GRID = 1e-6
_END = ("ux", "uy", "vx", "vy")


def half_edges(lines: DataFrame) -> DataFrame:
    """(h, ux, uy, vx, vy): both directions of the distinct edges of noded lines (geom), ends in steps of the grid; the two of an edge are 2 e and 2 e + 1."""
    at = lambda p: (F.round(p["x"] / GRID).cast("long"), F.round(p["y"] / GRID).cast("long"))
    ring = F.explode(F.flatten("geom.parts")).alias("r")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(F.get("r", i - 1).alias("u"), F.get("r", i).alias("v")))).alias("s")
    s = lines.where("geom IS NOT NULL").select(ring).where("size(r) > 1").select(pair)
    (ux, uy), (vx, vy) = at(F.col("s.u")), at(F.col("s.v"))
    e = s.select(ux.alias("ux"), uy.alias("uy"), vx.alias("vx"), vy.alias("vy")).where("ux != vx OR uy != vy")
    low = (F.col("ux") < F.col("vx")) | ((F.col("ux") == F.col("vx")) & (F.col("uy") < F.col("vy")))
    least = e.select(*[F.when(low, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_END, ("vx", "vy", "ux", "uy"))]).distinct()
    one = cut(least.withColumn("e", F.monotonically_increasing_id()))
    return one.select((F.col("e") * 2).alias("h"), *_END).union(one.select(F.col("e") * 2 + 1, "vx", "vy", "ux", "uy"))


def linked(edges: DataFrame) -> DataFrame:
    """(h, nxt): the half-edge that follows each with the same face on the left: at its end, the next clockwise from the way back."""
    around = Window.partitionBy("ux", "uy").orderBy(F.atan2((F.col("vy") - F.col("uy")).cast("double"), (F.col("vx") - F.col("ux")).cast("double")), "h")
    last = F.last("h").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return edges.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.coalesce(F.lag("h").over(around), last).alias("nxt"))


def labelled(links: DataFrame) -> DataFrame:
    """(h, lab): the least half-edge of each one's cycle, by pointer doubling."""
    now = cut(links.select("h", "nxt", F.col("h").alias("lab")))
    while True:
        far = now.select(F.col("h").alias("_h"), F.col("nxt").alias("_n"), F.col("lab").alias("_l"))
        new = cut(now.join(far, now["nxt"] == far["_h"]).select("h", F.col("_n").alias("nxt"), F.least("lab", "_l").alias("lab"), (F.col("_l") < F.col("lab")).alias("fell")))
        discard(now)
        now = new
        # if no least id of 2**k half-edges fell by looking 2**k farther, each has seen its whole cycle
        if now.where("fell").isEmpty():
            return now.select("h", "lab")


def cycles(edges: DataFrame) -> DataFrame:
    """(h, nxt, lab, ux, uy, vx, vy) of the half-edges whose edge has two faces."""
    links = cut(linked(edges))
    lab = labelled(links)
    two = lab.groupBy(F.shiftright("h", 1).alias("e")).agg((F.min("lab") != F.max("lab")).alias("two"))
    kept = cut(edges.join(two.where("two").select("e"), F.shiftright("h", 1) == F.col("e"), "left_semi"))
    if not two.where("NOT two").isEmpty():
        discard(links)
        links = cut(linked(kept))
        lab = labelled(links)
    return cut(kept.join(links, "h").join(lab, "h"))


def _rings(half: DataFrame) -> DataFrame:
    """(lab, ring): each cycle's half-edges (lab, h, nxt, ux, uy) as a polygon of one ring."""

    @G.arrowed(G.GEOM)
    def walked(h: pa.Array, nxt: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        rows = []
        for hs, ns, xs, ys in zip(*(c.to_pylist() for c in (h, nxt, x, y))):
            place = {k: i for i, k in enumerate(hs)}
            order, i = [], 0
            while True:
                order.append(i)
                i = place[ns[i]]
                if i == 0:
                    break
            order.append(0)
            rows.append((3, [[np.column_stack([xs, ys])[order] * GRID]]))
        return G.column_of(rows)

    all_ = half.groupBy("lab").agg(F.sort_array(F.collect_list(F.struct("h", "nxt", "ux", "uy"))).alias("s"))
    return G.hold(spread(all_), "ring", walked("s.h", "s.nxt", "s.ux", "s.uy")).select("lab", "ring")


@G.arrowed("boolean")
def _holds(g: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether a point is strictly inside."""
    shapes, at = G.Shapes(g), np.column_stack([c.to_numpy(zero_copy_only=False) for c in (x, y)])
    return pa.array([bool(kernels.inside(at[i : i + 1], shapes[i][0])[0] > 0) for i in range(len(shapes))], pa.bool_())


def faces(lines: DataFrame, size: float = 200.0) -> DataFrame:
    """(id, geom): the bounded faces of noded lines (geom), with holes where other networks lie inside them.

    Dead ends and bridges bound nothing. Repeated lines count once; null geometries and lines of no length not at all."""
    half = cycles(half_edges(lines))
    o = half.agg(F.min("ux").alias("x"), F.min("uy").alias("y")).first()
    if o["x"] is None:
        return lines.sparkSession.createDataFrame([], f"id bigint, geom {G.GEOM}")
    x = lambda c: (F.col(c) - F.lit(o["x"])).cast("double")
    y = lambda c: (F.col(c) - F.lit(o["y"])).cast("double")
    stats = cut(
        half.groupBy("lab").agg(
            F.sum(x("ux") * y("vy") - x("vx") * y("uy")).alias("a"), F.min("ux").alias("x0"), F.min("uy").alias("y0"), F.max("ux").alias("x1"), F.max("uy").alias("y1"), F.min(F.struct("ux", "uy")).alias("p"),
        )
    )
    shells = cut(_rings(half.join(stats.where("a > 0").select("lab", "a"), "lab")).join(stats, "lab"))
    metres = lambda *cs: [F.col(c) * GRID for c in cs]
    env = lambda a, b, c, d: F.struct(a.alias("minx"), b.alias("miny"), c.alias("maxx"), d.alias("maxy"))
    # an outer border inside a face lies in its envelope; its least vertex tells which faces hold it
    spot = stats.where("a < 0").select(F.col("lab").alias("hole"), *[F.col(c).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")], *[(F.col(f"p.u{c}") * GRID).alias(f"p{c}") for c in ("x", "y")])
    spot = spot.withColumn("l_env", env(F.col("px"), F.col("py"), F.col("px"), F.col("py")))
    around = shells.withColumn("r_env", env(*metres("x0", "y0", "x1", "y1")))
    met = envelope_join(spot, around, size).where("hx0 > x0 AND hy0 > y0 AND hx1 < x1 AND hy1 < y1").where(_holds("ring", "px", "py"))
    owner = cut(met.groupBy("hole").agg(F.min_by("lab", F.struct("a", "lab")).alias("lab")))
    rings = _rings(half.join(owner.select(F.col("hole").alias("lab")), "lab", "left_semi")).select(F.col("lab").alias("hole"), "ring")
    holes = owner.join(rings, "hole").groupBy("lab").agg(F.sort_array(F.collect_list(F.struct("hole", F.col("ring.parts")[0][0].alias("r")))).alias("hs"))
    parts = F.array(F.concat(F.col("ring.parts")[0], F.coalesce(F.col("hs.r"), F.array().cast("array<array<struct<x:double,y:double>>>"))))
    return shells.join(holes, "lab", "left").select(F.col("lab").alias("id"), F.struct(F.lit(3).cast("tinyint").alias("kind"), parts.alias("parts")).cast(G.GEOM).alias("geom"))
