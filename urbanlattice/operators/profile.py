"""What streets are like: profiles between buildings, means of their nodes' values, the final street table.

Across a street stand ticks: at its start, every ``distance`` metres and at its end, upright on the way from the sample
point before (at the start: to the next), half of ``length`` to either side. Each tick looks for the first building on it,
which a join by cells finds among the buildings nearby.

* width: mean distance to buildings on the left plus that on the right, half a tick where a side has none;
* width_deviation: standard deviation of all distances found, 0 without any;
* openness: share of half ticks without a building.

Parts of a multi-line have ticks of their own and count together. Streets of no length or without geometry, and all streets
if there are no buildings at all, get nulls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels
from ..session import spread
from .spatial_join import envelope_join, grown

TICK = "struct<x:double,y:double,dx:double,dy:double>"


def samples(line: np.ndarray, distance: float) -> np.ndarray:
    """Rows (x, y, dx, dy): places along a line and the unit direction of the way that leads there."""
    steps = np.hypot(*np.diff(line, axis=0).T)
    line = line[np.concatenate([[True], steps > 0])]
    at = np.concatenate([[0.0], np.cumsum(steps[steps > 0])])
    if len(at) < 2:
        return np.empty((0, 4))
    # an end that falls on a step isn't met twice
    places = np.append(np.arange(0.0, at[-1], distance), at[-1])
    xy = np.column_stack([np.interp(places, at, line[:, k]) for k in (0, 1)])
    way = np.diff(xy, axis=0)
    size = np.hypot(*way.T)
    # a bend may bring two samples to one place: the direction of the line there
    k = np.clip(np.searchsorted(at, places[1:], "left") - 1, 0, len(line) - 2)
    way = np.where(size[:, None] > 0, way, np.diff(line, axis=0)[k])
    way /= np.hypot(*way.T)[:, None]
    return np.column_stack([xy, np.vstack([way[:1], way])])


#: Samples of a street that are looked for among the buildings together.
RUN = 8


def _straight(line: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``samples`` gives for many lines (n, 2, 2) of one edge each, one below the other: line of each, its place in it, rows."""
    way = line[:, 1] - line[:, 0]
    long = np.hypot(*way.T)
    many = np.where(long > 0, np.ceil(long / distance).astype(int) + 1, 0)
    of = np.repeat(np.arange(len(line)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    last = k == many[of] - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = way / long[:, None]
    xy = np.where(last[:, None], line[of, 1], slope[of] * (k * distance)[:, None] + line[of, 0])
    step = np.diff(xy, axis=0, prepend=xy[:1])
    # the first goes the way of the next
    at = np.arange(len(of)) + (k == 0)
    step = step[at]
    size = np.hypot(*step.T)
    step = np.where(size[:, None] > 0, step, way[of])
    return of, k, np.column_stack([xy, step / np.hypot(*step.T)[:, None]])


def _ticks(distance: float):
    """struct<n, runs>: how many samples a street has, and those by runs of RUN (k, the first one's number; env, the box around them)."""

    @G.arrowed(f"struct<n:int,runs:array<struct<k:int,env:{G.ENV},ticks:array<{TICK}>>>>")
    def udf(g: pa.Array) -> pa.Array:
        shapes = G.Shapes(g)
        lines = shapes.known & np.isin(shapes.kinds, (2, 5))
        # lines of one edge, nearly all, are sampled at once
        one = lines & (np.diff(shapes.parts) == 1)
        one[one] = shapes.rings[shapes.parts[:-1][one] + 1] - shapes.rings[shapes.parts[:-1][one]] == 1
        ring = shapes.rings[shapes.parts[:-1][one]]
        plain = shapes.vertices[ring + 1] - shapes.vertices[ring] == 2
        first = shapes.vertices[ring][plain]
        line = np.stack([shapes.xy[first], shapes.xy[first + 1]], 1)
        finite = np.isfinite(line).all((1, 2))
        at = np.flatnonzero(one)[plain][finite]
        of, k, rows = _straight(line[finite], distance)
        rest = np.setdiff1d(np.flatnonzero(lines), at)
        others = {i: np.concatenate([np.empty((0, 4)), *[samples(p[0], distance) for p in shapes[i]]]) for i in rest}
        many = np.zeros(len(shapes), int)
        many[at] = np.bincount(of, minlength=len(at))
        for i, r in others.items():
            many[i] = len(r)
        ends = np.cumsum(many)
        start = ends - many
        all_ = np.empty((int(many.sum()), 4))
        all_[start[at][of] + k] = rows
        for i, r in others.items():
            all_[start[i] : ends[i]] = r
        runs = -(-many // RUN)
        street = np.repeat(np.arange(len(many)), runs)
        k = (np.arange(len(street)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        begin = start[street] + k
        numbers = lambda v: pa.array(np.ascontiguousarray(v))
        box = [f.reduceat(all_[:, c], begin) if len(begin) else np.empty(0) for f in (np.minimum, np.maximum) for c in (0, 1)]
        env = pa.StructArray.from_arrays([numbers(v) for v in box], ["minx", "miny", "maxx", "maxy"])
        each = pa.StructArray.from_arrays([numbers(all_[:, c]) for c in range(4)], ["x", "y", "dx", "dy"])
        ticks = pa.ListArray.from_arrays(numbers(np.append(begin, len(all_)).astype(np.int32)), each)
        run = pa.StructArray.from_arrays([numbers(k.astype(np.int32)), env, ticks], ["k", "env", "ticks"])
        return pa.StructArray.from_arrays([numbers(many.astype(np.int32)), pa.ListArray.from_arrays(numbers(np.append(0, np.cumsum(runs)).astype(np.int32)), run)], ["n", "runs"])

    return udf


def first_hit(x: float, y: float, tx: float, ty: float, parts: list[list[np.ndarray]]) -> float | None:
    """How far along the tick (tx, ty) from (x, y), as a share of it, a polygon begins; null if it's beyond."""
    at = np.array([[x, y]])
    if any(kernels.inside(at, p)[0] >= 0 for p in parts):
        return 0.0
    s = kernels.segments(parts)
    e, c = s[:, 1] - s[:, 0], s[:, 0] - at
    den = tx * e[:, 1] - ty * e[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (c[:, 0] * e[:, 1] - c[:, 1] * e[:, 0]) / den
        u = (c[:, 0] * ty - c[:, 1] * tx) / den
    t = t[(den != 0) & (u >= 0) & (u <= 1) & (t >= 0) & (t <= 1)]
    return float(t.min()) if len(t) else None


@G.arrowed("double")
def _hits(x: pa.Array, y: pa.Array, tx: pa.Array, ty: pa.Array, g: pa.Array) -> pa.Array:
    shapes = G.Shapes(g)
    return pa.array([first_hit(*at, p) if shapes.kinds[i] and (p := shapes[i]) is not None else None for i, at in enumerate(zip(*(c.to_pylist() for c in (x, y, tx, ty))))], pa.float64())


def street_profile(streets: DataFrame, buildings: DataFrame, distance: float = 10.0, length: float = 50.0) -> DataFrame:
    """(id, width, width_deviation, openness) of each street (id, geom) between buildings (geom)."""
    half = length / 2
    if buildings.where("geom IS NOT NULL").isEmpty():
        null = F.lit(None).cast("double")
        return streets.select("id", null.alias("width"), null.alias("width_deviation"), null.alias("openness"))
    at = G.hold(spread(streets.select("id", F.col("geom").alias("_g"))), "_s", _ticks(distance)("_g")).select("id", "_s")
    # runs of samples look for buildings, not each tick: what is dealt out goes with the streets
    run = at.select("id", F.explode("_s.runs").alias("_run")).select("id", F.col("_run.k").alias("_k"), F.col("_run.ticks").alias("_ticks"), grown(F.col("_run.env"), half).alias("l_env"))
    b = G.hold(spread(buildings.select(F.col("geom").alias("_b"))), "r_env", G.envelope(F.col("_b")))
    b = G.hold(b, "_rect", G.is_rectangle(F.col("_b"), F.col("r_env")))
    x, y, tx, ty, e = (F.col(c) for c in ("x", "y", "tx", "ty", "r_env"))

    def met(b: DataFrame) -> DataFrame:
        """Ticks with the buildings ``b`` whose envelopes meet theirs; the left of the way first."""
        each = envelope_join(run, b, (RUN - 1) * distance + length, small=True).select("id", "_k", *b.columns, F.posexplode("_ticks").alias("_j", "s"))
        each = each.select("id", (F.col("_k") + F.col("_j")).alias("k"), *b.columns, "s.*")
        by_x, by_y = F.abs("dy") * half, F.abs("dx") * half
        each = each.where((x - by_x <= e["maxx"]) & (x + by_x >= e["minx"]) & (y - by_y <= e["maxy"]) & (y + by_y >= e["miny"]))
        each = each.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
        each = each.select("id", "k", "side", *b.columns, "x", "y", (-F.col("dy") * F.col("side") * half).alias("tx"), (F.col("dx") * F.col("side") * half).alias("ty"))
        return each.where((F.least(x, x + tx) <= e["maxx"]) & (F.greatest(x, x + tx) >= e["minx"]) & (F.least(y, y + ty) <= e["maxy"]) & (F.greatest(y, y + ty) >= e["miny"]))

    # the share of the tick at which it enters a rectangle, by its sides
    enter, leave = F.lit(0.0), F.lit(1.0)
    for p, t, lo, hi in ((x, tx, e["minx"], e["maxx"]), (y, ty, e["miny"], e["maxy"])):
        a, c = F.try_divide(lo - p, t), F.try_divide(hi - p, t)
        beside = (p < lo) | (p > hi)
        enter = F.greatest(enter, F.when(t == 0, F.when(beside, 2.0).otherwise(0.0)).otherwise(F.least(a, c)))
        leave = F.least(leave, F.when(t == 0, 1.0).otherwise(F.greatest(a, c)))
    share = F.when(enter <= leave, enter)
    pairs = met(b.where("_rect").select("r_env")).select("id", "k", "side", (share * half).alias("_d"))
    # rectangles carry no geometries and go past no kernel
    if not (other := b.where("NOT _rect").select("r_env", "_b")).isEmpty():
        pairs = pairs.unionByName(met(other).select("id", "k", "side", (_hits("x", "y", "tx", "ty", "_b") * half).alias("_d")))
    near = pairs.where("_d IS NOT NULL").groupBy("id", "k", "side").agg(F.min("_d").alias("_d"))
    of = lambda side: F.avg(F.when(F.col("side") == side, F.col("_d")))
    got = near.groupBy("id").agg(of(1).alias("_l"), of(-1).alias("_r"), F.stddev_pop("_d").alias("_dev"), F.count(F.lit(1)).alias("_n"))
    said = lambda v: F.when(F.col("_all") > 0, v)
    return at.select("id", (2 * F.col("_s.n")).alias("_all")).join(got, "id", "left").select(
        "id", said(F.coalesce("_l", F.lit(half)) + F.coalesce("_r", F.lit(half))).alias("width"), said(F.coalesce("_dev", F.lit(0.0))).alias("width_deviation"),
        said(1 - F.coalesce("_n", F.lit(0)) / F.col("_all")).alias("openness"),
    )


def node_means(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` (u, v, ...) with the mean of each of ``columns`` of the nodes (osmid) at their ends; null if one is missing."""
    ends = lambda k: nodes.select(F.col("osmid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in columns])
    at = edges.join(ends("_u"), edges["u"] == F.col("_u"), "left").join(ends("_v"), edges["v"] == F.col("_v"), "left")
    return at.select(*[edges[c] for c in edges.columns if c not in columns], *[((F.col(f"_u{c}") + F.col(f"_v{c}")) / 2).alias(c) for c in columns])


def network_streets(edges: DataFrame, nodes: DataFrame, buildings: DataFrame, columns: list[str]) -> DataFrame:
    """The street table of a network: edges (id, u, v, osmid, length, geom) with their nodes' means, without duplicates, with
    profiles between the buildings."""
    from .streets import without_duplicates

    streets = without_duplicates(node_means(edges, nodes, columns))
    return streets.join(street_profile(streets, buildings), "id")


def inside_disc(dx, dy, by: float):
    """Whether (dx, dy) from its centre is inside the 64-gon with circumradius ``by``, as buffers draw it."""
    import math

    step = math.pi / 32
    turn = F.atan2(dy, dx)
    middle = (F.floor(turn / step) + 0.5) * step
    return F.sqrt(dx * dx + dy * dy) * F.cos(turn - middle) <= by * math.cos(step / 2)


def intersections_per_buffer(points: DataFrame, nodes: DataFrame, name: str, by: float = 500.0) -> DataFrame:
    """Nodes (geom, street_count) with more than one street in the buffer of each point (id, geom), a square kilometre of it."""
    at = G.hold(points.select("id", "geom"), "_p", G.centroid(F.col("geom")))
    a = at.where("geom IS NOT NULL").select("id", "_p", F.struct((F.col("_p.x") - by).alias("minx"), (F.col("_p.y") - by).alias("miny"), (F.col("_p.x") + by).alias("maxx"), (F.col("_p.y") + by).alias("maxy")).alias("l_env"))
    b = G.hold(nodes.where("street_count > 1 AND geom IS NOT NULL").select("geom"), "_q", G.centroid(F.col("geom"))).select("_q", F.struct(*[F.col(f"_q.{c}").alias(n) for c, n in (("x", "minx"), ("y", "miny"), ("x", "maxx"), ("y", "maxy"))]).alias("r_env"))
    met = envelope_join(a, b, 2 * by).where(inside_disc(F.col("_q.x") - F.col("_p.x"), F.col("_q.y") - F.col("_p.y"), by))
    n = met.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return points.select("id").join(n, "id", "left").select("id", (F.coalesce("_n", F.lit(0)) * 1e6 / (G.BUFFER_AREA * by * by)).alias(name))
