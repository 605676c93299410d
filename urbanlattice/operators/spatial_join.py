"""Spatial joins as equi-joins on grid cells.

Envelopes have levels by size: cells of level k have sides of ``size`` * 2**k, and an
envelope that fits such a side touches four of them at most, however large it is. Equal cells meet, at the
higher of a pair's levels; a pair is kept only in the cell of the lower left corner of
the envelopes' overlap, so that no pair comes twice and no ``distinct`` is needed.
Adaptive execution splits crowded cells. Exact predicates follow as Arrow-batched functions on what is left."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels
from ..session import cut, discard, spread

GEOMETRY_ARGS = ("kind", "parts")


def cells(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float | Column) -> Column:
    """array<struct<cx, cy>> of the cells that an envelope touches."""
    side = size if isinstance(size, Column) else F.lit(float(size))
    at = lambda v: F.floor(v / side)
    return F.flatten(F.transform(F.sequence(at(minx), at(maxx)), lambda i: F.transform(F.sequence(at(miny), at(maxy)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def level(env: Column, size: float) -> Column:
    """The least k >= 0 for which an envelope's sides fit into ``size`` * 2**k."""
    side = F.greatest(env["maxx"] - env["minx"], env["maxy"] - env["miny"])
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(float(size))) / F.lit(float(size)))).cast("int"))


def _side(k: Column, size: float) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(2.0), k)


def envelope_join(left: DataFrame, right: DataFrame, size: float, small: bool = False) -> DataFrame:
    """Pairs whose envelopes ``l_env`` and ``r_env`` meet, edges included. Column names of the sides must differ.

    The levels that occur on a side, a few numbers, are asked for before the join: rows are dealt into cells of their own
    level and of the other side's higher levels, and two meet at the higher of their levels. ``small``: left envelopes have
    sides of about ``size`` at most and are dealt into the first level's cells unasked, so that they aren't made twice."""
    names = [*left.columns, *right.columns]
    flats = lambda s: [F.col(f"_{s}{k}") for k in range(4)]
    # what a pair is asked lies flat in its rows, once: candidates are many times the pairs that are kept
    flat = lambda df, env, s: df.where(f"{env}.minx IS NOT NULL").select(*[c for c in df.columns if c != env], *[F.col(env)[n].alias(f"_{s}{k}") for k, n in enumerate(("minx", "miny", "maxx", "maxy"))])
    boxed = lambda s: F.struct(*[c.alias(n) for c, n in zip(flats(s), ("minx", "miny", "maxx", "maxy"))])
    a, b = flat(left, "l_env", "l"), flat(right, "r_env", "r")
    of_level = lambda s: F.lit(0) if small and s == "l" else level(boxed(s), size)
    # a stream can't be asked beforehand: it has the first level's cells, however many
    asked = [] if a.isStreaming or b.isStreaming else [(0, a, "l"), (1, b, "r")][small:]
    found = [(k, r["k"]) for k, df, s in asked for r in df.select(of_level(s).alias("k")).distinct().collect()] if len(asked) < 2 else [tuple(r) for r in a.select(F.lit(0), of_level("l")).union(b.select(F.lit(1), of_level("r"))).distinct().collect()]
    of = [sorted(k for s, k in found if s == n) for n in (0, 1)]
    of[0] = [0] if small else of[0]
    met = (F.col("_l0") <= F.col("_r2")) & (F.col("_r0") <= F.col("_l2")) & (F.col("_l1") <= F.col("_r3")) & (F.col("_r1") <= F.col("_l3"))
    # the lower left corner of the overlap is in the first column and row of one of the two
    first = lambda df, s, c, side: df.select("*", (F.floor(F.col(f"_{s}0") / side) == F.col(f"{c}.cx")).alias(f"_{s}fx"), (F.floor(F.col(f"_{s}1") / side) == F.col(f"{c}.cy")).alias(f"_{s}fy"), F.col(f"{c}.cx").alias(f"_{s}cx"), F.col(f"{c}.cy").alias(f"_{s}cy")).drop(c)
    met = met & (F.col("_lfx") | F.col("_rfx")) & (F.col("_lfy") | F.col("_rfy"))
    same = (F.col("_lcx") == F.col("_rcx")) & (F.col("_lcy") == F.col("_rcy"))
    whole = lambda pairs: pairs.where(met).select(*[boxed(c[0]).alias(c) if c in ("l_env", "r_env") else c for c in names])
    if len({*of[0], *of[1]}) <= 1:
        side = F.lit(size * 2.0 ** (of[0] or of[1] or [0])[0])
        a = first(a.withColumn("_c", F.explode(cells(*flats("l"), side))), "l", "_c", side)
        b = first(b.withColumn("_d", F.explode(cells(*flats("r"), side))), "r", "_d", side)
        return whole(a.join(b, same))

    def dealt(df: DataFrame, others: list[int], k: str, s: str) -> DataFrame:
        own, side = f"_{s}k", _side(F.col(k), size)
        df = df.withColumn(own, of_level(s))
        up = F.filter(F.lit(others).cast("array<int>"), lambda x: x > F.col(own))
        df = df.withColumn(k, F.explode(F.concat(F.array(F.col(own)), up)))
        return first(df.withColumn(k + "c", F.explode(cells(*flats(s), side))), s, k + "c", side)

    a, b = dealt(a, of[1], "_c", "l"), dealt(b, of[0], "_d", "r")
    # rows that are both dealt above their own levels never meet: one of the two keys is each side's own level
    a = a.withColumn("_t", F.explode(F.when(F.col("_c") == F.col("_lk"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2)))))
    b = b.withColumn("_u", F.explode(F.when(F.col("_d") == F.col("_rk"), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return whole(a.join(b, (F.col("_t") == F.col("_u")) & (F.col("_c") == F.col("_d")) & same))


def grown(env: Column, by: float) -> Column:
    return F.struct((env["minx"] - by).alias("minx"), (env["miny"] - by).alias("miny"), (env["maxx"] + by).alias("maxx"), (env["maxy"] + by).alias("maxy"))


def _pairs(f, kind: str):
    arrow = {"boolean": pa.bool_(), "double": pa.float64()}[kind]

    @G.arrowed(kind)
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        one, two = G.Shapes(a), G.Shapes(b)
        return pa.array([f(one.kinds[i], p, two.kinds[i], q) if one.kinds[i] and two.kinds[i] and (p := one[i]) is not None and (q := two[i]) is not None else None for i in range(len(one))], arrow)

    return udf


intersects = _pairs(lambda k, a, m, b: bool(kernels.intersects(k, a, m, b)), "boolean")
distance = _pairs(lambda k, a, m, b: float(kernels.distance(k, a, m, b)), "double")
overlap_area = _pairs(lambda k, a, m, b: float(kernels.overlap_area(a, b)), "double")
#: Of the second, which may be any polygon, inside the first, which is convex and turns counter-clockwise.
convex_overlap_area = _pairs(lambda k, a, m, b: float(kernels.convex_overlap(b, kernels.opened(a[0][0]))), "double")
ring_length_inside = _pairs(lambda k, a, m, b: float(kernels.line_inside_length(kernels.segments([[p[0]] for p in a]), b)), "double")
line_length_inside = _pairs(lambda k, a, m, b: float(kernels.line_inside_length(kernels.segments(a), b)), "double")
#: No point of the first outside the polygon and some in its interior: what lies on the boundary alone isn't within.
within = _pairs(lambda k, a, m, b: bool(all(any((kernels.inside(np.array([v]), p) >= 0).all() for p in b) for q in a for r in q for v in r)) and not _leaves(a, b) and (k in (3, 6) or _enters(a, b)), "boolean")


def _enters(a, b) -> bool:
    """Whether a vertex or an edge's middle of points or lines ``a`` is strictly inside polygon ``b``."""
    at = np.concatenate([*[np.asarray(r, float) for q in a for r in q], kernels.segments(a).mean(1)])
    return any(bool((kernels.inside(at, p) > 0).any()) for p in b)


def _leaves(a, b) -> bool:
    """Whether an edge of ``a`` leaves polygon ``b`` between its ends."""
    edges = kernels.segments(a)
    total = float(np.hypot(*(edges[:, 1] - edges[:, 0]).T).sum()) if len(edges) else 0.0
    return bool(total and kernels.line_inside_length(edges, b) < total * (1 - 1e-9))


def is_box(g: Column, env: Column) -> Column:
    """Whether a geometry is all of its envelope: a rectangle, a point, or a single edge along an axis."""
    edge = (g["kind"] == 2) & (F.size(g["parts"]) == 1) & (F.size(F.get(F.get(g["parts"], 0), 0)) == 2) & ((env["minx"] == env["maxx"]) | (env["miny"] == env["maxy"]))
    return F.coalesce((g["kind"] == 1) | edge | G.is_rectangle(g, env), F.lit(False))


def gap(e: Column, w: Column) -> Column:
    """Distance of two envelopes."""
    dx = F.greatest(e["minx"] - w["maxx"], w["minx"] - e["maxx"], F.lit(0.0))
    dy = F.greatest(e["miny"] - w["maxy"], w["miny"] - e["maxy"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def with_distance(pairs: DataFrame, left_geom: str, right_geom: str) -> DataFrame:
    """``pairs`` with the distance of two geometries, given envelopes _le, _re and _lb, _rb, whether they fill them: of boxes
    it's an expression, other pairs alone reach the kernel."""
    both = F.col("_lb") & F.col("_rb")
    asked = lambda c: G.only(~both, F.col(c))
    d = F.when(both, gap(F.col("_le"), F.col("_re"))).otherwise(distance(asked(left_geom), asked(right_geom)))
    return G.hold(pairs, "distance", d).drop("_le", "_re", "_lb", "_rb")


def meeting(pairs: DataFrame, left_geom: str, right_geom: str) -> DataFrame:
    """Of pairs whose envelopes meet, those whose geometries share a point, given _lb and _rb, whether they fill their envelopes:
    boxes share one, other pairs alone reach the kernel."""
    both = F.col("_lb") & F.col("_rb")
    asked = lambda c: G.only(~both, F.col(c))
    return G.hold(pairs, "_i", both | intersects(asked(left_geom), asked(right_geom))).where("_i").drop("_i")


def with_overlap(pairs: DataFrame, left_geom: str, right_geom: str) -> DataFrame:
    """``pairs`` with the overlap's area ``_a``, given envelopes l_env and r_env and _l_rect and _r_rect, whether they are
    rectangles: of two rectangles it's an expression, other pairs alone reach the kernel."""
    both = F.col("_l_rect") & F.col("_r_rect")
    asked = lambda c: G.only(~both, F.col(c))
    return G.hold(pairs, "_a", F.when(both, clipped_rectangle_area(F.col("l_env"), F.col("r_env"))).otherwise(overlap_area(asked(left_geom), asked(right_geom))))


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str, size: float, by: float = 0.0) -> DataFrame:
    """Inner join by ``predicate``: envelope, intersects, within, distance (at most ``by``)."""
    a = G.hold(G.hold(spread(left), "_le", G.envelope(F.col(left_geom))), "l_env", grown(F.col("_le"), by))
    b = G.hold(spread(right), "r_env", G.envelope(F.col(right_geom)))
    if predicate == "distance":
        a = G.hold(a, "_lb", is_box(F.col(left_geom), F.col("_le")))
        b = G.hold(b, "_rb", is_box(F.col(right_geom), F.col("r_env")))
        # envelopes that lie apart too far settle most pairs
        met = envelope_join(a, b, size).withColumn("_re", F.col("r_env")).where(gap(F.col("_le"), F.col("r_env")) <= by).drop("l_env", "r_env")
        return with_distance(met, left_geom, right_geom).where(F.col("distance") <= by)
    if predicate == "intersects":
        a = G.hold(a, "_lb", is_box(F.col(left_geom), F.col("_le"))).drop("_le")
        b = G.hold(b, "_rb", is_box(F.col(right_geom), F.col("r_env")))
        return meeting(envelope_join(a, b, size).drop("l_env", "r_env"), left_geom, right_geom).drop("_lb", "_rb")
    pairs = envelope_join(a.drop("_le"), b, size).drop("l_env", "r_env")
    if predicate == "within":
        return pairs.where(within(F.col(left_geom), F.col(right_geom)))
    if predicate == "envelope":
        return pairs
    raise ValueError(predicate)


def clipped_rectangle_area(env: Column, window: Column) -> Column:
    """Overlap of two axis-aligned rectangles."""
    dx = F.least(env["maxx"], window["maxx"]) - F.greatest(env["minx"], window["minx"])
    dy = F.least(env["maxy"], window["maxy"]) - F.greatest(env["miny"], window["miny"])
    return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)


def overlaps(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, size: float) -> DataFrame:
    """Pairs whose areas overlap, with the overlap's area ``_a``.

    Of two axis-aligned rectangles it's an expression; the kernel sees other pairs alone, once each, spread over the tasks."""
    a = G.hold(spread(left), "l_env", G.envelope(F.col(left_geom)))
    b = G.hold(spread(right), "r_env", G.envelope(F.col(right_geom)))
    a = G.hold(a, "_l_rect", G.is_rectangle(F.col(left_geom), F.col("l_env")))
    b = G.hold(b, "_r_rect", G.is_rectangle(F.col(right_geom), F.col("r_env")))
    e, w = F.col("l_env"), F.col("r_env")
    inner = (e["minx"] < w["maxx"]) & (w["minx"] < e["maxx"]) & (e["miny"] < w["maxy"]) & (w["miny"] < e["maxy"])
    pairs = envelope_join(a, b, size).where(inner)
    return with_overlap(pairs, left_geom, right_geom).where("_a > 0").drop("l_env", "r_env", "_l_rect", "_r_rect")


def largest_overlap(left: DataFrame, right: DataFrame, left_id: str, left_geom: str, right_id: str, right_geom: str, value: str, size: float) -> DataFrame:
    """(left_id, value): the right row of greatest overlap, the least right id on ties; null where none overlaps."""
    a = left.select(left_id, F.col(left_geom).alias("_g"))
    pairs = overlaps(a, right.select(right_id, value, F.col(right_geom).alias("_h")), "_g", "_h", size)
    best = pairs.groupBy(left_id).agg(F.max(F.struct("_a", (-F.col(right_id)).alias("_m"), value)).alias("_b"))
    return left.select(left_id).join(best.select(left_id, F.col(f"_b.{value}").alias(value)), left_id, "left")


def _reach(left: DataFrame, right: DataFrame) -> float | None:
    """A distance that no point of ``left`` (x, y) to one of ``right`` (x, y) exceeds; null if a side is empty."""
    a, b = (t.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() for t in (left, right))
    if a[0] is None or b[0] is None:
        return None
    return math.hypot(max(a[1] - b[0], b[1] - a[0]), max(a[3] - b[2], b[3] - a[2]))


def _nodes(points: DataFrame, x: str, y: str, i: str, j: str, side: str) -> DataFrame:
    """The cells (``side``: a name before the columns) that hold any of ``points``, with the box around what they hold."""
    return points.groupBy(F.col(i).alias(f"{side}i"), F.col(j).alias(f"{side}j")).agg(*[f(c).alias(f"{side}{n}") for c, n in ((x, "x"), (y, "y")) for f, n in ((F.min, n + "0"), (F.max, n + "1"))])


def _descended(left: DataFrame, right: DataFrame, left_id: str, size: float, far: float) -> DataFrame:
    """(left_id, _b: struct<d, _rid>) of each of ``left`` (left_id, x, y, _ci, _cj) from all of ``right`` (_rid, _rx, _ry, _i, _j).

    From cells that hold all down to those of side ``size``, each a quarter of the last, a left cell keeps the right cells that
    may hold the nearest of any of its points: those no farther at least than another one is at most. So far points don't
    meet all of a distant cluster, and no cell looks through what is empty."""
    a, b = cut(_nodes(left, "x", "y", "_ci", "_cj", "l")), cut(_nodes(right, "_rx", "_ry", "_i", "_j", "r"))
    top = max(1, math.ceil(math.log(max(far, size) / size, 4)))

    def level_of(t: DataFrame, side: str, k: int) -> DataFrame:
        up = lambda c: F.floor(F.col(f"{side}{c}") / F.lit(4**k)).alias(f"{side}{c}")
        return t.groupBy(up("i"), up("j")).agg(*[f(f"{side}{n}").alias(f"{side}{n}") for f, ns in ((F.min, ("x0", "y0")), (F.max, ("x1", "y1"))) for n in ns]) if k else t

    def kept(pairs: DataFrame) -> DataFrame:
        c = F.col
        least = [F.greatest(c(f"l{v}0") - c(f"r{v}1"), c(f"r{v}0") - c(f"l{v}1"), F.lit(0.0)) for v in "xy"]
        most = [F.greatest(c(f"l{v}1") - c(f"r{v}0"), c(f"r{v}1") - c(f"l{v}0")) for v in "xy"]
        long = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
        at = pairs.select("li", "lj", "ri", "rj", long(least).alias("_lo"), long(most).alias("_hi"))
        at = at.withColumn("_u", F.min("_hi").over(Window.partitionBy("li", "lj")))
        return cut(at.where(F.col("_lo") <= F.col("_u") * (1 + 1e-9)).select("li", "lj", "ri", "rj"))

    # a few cells on either side
    pairs = kept(level_of(a, "l", top).crossJoin(level_of(b, "r", top)))
    for k in reversed(range(top)):
        over = lambda t, side: t.select("*", *[F.floor(F.col(f"{side}{c}") / 4).alias(f"_{side}{c}") for c in "ij"])
        upper = pairs.select(*[F.col(c).alias(f"_{c}") for c in ("li", "lj", "ri", "rj")])
        lower = kept(upper.join(over(level_of(a, "l", k), "l"), ["_li", "_lj"]).join(over(level_of(b, "r", k), "r"), ["_ri", "_rj"]))
        discard(pairs)
        pairs = lower
    d = F.sqrt((F.col("x") - F.col("_rx")) * (F.col("x") - F.col("_rx")) + (F.col("y") - F.col("_ry")) * (F.col("y") - F.col("_ry")))
    met = pairs.join(right, (F.col("ri") == F.col("_i")) & (F.col("rj") == F.col("_j"))).join(left, (F.col("li") == F.col("_ci")) & (F.col("lj") == F.col("_cj")))
    out = cut(met.groupBy(left_id).agg(F.min(F.struct(d.alias("d"), "_rid")).alias("_b")))
    discard(a, b, pairs)
    return out


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float) -> DataFrame:
    """(left_id, right_id, distance) of each point's nearest point: columns x, y on both sides; the least id on ties.

    The 3 x 3 cells around a point settle those with a point within ``size``; the others look from large cells down
    (``_descended``). Points without coordinates get nulls and are nobody's nearest. An empty right side gives no rows."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(size)))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    nowhere = left.where(~known).select(left_id, F.lit(None).cast(dict(right.dtypes)[right_id]).alias(right_id), F.lit(None).cast("double").alias("distance"))
    # of points at one place only the least id can win
    r = cut(right.where(known).groupBy("x", "y").agg(F.min(right_id).alias("_rid")).select("_rid", F.col("x").alias("_rx"), F.col("y").alias("_ry"), cell("x").alias("_i"), cell("y").alias("_j")))
    if r.isEmpty():
        return nowhere.limit(0)
    far = _reach(left.where(known), right.where(known))
    if far is None:
        return nowhere
    points = spread(left.where(known).select(left_id, "x", "y", cell("x").alias("_ci"), cell("y").alias("_cj")))
    around = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.col("_ci") + i).alias("i"), (F.col("_cj") + j).alias("j")))))
    d = F.sqrt((F.col("x") - F.col("_rx")) * (F.col("x") - F.col("_rx")) + (F.col("y") - F.col("_ry")) * (F.col("y") - F.col("_ry")))
    best = points.withColumn("_c", F.explode(around)).join(r, (F.col("_c.i") == F.col("_i")) & (F.col("_c.j") == F.col("_j"))).groupBy(left_id).agg(F.min(F.struct(d.alias("d"), "_rid")).alias("_b"))
    done = cut(best.where(F.col("_b.d") <= size))
    rest = cut(points.join(done.select(left_id), left_id, "left_anti"))
    if not rest.isEmpty():
        done = done.unionByName(_descended(rest, r, left_id, size, far))
    return nowhere.unionByName(done.select(left_id, F.col("_b._rid").alias(right_id), F.col("_b.d").alias("distance")))


def closest_by_boxes(df: DataFrame, others: DataFrame, step: float = 100.0) -> DataFrame:
    """(id, other, distance) by growing boxes: the nearest, and least id on ties, of the geometries whose envelopes meet the
    first box of half side ``step``, 2 ``step``, ... around the centroid that meets any. It may miss a nearer one outside the
    box. Rows without geometry get nulls; an empty ``others`` gives no rows."""
    none = df.where("geom IS NULL").select("id", F.lit(None).cast(dict(others.dtypes)["id"]).alias("other"), F.lit(None).cast("double").alias("distance"))
    known = others.where("geom IS NOT NULL")
    if known.isEmpty():
        return none.limit(0)
    b = G.hold(spread(known.select(F.col("id").alias("other"), F.col("geom").alias("_h"))), "r_env", G.envelope(F.col("_h")))
    b = cut(G.hold(b, "_rb", is_box(F.col("_h"), F.col("r_env"))))
    shaped = not b.where("NOT _rb").isEmpty()
    a = G.hold(df.where("geom IS NOT NULL").select("id", F.col("geom").alias("_g")), "_cen", G.centroid(F.col("_g")))
    a = G.hold(a, "_le", G.envelope(F.col("_g")))
    a = cut(a.withColumn("_lb", is_box(F.col("_g"), F.col("_le"))))
    out, half, tries = none, step, 1
    while not a.isEmpty():
        box = F.struct((F.col("_cen.x") - half).alias("minx"), (F.col("_cen.y") - half).alias("miny"), (F.col("_cen.x") + half).alias("maxx"), (F.col("_cen.y") + half).alias("maxy"))
        # how far out a row's first box lies decides: boxes between the last size and this one are told apart by their sizes
        reach = lambda lo, hi, c: F.greatest(F.col(f"r_env.{lo}") - F.col(f"_cen.{c}"), F.col(f"_cen.{c}") - F.col(f"r_env.{hi}"), F.lit(0.0))
        size = F.greatest(F.lit(1), F.ceil(F.greatest(reach("minx", "maxx", "x"), reach("miny", "maxy", "y")) / step))
        boxed = a.withColumn("l_env", box)
        # pairs of boxes carry no geometries and go past no kernel
        near = envelope_join(boxed.where("_lb").drop("_g", "_lb"), b.where("_rb").drop("_h", "_rb"), 2 * half).select("id", size.alias("_k"), gap(F.col("_le"), F.col("r_env")).alias("distance"), "other")
        for x, y in [*[(boxed.where("_lb"), b.where("NOT _rb"))] * shaped, *[(boxed.where("NOT _lb"), b)] * (not a.where("NOT _lb").isEmpty())]:
            met = envelope_join(x, y, 2 * half).select("id", "_g", "_le", "_lb", "other", "_h", F.col("r_env").alias("_re"), "_rb", size.alias("_k"))
            near = near.unionByName(with_distance(met, "_g", "_h").select("id", "_k", "distance", "other"))
        near = near.groupBy("id").agg(F.min(F.struct("_k", "distance", "other")).alias("_b"))
        done = cut(near.select("id", F.col("_b.other").alias("other"), F.col("_b.distance").alias("distance")))
        out = out.unionByName(done)
        a = cut(a.join(done.select("id"), "id", "left_anti"))
        # twice as many sizes each time, so that far rows cost few rounds
        tries *= 2
        half = step * tries
    return out


def closest_object(df: DataFrame, others: DataFrame, step: float = 50.0, mode: str = "exact") -> DataFrame:
    """(id, other, distance): the exact nearest geometry, the least id on ties. Rows still open look twice as far each time,
    up to the extent of both sides. Rows without geometry get nulls; an empty ``others`` gives no rows. ``mode``: ``exact``, or
    ``reference`` for what ``closest_by_boxes`` finds."""
    if mode == "reference":
        return closest_by_boxes(df, others)
    if mode != "exact":
        raise ValueError(mode)
    corner = lambda t, e: t.select(F.explode(F.array(*[F.struct(F.col(f"{e}.{k}x").alias("x"), F.col(f"{e}.{k}y").alias("y")) for k in ("min", "max")])).alias("p")).select("p.*")
    none = df.select("id", F.lit(None).cast(dict(others.dtypes)["id"]).alias("other"), F.lit(None).cast("double").alias("distance"))
    if others.where("geom IS NOT NULL").isEmpty():
        return none.limit(0)
    # envelopes are found once, not in every round
    made = lambda t, name, geom, env, box: cut(G.hold(G.hold(spread(t.where("geom IS NOT NULL")).select(F.col("id").alias(name), F.col("geom").alias(geom)), env, G.envelope(F.col(geom))), box, is_box(F.col(geom), F.col(env))).where(F.col(env)["minx"].isNotNull()))
    a, b = made(df, "id", "_g", "_le", "_lb"), made(others, "other", "_h", "r_env", "_rb")
    far = _reach(corner(a, "_le"), corner(b, "r_env"))
    out, by = none.where(df["geom"].isNull()), step
    while far is not None:
        met = envelope_join(a.withColumn("l_env", grown(F.col("_le"), by)), b, 2 * by).withColumn("_re", F.col("r_env")).where(gap(F.col("_le"), F.col("r_env")) <= by).select("id", "_g", "_le", "_lb", "other", "_h", "_re", "_rb")
        near = with_distance(met, "_g", "_h").where(F.col("distance") <= by)
        best = cut(near.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("_b")).select("id", F.col("_b.other").alias("other"), F.col("_b.distance").alias("distance")))
        out = out.unionByName(best)
        if by >= far:
            break
        # what is left is written: else each round would do all earlier ones' joins again
        rest = cut(a.join(best.select("id"), "id", "left_anti"))
        discard(a)
        a = rest
        if a.isEmpty():
            break
        by = min(2 * by, max(far, by * 1.01))
    discard(a, b)
    return out
