"""Street features: windows, nearest objects, own blocks, intersections; street cleaning, splitting and faces."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels
from ..session import cut, spread
from .buildings import window_of, window_pairs, window_stats, zero_filled
from .spatial_join import closest_object, envelope_join, grown, spatial_join, with_overlap


def clipped_edge(p: Column, q: Column, w: Column) -> Column:
    """Length of an edge inside a window (Liang-Barsky)."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    t0, t1 = F.lit(0.0), F.lit(1.0)
    for d, lo, hi in ((dx, w["minx"] - p["x"], w["maxx"] - p["x"]), (dy, w["miny"] - p["y"], w["maxy"] - p["y"])):
        a, b = F.try_divide(lo, d), F.try_divide(hi, d)
        out = (lo > 0) | (hi < 0)
        # an edge along the other axis is inside or outside as a whole
        t0 = F.greatest(t0, F.when(d == 0, F.when(out, 2.0).otherwise(0.0)).otherwise(F.least(a, b)))
        t1 = F.least(t1, F.when(d == 0, 1.0).otherwise(F.greatest(a, b)))
    return F.greatest(F.lit(0.0), t1 - t0) * F.sqrt(dx * dx + dy * dy)


def clipped_length(g: Column, w: Column) -> Column:
    """Length of a line inside a window, edge by edge, as an expression."""
    return G._total(F.transform(F.flatten(g["parts"]), lambda r: G._fold(r, lambda p, q: clipped_edge(p, q, w))))


def streets_distance_based(df: DataFrame, streets: DataFrame, sizes=(100.0,), averages=("length", "width"), deviations=("length", "width_deviation"), maxima=()) -> DataFrame:
    """Clipped total length and means, sample deviations and maxima of the streets' columns in square buffers."""
    ring = F.get(F.get(F.col("geom.parts"), 0), 0)
    # lines of one edge, the most frequent ones, need no fold over vertices
    single = F.when((F.size("geom.parts") == 1) & (F.size(ring) == 2), F.struct(F.get(ring, 0).alias("p"), F.get(ring, 1).alias("q")))
    pairs = window_pairs(df, G.hold(G.hold(streets, "_length", G.length(F.col("geom"))), "_edge", single), max(sizes))

    def aggregates(near, b, label):
        w, e = window_of(b), F.col("r_env")
        whole = (e["minx"] >= w["minx"]) & (e["maxx"] <= w["maxx"]) & (e["miny"] >= w["miny"]) & (e["maxy"] <= w["maxy"])
        # only lines that the window cuts are clipped
        out = [F.sum(F.when(near & whole, F.col("r__length")).when(near & F.col("r__edge").isNotNull(), clipped_edge(F.col("r__edge.p"), F.col("r__edge.q"), w)).when(near, clipped_length(F.col("r_geom"), w))).alias(f"street_length_total_within_buffer_{label}")]
        out += [F.avg(F.when(near, F.col(f"r_{c}"))).alias(f"street_{c}_av_within_buffer_{label}") for c in averages]
        out += [F.stddev_samp(F.when(near, F.col(f"r_{c}"))).alias(f"street_{c}_std_within_buffer_{label}") for c in deviations]
        return out + [F.max(F.when(near, F.col(f"r_{c}"))).alias(f"street_{c}_max_within_buffer_{label}") for c in maxima]

    return zero_filled(df, window_stats(pairs, list(sizes), aggregates))


def intersection_count(df: DataFrame, points: DataFrame, sizes=(100.0,)) -> DataFrame:
    """intersection_count_within_B: points in the square buffer, 0 where there's none."""
    pairs = window_pairs(df, points, max(sizes))
    return zero_filled(df, window_stats(pairs, list(sizes), lambda near, b, label: [F.sum(near.cast("double")).alias(f"intersection_count_within_{label}")]))


def street_blocks_distance_based(df: DataFrame, sbb: DataFrame, sizes=(100.0,)) -> DataFrame:
    """Number, mean and deviation of area and phi, deviation of orientation of street blocks that meet the buffer."""
    pairs = window_pairs(df, sbb, max(sizes))

    def aggregates(near, b, label):
        at = lambda c: F.when(near, F.col(f"r_{c}"))
        return [
            F.sum(near.cast("double")).alias(f"street_based_block_number_inter_buffer_{label}"),
            F.avg(at("area")).alias(f"street_based_block_av_area_inter_buffer_{label}"),
            F.stddev_samp(at("area")).alias(f"street_based_block_std_area_inter_buffer_{label}"),
            F.avg(at("phi")).alias(f"street_based_block_av_phi_inter_buffer_{label}"),
            F.stddev_samp(at("phi")).alias(f"street_based_block_std_phi_inter_buffer_{label}"),
            F.stddev_samp(at("orientation")).alias(f"street_based_block_std_orientation_inter_buffer_{label}"),
        ]

    return zero_filled(df, window_stats(pairs, list(sizes), aggregates))


#: Columns of the closest street: of the street, of the result.
CLOSEST = {
    "length": "street_length_closest_street",
    "width": "street_width_av_closest_street",
    "width_deviation": "street_width_std_closest_street",
    "openness": "street_openness_closest_street",
    "betweenness_metric_e": "street_betweeness_global_closest_street",
    "closeness_global": "street_closeness_global_closest_street",
    "closeness500": "street_closeness_500_closest_street",
}


def closest_street_features(df: DataFrame, streets: DataFrame, step: float = 50.0) -> DataFrame:
    """distance_to_closest_street and what the closest street's columns say (those of CLOSEST that ``streets`` has), 0 for missing values."""
    names = {c: n for c, n in CLOSEST.items() if c in streets.columns}
    got = closest_object(df, streets, step).withColumnRenamed("distance", "distance_to_closest_street")
    values = streets.select(F.col("id").alias("_s"), *[F.col(c).cast("double").alias(n) for c, n in names.items()])
    at = df.select("id").join(got, "id", "left").join(values, F.col("other") == F.col("_s"), "left")
    return at.select("id", F.col("other").alias("closest_street"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("distance_to_closest_street", *names.values())])


def own_street_block(df: DataFrame, sbb: DataFrame, size: float = 200.0, least: bool = False) -> DataFrame:
    """street_based_block_area, _phi, _corners of the block that holds most of each row (``least``: the smallest overlap), else 0."""
    a = df.select("id", F.col("geom").alias("_g"))
    b = sbb.select(F.col("id").alias("_o"), F.col("geom").alias("_h"), "area", "phi", "corners")
    a = G.hold(spread(a), "l_env", G.envelope(F.col("_g")))
    b = G.hold(spread(b), "r_env", G.envelope(F.col("_h")))
    a = G.hold(a, "_l_rect", G.is_rectangle(F.col("_g"), F.col("l_env")))
    b = G.hold(b, "_r_rect", G.is_rectangle(F.col("_h"), F.col("r_env")))
    pairs = with_overlap(envelope_join(a, b, size), "_g", "_h")
    pick = F.min_by if least else F.max_by
    got = pairs.groupBy("id").agg(pick(F.struct("area", "phi", "corners"), F.struct("_a", "_o" if least else (-F.col("_o")).alias("_m"))).alias("_b"))
    zero = lambda c: F.coalesce(F.col(f"_b.{c}").cast("double"), F.lit(0.0)).alias(f"street_based_block_{c}")
    return df.select("id").join(got, "id", "left").select("id", zero("area"), zero("phi"), zero("corners"))


def beta_index(cells: DataFrame, nodes: DataFrame, size: float = 500.0) -> DataFrame:
    """Mean streets a node of the nodes (geom, street_count) within each polygon; null if there's none."""
    pairs = spatial_join(nodes.select("street_count", F.col("geom").alias("_g")), cells.select("id", F.col("geom").alias("_h")), "_g", "_h", "within", size)
    return cells.select("id").join(pairs.groupBy("id").agg(F.avg("street_count").alias("feature_beta_index")), "id", "left")


def intersections_per_area(cells: DataFrame, nodes: DataFrame, name: str, size: float = 500.0) -> DataFrame:
    """Nodes with more than one street within each polygon, a square kilometre."""
    pairs = spatial_join(nodes.where("street_count > 1").select(F.col("geom").alias("_g")), cells.select("id", F.col("geom").alias("_h")), "_g", "_h", "within", size)
    n = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return cells.select("id", G.area(F.col("geom")).alias("_a")).join(n, "id", "left").select("id", (F.coalesce("_n", F.lit(0)) * 1e6 / F.col("_a")).alias(name))


def single_edges(one: G.Shapes, two: G.Shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows where both geometries are one edge, the first's edges (n, 2, 2), the second's)."""

    def of(s: G.Shapes) -> tuple[np.ndarray, np.ndarray]:
        first, last = (s.vertices[s.rings[s.parts[k]]] for k in (slice(None, -1), slice(1, None)))
        return first, np.isin(s.kinds, (2, 5)) & s.known & (np.diff(s.parts) == 1) & (last - first == 2)

    (a, x), (b, y) = of(one), of(two)
    both = x & y
    edge = lambda s, at: s.xy[at[both][:, None] + np.arange(2)]
    return both, edge(one, a), edge(two, b)


def is_edge(g: Column) -> Column:
    """Whether a geometry is a line of one edge."""
    one = F.get(g["parts"], 0)
    return F.coalesce(g["kind"].isin(2, 5) & (F.size(g["parts"]) == 1) & (F.size(one) == 1) & (F.size(F.get(one, 0)) == 2), F.lit(False))


def edge_table(df: DataFrame, name: str, s: str) -> DataFrame:
    """(name, {s}_env, _at, {s}one, {s}x0, {s}y0, {s}x1, {s}y1, {s}g) of lines (id, geom): their envelope and first vertex,
    whether they are one edge, and its ends. Other lines alone keep their geometry, null is left out."""
    g = F.col("geom")
    ring = F.get(F.get(g["parts"], 0), 0)
    at = G.hold(G.hold(spread(df.select(F.col("id").alias(name), "geom")), f"{s}_env", G.envelope(g)), f"{s}one", is_edge(g))
    ends = [F.get(ring, k)[c].alias(f"{s}{c}{k}") for k in (0, 1) for c in "xy"]
    return at.where(F.col(f"{s}_env")["minx"].isNotNull()).select(name, f"{s}_env", F.get(G.vertices(g), 0).alias("_at"), f"{s}one", *ends, G.only(~F.col(f"{s}one"), g).alias(f"{s}g"))


def edge_shape(s: str) -> Column:
    """The geometry of a row of ``edge_table``."""
    return F.when(F.col(f"{s}one"), G.segment(*[F.col(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")])).otherwise(F.col(f"{s}g"))


def by_edges(a: DataFrame, b: DataFrame, others: bool, pairs) -> DataFrame:
    """``pairs(x, y, plain)`` of ``edge_table``s l and r of the same lines, united: of lines of one edge each, the most frequent
    ones, without geometries (``plain``); and, if there are ``others``, of these with all."""
    out = pairs(a.where("lone").drop("lg"), b.where("rone").drop("rg"), True)
    if others:
        out = out.unionByName(pairs(a.where("lone"), b.where("NOT rone"), False)).unionByName(pairs(a.where("NOT lone"), b, False))
    return out


#: Somewhat over a metre: how far envelopes reach to find what may be within a metre.
NEAR = 1.001


def without_duplicates(streets: DataFrame, contained: str = "contained") -> DataFrame:
    """One street for each (osmid, length rounded half to even), then none of those within a metre of another.

    Of two streets within a metre of each other the later id goes; of a one-sided pair the contained one, or with
    ``contained='container'`` the longer."""
    from .city import kept_first

    # written once, as several joins read it
    once = cut(kept_first(streets.withColumn("_l", F.bround("length", 0)), ["osmid", "_l"], ["id"]).drop("_l"))

    @G.arrowed("boolean")
    def covers(a: pa.Array, b: pa.Array) -> pa.Array:
        one, two = G.Shapes(a), G.Shapes(b)
        out = np.zeros(len(one), bool)
        single, p, q = single_edges(one, two)
        # lines of one edge each, the most frequent ones, all at once: both ends of the second from the first
        s, d = p[:, 0], p[:, 1] - p[:, 0]
        n = (d * d).sum(1)
        near = np.ones(len(p), bool)
        for v in (q[:, 0], q[:, 1]):
            t = np.clip(np.divide(((v - s) * d).sum(1), n, out=np.zeros(len(n)), where=n > 0), 0, 1)
            near &= np.hypot(*(v - s - t[:, None] * d).T) <= 1
        out[single] = near
        for i in np.flatnonzero(~single):
            out[i] = bool((kernels.point_segment_distance(two.points(i), kernels.segments(one[i])).min(1) <= 1).all())
        return pa.array(out)

    # each vertex of the second is near the first, so that its first vertex tells the candidates; both ways are asked at once
    a, b = edge_table(once, "id", "l"), edge_table(once, "_o", "r").withColumn("_whole", F.col("r_env"))
    b = b.withColumn("r_env", F.struct(*[F.col(f"_at.{c}").alias(n) for c, n in (("x", "minx"), ("y", "miny"), ("x", "maxx"), ("y", "maxy"))]))
    a = a.withColumn("l_env", grown(F.col("l_env"), NEAR)).drop("_at")

    def ends_near(s: str, o: str) -> Column:
        """Whether both ends of the second's edge are within a metre of the first's."""
        c = lambda n: F.col(n)
        dx, dy = c(f"{s}x1") - c(f"{s}x0"), c(f"{s}y1") - c(f"{s}y0")
        out = F.lit(True)
        for k in "01":
            vx, vy = c(f"{o}x{k}") - c(f"{s}x0"), c(f"{o}y{k}") - c(f"{s}y0")
            at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(vx * dx + vy * dy, dx * dx + dy * dy), F.lit(0.0))))
            out = out & (F.hypot(vx - at * dx, vy - at * dy) <= 1)
        return out

    w, e = F.col("l_env"), F.col("_whole")
    inside = (e["minx"] >= w["minx"]) & (e["miny"] >= w["miny"]) & (e["maxx"] <= w["maxx"]) & (e["maxy"] <= w["maxy"])

    def asked(x: DataFrame, y: DataFrame, plain: bool) -> DataFrame:
        pairs = envelope_join(x, y, 100.0).where("id != _o").where(inside)
        if plain:
            return pairs.where(ends_near("l", "r")).select("id", "_o", ends_near("r", "l").alias("_back"))
        return pairs.select("id", "_o", covers(edge_shape("l"), edge_shape("r")).alias("_c"), covers(edge_shape("r"), edge_shape("l")).alias("_back")).where("_c").drop("_c")

    both = by_edges(a, b, not a.where("NOT lone").isEmpty(), asked)
    gone = F.when(F.col("_back"), F.greatest("id", "_o")).otherwise(F.col("_o") if contained == "contained" else F.col("id"))
    return once.join(both.select(gone.alias("id")).distinct(), "id", "left_anti")


def split_crossing(streets: DataFrame, size: float = 200.0) -> DataFrame:
    """Every street cut where another crosses its interior: (id, street, geom). ``id``: the street's, then the part's number in
    as many digits as the street of most parts needs (one, unless it has over ten)."""

    @G.arrowed("array<double>")
    def cuts(g: pa.Array, h: pa.Array) -> pa.Array:
        """Places along the first line, 0-1 of each edge added to the edge's number, where the second crosses."""
        lines, others = G.Shapes(g), G.Shapes(h)
        single, p, q = single_edges(lines, others)
        out: list = [()] * len(lines)
        # lines of one edge each, the most frequent ones, all at once
        d, e, ca = p[:, 1] - p[:, 0], q[:, 1] - q[:, 0], q[:, 0] - p[:, 0]
        den = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (ca[:, 0] * e[:, 1] - ca[:, 1] * e[:, 0]) / den, (ca[:, 0] * d[:, 1] - ca[:, 1] * d[:, 0]) / den
        hit = (den != 0) & (v >= 0) & (v <= 1) & (u > 0) & (u < 1)
        for i, z in zip(np.flatnonzero(single)[hit].tolist(), u[hit].tolist()):
            out[i] = (z,)
        for i in np.flatnonzero(~single):
            found = []
            s, t = kernels.segments(lines[i]), kernels.segments(others[i])
            c, e = t[:, 0], t[:, 1] - t[:, 0]
            for k, (x, y) in enumerate(s):
                d = y - x
                den = d[0] * e[:, 1] - d[1] * e[:, 0]
                ca = c - x
                with np.errstate(divide="ignore", invalid="ignore"):
                    u = (ca[:, 0] * e[:, 1] - ca[:, 1] * e[:, 0]) / den
                    v = (ca[:, 0] * d[1] - ca[:, 1] * d[0]) / den
                found += [k + float(z) for z in u[(den != 0) & (v >= 0) & (v <= 1) & (u >= 0) & (u <= 1)] if 0 < k + z < len(s)]
            out[i] = found
        return pa.array(out, pa.list_(pa.float64()))

    def crossings(x: DataFrame, y: DataFrame, plain: bool) -> DataFrame:
        pairs = envelope_join(x, y, size).where("id != _o")
        if not plain:
            return pairs.select("id", F.explode(cuts(edge_shape("l"), edge_shape("r"))).alias("t"))
        c = F.col
        dx, dy, ex, ey, cx, cy = c("lx1") - c("lx0"), c("ly1") - c("ly0"), c("rx1") - c("rx0"), c("ry1") - c("ry0"), c("rx0") - c("lx0"), c("ry0") - c("ly0")
        den = dx * ey - dy * ex
        u, v = F.try_divide(cx * ey - cy * ex, den), F.try_divide(cx * dy - cy * dx, den)
        return pairs.where((den != 0) & (v >= 0) & (v <= 1) & (u > 0) & (u < 1)).select("id", u.alias("t"))

    a, b = edge_table(streets, "id", "l").drop("_at"), edge_table(streets, "_o", "r").drop("_at")
    others = not a.where("NOT lone").isEmpty()
    at = by_edges(a, b, others, crossings)
    at = at.groupBy("id").agg(F.sort_array(F.collect_set(F.round("t", 9))).alias("ts"))

    @G.vectorized(f"array<{G.GEOM}>")
    def pieces(g: pd.DataFrame, ts: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(g["parts"], ts):
            line = G.points_of({"parts": p})
            marks = sorted({*range(len(line)), *(t if t is not None else [])})
            point = lambda m: line[min(int(m), len(line) - 2)] + (line[min(int(m), len(line) - 2) + 1] - line[min(int(m), len(line) - 2)]) * (m - min(int(m), len(line) - 2))
            ends, parts, run = set(t if t is not None else []), [], []
            for m in marks:
                run.append(point(m))
                if m in ends or m == len(line) - 1:
                    if len(run) > 1:
                        parts.append({"kind": 2, "parts": [[[{"x": float(x), "y": float(y)} for x, y in run]]]})
                    run = [point(m)]
            out.append(parts)
        return pd.Series(out)

    at = cut(at)
    most = at.agg(F.max(F.size("ts"))).first()[0] or 0
    # lines of one edge are cut by an expression
    lines = G.hold(streets.select("id", "geom"), "_ring", F.get(F.get(F.col("geom.parts"), 0), 0))
    lines = G.hold(lines, "_one", is_edge(F.col("geom"))).join(at, "id", "left")
    p, q = F.get("_ring", 0), F.get("_ring", 1)
    x, y = (lambda m, c=c: p[c] + (q[c] - p[c]) * m for c in "xy")
    # a place rounded to an end cuts nothing off
    knots = F.concat(F.array(F.lit(0.0)), F.filter(F.coalesce("ts", F.array().cast("array<double>")), lambda m: (m > 0) & (m < 1)), F.array(F.lit(1.0)))
    plain = G.let(knots, lambda ms: F.transform(F.sequence(F.lit(0), F.size(ms) - 2), lambda k: G.let(F.get(ms, k), lambda m: G.let(F.get(ms, k + 1), lambda n: G.segment(x(m), y(m), x(n), y(n))))))
    parts = lines.where("_one").select("id", F.posexplode(plain).alias("_k", "geom"))
    if others:
        parts = parts.unionByName(lines.where("NOT _one AND geom IS NOT NULL").select("id", F.posexplode(pieces("geom", "ts")).alias("_k", "geom")))
    return parts.select((F.col("id") * 10 ** len(str(most)) + F.col("_k")).alias("id"), F.col("id").alias("street"), "geom")


def street_blocks(noded: DataFrame, size: float = 200.0) -> DataFrame:
    """Faces between streets: (id, geom, area, phi, corners, orientation) from noded lines (geom)."""
    from .faces import faces

    g = F.col("geom")
    at = G.hold(G.hold(faces(noded, size), "_c", G.centroid(g)), "_m", G.shape_measures("geom"))
    return at.select("id", "geom", G.area(g).alias("area"), G.phi(g, F.col("_c")).alias("phi"), G.corners(g).alias("corners"), F.col("_m.orientation").alias("orientation"))
