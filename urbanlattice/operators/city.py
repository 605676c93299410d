"""Whole-table features, land use, areal interpolation, accessibility, hex joins, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut
from .buildings import disc, window_pairs, window_stats, zero_filled
from .spatial_join import clipped_rectangle_area, envelope_join, overlaps, spatial_join


def totals(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """One row: count, sum, mean and sample deviation."""
    return df.agg(F.count(F.lit(1)).alias(f"{prefix}_count"), F.sum(value).alias(f"total_{prefix}_{value}"), F.avg(value).alias(f"av_{prefix}_{value}"), F.stddev_samp(value).alias(f"std_{prefix}_{value}"))


def block_totals(blocks: DataFrame, steps=(5, 10, 20)) -> DataFrame:
    """One row of block counts by length; ``blocks``: BlockId, BlockLength, one row a building."""
    lows, highs = [2, *steps], [*(s - 1 for s in steps), None]
    n = F.col("BlockLength")
    cols = [F.sum((n == 1).cast("long")).alias("n_detached_buildings")]
    for lo, hi in zip(lows, highs):
        cols.append(F.sum((n.between(lo, hi) if hi else n >= lo).cast("long")).alias(f"blocks_{lo}_to_{hi or 'inf'}"))
    return blocks.select("BlockId", "BlockLength").distinct().agg(*cols)


def class_shares(lu: DataFrame, classes: list[str], boundary_area: Column) -> DataFrame:
    """One row: each class's area over the boundary's."""
    return lu.agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("area"))) / boundary_area, F.lit(0.0)).alias(f"prop_{c}") for c in classes])


def land_use_in_window(df: DataFrame, lu: DataFrame, classes: list[str], sizes=(100.0,), area: Column | None = None, prefix: str = "") -> DataFrame:
    """lu_X_within_buffer_B: each class's area in the square buffer; lu_roads: what the classes leave. ``lu``: class, geom.
    ``prefix``: what its class has before the X of the column's name."""
    from .buildings import clipped_area, window_of

    w, e = window_of, F.col("r_env")
    clipped = lambda window: clipped_rectangle_area(e, window)

    def cut_by_windows(lu: DataFrame, area) -> DataFrame:
        pairs = window_pairs(df, lu, max(sizes))
        for b in sizes:
            # what lies whole in the window is an expression; the kernel sees the others alone
            inside = (e["minx"] >= w(b)["minx"]) & (e["maxx"] <= w(b)["maxx"]) & (e["miny"] >= w(b)["miny"]) & (e["maxy"] <= w(b)["maxy"])
            a = area(w(b)) if area is not None else F.when(inside, G.area(F.col("r_geom"))).otherwise(clipped_area(G.only(~inside, F.col("r_geom")), w(b)))
            pairs = G.hold(pairs, f"_a_{b:g}", a)
        return pairs.select("id", "_cen", "r_env", "r_class", *[f"`_a_{b:g}`" for b in sizes])

    if area is not None:
        pairs = cut_by_windows(lu, area)
    else:
        # rectangles carry no geometries and go past no kernel
        lu = G.hold(G.hold(lu.where("geom IS NOT NULL"), "_e", G.envelope(F.col("geom"))), "_rect", G.is_rectangle(F.col("geom"), F.col("_e"))).drop("_e")
        plain, other = lu.where("_rect").drop("_rect"), lu.where("NOT _rect").drop("_rect")
        pairs = cut_by_windows(plain, clipped)
        if not other.isEmpty():
            pairs = pairs.unionByName(cut_by_windows(other, None))

    def aggregates(near, b, label):
        return [F.sum(F.when(near & (F.col("r_class") == prefix + c), F.col(f"`_a_{label}`"))).alias(f"lu_{c}_within_buffer_{label}") for c in classes]

    got = zero_filled(df, window_stats(pairs, list(sizes), aggregates))
    for b in sizes:
        rest = F.lit(4.0 * b * b)
        for c in classes:
            rest = rest - F.col(f"`lu_{c}_within_buffer_{b:g}`")
        got = got.withColumn(f"lu_roads_within_buffer_{b:g}", rest)
    return got


def interpolated(df: DataFrame, data: DataFrame, value: str, names: dict[str, str], size: float = 500.0, buffer: float = 50.0) -> DataFrame:
    """Areal interpolation of ``value`` of polygons (did, geom) onto polygons, or discs of ``buffer`` around points (id, geom).

    ``names``: a result column for each kind that is asked: ``weighted`` (mean by overlap), ``total`` (by the share of each
    data polygon), ``total_per_area`` (a square kilometre). One spatial join serves all. Null where nothing overlaps."""
    if unknown := set(names) - {"weighted", "total", "total_per_area"}:
        raise ValueError(f"unknown kinds {unknown}")
    at = G.hold(df.select("id", "geom"), "_c", G.centroid(F.col("geom")))
    at = at.select("id", F.when(F.col("geom.kind") == 1, disc(F.col("_c"), buffer)).otherwise(F.col("geom")).alias("_g"))
    at = G.hold(at, "_own", G.area(F.col("_g")))
    b = G.hold(data.select("did", F.col("geom").alias("_h"), F.col(value).alias("_v")), "_whole", G.area(F.col("_h")))
    pairs = overlaps(at.select("id", "_g"), b, "_g", "_h", size)
    total = F.sum(F.col("_v") * F.col("_a") / F.col("_whole"))
    # areas without a value count for nothing
    weight = F.sum(F.when(F.col("_v").isNotNull(), F.col("_a")))
    got = pairs.groupBy("id").agg(F.try_divide(F.sum(F.col("_v") * F.col("_a")), weight).alias("_weighted"), total.alias("_total"))
    said = {"weighted": F.col("_weighted"), "total": F.col("_total"), "total_per_area": F.try_divide(F.col("_total"), F.col("_own")) * 1e6}
    return at.select("id", "_own").join(got, "id", "left").select("id", *[said[k].alias(n) for k, n in names.items()])


def feature_in_buffer(df: DataFrame, data: DataFrame, value: str, name: str, kind: str = "weighted", size: float = 500.0, buffer: float = 50.0) -> DataFrame:
    """``interpolated`` of one kind."""
    return interpolated(df, data, value, {kind: name}, size, buffer)


def trips_per_capita(origins: DataFrame, population: DataFrame, trips: DataFrame, value: str, name: str, size: float = 500.0, buffer: float = 50.0) -> DataFrame:
    """num_trips of each origin (id, geom) in ``trips`` (id_origin), its population by areal interpolation, and their ratio."""
    once = origins.select("id", "geom").dropDuplicates(["id"])
    n = trips.groupBy(F.col("id_origin").alias("id")).agg(F.count(F.lit(1)).alias("num_trips"))
    people = feature_in_buffer(once, population, value, "pop_count", "total", size, buffer)
    return once.select("id").join(n, "id", "left").join(people, "id").select("id", "num_trips", "pop_count", F.try_divide(F.col("num_trips"), F.col("pop_count")).alias(name))


def class_counts(areas: DataFrame, points: DataFrame, kind: str, size: float = 500.0) -> DataFrame:
    """(id, kind, counts, class_total): points (geom, kind) of each kind in each polygon, and the kind's points in all."""
    pairs = spatial_join(points.select(F.col("geom").alias("_p"), kind), areas.select("id", F.col("geom").alias("_q")), "_p", "_q", "intersects", size)
    return pairs.groupBy("id", kind).agg(F.count(F.lit(1)).alias("counts")).join(points.groupBy(kind).agg(F.count(F.lit(1)).alias("class_total")), kind).select("id", kind, "counts", "class_total")


def population_shares(areas: DataFrame, people: DataFrame, value: str, size: float = 500.0, name: str = "Population Count") -> DataFrame:
    """(id, land_use, counts, total_count, lu_perc): each area's people by areal interpolation, those of all areas and its share,
    under a class name of their own. Areas that nothing overlaps have nulls."""
    at = feature_in_buffer(areas, people, value, "counts", "total", size)
    total = at.agg(F.sum("counts").alias("total_count"))
    return at.join(F.broadcast(total), F.lit(True)).select("id", F.lit(name).alias("land_use"), "counts", "total_count", F.try_divide("counts", "total_count").alias("lu_perc"))


def with_population(counts: DataFrame, people: DataFrame, kind: str, name: str = "Population Count") -> DataFrame:
    """``counts`` (id, kind, counts) with a further kind: each area's ``people`` (id, pop)."""
    return counts.select("id", kind, F.col("counts").cast("double").alias("counts")).unionByName(people.select("id", F.lit(name).alias(kind), F.col("pop").cast("double").alias("counts")))


def entropy(counts: DataFrame, unit: str, kind: str, n: str, normed: bool = False) -> DataFrame:
    """Land-use mix of each unit: -sum p ln p / ln K, K the number of kinds; ``normed`` weighs kinds by their totals first."""
    k = counts.select(kind).distinct().count()
    value = F.col(n).cast("double")
    at = counts.withColumn("_v", value / F.sum(value).over(Window.partitionBy(kind)) if normed else value)
    at = at.withColumn("_p", F.col("_v") / F.sum("_v").over(Window.partitionBy(unit)))
    term = F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0)
    return at.groupBy(unit).agg((-F.sum(term) / math.log(k) if k > 1 else F.lit(0.0)).alias("ft_lu_entropy_" + ("normed" if normed else "classic")))


def jobs_within(pairs: DataFrame, n_jobs: float, version: str = "v2") -> DataFrame:
    """Job-weighted mean distance to the nearest ``n_jobs`` jobs; ``pairs``: id, other, distance, num_jobs.

    v2 takes others while the jobs before them are fewer than asked for; v1 while each one's own jobs are. Where those taken
    have no jobs at all, v1 gives the plain mean and v2 fails, as there is no weighted mean."""
    w = Window.partitionBy("id").orderBy("distance", "other")
    if version == "v2":
        before = F.coalesce(F.sum("num_jobs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        at = pairs.withColumn("_take", before < n_jobs)
    else:
        full = F.max((F.col("num_jobs") >= n_jobs).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        at = pairs.withColumn("_take", (full == 0) | (F.row_number().over(w) == 1))
    jobs = F.sum("num_jobs")
    none = F.avg("distance") if version == "v1" else F.raise_error(F.lit("no jobs to weight distances by")).cast("double")
    return at.where("_take").groupBy("id").agg(F.when(jobs > 0, F.sum(F.col("num_jobs") * F.col("distance")) / jobs).otherwise(none).alias("employment_access"))


def employment_access(points: DataFrame, jobs: DataFrame, n_jobs: float, reach: float = 300.0) -> DataFrame:
    """``jobs_within`` (v2) of points (id, x, y) over jobs (other, x, y, num_jobs); points and jobs meet by cells.

    A point is settled once the circle of radius ``reach`` holds ``n_jobs`` jobs; the others look twice as far each time, at
    last over all jobs."""
    j, p = (t.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() for t in (jobs, points))
    empty = j[0] is None or p[0] is None
    far = 0.0 if empty else math.hypot(max(j[1] - p[0], p[1] - j[0]), max(j[3] - p[2], p[3] - j[2])) * (1 + 1e-9)
    at = jobs.select("other", F.col("x").alias("_x"), F.col("y").alias("_y"), "num_jobs")
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    open_, out = points.select("id", "x", "y"), None
    while True:
        box = F.struct((F.col("x") - reach).alias("minx"), (F.col("y") - reach).alias("miny"), (F.col("x") + reach).alias("maxx"), (F.col("y") + reach).alias("maxy"))
        spot = F.struct(F.col("_x").alias("minx"), F.col("_y").alias("miny"), F.col("_x").alias("maxx"), F.col("_y").alias("maxy"))
        pairs = envelope_join(open_.withColumn("l_env", box), at.withColumn("r_env", spot), 2 * reach).select("id", "other", F.sqrt(dx * dx + dy * dy).alias("distance"), "num_jobs").where(F.col("distance") <= reach)
        if reach < far:
            pairs = pairs.join(pairs.groupBy("id").agg(F.sum("num_jobs").alias("_n")).where(F.col("_n") >= n_jobs).select("id"), "id", "left_semi")
        done = cut(jobs_within(pairs, n_jobs))
        out = done if out is None else out.unionByName(done)
        open_ = open_.join(done.select("id"), "id", "left_anti")
        if reach >= far or not open_.limit(1).count():
            return out
        reach *= 2


def tract_employment_access(tracts: DataFrame, jobs: DataFrame, value: str, share: float = 0.1, size: float = 500.0) -> DataFrame:
    """(id, employment_access) by the first rule: job polygons (did, geom, ``value``) are spread over the tracts (id, geom), and
    each tract takes tracts by distance of centroids while their own jobs are fewer than int(share * all jobs).

    Tracts meet all tracts, as the rule asks; they are the few units of a city."""
    at = feature_in_buffer(tracts, jobs, value, "num_jobs", "total", size)
    c = G.hold(tracts.select("id", "geom"), "_c", G.centroid(F.col("geom"))).select("id", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))
    known = cut(at.join(c, "id").select("id", "x", "y", F.coalesce("num_jobs", F.lit(0.0)).alias("num_jobs")))
    n = int(share * (known.agg(F.sum("num_jobs")).first()[0] or 0.0))
    other = known.select(F.col("id").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"), "num_jobs")
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    pairs = known.select("id", "x", "y").join(other, F.lit(True)).select("id", "other", F.sqrt(dx * dx + dy * dy).alias("distance"), "num_jobs")
    return jobs_within(pairs, n, "v1")


def jobs_near(tracts: DataFrame, jobs: DataFrame, reach: float = 10_000.0) -> DataFrame:
    """The rows of ``jobs`` (other, geom) within ``reach`` of any of the tracts (id, geom)."""
    a, b = jobs.select("other", F.col("geom").alias("_g")), tracts.select(F.col("geom").alias("_h"))
    near = spatial_join(a, b, "_g", "_h", "distance", 2 * reach, reach).select("other").distinct()
    return jobs.join(near, "other", "left_semi")


def area_plus_buffer(df: DataFrame, boundary: DataFrame, buffer: float, size: float = 500.0) -> DataFrame:
    """The rows of ``df`` (id, geom) within ``buffer`` of the boundary (geom), with is_buffer: whether they don't meet it itself."""
    near = spatial_join(df.select("id", F.col("geom").alias("_g")), boundary.select(F.col("geom").alias("_h")), "_g", "_h", "distance", size, buffer)
    flag = near.groupBy("id").agg((F.min("distance") > 0).alias("is_buffer"))
    return df.join(flag, "id")


def away_from_boundary(points: DataFrame, area: DataFrame, buffer: float, size: float = 500.0) -> DataFrame:
    """The points (id, geom) inside the largest part of the area (geom) and farther than ``buffer`` from its boundary: those
    within the area once its edge has gone by ``buffer``."""
    part = area.select(G.largest_part(F.col("geom")).alias("_h"))
    inside = spatial_join(points.select("id", F.col("geom").alias("_g")), part, "_g", "_h", "within", size).select("id").distinct()
    edge = part.select(F.explode(F.flatten("_h.parts")).alias("r")).select(F.struct(F.lit(2).cast("tinyint").alias("kind"), F.array(F.array("r")).alias("parts")).cast(G.GEOM).alias("_e"))
    near = spatial_join(points.select("id", F.col("geom").alias("_g")), edge, "_g", "_e", "distance", size, buffer).select("id").distinct()
    return points.join(inside, "id", "left_semi").join(near, "id", "left_anti")


def area_km2(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the area of all its geometries in square kilometres on each row."""
    total = df.agg(F.sum(G.area(F.col("geom")))).first()[0] or 0.0
    return df.withColumn(name, F.lit(total * 1e-6))


def network_length_km(df: DataFrame, edges: DataFrame, name: str, length: str = "length") -> DataFrame:
    """``df`` with the length of all directed edges in kilometres on each row."""
    total = edges.agg(F.sum(length)).first()[0] or 0.0
    return df.withColumn(name, F.lit(float(total) * 1e-3))


def city_streets(streets: DataFrame) -> DataFrame:
    """One row: total_length_street_city, av_length_street_city."""
    n = G.length(F.col("geom"))
    return streets.agg(F.sum(n).alias("total_length_street_city"), F.avg(n).alias("av_length_street_city"))


def city_intersections(points: DataFrame) -> DataFrame:
    """One row: intersections_count."""
    return points.agg(F.count(F.lit(1)).alias("intersections_count"))


def city_street_blocks(sbb: DataFrame) -> DataFrame:
    """One row: total_number_block_city, av_area_block_city, std_area_block_city."""
    return sbb.agg(F.count(F.lit(1)).alias("total_number_block_city"), F.avg("area").alias("av_area_block_city"), F.stddev_samp("area").alias("std_area_block_city"))


def keyed_feature(df: DataFrame, data: DataFrame, key: str, value: str, name: str, default=None) -> DataFrame:
    """Left join of one value by key (hex population, transit, income); ``default`` for keys without a match."""
    got = data.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    v = F.col("_v") if default is None else F.coalesce(F.col("_v"), F.lit(default))
    return df.join(got, df[key] == got["_k"], "left").select(*[df[c] for c in df.columns], v.alias(name))


def social_index(df: DataFrame, data: DataFrame, key: str = "hex_id") -> DataFrame:
    """Status and its trend by key; + is 1, +/- 0, - is -1."""
    sign = F.when(F.col("dynamic_index") == "+", 1.0).when(F.col("dynamic_index") == "+/-", 0.0).when(F.col("dynamic_index") == "-", -1.0)
    got = data.select(F.col(key).alias("_k"), F.col("status_index").alias("feature_social_status_index"), sign.alias("feature_social_dynamic_index"))
    return df.join(got, df[key] == got["_k"], "left").drop("_k")


def pizza_split(df: DataFrame, share: float = 0.2, angle: float = math.pi, buckets: int = 4096) -> DataFrame:
    """id and label: the sector of points (id, x, y) that starts at ``angle`` around the centroid is ``test``.

    The threshold is the angle at the place floor(share * n); it's found in two passes over a histogram, not by a global sort."""
    c = df.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not c["n"]:
        return df.select("id", F.lit("train").alias("label"))
    dx, dy = F.col("x") - c["x"], F.col("y") - c["y"]
    r = F.sqrt(dx * dx + dy * dy)
    cos = F.try_divide(dx * math.cos(angle) + dy * math.sin(angle), r)
    at = df.withColumn("_t", F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))), F.lit(0.0)))
    k = math.ceil(share * c["n"]) - 1  # how many of rank / n lie below the share
    lo, hi, before = 0.0, math.pi * (1 + 1e-9), 0
    while True:
        step = (hi - lo) / buckets
        bins = sorted((int(b["b"]), b["n"]) for b in at.where((F.col("_t") >= lo) & (F.col("_t") < hi)).groupBy(F.least(F.floor((F.col("_t") - lo) / step), F.lit(buckets - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        for b, n in bins:
            if before + n > k:
                break
            before += n
        lo2, hi2 = lo + b * step, lo + (b + 1) * step
        if n <= 50_000 or hi2 <= lo2 or (lo2, hi2) == (lo, hi):
            near = sorted(x["_t"] for x in at.where((F.col("_t") >= lo) & (F.col("_t") < hi)).where(F.least(F.floor((F.col("_t") - lo) / step), F.lit(buckets - 1)) == b).select("_t").limit(100_000).collect())
            cut = near[max(0, min(k - before, len(near) - 1))]
            return at.select("id", F.when(F.col("_t") < cut, F.lit("test")).otherwise(F.lit("train")).alias("label"))
        lo, hi = lo2, hi2


def kept_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def part_with_buffer(points: DataFrame, inner: DataFrame, outer: DataFrame, size: float) -> DataFrame:
    """Points of a part, and of its buffered part with ``buffer_part`` true; ids decide what has been taken."""
    a = points.select("id", F.col("geom").alias("_g"))
    ins = spatial_join(a, inner.select(F.col("geom").alias("_h")), "_g", "_h", "within", size).select("id").distinct()
    out = spatial_join(a, outer.select(F.col("geom").alias("_h")), "_g", "_h", "intersects", size).select("id").distinct().join(ins, "id", "left_anti")
    flag = ins.withColumn("buffer_part", F.lit(False)).unionByName(out.withColumn("buffer_part", F.lit(True)))
    return points.join(flag, "id")


def changed_cells(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Row by row difference of two tables: cells that differ read ``old --> new``; two nulls differ, as missing values do. All
    cells of a row that one table lacks read ``absent`` on that side."""
    cols = [c for c in old.columns if c != key and c in new.columns]
    a, b = old.withColumn("_there", F.lit(True)).alias("a"), new.withColumn("_there", F.lit(True)).alias("b")
    text = lambda t, c: F.when(F.col(f"{t}._there").isNull(), F.lit("absent")).otherwise(F.coalesce(F.col(f"{t}.`{c}`").cast("string"), F.lit("nan")))
    cells = [F.when(F.col(f"a.`{c}`") == F.col(f"b.`{c}`"), text("a", c)).otherwise(F.concat(text("a", c), F.lit(" --> "), text("b", c))).alias(c) for c in cols]
    return a.join(b, F.col(f"a.`{key}`") == F.col(f"b.`{key}`"), "full").select(F.coalesce(F.col(f"a.`{key}`"), F.col(f"b.`{key}`")).alias(key), *cells)
