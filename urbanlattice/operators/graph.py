"""Connected components, blocks of touching buildings and shortest paths, as loops of joins that stop by themselves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut, discard, spread
from .spatial_join import spatial_join


#: A label that more than a share of 1 / HOT of the nodes carry is looked up in parts; by counting there are fewer than HOT.
HOT = 1000
#: Labels of fewer nodes are never hot.
LEAST_HOT = 10_000


def _looked_up(label: DataFrame, hot: dict[int, list]) -> DataFrame:
    """(id, c, g): each node's label with the label's own label. ``hot``: by a number of parts, the labels to be dealt into so many."""
    parts = F.lit(1)
    for n, labels in sorted(hot.items()):
        parts = F.when(F.col("c").isin(labels), F.lit(n)).otherwise(parts)
    asked = label.select("id", "c", F.pmod(F.xxhash64("id"), parts).cast("int").alias("_k"))
    told = label.select(F.col("id").alias("_id"), F.col("c").alias("g"), "id").withColumn("c", F.col("id"))
    told = told.select("_id", "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return asked.join(told, (F.col("c") == F.col("_id")) & (F.col("_k") == F.col("_part"))).select("id", "c", "g")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of each of ``nodes`` (id, null ones left out): the least id reachable over ``edges`` (a, b) between them.

    Each node carries a label, at first its own id. In each round it takes the least of its label, its label's label and its
    neighbours' labels' labels, and hands its neighbours' on to the node its label names, so that whole trees are hung under
    lesser ones and paths in any order of ids settle in about log2(length) rounds. A round is one join of the labels with
    themselves, one with the edges and one written table, which says itself whether it changed anything. A label that many
    nodes share is looked up in parts."""
    there = edges.where("a != b").select("a", "b")
    both = cut(there.union(there.select("b", "a")).distinct())
    label = cut(nodes.where("id IS NOT NULL").select("id", F.col("id").alias("c")).distinct())
    hot: dict[int, list] = {}
    total = label.count()
    for k in range(most_rounds):
        known = _looked_up(label, hot) if k else label.select("id", "c", F.col("c").alias("g"))
        least = both.join(known.select(F.col("id").alias("b"), "g"), "b").groupBy(F.col("a").alias("_a")).agg(F.min("g").alias("m"))
        met = known.join(least, F.col("id") == F.col("_a"), "left")
        # what a node hears, for itself and for the node that its label names
        heard = F.array(F.struct("id", F.least("c", "g", "m").alias("x"), F.col("c").alias("own")), F.struct(F.col("c").alias("id"), F.least("g", "m").alias("x"), F.lit(None).cast(dict(label.dtypes)["c"]).alias("own")))
        new = met.select(F.inline(heard)).groupBy("id").agg(F.min("x").alias("c"), F.min("own").alias("old"))
        new = cut(new.select("id", "c", (F.col("c") < F.col("old")).alias("changed")))
        discard(label)
        label = new
        by = label.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("changed"))
        many = (F.col("n") > LEAST_HOT) & (F.col("n") * HOT > total)
        changed, shared = by.agg(F.max("changed"), F.collect_list(F.when(many, F.struct("c", "n")))).first()
        if not changed:
            discard(both)
            return label.select("id", F.col("c").alias("component"))
        hot = {}
        for r in shared:
            hot.setdefault(1 << (r["n"] * HOT // total).bit_length(), []).append(r["c"])
    raise RuntimeError("components did not settle")


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """(column, number): the distinct values, numbered from 0 in their order, without one task that sees them all.

    Values are dealt into sorted ranges; how many each range has, one number a range, tells where its numbers start."""
    n = F.col("_place").bitwiseAND((1 << 33) - 1)
    some = cut(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    starts, total = [], 0
    for r in some.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], total))
        total += r["count"]
    at = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return some.join(F.broadcast(at), "_part").select(column, (F.col("_start") + n).alias("number"))


def adjacency(df: DataFrame, size: float = 100.0) -> DataFrame:
    """(a, b): pairs of polygons that share a point."""
    a = df.select(F.col("id").alias("a"), F.col("geom").alias("_g"))
    b = df.select(F.col("id").alias("b"), F.col("geom").alias("_h"))
    return spatial_join(a, b, "_g", "_h", "intersects", size).where("a < b").select("a", "b")


def block_level(df: DataFrame, size: float = 100.0, adjacent: DataFrame | None = None, measured: bool = True) -> DataFrame:
    """Blocks of touching buildings (id, geom): for each building its block and the block's measures.

    Ids are whole numbers. Without ``measured``, the columns that need hulls and circles are left out: longest axis, elongation,
    convexity, orientation, corners."""
    comp = cut(components(df.select("id"), adjacent if adjacent is not None else adjacency(df, size)))
    rows = df.join(comp, "id").select("id", "component", "geom", G.area(F.col("geom")).alias("_a"))
    stats = rows.groupBy("component").agg(F.count(F.lit(1)).alias("BlockLength"), F.avg("_a").alias("AvBlockFootprintArea"), F.coalesce(F.stddev_samp("_a"), F.lit(0.0)).alias("StdBlockFootprintArea"), F.sort_array(F.collect_list("id")).alias("TouchesIndexes"))
    sized = rows.join(stats.select("component", "BlockLength"), "component")
    # a building on its own is its block: only blocks of several are merged
    merged = dissolve(sized.where("BlockLength > 1").select("component", "geom"), "component", size)
    g, m = F.col("geom"), F.col("_m")
    shapes = sized.where("BlockLength = 1").select("component", "geom").unionByName(merged)
    if measured:
        shapes = G.hold(G.hold(spread(shapes), "_m", G.shape_measures("geom")), "BlockTotalFootprintArea", G.area(g))
        more = [m["longest_axis"].alias("BlockLongestAxisLength"), m["elongation"].alias("BlockElongation"), F.try_divide("BlockTotalFootprintArea", m["hull_area"]).alias("BlockConvexity"), m["orientation"].alias("BlockOrientation"), G.corners(g).alias("BlockCorners")]
    else:
        shapes, more = shapes.withColumn("BlockTotalFootprintArea", G.area(g)), []
    shapes = shapes.select("component", "BlockTotalFootprintArea", G.length(g).alias("BlockPerimeter"), *more)
    return comp.join(stats, "component").join(shapes, "component").select("id", F.col("component").alias("BlockId"), *stats.columns[1:], *shapes.columns[1:])


#: Polygons that one task unites at once, about.
UNITED = 1000


def dissolve(df: DataFrame, key: str, size: float = 1000.0) -> DataFrame:
    """(key, geom): the union of each key's polygons (key, geom), as one polygon or multi-polygon; null geometries are left out.

    A tree of unions: each round unites some UNITED polygons of a key that lie in one cell, cells grow fourfold each round,
    and the last round sees the outlines of a key's last cells alone. Keys of a few polygons each take one round."""
    from ..functions import overlay

    @G.arrowed(G.GEOM)
    def united(g: pa.Array) -> pa.Array:
        shapes = G.Shapes(g)
        return G.column_of([G.polygon_row(p) for p in overlay.together([overlay.uniting(shapes[i] or []) for i in range(len(shapes))])])

    def each(t: DataFrame, *by: str) -> DataFrame:
        # one row a group, with all its polygons as parts: small groups go through the kernel many at once
        together = F.struct(F.lit(6).cast("tinyint").alias("kind"), F.flatten(F.collect_list("geom.parts")).alias("parts")).cast(G.GEOM)
        return cut(G.hold(t.groupBy(*by).agg(together.alias("_all")), "geom", united("_all")).select(key, "geom"))

    # held: filters and envelopes above would make the geometries again
    rows = G.hold(df.select(key, F.col("geom").alias("_made")), "geom", F.col("_made")).where("geom IS NOT NULL").select(key, "geom")
    side = float(size)
    while True:
        at = G.hold(rows, "_e", G.envelope(F.col("geom"))).select(key, "geom", F.floor(F.col("_e.minx") / side).alias("_i"), F.floor(F.col("_e.miny") / side).alias("_j"))
        at = cut(at)
        counts = cut(at.groupBy(key, "_i", "_j").agg(F.count(F.lit(1)).alias("_n")))
        if counts.groupBy(key).agg(F.sum("_n").alias("_n")).where(F.col("_n") > UNITED).isEmpty():
            new = each(at.where("_i IS NOT NULL AND _j IS NOT NULL"), key)
            discard(at, counts)
            return new
        # a key of few polygons is united at once; a crowded cell in parts
        few, parts = F.sum("_n").over(Window.partitionBy(key)) <= UNITED, F.ceil(F.col("_n") / UNITED)
        how = counts.select(F.col(key).alias("_key"), F.col("_i").alias("_x"), F.col("_j").alias("_y"), F.when(few, 0).otherwise(F.col("_i")).alias("_gi"), F.when(few, 0).otherwise(F.col("_j")).alias("_gj"), F.when(few, 1).otherwise(parts).alias("_parts"))
        met = at.join(how, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_i") == F.col("_x")) & (F.col("_j") == F.col("_y")))
        part = F.pmod(F.xxhash64("geom"), F.col("_parts")).cast("int")
        new = each(met.select(key, "geom", "_gi", "_gj", part.alias("_p")), key, "_gi", "_gj", "_p")
        crowded = not counts.where(F.col("_n") > UNITED).isEmpty()
        discard(at, counts)
        if new.groupBy(key).count().where("count > 1").isEmpty():
            return new
        rows, side = new, side if crowded else side * 4


def _inside(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(n, o1, o2): nodes with exactly two neighbours that are none of ``anchors`` (node)."""
    around = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select("v", "u")).distinct()
    two = around.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.min("o").alias("o1"), F.max("o").alias("o2")).where("k = 2")
    return two.join(anchors.select(F.col("node").alias("n")).distinct(), "n", "left_anti").select("n", "o1", "o2")


def chains(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(p, q, anchor, dist) for directed edges (u, v, length): for each edge p to q, the last node before q, on the only way there,
    that isn't one of ``inside`` (n, o1, o2), nodes with two neighbours, and how far q is from it.

    Pointer doubling: log2(longest chain) rounds. Edges that no way leads to (rings and one-way ends) are left out."""
    e = edges.join(inside, edges["u"] == inside["n"], "left").select("u", "v", "length", F.when(F.col("v") == F.col("o1"), F.col("o2")).otherwise(F.col("o1")).alias("o"), F.col("n").isNotNull().alias("open"))
    # (ap, aq): the edge reached on the way back; dist: from aq to q, or from ap once ap is outside
    now = cut(e.select(F.col("u").alias("p"), F.col("v").alias("q"), F.when(F.col("open"), F.col("o")).otherwise(F.col("u")).alias("ap"), F.when(F.col("open"), F.col("u")).otherwise(F.col("v")).alias("aq"), F.col("length").alias("dist"), "open"))
    left = None
    while (n := now.where("open").count()) and n != left:  # what doesn't close any more goes round a ring
        left = n
        far = now.select(F.col("p").alias("_p"), F.col("q").alias("_q"), F.col("ap").alias("_ap"), F.col("aq").alias("_aq"), F.col("dist").alias("_d"), F.col("open").alias("_o"))
        on = now.where("open").join(far, (F.col("ap") == F.col("_p")) & (F.col("aq") == F.col("_q")))
        new = cut(now.where("NOT open").unionByName(on.select("p", "q", F.col("_ap").alias("ap"), F.col("_aq").alias("aq"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_o").alias("open"))))
        discard(now)
        now = new
    out = now.where("NOT open").select("p", "q", F.col("ap").alias("anchor"), "dist")
    out.cut_path = now.cut_path
    return out


#: Chains are contracted if their nodes are at least this share of the edges: else there is little to gain by it.
IN_CHAINS = 0.1


def shortest_paths(edges: DataFrame, sources: DataFrame, width: float = 16.0) -> DataFrame:
    """(source, node, distance) over directed ``edges`` (u, v, length >= 0) from each of ``sources`` (source, node).

    Chains of nodes with two neighbours become one edge before the search, and their nodes get their distances after it, so
    that rounds go with crossings, not with vertices. The search takes buckets of ``width`` mean edges: nodes farther than the
    bucket wait until all nearer ones have settled. Every round is written; earlier ones are deleted. Edges without a length
    don't count; nodes out of reach have no row."""
    e = cut(edges.where("u != v AND length IS NOT NULL").groupBy("u", "v").agg(F.min("length").cast("double").alias("length")))
    starts = cut(sources.select("source", "node").distinct())
    inside = cut(_inside(e, starts))
    contracted = inside.count() >= IN_CHAINS * e.count() > 0
    if contracted:
        by = chains(e, inside)
        to = cut(by.join(inside, by["q"] == inside["n"], "left_anti").where("anchor != q").groupBy("anchor", "q").agg(F.min("dist").alias("length")))
    else:
        to = e.select(F.col("u").alias("anchor"), F.col("v").alias("q"), "length")
    bucket = width * (to.agg(F.avg("length")).first()[0] or 1.0)
    best, limit = cut(starts.select("source", "node", F.lit(0.0).alias("distance"), F.lit(True).alias("open"))), -1.0
    while (least := best.where("open").agg(F.min("distance")).first()[0]) is not None:
        if least > limit:
            limit = least + bucket
        ready = F.col("open") & (F.col("distance") <= limit)
        step = best.where(ready).join(to, F.col("node") == F.col("anchor")).groupBy("source", "q").agg(F.min(F.col("distance") + F.col("length")).alias("d"))
        old = best.select(F.col("source").alias("_s"), F.col("node").alias("_n"), F.col("distance").alias("_d"), (F.col("open") & ~ready).alias("_o"))
        met = old.join(step, (F.col("_s") == F.col("source")) & (F.col("_n") == F.col("q")), "full")
        fell = F.coalesce(F.col("_d").isNull() | (F.col("d") < F.col("_d")), F.lit(False)) | F.coalesce("_o", F.lit(False))
        new = cut(met.select(F.coalesce("_s", "source").alias("source"), F.coalesce("_n", "q").alias("node"), F.least("_d", "d").alias("distance"), fell.alias("open")))
        discard(best)
        best = new
    if not contracted:
        discard(e, starts, inside)
        return best.select("source", "node", "distance")
    # the nodes inside chains, from either end
    far = by.join(inside, by["q"] == inside["n"], "left_semi")
    met = best.select("source", F.col("node").alias("anchor"), "distance").join(far, "anchor").groupBy("source", F.col("q").alias("node")).agg(F.min(F.col("distance") + F.col("dist")).alias("distance"))
    out = cut(best.select("source", "node", "distance").unionByName(met))
    discard(e, starts, inside, by, to, best)
    return out
