"""Queries over streets, their nodes and blocks, and over building parts with heights, with SQL over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import city as C
from ..operators import profile as P
from ..operators import streets as S
from . import views as V
from .queries_common import rounded


def street_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, its deviation and openness of all streets between all buildings."""
    return rounded(P.street_profile(V.streets(spark, sf_dir).select("id", "geom"), V.buildings(spark, sf_dir).select("geom")))


def _nodes(spark, sf_dir) -> DataFrame:
    return V.nodes(spark, sf_dir).select("osmid", (F.col("x") / 1000).alias("closeness500"), (F.col("y") / 1000).alias("closeness_global"))


def edge_node_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of edges as means of their two nodes; null where a node isn't known."""
    return rounded(P.node_means(V.edges(spark, sf_dir), _nodes(spark, sf_dir), ["closeness500", "closeness_global"]), 6)


def _street_blocks(spark, sf_dir) -> DataFrame:
    i = F.col("id")
    return V.land_use(spark, sf_dir).select("id", "geom", (1e4 + i % 7).alias("area"), (i % 10 / 10).alias("phi"), (i % 45).cast("double").alias("orientation"))


def street_blocks_within_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street blocks that meet the window around each building."""
    return rounded(S.street_blocks_distance_based(V.buildings(spark, sf_dir), _street_blocks(spark, sf_dir)))


def _central_streets(spark, sf_dir) -> DataFrame:
    i = F.col("id")
    return V.streets(spark, sf_dir).withColumn("openness", (i % 11).cast("double")).withColumn("betweenness_metric_e", (i % 101).cast("double")).withColumn("closeness_global", (i % 13).cast("double")).withColumn("closeness500", (i % 17).cast("double"))


def street_centrality_within_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and maxima of openness, betweenness and closeness of the streets that meet the window around each building."""
    got = S.streets_distance_based(V.buildings(spark, sf_dir), _central_streets(spark, sf_dir), averages=("openness", "betweenness_metric_e", "closeness_global", "closeness500"), deviations=(), maxima=("betweenness_metric_e", "closeness_global"))
    return rounded(got, 6)


def closest_street_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of the closest street, centrality included."""
    return rounded(S.closest_street_features(V.buildings(spark, sf_dir), _central_streets(spark, sf_dir), 10.0))


def intersections_around_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings in the 60 m buffers of points, a square kilometre."""
    nodes = V.points(spark, sf_dir).select((F.col("id") % 5).alias("street_count"), "geom")
    return rounded(P.intersections_per_buffer(V.jobs(spark, sf_dir).select("id", "geom"), nodes, "intersections_per_km2", 60.0))


def population_of_tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population of tracts from land-use tiles, their share of all, as a class of its own."""
    people = V.land_use(spark, sf_dir).select(F.col("id").alias("did"), "geom", (1.0 + F.col("id") % 13).alias("total_population"))
    return rounded(C.population_shares(V.tracts(spark, sf_dir).select("id", "geom"), people, "total_population", 200.0), 6)


def wall_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building parts as 3-D shapes (footprints in two halves, walls), their heights and dissolved footprints."""
    from ..sources import vector as R

    b = V.buildings(spark, sf_dir)
    x0, y0, x1, y1, low, high = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d"), F.col("id") % 7 + 0.5, F.col("id") % 7 + F.col("w") + 0.25
    text = lambda *ps: F.concat(F.lit("POLYGON Z (("), F.concat_ws(", ", *[F.concat_ws(" ", *[v.cast("string") for v in p]) for p in (*ps, ps[0])]), F.lit("))"))
    middle = (x0 + x1) / 2
    part = lambda kind, wkt: F.struct(F.lit(kind).alias("TYP"), wkt.alias("wkt"))
    parts = F.array(
        part("footprint", text((x0, y0, low), (middle, y0, low), (middle, y1, low), (x0, y1, low))), part("footprint", text((middle, y0, low), (x1, y0, low), (x1, y1, low), (middle, y1, low))),
        part("wall", text((x0, y0, low), (x1, y0, low), (x1, y0, high - 1), (x0, y0, high - 1))), part("wall", text((x0, y0, low + 1), (x0, y1, low + 1), (x0, y1, high), (x0, y0, high))), part("roof", text((x0, y0, high + 9), (x1, y0, high + 9), (x1, y1, high + 9), (x0, y1, high + 9))),
    )
    rows = b.select(F.col("id").alias("ID_BUD"), F.explode(parts).alias("p")).select("ID_BUD", "p.TYP", G.from_wkt(F.col("p.wkt")).alias("geom"), G.wkt_heights(F.col("p.wkt")).alias("zs"))
    got = R.walls_to_height(rows, "ID_BUD", "TYP", "footprint", "wall")
    return rounded(got.select("ID_BUD", "computed_height", G.area(F.col("geom")).alias("area"), G.corners(F.col("geom")).alias("corners")))


ALL = [street_profiles, edge_node_means, street_blocks_within_100, street_centrality_within_100, closest_street_centrality, intersections_around_jobs, population_of_tracts, wall_heights]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from .queries import BLD, EDGES, JOBS, LU, PT, STR, TRACT

    central = "c2 AS (SELECT *, (id % 11)::DOUBLE AS openness, (id % 101)::DOUBLE AS betweenness_metric_e, (id % 13)::DOUBLE AS closeness_global, (id % 17)::DOUBLE AS closeness500 FROM s2)"
    window = "s.x0 <= cx + 100 AND s.x1 >= cx - 100 AND s.y0 <= cy + 100 AND s.y1 >= cy - 100"
    named = [f"round(coalesce({f}({c}), 0), 6)::DOUBLE AS street_{c}_{n}_within_buffer_100" for f, n, cs in (("avg", "av", ("openness", "betweenness_metric_e", "closeness_global", "closeness500")), ("max", "max", ("betweenness_metric_e", "closeness_global"))) for c in cs]
    node = "node AS (SELECT s_suppkey AS osmid, ((s_suppkey * 53) % 1000)::DOUBLE / 1000 AS a, ((s_suppkey * 29) % 1000)::DOUBLE / 1000 AS b FROM supplier)"
    blocks = "sbb AS (SELECT id, x0, y0, 1e4::DOUBLE + id % 7 AS area, (id % 10) / 10 AS phi, (id % 45)::DOUBLE AS orientation FROM lu)"
    return {
        # a building's lattice column or row tells which ticks can meet it
        "street_profiles": f"""WITH {BLD}, {STR}, smp AS (SELECT id, flat, x0, y0, length, unnest(list_append(range(0, length::BIGINT, 10)::DOUBLE[], length)) AS t FROM s2),
          tick AS (SELECT id, t, s, flat, CASE WHEN flat THEN x0 + t ELSE x0 END AS x, CASE WHEN flat THEN y0 ELSE y0 + t END AS y FROM smp, (VALUES (1), (-1)) v(s)),
          pl AS (SELECT *, CASE WHEN flat THEN x ELSE y END AS along, CASE WHEN flat THEN y ELSE x END AS across, unnest([floor((CASE WHEN flat THEN x ELSE y END) / 20), floor((CASE WHEN flat THEN x ELSE y END) / 20) - 1]) AS c FROM tick),
          b AS (SELECT TRUE AS flat, x0 / 20 AS c, x0 AS a0, x1 AS a1, y0 AS o0, y1 AS o1 FROM b2 UNION ALL SELECT FALSE, y0 / 20, y0, y1, x0, x1 FROM b2),
          hit AS (SELECT pl.id, pl.t, pl.s, pl.flat, min(CASE WHEN s = 1 THEN greatest(0, o0 - across) ELSE greatest(0, across - o1) END) AS d FROM pl JOIN b ON pl.flat = b.flat AND pl.c = b.c AND along BETWEEN a0 AND a1 AND CASE WHEN s = 1 THEN o1 >= across AND o0 <= across + 25 ELSE o0 <= across AND o1 >= across - 25 END GROUP BY ALL),
          g AS (SELECT id, avg(d) FILTER (s = 1) AS l, avg(d) FILTER (s = -1) AS r, stddev_pop(d) AS dev, count(*) AS n FROM hit GROUP BY id), k AS (SELECT id, 2 * count(*) AS n FROM smp GROUP BY id)
          SELECT k.id, round(coalesce(l, 25) + coalesce(r, 25), 4) AS width, round(coalesce(dev, 0), 4) AS width_deviation, round(1 - coalesce(g.n, 0) / k.n, 4) AS openness FROM k LEFT JOIN g USING (id)""",
        "edge_node_means": f"WITH {EDGES}, {node} SELECT edge.u, edge.v, length, round((p.a + q.a) / 2, 6) AS closeness500, round((p.b + q.b) / 2, 6) AS closeness_global FROM edge LEFT JOIN node p ON p.osmid = u LEFT JOIN node q ON q.osmid = v",
        "street_blocks_within_100": f"WITH {BLD}, {LU}, {blocks}, near AS (SELECT b.id AS bid, s.* FROM b2 b JOIN sbb s ON s.x0 <= cx + 100 AND s.x0 + 100 >= cx - 100 AND s.y0 <= cy + 100 AND s.y0 + 100 >= cy - 100) SELECT b2.id, count(bid)::DOUBLE AS street_based_block_number_inter_buffer_100, "
        + ", ".join(f"round(coalesce({f}(near.{c}), 0), 4)::DOUBLE AS street_based_block_{n}_{c}_inter_buffer_100" for c, fs in (("area", "ab"), ("phi", "ab"), ("orientation", "b")) for f, n in (("avg", "av"), ("stddev_samp", "std")) if ("a" if n == "av" else "b") in fs)
        + " FROM b2 LEFT JOIN near ON bid = b2.id GROUP BY b2.id",
        "street_centrality_within_100": f"WITH {BLD}, {STR}, {central}, near AS (SELECT b.id AS bid, s.*, greatest(0, least(s.x1, cx + 100) - greatest(s.x0, cx - 100)) + greatest(0, least(s.y1, cy + 100) - greatest(s.y0, cy - 100)) AS part FROM b2 b JOIN c2 s ON {window}) SELECT b2.id, round(coalesce(sum(part), 0), 6) AS street_length_total_within_buffer_100, {', '.join(named)} FROM b2 LEFT JOIN near ON bid = b2.id GROUP BY b2.id",
        "closest_street_centrality": f"WITH {BLD}, {STR}, {central}, p AS (SELECT b.id, s.id AS sid, sqrt(pow(greatest(0, s.x0 - b.x1, b.x0 - s.x1), 2) + pow(greatest(0, s.y0 - b.y1, b.y0 - s.y1), 2)) AS dist FROM b2 b CROSS JOIN s2 s), m AS (SELECT id, min(struct_pack(d := dist, s := sid)) AS m FROM p GROUP BY id) SELECT m.id, m.s AS closest_street, round(m.d, 4) AS distance_to_closest_street, c.length AS street_length_closest_street, round(c.width, 4) AS street_width_av_closest_street, round(c.width, 4) AS street_width_std_closest_street, round(c.openness, 4) AS street_openness_closest_street, round(c.betweenness_metric_e, 4) AS street_betweeness_global_closest_street, round(c.closeness_global, 4) AS street_closeness_global_closest_street, round(c.closeness500, 4) AS street_closeness_500_closest_street FROM m JOIN c2 c ON c.id = m.s",
        "intersections_around_jobs": f"WITH {JOBS}, {PT}, d AS (SELECT jobs.id, pt.x - jobs.x AS dx, pt.y - jobs.y AS dy FROM jobs JOIN pt ON pt.id % 5 > 1 AND pt.x BETWEEN jobs.x - 60 AND jobs.x + 60 AND pt.y BETWEEN jobs.y - 60 AND jobs.y + 60), i AS (SELECT id, sqrt(dx * dx + dy * dy) * cos(atan2(dy, dx) - (floor(atan2(dy, dx) / (pi() / 32)) + 0.5) * (pi() / 32)) <= 60 * cos(pi() / 64) AS inner_ FROM d) SELECT jobs.id, round(count(i.id) * 1e6 / (3.1365484905459389::DOUBLE * 3600), 4)::DOUBLE AS intersections_per_km2 FROM jobs LEFT JOIN i ON i.id = jobs.id AND inner_ GROUP BY jobs.id",
        "population_of_tracts": f"WITH {TRACT}, {LU}, o AS (SELECT t.id, (1 + l.id % 13) * greatest(0, least(t.x0 + 200, l.x0 + 100) - greatest(t.x0, l.x0)) * greatest(0, least(t.y0 + 200, l.y0 + 100) - greatest(t.y0, l.y0)) / 1e4 AS n FROM tract t JOIN lu l ON t.x0 < l.x0 + 100 AND l.x0 < t.x0 + 200 AND t.y0 < l.y0 + 100 AND l.y0 < t.y0 + 200), s AS (SELECT tract.id, sum(n) AS n FROM tract LEFT JOIN o ON o.id = tract.id GROUP BY tract.id) SELECT id, 'Population Count' AS land_use, round(n, 6)::DOUBLE AS counts, round(sum(n) OVER (), 6)::DOUBLE AS total_count, round(n / sum(n) OVER (), 6)::DOUBLE AS lu_perc FROM s",
        "wall_heights": f"WITH {BLD} SELECT id AS \"ID_BUD\", round(w - 0.25, 4) AS computed_height, area, 4::BIGINT AS corners FROM b2",
    }
