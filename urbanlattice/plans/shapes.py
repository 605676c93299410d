"""Queries over turned, concave, holed and multi-part shapes, whose SQL is closed forms of the layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import overlay as O
from ..session import spread
from . import views as V
from .queries_common import rounded

#: Area of the 64-gon with circumradius 1, in SQL.
DISC = "3.1365484905459389::DOUBLE"


def _n(name: str) -> Column:
    return F.col(name)


def _parts(g: Column) -> Column:
    return F.coalesce(F.size(g["parts"]), F.lit(0)).cast("long")


def boundary_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary rows of the tracts, written as CSV and read again: areas of the 500 m and 2 km buffers."""
    from ..session import shared_path
    from ..sources import tables as T

    t = V.tracts(spark, sf_dir).select(F.lit("C").alias("NAME_0"), F.col("region").cast("string").alias("NAME_1"), F.col("id").cast("string").alias("NAME_2"), "geom")
    at = shared_path(spark, "boundaries")
    T.write_boundaries(O.boundary_file(t, F.col("geom"), ["NAME_0", "NAME_1", "NAME_2"]), at)
    got = T.read_boundaries(spark, at)
    for k, c in enumerate(("boundary_GADM", "boundary_GADM_500m_buffer", "boundary_GADM_2k_buffer")):
        got = G.hold(got, f"g{k}", G.from_wkt(F.col(c)))
    return rounded(got.select("country", "region", "city", G.area(_n("g0")).alias("area"), G.area(_n("g1")).alias("area_500m"), G.area(_n("g2")).alias("area_2k"), "path"), 2)


def shape_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned rectangles, L-shapes, holed and two-part shapes, grown by 2 and shrunk by 1."""
    # a few megabytes of table are one split
    s = G.hold(spread(V.shapes(spark, sf_dir)), "g", G.from_wkt(F.col("wkt"))).select("id", "g")
    s = G.hold(s, "m", O.buffer_measures(_n("g"), [2.0, -1.0]))
    return rounded(s.select("id", _n("m.area0").alias("grown"), _n("m.rings0").alias("grown_rings"), _n("m.area1").alias("shrunk"), _n("m.parts1").alias("shrunk_parts")), 3)


def single_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes without multi-polygons: all grown by a centimetre, then the largest part of each."""
    s = G.hold(V.shapes(spark, sf_dir), "geom", G.from_wkt(F.col("wkt"))).select("id", "geom")
    got, before = O.single_polygons(s)
    return rounded(got.select("id", G.area(_n("geom")).alias("area"), _parts(_n("geom")).alias("parts"), F.lit(before).cast("long").alias("multi_before")), 3)


def _turned(g: Column) -> Column:
    """Turned by the angle of a 3-4-5 triangle."""
    vertex = lambda p: F.struct((0.6 * p["x"] - 0.8 * p["y"]).alias("x"), (0.8 * p["x"] + 0.6 * p["y"]).alias("y"))
    parts = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, vertex)))
    return F.struct(g["kind"].alias("kind"), parts.alias("parts")).cast(G.GEOM)


def _turned_shapes(spark, sf_dir) -> DataFrame:
    """Shapes that are axis-parallel (rectangles, L-shapes, holed, two-part), turned: id, geom."""
    w = V.shapes(spark, sf_dir, straight=True)
    return G.hold(G.hold(w, "_g", G.from_wkt(F.col("wkt"))).select("id", "_g"), "geom", _turned(_n("_g"))).select("id", "geom")


def _turned_tiles(spark, sf_dir) -> DataFrame:
    return V.land_use(spark, sf_dir).select(F.col("id").alias("other"), "class", _turned(_n("geom")).alias("shape"))


def overlay_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces in which turned shapes and turned land-use tiles overlap, as geometry."""
    got = O.pieces(_turned_shapes(spark, sf_dir), _turned_tiles(spark, sf_dir), 100.0)
    return rounded(got.select("id", "other", "class", G.area(_n("piece")).alias("area"), _parts(_n("piece")).alias("parts")), 3)


def overlay_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turned shape has outside the first tile it overlaps (by number), and inside: together the shape."""
    shapes, tiles = _turned_shapes(spark, sf_dir), _turned_tiles(spark, sf_dir)
    first = O.pieces(shapes, tiles.select("other", "shape"), 100.0).groupBy("id").agg(F.min_by("piece", "other").alias("inside"), F.min("other").alias("other"))
    at = shapes.join(first, "id").join(tiles.select("other", "shape"), "other")
    at = G.hold(at.repartition("id"), "rest", O.difference("geom", "shape"))
    return rounded(at.select("id", "other", G.area(_n("inside")).alias("inside"), F.coalesce(G.area(_n("rest")), F.lit(0.0)).alias("outside")), 3)


def _text_ring(*points) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in (*points, points[0])]), F.lit(")"))


def ring_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints as their files may give them, by id modulo 4: rectangles, bow ties, rectangles with a spike, nested rings."""
    b = V.buildings(spark, sf_dir)
    x0, y0, x1, y1 = _n("x0"), _n("y0"), _n("x0") + _n("w"), _n("y0") + _n("d")
    box = _text_ring((x0, y0), (x1, y0), (x1, y0), (x1, y1), (x0, y1))  # with a repeated point, which is valid
    bow = _text_ring((x0, y0), (x1, y1), (x1, y0), (x0, y1))
    spike = _text_ring((x0, y0), (x1, y0), (x1 + 3, y0), (x1, y0), (x1, y1), (x0, y1))
    nested = F.concat_ws(", ", box, _text_ring((x0 + 1, y0 + 1), (x1 - 1, y0 + 1), (x1 - 1, y1 - 1), (x0 + 1, y1 - 1)), _text_ring((x0 + 2, y0 + 2), (x0 + 3, y0 + 2), (x0 + 3, y0 + 3), (x0 + 2, y0 + 3)))
    i = F.col("id") % 4
    wkt = F.concat(F.lit("POLYGON ("), F.when(i == 0, box).when(i == 1, bow).when(i == 2, spike).otherwise(nested), F.lit(")"))
    at = G.hold(G.hold(spread(b.select("id", wkt.alias("wkt"))), "g", G.from_wkt(F.col("wkt"))), "r", O.repaired(_n("g")))
    return rounded(at.select("id", F.col("r.was_invalid").alias("was_invalid"), G.area(F.col("r.geom")).alias("area"), _parts(F.col("r.geom")).alias("parts")), 3)


ALL = [boundary_buffers, shape_buffers, single_shapes, overlay_pieces, overlay_rest, ring_repair]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


SHP = "shp AS (SELECT p_partkey AS id, p_partkey % 4 AS k, (20 + p_size % 16)::DOUBLE AS w, (40 + p_partkey % 7)::DOUBLE AS d, (20 * (p_partkey % 50))::DOUBLE AS x, (20 * (p_partkey // 50))::DOUBLE AS y FROM part)"
#: Rectangles whose signed areas make up each straight shape.
BOXES = f"""{SHP}, box AS (
  SELECT id, 1 AS s, x AS x0, y AS y0, x + w AS x1, y + d AS y1 FROM shp WHERE k IN (0, 2, 3)
  UNION ALL SELECT id, 1, x, y, x + w, y + d / 2 FROM shp WHERE k = 1
  UNION ALL SELECT id, 1, x, y + d / 2, x + w / 2, y + d FROM shp WHERE k = 1
  UNION ALL SELECT id, -1, x + 2, y + 3, x + 7, y + 9 FROM shp WHERE k = 2
  UNION ALL SELECT id, 1, x + 60, y, x + 60 + w, y + w FROM shp WHERE k = 3)"""
_CUT = """o AS (SELECT b.id, lu.id AS other, class, s, greatest(0, least(b.x1, lu.x0 + 100) - greatest(b.x0, lu.x0)) * greatest(0, least(b.y1, lu.y0 + 100) - greatest(b.y0, lu.y0)) AS a FROM box b
  JOIN lu ON b.x0 < lu.x0 + 100 AND lu.x0 < b.x1 AND b.y0 < lu.y0 + 100 AND lu.y0 < b.y1),
  pc AS (SELECT o.id, other, class, sum(s * a) AS area, max(shp.k) AS k, count(*) AS boxes FROM o JOIN shp ON shp.id = o.id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    from .queries import LU, TRACT

    grown = lambda r: f"CASE k WHEN 0 THEN w * d + 2 * (w + d) * {r} + {DISC} * {r * r} WHEN 1 THEN 0.75 * w * d + 2 * (w + d) * {r} + 1.25 * {DISC} * {r * r} - {r * r} WHEN 2 THEN w * d + 2 * (w + d) * {r} + {DISC} * {r * r} - (5 - {2 * r}) * (6 - {2 * r}) ELSE w * d + 2 * (w + d) * {r} + w * w + 4 * w * {r} + 2 * {DISC} * {r * r} END"
    shrunk = f"CASE k WHEN 0 THEN (w - 2) * (d - 2) WHEN 1 THEN 0.75 * w * d - 2 * (w + d) + 5 - {DISC} / 4 WHEN 2 THEN (w - 2) * (d - 2) - (30 + 22 + {DISC}) ELSE (w - 2) * (d - 2) + (w - 2) * (w - 2) END"
    one = 0.01
    big = f"CASE k WHEN 3 THEN w * d + 2 * (w + d) * {one} + {DISC} * {one * one} ELSE {grown(one)} END"
    return {
        "boundary_buffers": f"WITH {TRACT} SELECT 'C' AS country, region::VARCHAR AS region, id::VARCHAR AS city, 40000.0::DOUBLE AS area, round(40000 + 800 * 500 + {DISC} * 500 * 500, 2) AS area_500m, round(40000 + 800 * 2000 + {DISC} * 2000 * 2000, 2) AS area_2k, 'C/' || region || '/' || id AS path FROM tract",
        "shape_buffers": f"WITH {SHP} SELECT id, round({grown(2)}, 3) AS grown, CASE WHEN k IN (2, 3) THEN 2 ELSE 1 END::BIGINT AS grown_rings, round({shrunk}, 3) AS shrunk, CASE WHEN k = 3 THEN 2 ELSE 1 END::BIGINT AS shrunk_parts FROM shp",
        "single_shapes": f"WITH {SHP} SELECT id, round({big}, 3) AS area, 1::BIGINT AS parts, (SELECT count(*) FROM shp WHERE k = 3)::BIGINT AS multi_before FROM shp",
        "overlay_pieces": f"WITH {BOXES}, {LU}, {_CUT} SELECT id, other, class, round(area, 3) AS area, CASE WHEN k = 3 THEN boxes ELSE 1 END::BIGINT AS parts FROM pc WHERE area > 1e-6",
        "overlay_rest": f"WITH {BOXES}, {LU}, {_CUT}, f AS (SELECT id, min(other) AS other, min_by(area, other) AS inside FROM pc WHERE area > 1e-6 GROUP BY id) SELECT id, other, round(inside, 3) AS inside, round((SELECT sum(s * (x1 - x0) * (y1 - y0)) FROM box WHERE box.id = f.id) - inside, 3) AS outside FROM f",
        "ring_repair": "WITH b AS (SELECT p_partkey AS id, (5 + p_size % 16)::DOUBLE AS w, (5 + (p_partkey * 7) % 16)::DOUBLE AS d FROM part) SELECT id, id % 4 <> 0 AS was_invalid, round(CASE id % 4 WHEN 1 THEN w * d / 2 WHEN 3 THEN w * d - (w - 2) * (d - 2) + 1 ELSE w * d END, 3) AS area, CASE WHEN id % 4 IN (1, 3) THEN 2 ELSE 1 END::BIGINT AS parts FROM b",
    }
