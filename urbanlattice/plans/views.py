"""The driver's tables as geometry: deterministic whole-number layouts that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import spread


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that geometries are made of: dealt out while its rows are small, however few splits its file has."""
    return spread(_t(spark, sf_dir, name))


def buildings(spark, sf_dir) -> DataFrame:
    """Rectangles on a 20 m lattice: id, x0, y0, w, d, geom."""
    i = F.col("p_partkey")
    at = _dealt(spark, sf_dir, "part").select(i.alias("id"), (20 * (i % 50)).cast("double").alias("x0"), (20 * F.floor(i / 50)).cast("double").alias("y0"), (5 + F.col("p_size") % 16).cast("double").alias("w"), (5 + (i * 7) % 16).cast("double").alias("d"))
    return at.withColumn("geom", G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d")))


def measured_buildings(spark, sf_dir) -> DataFrame:
    from ..operators.buildings import building_level

    return building_level(buildings(spark, sf_dir).select("id", "geom")).select("id", "geom", F.col("FootprintArea").alias("footprint_area"), F.col("Elongation").alias("elongation"), F.col("Convexity").alias("convexity"), F.col("Orientation").alias("orientation"))


def streets(spark, sf_dir) -> DataFrame:
    """Axis-parallel segments of all orders: id, osmid, length, width, width_deviation, geom."""
    i = F.col("o_orderkey")
    at = _dealt(spark, sf_dir, "orders").select(i.alias("id"), ((F.col("o_custkey") * 13) % 1000).cast("double").alias("x"), F.floor(i * 8 / 150).cast("double").alias("y"), (10 + i % 90).cast("double").alias("length"), (F.col("o_totalprice") / 1e4).alias("width"), ((i / 10).cast("long") % 2 == 0).alias("flat"))
    g = G.segment(F.col("x"), F.col("y"), F.col("x") + F.when(F.col("flat"), F.col("length")).otherwise(0.0), F.col("y") + F.when(F.col("flat"), 0.0).otherwise(F.col("length")))
    return at.select("id", F.col("id").alias("osmid"), "length", "width", F.col("width").alias("width_deviation"), g.alias("geom"))


def land_use(spark, sf_dir) -> DataFrame:
    """100 m tiles: id, class, x0, y0, geom."""
    i = F.col("s_suppkey")
    at = _t(spark, sf_dir, "supplier").select(i.alias("id"), (F.col("s_nationkey") % 10).cast("string").alias("class"), (100 * (i % 10)).cast("double").alias("x0"), (100 * F.floor(i / 10)).cast("double").alias("y0"))
    return at.withColumn("geom", G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + 100, F.col("y0") + 100))


def points(spark, sf_dir) -> DataFrame:
    e = _dealt(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("user_id") * 37) % 1000).cast("double").alias("x"), F.floor(F.col("event_id") * 8 / 100).cast("double").alias("y"), "event_type", "ts")
    return e.withColumn("geom", G.point(F.col("x"), F.col("y")))


def tracts(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    at = _t(spark, sf_dir, "nation").select(n.cast("long").alias("id"), F.col("n_regionkey").alias("region"), (200 * (n % 5)).cast("double").alias("x0"), (200 * F.floor(n / 5)).cast("double").alias("y0"))
    return at.withColumn("geom", G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + 200, F.col("y0") + 200))


def jobs(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    at = _dealt(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 17) % 1000).cast("double").alias("y"), F.floor(F.abs("c_acctbal") / 100).cast("double").alias("num_jobs"))
    return at.withColumn("geom", G.point(F.col("x"), F.col("y")))


def edges(spark, sf_dir) -> DataFrame:
    """Directed edges of all line items: u, v, least length."""
    n = _t(spark, sf_dir, "supplier").count()
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % n).alias("v"), F.col("l_quantity").cast("double").alias("length")).groupBy("u", "v").agg(F.min("length").alias("length"))


def nodes(spark, sf_dir) -> DataFrame:
    """Places of the graph's nodes: osmid, x, y."""
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(k.alias("osmid"), ((k * 53) % 1000).cast("double").alias("x"), ((k * 29) % 1000).cast("double").alias("y"))


def labelled_land_use(spark, sf_dir) -> DataFrame:
    """The tiles with a label of the land cover map each: id, label, geom."""
    from ..operators.land_use import TYPOLOGIES

    labels = F.array(*[F.lit(x) for xs in TYPOLOGIES.values() for x in xs])
    i = F.col("s_suppkey")
    at = _t(spark, sf_dir, "supplier").select(i.alias("id"), F.get(labels, (i % F.size(labels)).cast("int")).alias("label"), (100 * (i % 10)).cast("double").alias("x0"), (100 * F.floor(i / 10)).cast("double").alias("y0"))
    return at.select("id", "label", G.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + 100, F.col("y0") + 100).alias("geom"))


def shapes(spark, sf_dir, straight: bool = False) -> DataFrame:
    """By id modulo 4: rectangles turned by the angle of a 3-4-5 triangle, L-shapes, rectangles with a hole, and pairs of
    rectangles as one multi-polygon: id, wkt. Sides are w = 20 + p_size % 16 and d = 40 + id % 7. ``straight``: the first aren't turned."""
    i = F.col("id")
    at = _dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (20 + F.col("p_size") % 16).cast("double").alias("w"), (40 + F.col("p_partkey") % 7).cast("double").alias("d"))
    x, y, w, d = (20 * (i % 50)).cast("double"), (20 * F.floor(i / 50)).cast("double"), F.col("w"), F.col("d")
    ring = lambda *ps: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in (*ps, ps[0])]), F.lit(")"))
    box = lambda x0, y0, x1, y1: ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    turned = box(x, y, x + w, y + d) if straight else ring((x, y), (x + 0.6 * w, y + 0.8 * w), (x + 0.6 * w - 0.8 * d, y + 0.8 * w + 0.6 * d), (x - 0.8 * d, y + 0.6 * d))
    ell = ring((x, y), (x + w, y), (x + w, y + d / 2), (x + w / 2, y + d / 2), (x + w / 2, y + d), (x, y + d))
    holed = F.concat_ws(", ", box(x, y, x + w, y + d), box(x + 2, y + 3, x + 7, y + 9))
    two = F.concat(F.lit("(("), box(x, y, x + w, y + d), F.lit("), ("), box(x + 60, y, x + 60 + w, y + w), F.lit("))"))
    poly = lambda body: F.concat(F.lit("POLYGON ("), body, F.lit(")"))
    return at.select("id", F.when(i % 4 == 0, poly(turned)).when(i % 4 == 1, poly(ell)).when(i % 4 == 2, poly(holed)).otherwise(F.concat(F.lit("MULTIPOLYGON "), two)).alias("wkt"))
