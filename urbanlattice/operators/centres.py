"""Distances to city centres: straight, to the nearest of several, and along the road network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut
from .graph import shortest_paths
from .spatial_join import is_box, nearest, spatial_join, with_distance


def _points(df: DataFrame) -> DataFrame:
    """(id, x, y) of the rows' centroids."""
    at = G.hold(df.select("id", "geom"), "_c", G.centroid(F.col("geom")))
    return at.select("id", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))


def distance_cbd(df: DataFrame, centre: DataFrame) -> DataFrame:
    """feature_distance_cbd: the straight distance of each geometry to the centre (geom; the one of least id)."""
    one = centre.orderBy("id").select(G.as_wkt(F.col("geom"))).first()
    if one is None:
        raise ValueError("no centre to measure the distance to")
    at = G.hold(G.hold(df.withColumn("_to", G.from_wkt(F.lit(one[0]))), "_le", G.envelope(F.col("geom"))), "_re", G.envelope(F.col("_to")))
    at = at.withColumn("_lb", is_box(F.col("geom"), F.col("_le"))).withColumn("_rb", is_box(F.col("_to"), F.col("_re")))
    return with_distance(at, "geom", "_to").select(*df.columns, F.col("distance").alias("feature_distance_cbd"))


def distance_local_cbd(df: DataFrame, centres: DataFrame, size: float = 1000.0) -> DataFrame:
    """feature_distance_local_cbd: the straight distance of each centroid to the nearest centre, and that centre's id."""
    got = nearest(_points(df), _points(centres).withColumnRenamed("id", "centre"), "id", "centre", size)
    return df.join(got.select("id", "centre", F.col("distance").alias("feature_distance_local_cbd")), "id", "left")


def network_distance(df: DataFrame, centres: DataFrame, nodes: DataFrame, edges: DataFrame, name: str, size: float = 500.0) -> DataFrame:
    """(id, ``name``): length of the shortest directed path from each row (id, geom) to its centre, over ``edges`` (u, v, length).

    Rows and centres are snapped to the nearest of ``nodes`` (osmid, x, y), whose distances count too. With one centre, rows
    without a path get the straight distance; with several, each row goes to the nearest one and rows without a path get
    null. Polygons that meet a centre get 0. No centre raises ValueError. One row a centre comes to the driver in neither
    case: paths from all centres are one table, found over the reversed edges."""
    n = centres.count()
    if not n:
        raise ValueError("no centre to measure the distance to")
    at, places = cut(_points(df)), cut(_points(centres).withColumnRenamed("id", "centre"))
    own = nearest(at, places, "id", "centre", size).withColumnRenamed("distance", "straight")
    start = nearest(at, nodes, "id", "osmid", size).select("id", F.col("osmid").alias("_from"), F.col("distance").alias("_before"))
    end = cut(nearest(places, nodes, "centre", "osmid", size).select(F.col("centre").alias("_centre"), F.col("osmid").alias("_to"), F.col("distance").alias("_after")))
    paths = shortest_paths(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"), end.select(F.col("_centre").alias("source"), F.col("_to").alias("node")))
    row = own.join(start, "id", "left").join(end, F.col("centre") == F.col("_centre"), "left")
    row = row.join(paths.select("source", "node", F.col("distance").alias("_path")), (F.col("_centre") == F.col("source")) & (F.col("_from") == F.col("node")), "left")
    length = F.col("_path") + F.col("_before") + F.col("_after")
    if n == 1:
        length = F.coalesce(length, F.col("straight"))
    areas = df.where(F.col("geom.kind").isin(3, 6)).select("id", F.col("geom").alias("_g"))
    on = spatial_join(areas, centres.select(F.col("geom").alias("_h")), "_g", "_h", "intersects", size).select(F.col("id").alias("_on")).distinct()
    got = row.select("id", length.alias("_l")).join(on, F.col("id") == F.col("_on"), "left")
    got = got.select(F.col("id").alias("_id"), F.when(F.col("_on").isNotNull(), F.lit(0.0)).otherwise(F.col("_l")).alias(name))
    return df.select("id").join(got, F.col("id") == F.col("_id"), "left").select("id", name)
