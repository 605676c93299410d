"""Land use: the class map, the class at an object, class areas around it and in hexagons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .buildings import disc
from .city import land_use_in_window
from .spatial_join import convex_overlap_area, largest_overlap, overlaps, spatial_join

#: The classes of the European urban land cover map by name, and the class they count as.
TYPOLOGIES = {
    "lu_urban_fabric": (
        "Continuous urban fabric (S.L. : > 80%)",
        "Discontinuous dense urban fabric (S.L. : 50% -  80%)",
        "Discontinuous medium density urban fabric (S.L. : 30% - 50%)",
        "Discontinuous low density urban fabric (S.L. : 10% - 30%)",
        "Discontinuous very low density urban fabric (S.L. : < 10%)",
        "Isolated structures",
        "Sports and leisure facilities",
    ),
    "lu_industrial_commercial": ("Industrial, commercial, public, military and private units",),
    "lu_ports_airports": ("Port areas", "Airports"),
    "lu_roads": ("Fast transit roads and associated land", "Other roads and associated land"),
    "lu_railways": ("Railways and associated land",),
    "lu_other": ("Mineral extraction and dump sites", "Construction sites", "Land without current use", "No data (Missing imagery)"),
    "lu_urban_green": ("Green urban areas",),
    "lu_agricultural": (
        "Arable land (annual crops)",
        "Permanent crops (vineyards, fruit trees, olive groves)",
        "Pastures",
        "Complex and mixed cultivation patterns",
        "Orchads",
    ),
    "lu_natural": (
        "Forests",
        "Herbaceous vegetation associations (natural grassland, moors...)",
        "Open spaces with little or no vegetation (beaches, dunes, bare rocks, glaciers)",
        "Wetlands",
    ),
    "lu_water": ("Water",),
    "lu_ocean_country": ("ocean_other_country",),
}
ROADS = "lu_roads"


def mapped(column: Column, typologies: dict[str, tuple[str, ...]] = TYPOLOGIES) -> Column:
    """The class that a source label counts as; null for an unknown label."""
    pairs = [F.lit(x) for kind, labels in typologies.items() for label in labels for x in (label, kind)]
    return F.try_element_at(F.create_map(*pairs), column)


def one_hot(df: DataFrame, column: str, prefix: str, classes: list[str]) -> DataFrame:
    """id and a column of 0 and 1 for each class, whether it occurs or not."""
    return df.select("id", *[F.coalesce((F.col(column) == c).cast("long"), F.lit(0).cast("long")).alias(f"{prefix}_{c}") for c in classes])


def land_use_of_points(points: DataFrame, lu: DataFrame, buffer: float, size: float = 100.0) -> DataFrame:
    """(id, class) of the polygon (lid, class, lgeom) that holds each point (id, geom); of several, the one that covers most
    of the disc of ``buffer`` around it, then the least lid; null if none does."""
    pairs = spatial_join(points.select("id", F.col("geom").alias("_g")), lu.select("lid", "class", F.col("lgeom").alias("_h")), "_g", "_h", "intersects", size)
    at = G.hold(pairs, "_c", G.centroid(F.col("_g"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    # a point in one polygon alone asks no kernel
    at = G.hold(at, "_a", convex_overlap_area(G.only(F.col("_n") > 1, disc(F.col("_c"), buffer)), G.only(F.col("_n") > 1, F.col("_h"))))
    # equal shares of a symmetric disc must tie
    best = at.groupBy("id").agg(F.max(F.struct(F.round("_a", 6).alias("_a"), (-F.col("lid")).alias("_m"), "class")).alias("_b")).select("id", F.col("_b.class").alias("class"))
    return points.select("id").join(best, "id", "left")


def urban_atlas_features(df: DataFrame, lu: DataFrame, label: str, sizes=(100.0,), mode: str = "building", typologies: dict = TYPOLOGIES, cell: float = 100.0, area=None) -> DataFrame:
    """id; bld_in_* or point_in_* (``mode``: ``building`` by largest overlap, ``point`` by containment, or ``none``); and each
    class's area within square buffers, of which roads take what the others leave. ``lu``: id, geom and ``label``."""
    classes = sorted(typologies)
    known = lu.select(F.col("id").alias("lid"), F.col("geom").alias("lgeom"), mapped(F.col(label), typologies).alias("class"))
    # roads are the rest: their polygons, the largest of all, stay out of the windows
    rest = [c for c in classes if c != ROADS]
    got = land_use_in_window(df, known.where(F.col("class").isin(rest)).select("class", F.col("lgeom").alias("geom")), [c.removeprefix("lu_") for c in rest], sizes, area, "lu_") if sizes else df.select("id")
    if mode == "none":
        return got
    if mode == "building":
        at, prefix = largest_overlap(df, known, "id", "geom", "lid", "lgeom", "class", cell), "bld_in"
    elif mode == "point":
        at, prefix = land_use_of_points(df, known, max(sizes) if sizes else cell, cell), "point_in"
    else:
        raise ValueError(mode)
    return one_hot(at, "class", prefix, classes).join(got, "id")


def land_use_of_hexes(hexes: DataFrame, lu: DataFrame, classes: list[str], size: float = 500.0) -> DataFrame:
    """feature_ua_X: each class's area in each hexagon (id, geom), 0 where there's none; feature_ua_Roads: what they leave."""
    pairs = overlaps(hexes.select("id", F.col("geom").alias("_g")), lu.select("class", F.col("geom").alias("_h")), "_g", "_h", size)
    sums = pairs.groupBy("id").agg(*[F.sum(F.when(F.col("class") == c, F.col("_a"))).alias(f"feature_ua_{c}") for c in classes], F.sum("_a").alias("_all"))
    at = hexes.select("id", G.area(F.col("geom")).alias("_own")).join(sums, "id", "left")
    return at.select("id", *[F.coalesce(f"`feature_ua_{c}`", F.lit(0.0)).alias(f"feature_ua_{c}") for c in classes], (F.col("_own") - F.coalesce("_all", F.lit(0.0))).alias("feature_ua_Roads"))
