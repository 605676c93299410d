"""Registered queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blocks as K
from ..operators import buildings as B
from ..operators import centres as D
from ..operators import city as C
from ..operators import graph as N
from ..operators import land_use as L
from ..operators import streets as S
from ..operators.spatial_join import largest_overlap, nearest, spatial_join
from . import network, shapes
from . import views as V
from .queries_common import rounded as _rounded

CLASSES = [str(k) for k in range(10)]


def building_level(spark, sf_dir):
    return _rounded(B.building_level(V.buildings(spark, sf_dir).select("id", "geom")).drop("geom"))


def buildings_within_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(B.buildings_distance_based(V.buildings(spark, sf_dir), V.measured_buildings(spark, sf_dir), (100.0,), rectangles=True))


def buildings_within_50_kernel(spark, sf_dir):
    """By the general clipping kernel."""
    return _rounded(B.buildings_distance_based(V.buildings(spark, sf_dir), V.measured_buildings(spark, sf_dir), (50.0,)).select("id", "buildings_within_buffer_50", "total_ft_area_within_buffer_50"))


def buildings_round_buffer(spark, sf_dir):
    b = V.buildings(spark, sf_dir)
    return b.select("id").join(B.round_buffer_pairs(b, b, 40.0, True).groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def touching_buildings(spark, sf_dir):
    return _rounded(B.touches(V.buildings(spark, sf_dir)))


def building_blocks(spark, sf_dir):
    return _rounded(N.block_level(V.buildings(spark, sf_dir).select("id", "geom"), measured=False).select("id", "BlockId", "BlockLength", "AvBlockFootprintArea", "StdBlockFootprintArea", "BlockTotalFootprintArea", "BlockPerimeter"))


def block_numbers(spark, sf_dir):
    """Blocks of touching buildings, numbered from 0 by their least building."""
    b = V.buildings(spark, sf_dir)
    comp = N.components(b.select("id"), N.adjacency(b))
    return comp.join(N.dense_numbers(comp, "component"), "component").select("id", F.col("number").alias("BlockNumber"))


def closest_street_by_boxes(spark, sf_dir):
    """The closest of the streets that the first of the boxes around each building meets."""
    from ..operators.spatial_join import closest_object

    return _rounded(closest_object(V.buildings(spark, sf_dir), V.streets(spark, sf_dir), mode="reference"))


def block_totals(spark, sf_dir):
    b = V.buildings(spark, sf_dir)
    comp = N.components(b.select("id"), N.adjacency(b))
    n = comp.groupBy("component").agg(F.count(F.lit(1)).alias("BlockLength"))
    return C.block_totals(n.withColumnRenamed("component", "BlockId"))


def city_buildings(spark, sf_dir):
    return _rounded(C.totals(V.buildings(spark, sf_dir).select(G.area(F.col("geom")).alias("area")), "area", "buildings"))


def city_streets(spark, sf_dir):
    return _rounded(C.totals(V.streets(spark, sf_dir).select(G.length(F.col("geom")).alias("length")), "length", "streets"))


def streets_within_100(spark, sf_dir):
    return _rounded(S.streets_distance_based(V.buildings(spark, sf_dir), V.streets(spark, sf_dir)))


def intersections_within_100(spark, sf_dir):
    return S.intersection_count(V.buildings(spark, sf_dir), V.points(spark, sf_dir).select("id", "geom"))


def land_use_of_buildings(spark, sf_dir):
    return largest_overlap(V.buildings(spark, sf_dir), V.land_use(spark, sf_dir).withColumnRenamed("id", "lid").withColumnRenamed("geom", "lgeom").select("lid", "class", "lgeom"), "id", "geom", "lid", "lgeom", "class", 100.0)


def land_use_within_100(spark, sf_dir):
    return _rounded(C.land_use_in_window(V.buildings(spark, sf_dir), V.land_use(spark, sf_dir).select("class", "geom"), CLASSES, (100.0,), area=lambda w: B.clipped_rectangle_area(F.col("r_env"), w)))


def land_use_shares(spark, sf_dir):
    return _rounded(C.class_shares(V.land_use(spark, sf_dir).select("class", G.area(F.col("geom")).alias("area")), CLASSES, F.lit(1e6)))


def areal_interpolation(spark, sf_dir):
    t = V.tracts(spark, sf_dir)
    data = V.land_use(spark, sf_dir).select(F.col("id").alias("did"), "geom", F.col("class").cast("double").alias("v"))
    return _rounded(C.interpolated(t, data, "v", {"weighted": "weighted", "total": "total", "total_per_area": "per_km2"}, 200.0))


def land_use_entropy(spark, sf_dir):
    n = V._t(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(C.entropy(n, "source", "lang", "n").join(C.entropy(n, "source", "lang", "n", True), "source"), 6)


def employment_access(spark, sf_dir):
    """Tract centres by jobs (25 tracts, all customers)."""
    t = V.tracts(spark, sf_dir).select("id", (F.col("x0") + 100).alias("x"), (F.col("y0") + 100).alias("y"))
    return _rounded(C.employment_access(t, V.jobs(spark, sf_dir).where("num_jobs > 0").select(F.col("id").alias("other"), "x", "y", "num_jobs"), 500.0))


def nearest_job(spark, sf_dir):
    at = V.buildings(spark, sf_dir).select("id", (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("d") / 2).alias("y"))
    return _rounded(nearest(at, V.jobs(spark, sf_dir).select(F.col("id").alias("job"), "x", "y"), "id", "job", 50.0))


def closest_street(spark, sf_dir):
    """The closest of all streets for every building, and what is known of it."""
    return _rounded(S.closest_street_features(V.buildings(spark, sf_dir), V.streets(spark, sf_dir), 10.0))


def points_in_tracts(spark, sf_dir):
    a = V.points(spark, sf_dir).select(F.col("id").alias("pid"), F.col("geom").alias("_g"), "event_type")
    t = V.tracts(spark, sf_dir).select("id", F.col("geom").alias("_h"))
    return spatial_join(a, t, "_g", "_h", "intersects", 200.0).groupBy("id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def hex_population(spark, sf_dir):
    t = V._t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hex_id"))
    data = V._t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return _rounded(C.keyed_feature(t, data.select(F.col("o_custkey").alias("hex_id"), "v"), "hex_id", "v", "feature_pop_density", 0.0), 2)


def road_distance(spark, sf_dir):
    src = spark.createDataFrame([(1, 1)], "source bigint, node bigint")
    return N.shortest_paths(V.edges(spark, sf_dir), src).select("node", "distance")


def street_components(spark, sf_dir):
    e = V.edges(spark, sf_dir)
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    return N.components(nodes, e.select(F.col("u").alias("a"), F.col("v").alias("b")))


def streets_without_duplicates(spark, sf_dir):
    return _rounded(S.without_duplicates(V.streets(spark, sf_dir)).select("id", "length"))


def pizza_split(spark, sf_dir):
    e = V._t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return C.pizza_split(e)


def wkt_round_trip(spark, sf_dir):
    b = V.buildings(spark, sf_dir).select("id", G.as_wkt(F.col("geom")).alias("wkt"))
    b, g = G.hold(b, "g", G.from_wkt(F.col("wkt"))), F.col("g")
    return _rounded(b.select("id", G.area(g).alias("area"), G.length(g).alias("perimeter"), G.centroid(g)["x"].alias("cx"), G.centroid(g)["y"].alias("cy")))


def tract_dissolve(spark, sf_dir):
    """Regions as the union of their tracts: area, outline, parts and the first tract."""
    t = V.tracts(spark, sf_dir)
    g = F.col("geom")
    shape = N.dissolve(t.select("region", "geom"), "region", 300.0).select("region", G.area(g).alias("area"), G.length(g).alias("perimeter"), F.size("geom.parts").alias("n_parts"))
    return _rounded(shape.join(t.groupBy("region").agg(F.min("id").alias("first_id")), "region"))


def _nodes(spark, sf_dir):
    return V.points(spark, sf_dir).select("id", "geom", (F.col("id") % 5).alias("street_count"))


def beta_index(spark, sf_dir):
    return _rounded(S.beta_index(V.tracts(spark, sf_dir), _nodes(spark, sf_dir), 200.0))


def intersections_per_area(spark, sf_dir):
    return _rounded(S.intersections_per_area(V.tracts(spark, sf_dir), _nodes(spark, sf_dir), "intersections_per_km2", 200.0))


def own_street_block(spark, sf_dir):
    blocks = V.land_use(spark, sf_dir).select("id", "geom", F.lit(1e4).alias("area"), (F.col("id") % 7).alias("phi"), F.lit(4).alias("corners"))
    return _rounded(S.own_street_block(V.buildings(spark, sf_dir), blocks, 100.0))


def street_pieces(spark, sf_dir):
    """Pieces of each street after it's cut at all crossings, and their total length."""
    cut = S.split_crossing(V.streets(spark, sf_dir), 100.0)
    return _rounded(cut.groupBy("street").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(G.length(F.col("geom"))).alias("length")))


def social_index(spark, sf_dir):
    n = V._t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("hex_id"), F.col("n_regionkey").cast("double").alias("status_index"), F.get(F.array(*map(F.lit, ("+", "+/-", "-"))), F.col("n_nationkey") % 4).alias("dynamic_index"))
    return C.social_index(V._t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 30).alias("hex_id")), n)


def part_with_buffer(spark, sf_dir):
    box = lambda x0, y0, x1, y1: spark.range(1).select(G.rectangle(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)).alias("geom"))
    return C.part_with_buffer(V.points(spark, sf_dir), box(200.0, 10.0, 600.0, 400.0), box(150.0, 0.0, 650.0, 450.0), 100.0).select("id", "buffer_part")


def table_difference(spark, sf_dir):
    old = V._t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    new = old.select("c_custkey", F.when(k % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return C.changed_cells(old, new, "c_custkey")


def first_event_of_user(spark, sf_dir):
    return C.kept_first(V._t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def building_block_shapes(spark, sf_dir):
    """All measures of each building's block."""
    return _rounded(N.block_level(V.buildings(spark, sf_dir).select("id", "geom")).drop("TouchesIndexes"))


def blocks_in_window(spark, sf_dir):
    """Blocks within 50 and 100 m; their orientation is 0 as all walls follow the axes."""
    b = V.buildings(spark, sf_dir).select("id", "geom")
    at = b.join(N.block_level(b), "id")
    return _rounded(K.blocks_distance_based(b, at, (50.0, 100.0)), 6)


def buildings_round_area(spark, sf_dir):
    """Number, clipped area and means in round buffers of 25 and 40 m, own copies left out."""
    b = V.buildings(spark, sf_dir).select("id", "geom", G.area(F.col("geom")).alias("footprint_area"))
    return _rounded(B.buildings_distance_based(b, b, (25.0, 40.0), mode="round", same=True, means=("footprint_area",), deviations=("footprint_area",)))


def shape_measures(spark, sf_dir):
    """Measures of turned, concave, holed and multi-part shapes that have a closed form, from their WKT."""
    g = F.col("geom")
    at = B.building_level(V.shapes(spark, sf_dir).select("id", G.from_wkt(F.col("wkt")).alias("geom")))
    at = G.hold(at, "_c", G.centroid(g))
    one = F.col("id") % 4
    return _rounded(at.select("id", "FootprintArea", "Perimeter", F.when(one < 2, F.col("Corners")).otherwise(F.col("Corners")).alias("Corners"), F.when(one != 3, F.col("Convexity")).alias("Convexity"), F.when(one == 0, F.col("Elongation")).alias("Elongation"), F.when(one == 0, F.col("Orientation")).alias("Orientation"), F.when(one != 3, F.col("LongestAxisLength")).alias("LongestAxisLength"), F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy")))


def _centre(spark):
    return spark.range(1).select("id", G.point(F.lit(510.0), F.lit(330.0)).alias("geom"))


def _centres(spark, sf_dir):
    k = F.col("r_regionkey").cast("long")
    return V._t(spark, sf_dir, "region").select(k.alias("id"), G.point(200.0 * k + 50, 150.0 * k + 35).alias("geom"))


def distance_to_centre(spark, sf_dir):
    return _rounded(D.distance_cbd(V.buildings(spark, sf_dir).select("id", "geom"), _centre(spark)).select("id", "feature_distance_cbd"))


def distance_to_local_centre(spark, sf_dir):
    return _rounded(D.distance_local_cbd(V.buildings(spark, sf_dir).select("id", "geom"), _centres(spark, sf_dir)).select("id", "centre", "feature_distance_local_cbd"))


def network_distance_to_centre(spark, sf_dir):
    return _rounded(D.network_distance(V.tracts(spark, sf_dir).select("id", "geom"), _centre(spark), V.nodes(spark, sf_dir), V.edges(spark, sf_dir), "distance", 100.0))


def network_distance_to_local_centres(spark, sf_dir):
    return _rounded(D.network_distance(V.tracts(spark, sf_dir).select("id", "geom"), _centres(spark, sf_dir), V.nodes(spark, sf_dir), V.edges(spark, sf_dir), "distance", 100.0))


def urban_atlas_of_buildings(spark, sf_dir):
    return _rounded(L.urban_atlas_features(V.buildings(spark, sf_dir), V.labelled_land_use(spark, sf_dir), "label", (50.0, 100.0)))


def urban_atlas_of_points(spark, sf_dir):
    return L.urban_atlas_features(V.points(spark, sf_dir).select("id", "geom"), V.labelled_land_use(spark, sf_dir), "label", (), "point")


def land_use_of_hexes(spark, sf_dir):
    return _rounded(L.land_use_of_hexes(V.tracts(spark, sf_dir), V.land_use(spark, sf_dir), CLASSES, 200.0))


def trips_per_capita(spark, sf_dir):
    trips = V._t(spark, sf_dir, "events").select((F.col("user_id") % 25).cast("long").alias("id_origin"))
    people = V.land_use(spark, sf_dir).select(F.col("id").alias("did"), "geom", (1.0 + F.col("id") % 13).alias("pop"))
    return _rounded(C.trips_per_capita(V.tracts(spark, sf_dir), people, trips, "pop", "trips_per_capita", 200.0))


def tract_employment_access(spark, sf_dir):
    jobs = V.land_use(spark, sf_dir).select(F.col("id").alias("did"), "geom", (1.0 + F.col("id") % 13).alias("n"))
    return _rounded(C.tract_employment_access(V.tracts(spark, sf_dir), jobs, "n", 0.1, 200.0))


def class_counts_of_tracts(spark, sf_dir):
    return C.class_counts(V.tracts(spark, sf_dir), V.points(spark, sf_dir).select("geom", "event_type"), "event_type", 200.0)


def jobs_near_tracts(spark, sf_dir):
    """Jobs, spread over twice the tracts' extent, within 60 m of any tract."""
    j = V.jobs(spark, sf_dir).select(F.col("id").alias("other"), "num_jobs", G.point(2 * F.col("x"), 2 * F.col("y")).alias("geom"))
    return C.jobs_near(V.tracts(spark, sf_dir), j, 60.0).select("other", "num_jobs")


def area_plus_buffer(spark, sf_dir):
    box = spark.range(1).select(G.rectangle(F.lit(200.0), F.lit(10.0), F.lit(600.0), F.lit(400.0)).alias("geom"))
    return C.area_plus_buffer(V.buildings(spark, sf_dir).select("id", "geom"), box, 50.0, 100.0).select("id", "is_buffer")


def away_from_boundary(spark, sf_dir):
    box = spark.range(1).select(G.rectangle(F.lit(200.0), F.lit(10.0), F.lit(600.0), F.lit(400.0)).alias("geom"))
    return C.away_from_boundary(V.points(spark, sf_dir).select("id", "geom"), box, 20.0, 100.0).select("id")


def city_level(spark, sf_dir):
    """Whole-city figures in one row: area, network length, streets, intersections, street blocks."""
    t = V.tracts(spark, sf_dir).where("id = 0").select("geom")
    area = C.area_km2(V.tracts(spark, sf_dir), "area_km2").agg(F.first("area_km2").alias("area_km2"))
    network = C.network_length_km(t, V.edges(spark, sf_dir), "network_km").select("network_km")
    blocks = V.land_use(spark, sf_dir).select(F.lit(1e4).alias("area"))
    parts = [area, network, C.city_streets(V.streets(spark, sf_dir)), C.city_intersections(V.points(spark, sf_dir)), C.city_street_blocks(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return _rounded(out)


def _shared(spark, name):
    from ..session import shared_path

    return shared_path(spark, name)


def csv_round_trip(spark, sf_dir):
    """Buildings written as CSV with WKT and read again."""
    from ..sources import tables as T

    at = _shared(spark, "csv")
    T.write_csv_wkt(V.buildings(spark, sf_dir).select("id", "geom"), at)
    got = G.hold(T.read_csv_wkt(spark, at, "id bigint, geometry string"), "g", F.col("geom"))
    return _rounded(got.select("id", G.area(F.col("g")).alias("area"), G.length(F.col("g")).alias("perimeter")))


def trips_round_trip(spark, sf_dir):
    """Events written as trips and read again as origins and destinations."""
    from ..sources import tables as T

    at = _shared(spark, "trips")
    e = V.points(spark, sf_dir)
    e.select(F.col("id").alias("tripid"), F.lit(1.5).alias("tripdistancemeters"), F.lit(2.5).alias("lengthoftrip"), F.lit("a").alias("startdate"), F.lit("b").alias("enddate"), F.col("y").alias("startloclat"), F.col("x").alias("startloclon"), (F.col("y") + 1).alias("endloclat"), (F.col("x") + 2).alias("endloclon"), F.col("event_type").alias("providertype")).write.csv(at, header=True)
    one, two = T.read_trips(spark, at)
    c = lambda t, k: t.select(F.col("tripid").cast("long").alias("id"), "providertype", F.lit(k).alias("end"), G.centroid(F.col("geom"))["x"].alias("x"), G.centroid(F.col("geom"))["y"].alias("y"))
    return c(one, "origin").unionByName(c(two, "destination"))


def gml_buildings(spark, sf_dir):
    """Building models written as GML text and read again: heights, footprint, roof."""
    from ..sources import gml as M

    b = V.buildings(spark, sf_dir)
    x0, y0, x1, y1, z = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("d"), F.col("w") + 2
    ring = lambda *ps: F.concat_ws(" ", *[v.cast("string") for p in (*ps, ps[0]) for v in p])
    surface = lambda tag, ps: F.concat(F.lit(f"<bldg:{tag}><gml:posList>"), ps, F.lit(f"</gml:posList></bldg:{tag}>"))
    low, slope = F.lit(1.0), F.when(F.col("id") % 2 == 0, z).otherwise(z + 1)
    text = F.concat(
        F.lit('<bldg:Building gml:id="b'), F.col("id").cast("string"), F.lit('"><gml:Envelope><gml:lowerCorner>0 0 1</gml:lowerCorner><gml:upperCorner>9 9 '), z.cast("string"),
        F.lit("</gml:upperCorner></gml:Envelope><bldg:measuredHeight>"), (z - 1).cast("string"), F.lit("</bldg:measuredHeight>"),
        surface("GroundSurface", ring((x0, y0, low), (x1, y0, low), (x1, y1, low), (x0, y1, low))),
        surface("WallSurface", ring((x0, y0, low), (x1, y0, low), (x1, y0, z), (x0, y0, z))),
        surface("RoofSurface", ring((x0, y0, z), (x1, y0, z), (x1, y1, slope), (x0, y1, slope))), F.lit("</bldg:Building>"),
    )
    at = _shared(spark, "gml")
    b.select(text.alias("value")).write.text(at)
    f, g = F.col("fragment"), F.col("g")
    got = M.elements(spark, at).select(F.regexp_extract(M.attribute(f, "gml:id"), r"\d+", 0).cast("long").alias("id"), M.wall_height(f).alias("height"), M.envelope_height(f).alias("height_bbox"), M.measured_height(f).alias("measured_height"), M.roof_over_wall(f).alias("roof_over_wall"), M.roof_type(f).alias("roof"), M.footprint(f).alias("g"))
    return _rounded(G.hold(got, "area", G.area(g)).drop("g"))


def street_faces(spark, sf_dir):
    """Street blocks of a lattice: the outlines of the land-use tiles, cut at all crossings, and the faces between them."""
    t = V.land_use(spark, sf_dir)
    side = lambda k, x0, y0, x1, y1: t.select((F.col("id") * 4 + k).alias("id"), G.segment(x0, y0, x1, y1).alias("geom"))
    x, y = F.col("x0"), F.col("y0")
    # lower and left sides, and those on the upper and right that no other tile has
    lines = side(0, x, y, x + 100, y).unionByName(side(1, x, y, x, y + 100)).unionByName(side(2, x, y + 100, x + 100, y + 100)).unionByName(side(3, x + 100, y, x + 100, y + 100))
    once = lines.groupBy("geom").agg(F.min("id").alias("id")).select("id", "geom")
    faces = S.street_blocks(once)
    got = G.hold(faces, "e", G.envelope(F.col("geom")))
    return _rounded(got.select(F.col("e.minx").alias("x0"), F.col("e.miny").alias("y0"), "area", "corners", "orientation"))


# names under which the whole-table forms were registered while others read a part
WHOLE = {"closest_street_all": closest_street, "city_streets_all": city_streets, "streets_within_100_all": streets_within_100, "street_pieces_all": street_pieces, "streets_without_duplicates_all": streets_without_duplicates, "road_distance_all": road_distance, "street_components_all": street_components}

_ALL = [
    building_level, buildings_within_100, buildings_within_50_kernel, buildings_round_buffer, touching_buildings, building_blocks, block_totals, city_buildings, city_streets, streets_within_100, intersections_within_100,
    land_use_of_buildings, land_use_within_100, land_use_shares, areal_interpolation, land_use_entropy, employment_access, nearest_job, closest_street, points_in_tracts, hex_population, road_distance, street_components,
    streets_without_duplicates, pizza_split, wkt_round_trip, tract_dissolve, beta_index, intersections_per_area, own_street_block, street_pieces, social_index, part_with_buffer, table_difference, first_event_of_user,
    building_block_shapes, blocks_in_window, buildings_round_area, shape_measures, distance_to_centre, distance_to_local_centre, network_distance_to_centre, network_distance_to_local_centres, urban_atlas_of_buildings,
    urban_atlas_of_points, land_use_of_hexes, trips_per_capita, tract_employment_access, class_counts_of_tracts, jobs_near_tracts, area_plus_buffer, away_from_boundary, city_level, csv_round_trip, trips_round_trip,
    gml_buildings, street_faces, block_numbers, closest_street_by_boxes,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | WHOLE | shapes.queries() | network.queries()


BLD = "bld AS (SELECT p_partkey AS id, (20 * (p_partkey % 50))::DOUBLE AS x0, (20 * (p_partkey // 50))::DOUBLE AS y0, (5 + p_size % 16)::DOUBLE AS w, (5 + (p_partkey * 7) % 16)::DOUBLE AS d FROM part), b2 AS (SELECT *, x0 + w AS x1, y0 + d AS y1, x0 + w / 2 AS cx, y0 + d / 2 AS cy, w * d AS area, least(w, d) / greatest(w, d) AS elo FROM bld)"
STR = "str AS (SELECT o_orderkey AS id, ((o_custkey * 13) % 1000)::DOUBLE AS x0, floor(o_orderkey * 8 / 150)::DOUBLE AS y0, (10 + o_orderkey % 90)::DOUBLE AS length, o_totalprice / 1e4 AS width, (o_orderkey // 10) % 2 = 0 AS flat FROM orders), s2 AS (SELECT *, x0 + CASE WHEN flat THEN length ELSE 0 END AS x1, y0 + CASE WHEN flat THEN 0 ELSE length END AS y1 FROM str)"
LU = "lu AS (SELECT s_suppkey AS id, (s_nationkey % 10)::VARCHAR AS class, (100 * (s_suppkey % 10))::DOUBLE AS x0, (100 * (s_suppkey // 10))::DOUBLE AS y0 FROM supplier)"
PT = "pt AS (SELECT event_id AS id, ((user_id * 37) % 1000)::DOUBLE AS x, floor(event_id * 8 / 100)::DOUBLE AS y, event_type FROM events)"
TRACT = "tract AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS region, (200 * (n_nationkey % 5))::DOUBLE AS x0, (200 * (n_nationkey // 5))::DOUBLE AS y0 FROM nation)"
JOBS = "jobs AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1000)::DOUBLE AS x, ((c_custkey * 17) % 1000)::DOUBLE AS y, floor(abs(c_acctbal) / 100)::DOUBLE AS num_jobs FROM customer)"
EDGES = "edge AS (SELECT l_suppkey AS u, l_partkey % (SELECT count(*) FROM supplier) AS v, min(l_quantity)::DOUBLE AS length FROM lineitem GROUP BY 1, 2)"


def _touch(extra: str = "") -> str:
    return f"nb AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) + greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS wall FROM b2 a JOIN b2 b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1){extra}"


def _near(size: int) -> str:
    return f"near AS (SELECT a.id AS aid, b.*, greatest(0, least(b.x1, a.cx + {size}) - greatest(b.x0, a.cx - {size})) * greatest(0, least(b.y1, a.cy + {size}) - greatest(b.y0, a.cy - {size})) AS part FROM b2 a JOIN b2 b ON b.x0 <= a.cx + {size} AND b.x1 >= a.cx - {size} AND b.y0 <= a.cy + {size} AND b.y1 >= a.cy - {size})"


COMP = "WITH RECURSIVE {bld}, {touch}, reach(id, r) AS (SELECT id, id FROM b2 UNION SELECT nb.b, reach.r FROM reach JOIN nb ON nb.a = reach.id), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


def oracle_sql() -> dict[str, str]:
    phi = 3.1365484905459389
    comp = COMP.format(bld=BLD, touch=_touch())
    lu_cols = ", ".join(f"round(coalesce(sum(a) FILTER (class = '{c}'), 0), 4) AS \"lu_{c}_within_buffer_100\"" for c in CLASSES)
    found = {
        "building_level": f"WITH {BLD} SELECT id, w * d AS \"FootprintArea\", 2 * (w + d) AS \"Perimeter\", round(area / ({phi} * (w * w + d * d) / 4), 4) AS \"Phi\", round(sqrt(w * w + d * d), 4) AS \"LongestAxisLength\", round(elo, 4) AS \"Elongation\", 1.0::DOUBLE AS \"Convexity\", 0.0::DOUBLE AS \"Orientation\", 4::BIGINT AS \"Corners\" FROM b2",
        "buildings_within_100": f"WITH {BLD}, {_near(100)} SELECT aid AS id, count(*)::DOUBLE AS buildings_within_buffer_100, round(sum(part), 4) AS total_ft_area_within_buffer_100, round(avg(area), 4) AS av_footprint_area_within_buffer_100, round(avg(elo), 4) AS av_elongation_within_buffer_100, 1.0::DOUBLE AS av_convexity_within_buffer_100, 0.0::DOUBLE AS av_orientation_within_buffer_100, round(coalesce(stddev_samp(area), 0), 4) AS std_footprint_area_within_buffer_100, round(coalesce(stddev_samp(elo), 0), 4) AS std_elongation_within_buffer_100, 0.0::DOUBLE AS std_convexity_within_buffer_100, 0.0::DOUBLE AS std_orientation_within_buffer_100 FROM near GROUP BY aid",
        "buildings_within_50_kernel": f"WITH {BLD}, {_near(50)} SELECT aid AS id, count(*)::DOUBLE AS buildings_within_buffer_50, round(sum(part), 4) AS total_ft_area_within_buffer_50 FROM near GROUP BY aid",
        "touching_buildings": f"WITH {BLD}, {_touch()} SELECT b2.id, count(nb.b) AS \"CountTouches\", coalesce(sum(wall), 0)::DOUBLE AS \"SharedWallLength\" FROM b2 LEFT JOIN nb ON nb.a = b2.id GROUP BY b2.id",
        "building_blocks": f"{comp} SELECT id, component AS \"BlockId\", count(*) OVER w AS \"BlockLength\", round(avg(area) OVER w, 4) AS \"AvBlockFootprintArea\", round(coalesce(stddev_samp(area) OVER w, 0), 4) AS \"StdBlockFootprintArea\", sum(area) OVER w AS \"BlockTotalFootprintArea\", sum(2 * (w + d) - coalesce(wall, 0)) OVER w AS \"BlockPerimeter\" FROM comp JOIN b2 USING (id) LEFT JOIN (SELECT a, sum(wall) AS wall FROM nb GROUP BY a) ON a = id WINDOW w AS (PARTITION BY component)",
        "block_numbers": f"{comp} SELECT id, (dense_rank() OVER (ORDER BY component) - 1)::BIGINT AS \"BlockNumber\" FROM comp",
        "closest_street_by_boxes": f"WITH {BLD}, {STR}, p AS (SELECT b.id, s.id AS other, greatest(1, ceil(greatest(s.x0 - cx, cx - s.x1, s.y0 - cy, cy - s.y1, 0) / 100)) AS k, sqrt(pow(greatest(0, s.x0 - b.x1, b.x0 - s.x1), 2) + pow(greatest(0, s.y0 - b.y1, b.y0 - s.y1), 2)) AS d FROM b2 b CROSS JOIN s2 s), m AS (SELECT id, min(struct_pack(k := k, d := d, o := other)) AS m FROM p GROUP BY id) SELECT id, m.o AS other, round(m.d, 4) AS distance FROM m",
        "block_totals": f"{comp}, n AS (SELECT component, count(*) AS k FROM comp GROUP BY component) SELECT sum((k = 1)::BIGINT)::BIGINT AS n_detached_buildings, sum((k BETWEEN 2 AND 4)::BIGINT)::BIGINT AS blocks_2_to_4, sum((k BETWEEN 5 AND 9)::BIGINT)::BIGINT AS blocks_5_to_9, sum((k BETWEEN 10 AND 19)::BIGINT)::BIGINT AS blocks_10_to_19, sum((k >= 20)::BIGINT)::BIGINT AS blocks_20_to_inf FROM n",
        "city_buildings": f"WITH {BLD} SELECT count(*) AS buildings_count, sum(area) AS total_buildings_area, round(avg(area), 4) AS av_buildings_area, round(stddev_samp(area), 4) AS std_buildings_area FROM b2",
        "city_streets": f"WITH {STR} SELECT count(*) AS streets_count, sum(length) AS total_streets_length, round(avg(length), 4) AS av_streets_length, round(stddev_samp(length), 4) AS std_streets_length FROM s2",
        "streets_within_100": f"WITH {BLD}, {STR}, near AS (SELECT b.id AS bid, s.*, greatest(0, least(s.x1, cx + 100) - greatest(s.x0, cx - 100)) + greatest(0, least(s.y1, cy + 100) - greatest(s.y0, cy - 100)) AS part FROM b2 b JOIN s2 s ON s.x0 <= cx + 100 AND s.x1 >= cx - 100 AND s.y0 <= cy + 100 AND s.y1 >= cy - 100) SELECT b2.id, round(coalesce(sum(part), 0), 4) AS street_length_total_within_buffer_100, round(coalesce(avg(length), 0), 4) AS street_length_av_within_buffer_100, round(coalesce(avg(width), 0), 4) AS street_width_av_within_buffer_100, round(coalesce(stddev_samp(length), 0), 4) AS street_length_std_within_buffer_100, round(coalesce(stddev_samp(width), 0), 4) AS street_width_deviation_std_within_buffer_100 FROM b2 LEFT JOIN near ON bid = b2.id GROUP BY b2.id",
        "intersections_within_100": f"WITH {BLD}, {PT} SELECT b2.id, count(pt.id)::DOUBLE AS intersection_count_within_100 FROM b2 LEFT JOIN pt ON x BETWEEN cx - 100 AND cx + 100 AND y BETWEEN cy - 100 AND cy + 100 GROUP BY b2.id",
        "land_use_of_buildings": f"WITH {BLD}, {LU}, o AS (SELECT b.id, l.id AS lid, class, greatest(0, least(b.x1, l.x0 + 100) - greatest(b.x0, l.x0)) * greatest(0, least(b.y1, l.y0 + 100) - greatest(b.y0, l.y0)) AS a FROM b2 b JOIN lu l ON b.x0 < l.x0 + 100 AND l.x0 < b.x1 AND b.y0 < l.y0 + 100 AND l.y0 < b.y1), r AS (SELECT id, class, row_number() OVER (PARTITION BY id ORDER BY a DESC, lid) AS n FROM o) SELECT b2.id, class FROM b2 LEFT JOIN r ON r.id = b2.id AND n = 1",
        "land_use_within_100": f"WITH {BLD}, {LU}, o AS (SELECT b.id, class, greatest(0, least(cx + 100, l.x0 + 100) - greatest(cx - 100, l.x0)) * greatest(0, least(cy + 100, l.y0 + 100) - greatest(cy - 100, l.y0)) AS a FROM b2 b JOIN lu l ON cx - 100 <= l.x0 + 100 AND l.x0 <= cx + 100 AND cy - 100 <= l.y0 + 100 AND l.y0 <= cy + 100) SELECT b2.id, {lu_cols}, round(40000 - coalesce(sum(a), 0), 4) AS lu_roads_within_buffer_100 FROM b2 LEFT JOIN o ON o.id = b2.id GROUP BY b2.id",
        "land_use_shares": f"WITH {LU} SELECT " + ", ".join(f"round(count(*) FILTER (class = '{c}') * 1e4 / 1e6, 4)::DOUBLE AS prop_{c}" for c in CLASSES) + " FROM lu",
        "areal_interpolation": f"WITH {TRACT}, {LU}, o AS (SELECT t.id, class::DOUBLE AS v, greatest(0, least(t.x0 + 200, l.x0 + 100) - greatest(t.x0, l.x0)) * greatest(0, least(t.y0 + 200, l.y0 + 100) - greatest(t.y0, l.y0)) AS a FROM tract t JOIN lu l ON t.x0 < l.x0 + 100 AND l.x0 < t.x0 + 200 AND t.y0 < l.y0 + 100 AND l.y0 < t.y0 + 200) SELECT tract.id, round(sum(v * a) / sum(a), 4) AS weighted, round(sum(v * a / 1e4), 4) AS total, round(sum(v * a / 1e4) / 4e4 * 1e6, 4) AS per_km2 FROM tract LEFT JOIN o USING (id) GROUP BY tract.id",
        "land_use_entropy": "WITH n AS (SELECT source, lang, count(*)::DOUBLE AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p, n / sum(n) OVER (PARTITION BY lang) AS q FROM n), r AS (SELECT *, q / sum(q) OVER (PARTITION BY source) AS z, (SELECT count(DISTINCT lang) FROM n) AS k FROM p) SELECT source, round(-sum(p * ln(p)) / ln(any_value(k)), 6) + 0 AS ft_lu_entropy_classic, round(-sum(z * ln(z)) / ln(any_value(k)), 6) + 0 AS ft_lu_entropy_normed FROM r GROUP BY source",
        "employment_access": f"WITH {TRACT}, {JOBS}, p AS (SELECT t.id, j.id AS other, sqrt((x - x0 - 100) * (x - x0 - 100) + (y - y0 - 100) * (y - y0 - 100)) AS dist, num_jobs AS n FROM tract t JOIN jobs j ON num_jobs > 0), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY id ORDER BY dist, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT id, round(sum(n * dist) / sum(n), 4) AS employment_access FROM c WHERE before < 500 GROUP BY id",
        "nearest_job": f"WITH {BLD}, {JOBS}, p AS (SELECT b.id, j.id AS job, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM b2 b CROSS JOIN jobs j), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, job) AS n FROM p) SELECT id, job, round(dist, 4) AS distance FROM r WHERE n = 1",
        "closest_street": f"WITH {BLD}, {STR}, p AS (SELECT b.id, s.id AS sid, s.length, s.width, sqrt(pow(greatest(0, s.x0 - b.x1, b.x0 - s.x1), 2) + pow(greatest(0, s.y0 - b.y1, b.y0 - s.y1), 2)) AS dist FROM b2 b CROSS JOIN s2 s), m AS (SELECT id, min(struct_pack(d := dist, s := sid, l := length, w := width)) AS m FROM p GROUP BY id) SELECT id, m.s AS closest_street, round(m.d, 4) AS distance_to_closest_street, m.l AS street_length_closest_street, round(m.w, 4) AS street_width_av_closest_street, round(m.w, 4) AS street_width_std_closest_street FROM m",
        "points_in_tracts": f"WITH {PT}, {TRACT} SELECT tract.id, event_type, count(*) AS n FROM pt JOIN tract ON x BETWEEN x0 AND x0 + 200 AND y BETWEEN y0 AND y0 + 200 GROUP BY 1, 2",
        "hex_population": "SELECT c_custkey AS hex_id, round(coalesce(sum(o_totalprice), 0), 2) AS feature_pop_density FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "street_components": f"WITH RECURSIVE {EDGES}, e AS (SELECT u AS a, v AS b FROM edge UNION SELECT v, u FROM edge), reach(id, r) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id) SELECT id, min(r) AS component FROM reach GROUP BY id",
        "pizza_split": "WITH e AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM e), t AS (SELECT id, n, acos(greatest(-1, least(1, -(x - mx) / sqrt((x - mx) * (x - mx) + (y - my) * (y - my))))) AS t FROM e, c), k AS (SELECT *, row_number() OVER (ORDER BY t) AS rn FROM t), cut AS (SELECT t AS v FROM k WHERE rn = (SELECT count(*) FROM k WHERE rn / n < 0.2) + 1) SELECT id, CASE WHEN t < v THEN 'test' ELSE 'train' END AS label FROM k, cut",
        "wkt_round_trip": f"WITH {BLD} SELECT id, area, 2 * (w + d) AS perimeter, round(cx, 4) AS cx, round(cy, 4) AS cy FROM b2",
        "tract_dissolve": f"WITH RECURSIVE {TRACT}, nb AS (SELECT a.region, a.id AS a, b.id AS b FROM tract a JOIN tract b ON a.region = b.region AND abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 200), reach(region, id, r) AS (SELECT region, id, id FROM tract UNION SELECT nb.region, nb.b, reach.r FROM reach JOIN nb ON nb.a = reach.id), part AS (SELECT region, id, min(r) AS r FROM reach GROUP BY ALL) SELECT region, count(*) * 40000.0::DOUBLE AS area, count(*) * 800.0::DOUBLE - 200 * (SELECT count(*) FROM nb WHERE nb.region = tract.region) AS perimeter, (SELECT count(DISTINCT r) FROM part WHERE part.region = tract.region)::INT AS n_parts, min(id) AS first_id FROM tract GROUP BY region",
        "beta_index": f"WITH {PT}, {TRACT} SELECT tract.id, round(avg(pt.id % 5), 4) AS feature_beta_index FROM tract LEFT JOIN pt ON x > x0 AND x < x0 + 200 AND y > y0 AND y < y0 + 200 GROUP BY 1",
        "intersections_per_area": f"WITH {PT}, {TRACT} SELECT tract.id, round(count(pt.id) * 1e6 / 4e4, 4)::DOUBLE AS intersections_per_km2 FROM tract LEFT JOIN pt ON pt.id % 5 > 1 AND x > x0 AND x < x0 + 200 AND y > y0 AND y < y0 + 200 GROUP BY 1",
        "own_street_block": f"WITH {BLD}, {LU}, o AS (SELECT b.id, l.id AS lid, greatest(0, least(b.x1, l.x0 + 100) - greatest(b.x0, l.x0)) * greatest(0, least(b.y1, l.y0 + 100) - greatest(b.y0, l.y0)) AS a FROM b2 b JOIN lu l ON b.x0 <= l.x0 + 100 AND l.x0 <= b.x1 AND b.y0 <= l.y0 + 100 AND l.y0 <= b.y1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a DESC, lid) AS n FROM o) SELECT b2.id, CASE WHEN lid IS NULL THEN 0 ELSE 1e4 END::DOUBLE AS street_based_block_area, coalesce(lid % 7, 0)::DOUBLE AS street_based_block_phi, CASE WHEN lid IS NULL THEN 0 ELSE 4 END::DOUBLE AS street_based_block_corners FROM b2 LEFT JOIN r ON r.id = b2.id AND n = 1",
        "street_pieces": f"WITH {STR}, cut AS (SELECT s.id, CASE WHEN s.flat THEN o.x0 ELSE o.y0 END AS place FROM s2 s JOIN s2 o ON s.flat <> o.flat AND CASE WHEN s.flat THEN o.x0 > s.x0 AND o.x0 < s.x1 AND s.y0 BETWEEN o.y0 AND o.y1 ELSE o.y0 > s.y0 AND o.y0 < s.y1 AND s.x0 BETWEEN o.x0 AND o.x1 END) SELECT s2.id AS street, 1 + count(DISTINCT place) AS n_pieces, any_value(length) AS length FROM s2 LEFT JOIN cut ON cut.id = s2.id GROUP BY 1",
        "social_index": "SELECT c_custkey, c_custkey % 30 AS hex_id, n_regionkey::DOUBLE AS feature_social_status_index, CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 END::DOUBLE AS feature_social_dynamic_index FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30",
        "part_with_buffer": f"WITH {PT}, f AS (SELECT id, x > 200 AND x < 600 AND y > 10 AND y < 400 AS i, x BETWEEN 150 AND 650 AND y BETWEEN 0 AND 450 AS o FROM pt) SELECT id, NOT i AS buffer_part FROM f WHERE i OR o",
        "table_difference": "WITH n AS (SELECT c_custkey AS k, c_nationkey AS a, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS b, c_mktsegment AS c, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS d FROM customer) SELECT k AS c_custkey, CASE WHEN a = b THEN a::VARCHAR ELSE coalesce(a::VARCHAR, 'nan') || ' --> ' || coalesce(b::VARCHAR, 'nan') END AS c_nationkey, CASE WHEN c = d THEN c ELSE coalesce(c, 'nan') || ' --> ' || coalesce(d, 'nan') END AS c_mktsegment FROM n",
        "first_event_of_user": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    }
    found |= _more_sql(comp)
    found |= shapes.oracle_sql() | network.oracle_sql()
    return found | {name: found[f.__name__] for name, f in WHOLE.items()}


def _labels() -> tuple[str, str]:
    """SQL of the list of labels and of the class of a label."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    labels = [(label, kind) for kind, xs in L.TYPOLOGIES.items() for label in xs]
    return "[" + ", ".join(quote(x) for x, _ in labels) + "]", "CASE label " + " ".join(f"WHEN {quote(x)} THEN {quote(k)}" for x, k in labels) + " END"


def _rect(a: str, b: str) -> str:
    """SQL of the overlap of two boxes x0, y0, x1, y1."""
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def _path_sql(sources: str, areas: str, end: str) -> str:
    """SQL of the distances to centres c (id, x, y): snapped rows and centres, and shortest paths over the reversed edges."""
    near = lambda t, k: f"SELECT {t}.id, n.osmid, sqrt(({t}.x - n.x) ** 2 + ({t}.y - n.y) ** 2) AS d, row_number() OVER (PARTITION BY {t}.id ORDER BY sqrt(({t}.x - n.x) ** 2 + ({t}.y - n.y) ** 2), n.osmid) AS k FROM {t} CROSS JOIN n"
    return (
        f"WITH RECURSIVE {EDGES}, n AS (SELECT s_suppkey AS osmid, ((s_suppkey * 53) % 1000)::DOUBLE AS x, ((s_suppkey * 29) % 1000)::DOUBLE AS y FROM supplier), c AS ({sources}), {areas}, "
        f"fa AS (SELECT * FROM ({near('a', 'a')}) WHERE k = 1), fc AS (SELECT * FROM ({near('c', 'c')}) WHERE k = 1), "
        "own AS (SELECT a.id, c.id AS c, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2), c.id) AS k FROM a CROSS JOIN c), "
        "far(c, node, dist) USING KEY (c, node) AS (SELECT id, osmid, 0.0::DOUBLE FROM fc UNION SELECT f.c, e.u, min(f.dist + e.length) FROM far f JOIN edge e ON e.v = f.node LEFT JOIN recurring.far r ON r.c = f.c AND r.node = e.u WHERE r.dist IS NULL OR f.dist + e.length < r.dist GROUP BY 1, 2) "
        f"SELECT a.id, round(CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.x BETWEEN a.x0 AND a.x0 + 200 AND c.y BETWEEN a.y0 AND a.y0 + 200) THEN 0 ELSE {end} END, 4) + 0 AS distance FROM a JOIN own ON own.id = a.id AND own.k = 1 JOIN fa ON fa.id = a.id JOIN fc ON fc.id = own.c LEFT JOIN far ON far.c = own.c AND far.node = fa.osmid"
    )


def _more_sql(comp: str) -> dict[str, str]:
    turn = lambda k: f"({k} + 0.5) * pi() / 32"
    # the sides of the 64-gon part it from a box if any of their directions does
    disc = " AND ".join(f"abs(({{x}}) * cos({turn(k)}) + ({{y}}) * sin({turn(k)})) <= {{r}} * cos(pi() / 64) + b.w / 2 * abs(cos({turn(k)})) + b.d / 2 * abs(sin({turn(k)})) + 1e-9" for k in range(32))
    tract = "a AS (SELECT n_nationkey::BIGINT AS id, (200 * (n_nationkey % 5))::DOUBLE AS x0, (200 * (n_nationkey // 5))::DOUBLE AS y0, x0 + 100 AS x, y0 + 100 AS y FROM nation)"
    centres = "SELECT r_regionkey::BIGINT AS id, 200.0::DOUBLE * r_regionkey + 50 AS x, 150.0::DOUBLE * r_regionkey + 35 AS y FROM region"
    labels, kind = _labels()
    classes = sorted(L.TYPOLOGIES)
    lab = f"lab AS (SELECT s_suppkey AS id, ({labels})[1 + s_suppkey % {len(labels.split(chr(39) + ', ' + chr(39)))}] AS label, {kind} AS class, (100 * (s_suppkey % 10))::DOUBLE AS x0, (100 * (s_suppkey // 10))::DOUBLE AS y0, x0 + 100 AS x1, y0 + 100 AS y1 FROM supplier)"
    win = lambda b: f"w{b} AS (SELECT b2.id, class, greatest(0, least(cx + {b}, l.x1) - greatest(cx - {b}, l.x0)) * greatest(0, least(cy + {b}, l.y1) - greatest(cy - {b}, l.y0)) AS a FROM b2 JOIN lab l ON class <> 'lu_roads' AND cx - {b} <= l.x1 AND l.x0 <= cx + {b} AND cy - {b} <= l.y1 AND l.y0 <= cy + {b}), s{b} AS (SELECT id, " + ", ".join(f"coalesce(sum(a) FILTER (class = '{c}'), 0) AS {c}" for c in classes if c != L.ROADS) + f", sum(a) AS total FROM w{b} GROUP BY id)"
    cols = lambda b: ", ".join(f"round(coalesce(s{b}.{c}, 0), 4) AS \"{c}_within_buffer_{b}\"" for c in classes if c != L.ROADS) + f", round({4.0 * b * b}::DOUBLE - coalesce(s{b}.total, 0), 4) AS lu_roads_within_buffer_{b}"
    hot = lambda prefix: ", ".join(f"coalesce(class = '{c}', false)::BIGINT AS {prefix}_{c}" for c in classes)
    block_near = ", ".join(f"n{b} AS (SELECT DISTINCT a.id, c.component AS blk FROM b2 a JOIN b2 b ON b.x0 <= a.cx + {b} AND b.x1 >= a.cx - {b} AND b.y0 <= a.cy + {b} AND b.y1 >= a.cy - {b} JOIN comp c ON c.id = b.id), m{b} AS (SELECT n.id, count(*)::DOUBLE AS k, avg(len) AS al, avg(tot) AS at, avg(av) AS aa, stddev_samp(len) AS sl, stddev_samp(tot) AS st, stddev_samp(av) AS sa FROM n{b} n JOIN blk ON blk.component = n.blk AND len > 1 GROUP BY n.id)" for b in (50, 100))
    block_cols = ", ".join(f"coalesce(m{b}.k, 0)::DOUBLE AS blocks_within_buffer_{b}, " + ", ".join(f"round(coalesce(m{b}.{p}{c}, 0), 6) AS {full}_{name}_within_buffer_{b}" for p, full in (("a", "av"), ("s", "std")) for c, name in (("l", "block_length"), ("t", "block_footprint_area"), ("a", "block_av_footprint_area"))) + f", 0.0::DOUBLE AS av_block_orientation_within_buffer_{b}, 0.0::DOUBLE AS std_block_orientation_within_buffer_{b}" for b in (50, 100))
    return {
        "buildings_round_buffer": f"WITH {BLD}, near AS MATERIALIZED (SELECT a.id AS aid, b.*, b.cx - a.cx AS dx, b.cy - a.cy AS dy FROM b2 a JOIN b2 b ON a.id <> b.id AND b.x0 <= a.cx + 40 AND b.x1 >= a.cx - 40 AND b.y0 <= a.cy + 40 AND b.y1 >= a.cy - 40) SELECT b2.id, count(b.id) AS n FROM b2 LEFT JOIN (SELECT * FROM near b WHERE {disc.format(x='dx', y='dy', r=40)}) b ON b.aid = b2.id GROUP BY b2.id",
        "road_distance": f"WITH RECURSIVE {EDGES}, far(node, dist) USING KEY (node) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION SELECT e.v, min(f.dist + e.length) FROM far f JOIN edge e ON e.u = f.node LEFT JOIN recurring.far r ON r.node = e.v WHERE r.dist IS NULL OR f.dist + e.length < r.dist GROUP BY 1) SELECT node, dist AS distance FROM far",
        "streets_without_duplicates": f"WITH {STR}, near AS (SELECT a.id, b.id AS o FROM s2 a JOIN s2 b ON a.id <> b.id AND a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1 WHERE " + " AND ".join(f"pow(greatest(0, a.x0 - b.x{k}, b.x{k} - a.x1), 2) + pow(greatest(0, a.y0 - b.y{k}, b.y{k} - a.y1), 2) <= 1" for k in (0, 1)) + "), gone AS (SELECT CASE WHEN m.id IS NOT NULL THEN greatest(n.id, n.o) ELSE n.o END AS id FROM near n LEFT JOIN near m ON m.id = n.o AND m.o = n.id) SELECT id, length FROM s2 WHERE id NOT IN (SELECT id FROM gone)",
        "blocks_in_window": f"{comp}, blk AS (SELECT component, count(*) AS len, sum(area) AS tot, avg(area) AS av FROM comp JOIN b2 USING (id) GROUP BY component), {block_near} SELECT b2.id, {block_cols} FROM b2 LEFT JOIN m50 ON m50.id = b2.id LEFT JOIN m100 ON m100.id = b2.id",
        "shape_measures": "WITH s AS (SELECT p_partkey AS id, (20 * (p_partkey % 50))::DOUBLE AS x, (20 * (p_partkey // 50))::DOUBLE AS y, (20 + p_size % 16)::DOUBLE AS w, (40 + p_partkey % 7)::DOUBLE AS d, p_partkey % 4 AS k FROM part) SELECT id, "
        "round(CASE k WHEN 1 THEN 0.75 * w * d WHEN 2 THEN w * d - 30 WHEN 3 THEN w * d + w * w ELSE w * d END, 4) AS \"FootprintArea\", CASE k WHEN 2 THEN 2 * (w + d) + 22 WHEN 3 THEN 2 * (w + d) + 4 * w ELSE 2 * (w + d) END AS \"Perimeter\", CASE k WHEN 1 THEN 6 WHEN 3 THEN 8 ELSE 4 END::BIGINT AS \"Corners\", "
        "round(CASE k WHEN 0 THEN 1 WHEN 1 THEN 0.75 / 0.875 WHEN 2 THEN (w * d - 30) / (w * d) END, 4)::DOUBLE AS \"Convexity\", CASE WHEN k = 0 THEN round(least(w, d) / greatest(w, d), 4) END AS \"Elongation\", CASE WHEN k = 0 THEN round(degrees(atan2(0.6, 0.8)), 4) END AS \"Orientation\", CASE WHEN k <> 3 THEN round(sqrt(w * w + d * d), 4) END AS \"LongestAxisLength\", "
        "round(CASE k WHEN 0 THEN x + 0.3 * w - 0.4 * d WHEN 1 THEN x + 5 * w / 12 WHEN 2 THEN (w * d * (x + w / 2) - 30 * (x + 4.5)) / (w * d - 30) ELSE (w * d * (x + w / 2) + w * w * (x + 60 + w / 2)) / (w * d + w * w) END, 4) AS cx, round(CASE k WHEN 0 THEN y + 0.4 * w + 0.3 * d WHEN 1 THEN y + 5 * d / 12 WHEN 2 THEN (w * d * (y + d / 2) - 30 * (y + 6)) / (w * d - 30) ELSE (w * d * (y + d / 2) + w * w * (y + w / 2)) / (w * d + w * w) END, 4) AS cy FROM s",
        "distance_to_centre": f"WITH {BLD} SELECT id, round(sqrt(pow(greatest(0, x0 - 510, 510 - x1), 2) + pow(greatest(0, y0 - 330, 330 - y1), 2)), 4) AS feature_distance_cbd FROM b2",
        "distance_to_local_centre": f"WITH {BLD}, c AS ({centres}), p AS (SELECT b2.id, c.id AS c, sqrt((cx - x) ** 2 + (cy - y) ** 2) AS d, row_number() OVER (PARTITION BY b2.id ORDER BY sqrt((cx - x) ** 2 + (cy - y) ** 2), c.id) AS k FROM b2 CROSS JOIN c) SELECT id, c AS centre, round(d, 4) AS feature_distance_local_cbd FROM p WHERE k = 1",
        "network_distance_to_centre": _path_sql("SELECT 0::BIGINT AS id, 510.0::DOUBLE AS x, 330.0::DOUBLE AS y", tract, "coalesce(far.dist + fa.d + fc.d, own.d)"),
        "network_distance_to_local_centres": _path_sql(centres, tract, "far.dist + fa.d + fc.d"),
        "urban_atlas_of_points": f"WITH {PT}, {lab}, o AS (SELECT pt.id, min_by(class, lab.id) AS class FROM pt JOIN lab ON x BETWEEN lab.x0 AND lab.x1 AND y BETWEEN lab.y0 AND lab.y1 GROUP BY pt.id), r AS (SELECT *, 1 AS n FROM o) SELECT pt.id, {hot('point_in')} FROM pt LEFT JOIN r ON r.id = pt.id",
        "urban_atlas_of_buildings": f"WITH {BLD}, {lab}, o AS (SELECT b.id, l.id AS lid, class, {_rect('b', 'l')} AS a FROM b2 b JOIN lab l ON b.x0 < l.x1 AND l.x0 < b.x1 AND b.y0 < l.y1 AND l.y0 < b.y1), r AS (SELECT id, class, row_number() OVER (PARTITION BY id ORDER BY a DESC, lid) AS n FROM o), {win(50)}, {win(100)} SELECT b2.id, {hot('bld_in')}, {cols(50)}, {cols(100)} FROM b2 LEFT JOIN r ON r.id = b2.id AND n = 1 LEFT JOIN s50 ON s50.id = b2.id LEFT JOIN s100 ON s100.id = b2.id",
        "land_use_of_hexes": f"WITH {TRACT}, {LU}, o AS (SELECT t.id, class, greatest(0, least(t.x0 + 200, l.x0 + 100) - greatest(t.x0, l.x0)) * greatest(0, least(t.y0 + 200, l.y0 + 100) - greatest(t.y0, l.y0)) AS a FROM tract t JOIN lu l ON t.x0 < l.x0 + 100 AND l.x0 < t.x0 + 200 AND t.y0 < l.y0 + 100 AND l.y0 < t.y0 + 200) SELECT tract.id, " + ", ".join(f"round(coalesce(sum(a) FILTER (class = '{c}'), 0), 4)::DOUBLE AS feature_ua_{c}" for c in CLASSES) + ", round(40000 - coalesce(sum(a), 0), 4)::DOUBLE AS \"feature_ua_Roads\" FROM tract LEFT JOIN o ON o.id = tract.id GROUP BY tract.id",
        "trips_per_capita": f"WITH {TRACT}, {LU}, n AS (SELECT (user_id % 25)::BIGINT AS id, count(*) AS num_trips FROM events GROUP BY 1), o AS (SELECT t.id, sum((1 + l.id % 13) * greatest(0, least(t.x0 + 200, l.x0 + 100) - greatest(t.x0, l.x0)) * greatest(0, least(t.y0 + 200, l.y0 + 100) - greatest(t.y0, l.y0)) / 1e4) AS pop FROM tract t JOIN lu l ON t.x0 < l.x0 + 100 AND l.x0 < t.x0 + 200 AND t.y0 < l.y0 + 100 AND l.y0 < t.y0 + 200 GROUP BY t.id) SELECT tract.id, num_trips, round(pop, 4)::DOUBLE AS pop_count, round(num_trips / pop, 4)::DOUBLE AS trips_per_capita FROM tract LEFT JOIN n USING (id) LEFT JOIN o USING (id)",
        "tract_employment_access": f"WITH {TRACT}, {LU}, o AS (SELECT t.id, t.x0, t.y0, coalesce(sum((1 + l.id % 13) * greatest(0, least(t.x0 + 200, l.x0 + 100) - greatest(t.x0, l.x0)) * greatest(0, least(t.y0 + 200, l.y0 + 100) - greatest(t.y0, l.y0)) / 1e4), 0) AS n FROM tract t LEFT JOIN lu l ON t.x0 < l.x0 + 100 AND l.x0 < t.x0 + 200 AND t.y0 < l.y0 + 100 AND l.y0 < t.y0 + 200 GROUP BY ALL), "
        "p AS (SELECT a.id, b.id AS other, b.n, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) AS d, floor(0.1 * (SELECT sum(n) FROM o)) AS most FROM o a CROSS JOIN o b), q AS (SELECT *, max((n >= most)::INT) OVER w AS past, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY id ORDER BY d, other ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT id, round(CASE WHEN sum(n) > 0 THEN sum(n * d) / sum(n) ELSE avg(d) END, 4) AS employment_access FROM q WHERE past = 0 OR k = 1 GROUP BY id",
        "class_counts_of_tracts": f"WITH {PT}, {TRACT}, t AS (SELECT event_type, count(*) AS class_total FROM pt GROUP BY 1) SELECT tract.id, event_type, count(*) AS counts, any_value(class_total) AS class_total FROM pt JOIN t USING (event_type) JOIN tract ON x BETWEEN x0 AND x0 + 200 AND y BETWEEN y0 AND y0 + 200 GROUP BY 1, 2",
        "jobs_near_tracts": f"WITH {JOBS} SELECT id AS other, num_jobs FROM jobs WHERE pow(greatest(0, 2 * x - 1000), 2) + pow(greatest(0, 2 * y - 1000), 2) <= 3600",
        "area_plus_buffer": f"WITH {BLD}, p AS (SELECT id, pow(greatest(0, 200 - x1, x0 - 600), 2) + pow(greatest(0, 10 - y1, y0 - 400), 2) AS d FROM b2) SELECT id, d > 0 AS is_buffer FROM p WHERE d <= 2500",
        "away_from_boundary": f"WITH {PT} SELECT id FROM pt WHERE x > 220 AND x < 580 AND y > 30 AND y < 380",
        "city_level": f"WITH {TRACT}, {EDGES}, {STR}, {PT}, {LU} SELECT (SELECT count(*) FROM tract) * 0.04::DOUBLE AS area_km2, round((SELECT sum(length) FROM edge) / 1000, 4) AS network_km, (SELECT sum(length) FROM s2) AS total_length_street_city, round((SELECT avg(length) FROM s2), 4) AS av_length_street_city, (SELECT count(*) FROM pt) AS intersections_count, (SELECT count(*) FROM lu) AS total_number_block_city, 1e4::DOUBLE AS av_area_block_city, 0.0::DOUBLE AS std_area_block_city",
        "csv_round_trip": f"WITH {BLD} SELECT id, area, 2 * (w + d) AS perimeter FROM b2",
        "trips_round_trip": f"WITH {PT} SELECT id, event_type AS providertype, 'origin' AS \"end\", x, y FROM pt UNION ALL SELECT id, event_type, 'destination', x + 2, y + 1 FROM pt",
        "gml_buildings": f"WITH {BLD} SELECT id, w + 1 AS height, w + 1 AS height_bbox, w + 1 AS measured_height, w + 1 AS roof_over_wall, CASE WHEN id % 2 = 0 THEN 'flat roof' ELSE 'slanted roof' END AS roof, area FROM b2",
        "street_faces": f"WITH {LU} SELECT x0, y0, 1e4::DOUBLE AS area, 4::BIGINT AS corners, 0.0::DOUBLE AS orientation FROM lu",
    }
