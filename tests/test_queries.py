"""Registered queries against their SQL, and small fixtures for what SQL can't say."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["building_level", "buildings_within_100", "touching_buildings", "block_totals", "streets_within_100", "land_use_within_100", "areal_interpolation", "land_use_entropy", "nearest_job", "street_components", "pizza_split", "beta_index", "intersections_per_area", "own_street_block", "street_pieces", "social_index", "part_with_buffer", "table_difference", "first_event_of_user", "buildings_round_buffer", "building_blocks", "blocks_in_window", "shape_measures", "distance_to_centre", "distance_to_local_centre", "network_distance_to_centre", "network_distance_to_local_centres", "urban_atlas_of_buildings", "land_use_of_hexes", "trips_per_capita", "tract_employment_access", "class_counts_of_tracts", "jobs_near_tracts", "area_plus_buffer", "away_from_boundary", "city_level", "csv_round_trip", "trips_round_trip", "gml_buildings", "street_faces", "tract_dissolve", "land_use_of_buildings", "points_in_tracts", "hex_population", "intersections_within_100", "land_use_shares", "wkt_round_trip", "urban_atlas_of_points", "block_numbers", "closest_street_by_boxes", "boundary_buffers", "shape_buffers", "single_shapes", "overlay_pieces", "overlay_rest", "ring_repair", "street_profiles", "edge_node_means", "street_blocks_within_100", "street_centrality_within_100", "closest_street_centrality", "intersections_around_jobs", "population_of_tracts", "wall_heights"]


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns, key=lambda c: (c not in ("id", "other", "source", "node", "street", "c_custkey", "user_id"), c))
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-6)


def test_wkt(spark):
    from urbanlattice.functions import geometry as G

    texts = ["POINT (1 2)", "LINESTRING (0 0, 3 4)", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5)))", "POINT Z (1 2 3)", None, "", "CIRCLE (1)"]
    df = G.hold(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string"), "g", G.from_wkt(F.col("t")))
    rows = df.select("id", G.area(F.col("g")).alias("a"), G.length(F.col("g")).alias("l"), F.col("g.kind").alias("k"), G.area(G.largest_part(F.col("g"))).alias("big")).orderBy("id").collect()
    assert [r["a"] for r in rows] == [0, 0, 84, 5, 0, None, None, None]
    assert rows[1]["l"] == 5 and rows[2]["l"] == 56 and rows[3]["big"] == 4 and [r["k"] for r in rows][:5] == [1, 2, 3, 6, 1]


def test_paths_on_a_small_graph(spark):
    from urbanlattice.operators.graph import shortest_paths

    e = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 2.0), (5, 1, 1.0)], "u bigint, v bigint, length double")
    got = shortest_paths(e, spark.createDataFrame([(1, 1)], "source bigint, node bigint")).collect()
    assert {r["node"]: r["distance"] for r in got} == {1: 0, 3: 1, 2: 2, 4: 4}


def test_gml(spark, tmp_path):
    from urbanlattice.sources.gml import read_citygml, roof_type, elements

    surface = lambda tag, pts: f"<bldg:{tag}><gml:posList>{pts}</gml:posList></bldg:{tag}>"
    text = (
        '<core:CityModel><bldg:Building gml:id="b1"><gml:Envelope><gml:lowerCorner>0 0 1</gml:lowerCorner><gml:upperCorner>4 4 7.5</gml:upperCorner></gml:Envelope>'
        "<bldg:measuredHeight>6</bldg:measuredHeight><bldg:consistsOfBuildingPart><bldg:measuredHeight>7</bldg:measuredHeight></bldg:consistsOfBuildingPart>"
        + surface("GroundSurface", "0 0 1 4 0 1 4 4 1 0 4 1 0 0 1") + surface("WallSurface", "0 0 1 4 0 1 4 0 6 0 0 6 0 0 1") + surface("RoofSurface", "0 0 6 4 0 6 4 4 6 0 4 6 0 0 6")
        + '</bldg:Building><bldg:Building gml:id="b2"></bldg:Building></core:CityModel>'
    )
    (tmp_path / "a.gml").write_text(text)
    rows = read_citygml(spark, str(tmp_path / "a.gml"), country="x").orderBy("id").collect()
    assert (rows[0]["height"], rows[0]["height_bbox"], rows[0]["measured_height"], rows[0]["geom"]["kind"]) == (5, 6.5, 7, 3)
    assert rows[1]["height"] is None and rows[1]["geom"] is None
    kinds = elements(spark, str(tmp_path / "a.gml")).select(roof_type(F.col("fragment")).alias("r")).collect()
    assert [k["r"] for k in kinds] == ["flat roof", None]
