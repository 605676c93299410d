"""Projections, file readers, unions and searches against plain versions and published values."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_projections_at_published_points(spark):
    from urbanlattice.functions import crs as C

    foot = 0.3048006096012192
    texas = C.Projection("lcc", (6378206.4, 294.978698213898), -99.0, 27 + 50 / 60, 1.0, 2_000_000 * foot, 0.0, (28 + 23 / 60, 30 + 17 / 60))
    points = [
        (32617, -(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, 630084, 4833438, 1.0),
        (25832, 9.0, 0.0, 500_000, 0, 1e-3),
        (texas, -96.0, 28.5, 2963503.91 * foot, 254759.80 * foot, 0.01),
        (5514, 16 + 50 / 60 + 59.179 / 3600, 50 + 12 / 60 + 32.442 / 3600, -568990.99, -1050538.63, 0.05),
        (2154, 3.0, 46.5, 700_000, 6_600_000, 1e-3),
        (2169, 6 + 1 / 6, 49 + 5 / 6, 80_000, 100_000, 1e-3),
    ]
    for code, lon, lat, x, y, near in points:
        r = spark.range(1).select(C.forward(code, F.lit(lon), F.lit(lat)).alias("p")).first()["p"]
        assert abs(r["x"] - x) <= near and abs(r["y"] - y) <= near, (code, r)
    for code in (25833, 7794, 2154, 2169, 5514):
        p = C.projection(code)
        at = spark.createDataFrame([(p.lon0 + dx, 46 + dy) for dx in (-2.5, 0.3, 2.0) for dy in (0.2, 3.1)], "lon double, lat double")
        there = at.select("lon", "lat", C.forward(code, F.col("lon"), F.col("lat")).alias("p")).select("lon", "lat", C.inverse(code, F.col("p.x"), F.col("p.y")).alias("q"))
        for r in there.collect():
            assert abs(r["lon"] - r["q"]["lon"]) < 1e-9 and abs(r["lat"] - r["q"]["lat"]) < 1e-9, code
    with pytest.raises(ValueError):
        C.projection(1)


def test_axes_and_centroid_in_degrees(spark):
    from urbanlattice.functions import crs as C
    from urbanlattice.functions import geometry as G

    at = spark.range(1).select(C.forward(25833, F.lit(13.4), F.lit(52.5)).alias("p"))
    at = at.select("p", G.rectangle(F.col("p.x") - 50, F.col("p.y") - 50, F.col("p.x") + 50, F.col("p.y") + 50).alias("geom"))
    r = at.select(C.centroid_lat_lon(F.col("geom"), 25833).alias("c"), C.axes_confused(F.col("p"), 25833).alias("a"), C.axes_confused(F.struct(F.col("p.y").alias("x"), F.col("p.x").alias("y")), 25833).alias("b"), C.transformed(F.col("geom"), 25833, 25832).alias("g")).first()
    assert abs(r["c"]["lat"] - 52.5) < 1e-6 and abs(r["c"]["lon"] - 13.4) < 1e-6 and not r["a"] and r["b"] and r["g"]["kind"] == 3


def shp(shapes):
    out = b""
    for i, (kind, parts) in enumerate(shapes):
        if kind == 0:
            body = struct.pack("<i", 0)
        elif kind == 1:
            body = struct.pack("<idd", 1, *parts)
        else:
            xy = [p for r in parts for p in r]
            starts = np.cumsum([0] + [len(r) for r in parts])[:-1]
            body = struct.pack("<i4dii", kind, 0, 0, 0, 0, len(parts), len(xy)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in xy)
        out += struct.pack(">ii", i + 1, len(body) // 2) + body
    return struct.pack(">i", 9994) + b"\0" * 96 + out


def dbf(fields, rows):
    size = 1 + sum(w for _, w in fields)
    head = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 32 + 32 * len(fields) + 1, size)
    for name, width in fields:
        head += name.encode().ljust(11, b"\0") + b"C\0\0\0\0" + bytes([width]) + b"\0" * 15
    return head + b"\x0d" + b"".join((b"*" if gone else b" ") + b"".join(str(v).encode().ljust(w) for v, (_, w) in zip(row, fields)) for gone, *row in rows) + b"\x1a"


def test_shapefiles(spark, tmp_path):
    from urbanlattice.functions import geometry as G
    from urbanlattice.sources.vector import read_shapefiles

    box = lambda x, y, n: [(x, y), (x, y + n), (x + n, y + n), (x + n, y), (x, y)]  # noqa: E731 - clockwise
    shapes = [(5, [box(0, 0, 10)]), (5, [box(0, 0, 10), box(2, 2, 3)[::-1]]), (5, [box(0, 0, 1), box(5, 5, 2)]), (0, None), (3, [[(0, 0), (3, 4)]]), (5, [box(0, 0, 4)])]
    (tmp_path / "a.shp").write_bytes(shp(shapes))
    (tmp_path / "a.dbf").write_bytes(dbf([("NAME", 5), ("POP", 6)], [(False, "one", 5), (False, "é", ""), (False, "c", "x"), (False, "d", 7), (False, "e", 8), (True, "gone", 9)]))
    (tmp_path / "p.shp").write_bytes(shp([(1, (3.0, 4.0))]))
    rows = read_shapefiles(spark, str(tmp_path), "NAME string, POP bigint").select("NAME", "POP", F.col("geom.kind").alias("k"), G.area(F.col("geom")).alias("a"), G.length(F.col("geom")).alias("l")).collect()
    got = sorted((tuple(r) for r in rows), key=str)
    assert got == sorted([("one", 5, 3, 100.0, 40.0), ("é", None, 3, 91.0, 52.0), ("c", None, 6, 5.0, 12.0), ("d", 7, None, None, None), ("e", 8, 2, 0.0, 5.0), (None, None, 1, 0.0, 0.0)], key=str)


def test_shapefiles_in_blocks(spark, tmp_path):
    """Shapes meet their own records in any number of blocks; a file of another number of records is an error; an empty one has no rows."""
    from urbanlattice.sources.vector import BLOCK, read_shapefiles

    def write(name, n, m):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.shp").write_bytes(shp([(1, (float(k), 2.0 * k)) for k in range(n)]))
        (tmp_path / name / "a.dbf").write_bytes(dbf([("K", 6)], [(k % 7 == 0, k) for k in range(m)]))
        return read_shapefiles(spark, str(tmp_path / name), "K int").select("K", F.col("geom.parts")[0][0][0].alias("p"))

    n = 2 * BLOCK + 3
    got = write("whole", n, n).collect()
    assert sorted(r["K"] for r in got) == [k for k in range(n) if k % 7] and all(tuple(r["p"]) == (r["K"], 2.0 * r["K"]) for r in got)
    assert len(write("even", BLOCK, BLOCK).collect()) == len([k for k in range(BLOCK) if k % 7])
    assert write("none", 0, 0).collect() == []
    for k, (a, b) in enumerate(((BLOCK, BLOCK + 1), (BLOCK + 1, BLOCK), (0, 3), (3, 0))):
        with pytest.raises(Exception, match="shapes and records"):
            write(f"odd{k}", a, b).collect()


def test_geopackages(spark, tmp_path):
    from urbanlattice.functions import geometry as G
    from urbanlattice.sources.vector import read_geopackages

    ring = [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]
    poly = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in ring)
    three = struct.pack("<BIII", 1, 1003, 1, 5) + b"".join(struct.pack("<ddd", *p, 9) for p in ring)
    multi = struct.pack("<BII", 1, 6, 2) + poly * 2
    db = sqlite3.connect(tmp_path / "x.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('lu', 'shape')")
    db.execute("CREATE TABLE lu (fid INTEGER, class TEXT, shape BLOB)")
    head = lambda flags, n: b"GP\0" + bytes([flags]) + struct.pack("<i", 4326) + b"\0" * 8 * n
    db.executemany("INSERT INTO lu VALUES (?, ?, ?)", [(1, "a", head(1, 0) + poly), (2, None, head(3, 4) + three), (3, "c", head(1, 0) + multi), (4, "d", None)])
    db.commit()
    db.close()
    rows = read_geopackages(spark, str(tmp_path), "lu", "fid bigint, class string").orderBy("fid").select("fid", "class", G.area(F.col("geom")).alias("a")).collect()
    assert [tuple(r) for r in rows] == [(1, "a", 12.0), (2, None, 12.0), (3, "c", 24.0), (4, "d", None)]


def test_union_of_polygons():
    from urbanlattice.functions import kernels as K
    from urbanlattice.functions import overlay as O

    box = lambda x0, y0, x1, y1: [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)]
    area = lambda parts: sum(K.ring_area(r) for p in parts for r in p)
    one = O.union([box(0, 0, 2, 1), box(2, 0, 4, 1), box(1, 1, 3, 2)])
    assert len(one) == 1 and len(one[0]) == 1 and abs(area(one) - 6) < 1e-6 and len(one[0][0]) == 9
    frame = O.union([box(0, 0, 5, 1), box(0, 4, 5, 5), box(0, 0, 1, 5), box(4, 0, 5, 5), box(2, 2, 3, 3)])
    assert sorted(map(len, frame)) == [1, 2] and abs(area(frame) - 17) < 1e-6
    corner = O.union([box(0, 0, 1, 1), box(1, 1, 2, 2)])
    assert len(corner) == 2 and abs(area(corner) - 2) < 1e-6
    (row,) = O.union([box(0, 0, 2, 1), box(2, 0, 4, 1)])
    assert len(row) == 1 and len(row[0]) == 5 and abs(area([row]) - 4) < 1e-6


def test_dissolve(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.graph import dissolve

    rows = [(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 900.0, 0.0, 1100.0, 2.0), (2, 5.0, 5.0, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "k bigint, x0 double, y0 double, x1 double, y1 double").select("k", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom")).unionByName(spark.range(1).select(F.lit(3).cast("bigint").alias("k"), F.lit(None).cast(G.GEOM).alias("geom")))
    got = {r["k"]: (r["a"], r["kind"]) for r in dissolve(df, "k", 100.0).select("k", G.area(F.col("geom")).alias("a"), F.col("geom.kind").alias("kind")).collect()}
    assert got == {1: (pytest.approx(407), 6), 2: (pytest.approx(1), 3)}


def test_nearest_with_nulls_and_outliers(spark):
    from urbanlattice.operators.spatial_join import nearest

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 1e6, -1e6), (4, 5.0, 5.0)], "id bigint, x double, y double")
    right = spark.createDataFrame([(7, 5.0, 6.0), (8, 5.0, 6.0), (9, None, None), (5, -40.0, 0.0)], "job bigint, x double, y double")
    got = {r["id"]: (r["job"], r["distance"]) for r in nearest(left, right, "id", "job", 1.0).collect()}
    assert got[2] == (None, None) and got[4] == (7, 1.0) and got[1][0] == 7 and got[3] == (7, pytest.approx(math.dist((1e6, -1e6), (5, 6))))
    assert nearest(left, right.limit(0), "id", "job", 1.0).count() == 0


def test_closest_object_of_rows_without_geometry(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.streets import closest_street_features

    at = lambda rows: spark.createDataFrame(rows, "id bigint, wkt string").select("id", G.from_wkt(F.col("wkt")).alias("geom"))
    df = at([(1, "POINT (0 0)"), (2, None), (3, "POLYGON ((100000 0, 100001 0, 100001 1, 100000 1, 100000 0))")])
    streets = at([(5, "LINESTRING (3 -5, 3 5)"), (6, "LINESTRING (-3 -5, -3 5)"), (7, None)]).withColumn("length", F.lit(10.0)).withColumn("openness", F.lit(0.5))
    got = {r["id"]: tuple(r)[1:] for r in closest_street_features(df, streets).collect()}
    assert got[1] == (5, 3.0, 10.0, 0.5) and got[2] == (None, 0.0, 0.0, 0.0) and got[3] == (5, 99997.0, 10.0, 0.5)


def clip(poly, box):
    """Sutherland and Hodgman's clipping by an axis-aligned box, with plain lists."""
    x0, y0, x1, y1 = box
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            a, b = keep * (p[axis] - bound), keep * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        poly = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2 if poly else 0.0


def test_round_buffers(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.buildings import buildings_distance_based

    boxes = {i: (11.0 * (i % 6), 13.0 * (i // 6), 11.0 * (i % 6) + 4 + i % 5, 13.0 * (i // 6) + 3 + i % 7) for i in range(36)}
    df = spark.createDataFrame([(i, *b, (b[2] - b[0]) * (b[3] - b[1])) for i, b in boxes.items()], "id bigint, x0 double, y0 double, x1 double, y1 double, footprint_area double")
    df = df.select("id", "footprint_area", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"))
    got = {r["id"]: r for r in buildings_distance_based(df, df, (9.1, 20.3), mode="round", same=True, means=("footprint_area",), deviations=()).collect()}
    for i, (x0, y0, x1, y1) in boxes.items():
        for r in (9.1, 20.3):
            disc = [((x0 + x1) / 2 + r * math.cos(k * math.pi / 32), (y0 + y1) / 2 + r * math.sin(k * math.pi / 32)) for k in range(64)]
            parts = {j: clip(disc, b) for j, b in boxes.items() if j != i}
            inside = [j for j, a in parts.items() if a > 1e-9]
            assert got[i][f"buildings_within_buffer_{r:g}"] == len(inside)
            assert abs(got[i][f"total_ft_area_within_buffer_{r:g}"] - sum(parts.values())) < 1e-6
            mean = sum((boxes[j][2] - boxes[j][0]) * (boxes[j][3] - boxes[j][1]) for j in inside) / len(inside) if inside else 0.0
            assert abs(got[i][f"av_footprint_area_within_buffer_{r:g}"] - mean) < 1e-9


def test_land_use_of_points(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.land_use import mapped, urban_atlas_features

    lu = spark.createDataFrame([(1, "Forests", 0.0, 0.0, 10.0, 10.0), (2, "Water", 10.0, 0.0, 12.0, 10.0), (3, "Pastures", 0.0, 10.0, 12.0, 30.0)], "id bigint, label string, x0 double, y0 double, x1 double, y1 double")
    lu = lu.select("id", "label", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"))
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 11.0, 5.0), (4, 50.0, 5.0)], "id bigint, x double, y double").select("id", G.point(F.col("x"), F.col("y")).alias("geom"))
    got = {r["id"]: {k for k, v in r.asDict().items() if v == 1 and k != "id"} for r in urban_atlas_features(pts, lu, "label", (5.0,), "point").select("id", *[f"point_in_lu_{c}" for c in ("natural", "water", "agricultural", "roads")]).collect()}
    assert got == {1: {"point_in_lu_natural"}, 2: {"point_in_lu_natural"}, 3: {"point_in_lu_water"}, 4: set()}
    assert spark.range(1).select(mapped(F.lit("nothing known")).alias("m")).first()["m"] is None


def test_pieces_beyond_ten_keep_their_own_ids(spark):
    from urbanlattice.functions import geometry as G
    from urbanlattice.operators.streets import split_crossing

    lines = [(1, "LINESTRING (0 0, 100 0)"), (11, "LINESTRING (0 50, 100 50)")] + [(100 + k, f"LINESTRING ({5 * k + 2} -1, {5 * k + 2} 1)") for k in range(15)]
    df = spark.createDataFrame(lines, "id bigint, wkt string").select("id", G.from_wkt(F.col("wkt")).alias("geom"))
    got = split_crossing(df).collect()
    assert len({r["id"] for r in got}) == len(got) == 16 + 1 + 30 and sum(r["street"] == 1 for r in got) == 16


def test_rows_of_one_table_only(spark):
    from urbanlattice.operators.city import changed_cells

    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in changed_cells(old, new, "k").collect()} == {1: "a --> absent", 2: "b --> c", 3: "absent --> nan"}
