"""Whole results on small tables, beside a brute force, where the shared SQL can't show a cut."""

import heapq
import math

import duckdb
import pytest

import __spark_entry__ as entry


def tables(spark, path, **rows):
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


JOBS = "c_custkey bigint, c_acctbal double"
JOB_AT = lambda k: (k * 37 % 1000, k * 17 % 1000)


def test_nearest_job_of_every_building(spark, tmp_path):
    parts = [(i, i % 16) for i in (1, 49, 2499, 2500, 2600, 5003, 20_000, 180_000)]
    jobs = [(k, 100.0) for k in range(1, 40)] + [(k + 1000, 100.0) for k in range(1, 40)]
    got = entry.queries()["nearest_job"](spark, tables(spark, tmp_path, part=("p_partkey bigint, p_size int", parts), customer=(JOBS, jobs))).collect()
    want = {}
    for i, size in parts:
        x, y = 20 * (i % 50) + (5 + size % 16) / 2, 20 * (i // 50) + (5 + i * 7 % 16) / 2
        d, job = min((math.dist((x, y), JOB_AT(k)), k) for k, _ in jobs)
        want[i] = (job, round(d, 4))
    assert {r["id"]: (r["job"], r["distance"]) for r in got} == want


def test_employment_access_looks_farther(spark, tmp_path):
    nations = [(n, n // 5) for n in range(25)]
    for name, jobs in {"spread": [(k, 2000.0 * (k % 6)) for k in range(1, 60)], "few": [(k, 1000.0) for k in (1, 2, 27)]}.items():
        at = tables(spark, tmp_path / name, nation=("n_nationkey int, n_regionkey int", nations), customer=(JOBS, jobs))
        got = {r["id"]: r["employment_access"] for r in entry.queries()["employment_access"](spark, at).collect()}
        for n, _ in nations:
            before, total = 0, 0.0
            for d, _, m in sorted((math.dist((200 * (n % 5) + 100, 200 * (n // 5) + 100), JOB_AT(k)), k, b // 100) for k, b in jobs if b >= 100):
                if before < 500:
                    before, total = before + m, total + m * d
            assert abs(got[n] - total / before) < 1e-3


ORDERS = ("o_orderkey bigint, o_custkey bigint, o_totalprice double", [(k, k * 7, 1000.0 * k) for k in range(1, 121)])


def street_boxes():
    """id: (x0, y0, x1, y1) of the segments of ORDERS."""
    out = {}
    for k, c, _ in ORDERS[1]:
        x, y, n, flat = c * 13 % 1000, k * 8 // 150, 10 + k % 90, k // 10 % 2 == 0
        out[k] = (x, y, x + n * flat, y + n * (not flat))
    return out


def test_closest_street_of_every_building(spark, tmp_path):
    parts = [(i, i % 16) for i in range(1, 60)] + [(2501, 3), (20_003, 4)]
    got = entry.queries()["closest_street_all"](spark, tables(spark, tmp_path, part=("p_partkey bigint, p_size int", parts), orders=ORDERS)).collect()
    want = {}
    for i, size in parts:
        x, y = 20 * (i % 50), 20 * (i // 50)
        a, b = x + 5 + size % 16, y + 5 + i * 7 % 16
        want[i] = round(min(math.hypot(max(0, s[0] - a, x - s[2]), max(0, s[1] - b, y - s[3])) for s in street_boxes().values()), 4)
    assert {r["id"]: r["distance_to_closest_street"] for r in got} == want


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["city_streets_all", "streets_within_100_all", "street_pieces_all", "street_components_all"])
def test_whole_tables_same_as_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == [pytest.approx(r, abs=1e-6) for r in sorted(want)]


def test_road_distance_over_all_line_items(spark):
    rows = duckdb.sql(f"SELECT l_suppkey, l_partkey % (SELECT count(*) FROM '{SF}/supplier.parquet'), min(l_quantity) FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").fetchall()
    best, heap = {}, [(0.0, 1)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for _, v, n in (r for r in rows if r[0] == u):
                heapq.heappush(heap, (d + n, v))
    assert {r["node"]: r["distance"] for r in entry.queries()["road_distance_all"](spark, SF).collect()} == best


def test_duplicates_among_all_streets(spark, tmp_path):
    got = {r["id"] for r in entry.queries()["streets_without_duplicates_all"](spark, tables(spark, tmp_path, orders=ORDERS)).collect()}
    boxes, gone = street_boxes(), set()
    inside = lambda q, p: all(math.hypot(max(0, p[0] - x, x - p[2]), max(0, p[1] - y, y - p[3])) <= 1 for x, y in (q[:2], q[2:]))
    for i, p in boxes.items():
        gone |= {max(i, j) if inside(p, q) else j for j, q in boxes.items() if i != j and inside(q, p)}
    assert got == set(boxes) - gone
