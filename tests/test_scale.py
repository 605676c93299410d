"""What must hold at any size: levels of cells, long paths, tables left behind, work done once."""

import heapq
import math
import os
import random

import pytest
from pyspark.sql import functions as F


def envelopes(spark, rows, name):
    e = F.struct(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias(f"{name}_env")
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"{name} bigint, minx double, miny double, maxx double, maxy double").select(name, e)


def test_envelopes_of_mixed_size(spark):
    from urbanlattice.operators.spatial_join import envelope_join, level

    rng = random.Random(1)

    def boxes(n):
        out = []
        for _ in range(n):
            size = rng.choice([0, 1, 10, 10, 64, 300, 5000])
            x, y = rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)
            out.append((x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)) if rng.random() < 0.7 else (round(x, -1), round(y, -1), round(x, -1) + size, round(y, -1) + size))
        return out

    for n, m in ((150, 170), (40, 1), (1, 40), (60, 0)):
        a, b = boxes(n), boxes(m)
        want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
        got = envelope_join(envelopes(spark, a, "l"), envelopes(spark, b, "r"), 10.0)
        assert sorted(map(tuple, got.select("l", "r").collect())) == want and got.columns == ["l", "l_env", "r", "r_env"]
    k = [x[0] for x in envelopes(spark, [(0, 0, 0, 0), (0, 0, 10, 10), (0, 0, 10.5, 1), (0, 0, 20, 1), (0, 0, 1, 2e6)], "l").select(level(F.col("l_env"), 10.0)).collect()]
    assert k == [0, 0, 1, 1, 18]


def test_one_polygon_over_a_million_cells(spark):
    from urbanlattice.operators.spatial_join import envelope_join

    country = envelopes(spark, [(0, 0, 1e6, 1e6)], "l")
    small = spark.range(20_000).select(F.col("id").alias("r"), F.struct((F.col("id") * 100.0).alias("minx"), F.lit(5.0).alias("miny"), (F.col("id") * 100.0 + 1).alias("maxx"), F.lit(6.0).alias("maxy")).alias("r_env"))
    assert envelope_join(country, small, 500.0).count() == 10_001  # a million cells of 500 m


def dijkstra(edges, start):
    out, heap = {}, [(0.0, start)]
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in out:
            out[u] = d
            for v, w in near.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return out


def test_paths_of_random_graphs(spark):
    from urbanlattice.operators.graph import shortest_paths

    rng = random.Random(2)
    for one_way, n, m in ((0.0, 60, 70), (0.5, 60, 75), (1.0, 50, 140), (0.3, 40, 36)):
        edges = []
        for _ in range(m):
            u, v, w = rng.randrange(n), rng.randrange(n), float(rng.randrange(0, 30))
            edges += [(u, v, w)] if rng.random() < one_way else [(u, v, w), (v, u, w)]
        for k in range(6):  # chains and rings of their own
            at = [rng.randrange(n), *range(1000 + 50 * k, 1000 + 50 * k + rng.randrange(1, 40)), rng.randrange(n)]
            links = [(a, b, float(rng.randrange(1, 9))) for a, b in zip(at, at[1:])]
            edges += links + ([(b, a, w + 1) for a, b, w in links] if k % 2 else [])
        edges += [(2000 + i, 2000 + (i + 1) % 9, 1.0) for i in range(9)]
        starts = [(0, 0), (1, 5), (2, 2003), (3, 1001), (3, 1003), (4, 99_999)]
        df = spark.createDataFrame(edges, "u bigint, v bigint, length double")
        got = {(r["source"], r["node"]): r["distance"] for r in shortest_paths(df, spark.createDataFrame(starts, "source bigint, node bigint"), 3.0).collect()}
        want: dict = {}
        for s, node in starts:
            for v, d in dijkstra(edges, node).items():
                want[s, v] = min(d, want.get((s, v), math.inf))
        assert got == pytest.approx(want)


def test_a_path_of_5000_edges(spark, monkeypatch):
    from urbanlattice.operators import graph

    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    line = spark.range(5000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(2.0).alias("length"))
    back = line.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(3.0).alias("length"))
    got = graph.shortest_paths(line.union(back), spark.createDataFrame([(1, 1000)], "source bigint, node bigint")).agg(F.count("*"), F.max("distance"), F.sum("distance")).first()
    assert tuple(got) == (5001, 8000.0, sum(2.0 * k for k in range(4001)) + sum(3.0 * k for k in range(1001))) and len(rounds) < 40


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_paths_with_and_without_chains(spark, monkeypatch, share):
    from urbanlattice.operators import graph

    monkeypatch.setattr(graph, "IN_CHAINS", share)
    edges = [(i, i + 1, 1.0) for i in range(12)] + [(0, 6, 2.5), (12, 3, 0.5), (6, 3, 9.0)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "u bigint, v bigint, length double"), spark.createDataFrame([(1, 0), (2, 5)], "source bigint, node bigint")).collect()
    assert {(r["source"], r["node"]): r["distance"] for r in got} == {(s, v): d for s, n in ((1, 0), (2, 5)) for v, d in dijkstra(edges, n).items()}


def least_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_graphs(spark, monkeypatch):
    """Also with labels that are looked up in parts, edges to unknown nodes, null nodes and no nodes at all."""
    from urbanlattice.operators import graph

    rng = random.Random(5)
    for m, least_hot in ((150, 10_000), (260, 2), (900, 2)):
        monkeypatch.setattr(graph, "LEAST_HOT", least_hot)
        monkeypatch.setattr(graph, "HOT", 10)
        nodes = rng.sample(range(10_000), 300)
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)] + [(nodes[0], 20_000), (20_000, nodes[1])]
        df = spark.createDataFrame([(n,) for n in [*nodes, None, nodes[3]]], "id bigint")
        got = graph.components(df, spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert len(got) == 300 and {r["id"]: r["component"] for r in got} == least_reachable(nodes, edges)
    assert graph.components(df.limit(0), spark.createDataFrame(edges, "a bigint, b bigint")).count() == 0


def test_components_of_a_shuffled_path(spark, monkeypatch):
    """2,000 nodes in a row in random order of ids: rounds go with the logarithm of its length."""
    from urbanlattice.operators import graph

    at, rounds, cut = list(range(2000)), [], graph.cut
    random.Random(7).shuffle(at)
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    got = graph.components(spark.range(2000), spark.createDataFrame(list(zip(at, at[1:])), "a bigint, b bigint"))
    assert got.select("component").distinct().collect() == [(0,)] and len(rounds) < 20


def test_rounds_leave_one_table(spark, monkeypatch, tmp_path):
    from urbanlattice import session
    from urbanlattice.operators import graph

    monkeypatch.setattr(session, "shared_path", lambda s, name: f"file://{tmp_path}/{name}-{len(os.listdir(tmp_path))}-{random.random()}")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(0, 20, 5.0)], "u bigint, v bigint, length double")
    assert graph.shortest_paths(edges, spark.createDataFrame([(1, 0)], "source bigint, node bigint")).count() == 41
    assert len(os.listdir(tmp_path)) == 1
    comp = graph.components(spark.range(41), edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    assert comp.select("component").distinct().count() == 1 and len(os.listdir(tmp_path)) == 2


def test_spread_runs_nothing(spark):
    """Rows pass a mapper once, also where the table that is spread comes out of a join."""
    from urbanlattice.session import spread

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).mapInArrow(count, "id bigint")
    out = spread(rows.join(spark.range(1000), "id").groupBy("id").count())
    assert seen.value == 0 and len(out.collect()) == 1000 and seen.value == 1000
