"""Operators without SQL, against brute force on small fixtures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import codes
from gridloom.operators import geometry, graphs, joins, nearest, raster, routes, statistics, tracks, triangulation
from gridloom.sources import text
from gridloom.streaming import stateful


def scattered(n, seed=7, side=100.0):
    r = random.Random(seed)
    return [(i, r.uniform(0, side), r.uniform(0, side)) for i in range(n)]


def test_hilbert_visits_neighbours(spark):
    cells = spark.createDataFrame([(x, y) for x in range(16) for y in range(16)], "x long, y long")
    rows = sorted(cells.select("x", "y", codes.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect(), key=lambda r: r.d)
    assert [r.d for r in rows] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_dbscan(spark):
    pts = scattered(150)
    got = {r.id: r.cluster for r in statistics.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), 8.0, 4).collect()}
    near = {i: [j for j, a, b in pts if math.hypot(a - x, b - y) <= 8.0] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= 4}
    label, k = {}, 0
    for i in sorted(core):
        if i not in label:
            k += 1
            todo = [i]
            while todo:
                j = todo.pop()
                if label.setdefault(j, k) == k:
                    todo += [m for m in near[j] if m in core and m not in label]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in near}
    assert got == want


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (8, 7)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    got = {r.node: r.root for r in joins.components(pairs, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 10}


def test_spanning_tree_and_shortest(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.5), (2, 3, 9.0), (0, 2, 5.0)]
    both = graphs.both_ways(spark.createDataFrame(edges, "src long, dst long, w double"))
    assert sorted((r.src, r.dst) for r in graphs.spanning_tree(both).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    far = {r.node: r.dist for r in graphs.shortest(both, spark.createDataFrame([(0,)], "source long")).collect()}
    assert far == {0: 0.0, 1: 1.0, 2: 3.0, 3: 12.0, 4: 13.5}


def test_betweenness_of_a_path(spark):
    both = graphs.both_ways(spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "src long, dst long, w double"))
    got = {r.node: r.score for r in graphs.betweenness(both, spark.createDataFrame([(i,) for i in range(5)], "source long")).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 3.0, 2: 4.0, 3: 3.0}


def test_betweenness_of_a_random_graph(spark):
    r = random.Random(5)
    edges = {(i, j): float(r.randrange(1, 4)) for i in range(12) for j in range(i) if r.random() < 0.3}
    near: dict = {}
    for (i, j), w in edges.items():
        near.setdefault(i, []).append((j, w))
        near.setdefault(j, []).append((i, w))
    want = dict.fromkeys(near, 0.0)

    def ways(at, goal, far, path):  # all shortest ways, by their lengths
        if at == goal:
            yield path
        for v, w in near[at]:
            if abs(far[v] + w - far[at]) < 1e-9:
                yield from ways(v, goal, far, [*path, v])

    for goal in near:
        far = {v: math.inf for v in near} | {goal: 0.0}
        for _ in near:
            for v in near:
                far[v] = min([far[v], *(far[u] + w for u, w in near[v])])
        for s in near:
            if s < goal and far[s] < math.inf:
                found = list(ways(s, goal, far, [s]))
                for path in found:
                    for v in path[1:-1]:
                        want[v] += 1 / len(found)
    both = graphs.both_ways(spark.createDataFrame([(i, j, w) for (i, j), w in edges.items()], "src long, dst long, w double"))
    got = {q.node: q.score for q in graphs.betweenness(both, spark.createDataFrame([(v,) for v in near], "source long")).collect()}
    assert all(got.get(v, 0.0) == pytest.approx(x) for v, x in want.items())


def test_cost_distance_over_tiles(spark):
    r = random.Random(3)
    v = {(i, j): r.uniform(1, 9) for i in range(9) for j in range(11)}
    cells = spark.createDataFrame([(i, j, x) for (i, j), x in v.items()], "r long, c long, v double")
    source = spark.createDataFrame([(0, 0)], "r long, c long").withColumn("cost", F.lit(0.0))
    step = lambda x, a, b, length: x + (a + b) / 2 * length
    got = {(q.r, q.c): q.cost for q in raster.spread_from(cells, source, step, tile=4).collect()}
    want = {k: math.inf for k in v}
    want[0, 0] = 0.0
    for _ in range(len(v)):
        for (i, j), x in list(want.items()):
            for a, b in raster.ROUND:
                if (i + a, j + b) in v:
                    want[i + a, j + b] = min(want[i + a, j + b], x + (v[i, j] + v[i + a, j + b]) / 2 * (math.sqrt(2) if a and b else 1))
    assert all(abs(got[k] - want[k]) < 1e-9 for k in v)


def test_fill_sinks_leaves_no_sink(spark):
    r = random.Random(5)
    cells = spark.createDataFrame([(i, j, r.uniform(0, 50)) for i in range(8) for j in range(8)], "r long, c long, v double")
    z = {(q.r, q.c): (q.v, q.filled) for q in raster.fill_sinks(cells).collect()}
    for (i, j), (v, f) in z.items():
        assert f >= v
        if 0 < i < 7 and 0 < j < 7:
            assert any(z[i + a, j + b][1] <= f for a, b in raster.ROUND)


def test_quadtree_holds_every_point_once(spark):
    pts = spark.createDataFrame(scattered(300, side=1000.0), "id long, x double, y double")
    leaves = nearest.quadtree_leaves(pts, 8, 1024.0).collect()
    assert sum(q.n for q in leaves) == 300
    assert all(q.n <= 8 for q in leaves)


def test_hull_and_circle(spark):
    pts = scattered(60)
    h = geometry.hull([(x, y) for _, x, y in pts])
    assert all(geometry.turn(a, b, (x, y)) >= -1e-9 for a, b in zip(h, h[1:] + h[:1], strict=True) for _, x, y in pts)
    cx, cy, r = geometry.least_circle(h)
    assert max(math.hypot(x - cx, y - cy) for _, x, y in pts) == pytest.approx(r, abs=1e-6)


def test_triangulated_circles_are_empty():
    p = [(x, y) for _, x, y in scattered(40)]
    tri = [t for t in triangulation.triangulate(p) if triangulation.OUTSIDE not in t]
    h = len(geometry.hull(p))
    assert len(tri) == 2 * len(p) - 2 - h
    for t in tri:
        x, y, r = geometry.circumcircle(*(p[i] for i in t))
        assert all((a - x) ** 2 + (b - y) ** 2 >= r * (1 - 1e-9) for a, b in p)


def test_minkowski_against_all_sums():
    s = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert geometry.minkowski(s, s) == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    r = random.Random(11)
    for _ in range(200):
        a, b = (geometry.hull([(r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(r.randrange(3, 12))]) for _ in range(2))
        sums = geometry.hull([(p[0] + q[0], p[1] + q[1]) for p in a for q in b])
        assert geometry.ring_area(geometry.minkowski(a, b)) == pytest.approx(geometry.ring_area(sums))


@pytest.mark.parametrize("kind", ["scattered", "clusters", "lattice", "speck"])
def test_triangles_of_tiles_are_the_whole_sets(spark, kind):
    r = random.Random(4)
    pts = {
        "scattered": scattered(250),
        "clusters": [(i, r.gauss(20 + 60 * (i % 3 == 0), 2), r.gauss(20 + 60 * (i % 2), 3)) for i in range(250)],
        "lattice": [(i, float(i % 12), float(i // 12)) for i in range(144)],
        "speck": [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(60)] + [(60 + i, 400 + r.gauss(0, 0.2), 300 + r.gauss(0, 0.2)) for i in range(340)],
    }[kind]
    tri = triangulation.triangles(spark.createDataFrame([*pts, (999, *pts[0][1:])], "id long, x double, y double"), 20.0)
    got, at = tri.collect(), {i: (x, y) for i, x, y in pts}
    used = {v for q in got for v in (q.a, q.b, q.c)}
    assert used == set(at)
    for q in got:
        x, y, r2 = geometry.circumcircle(*(at[v] for v in (q.a, q.b, q.c)))
        assert all((p - x) ** 2 + (s - y) ** 2 >= r2 * (1 - 1e-9) for p, s in at.values())
    covered = sum(abs(geometry.turn(*(at[v] for v in (q.a, q.b, q.c)))) / 2 for q in got)
    if kind != "lattice":  # where four points lie on a circle, tiles may choose either diagonal
        assert covered == pytest.approx(geometry.ring_area(geometry.hull(list(at.values()))))
    edges = [(math.dist(at[i], at[j]), i, j) for i in at for j in at if i < j]
    root = {i: i for i in at}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    length = 0.0
    for d, i, j in sorted(edges):
        if find(i) != find(j):
            root[find(i)] = find(j)
            length += d
    near = triangulation.gabriel(tri).select("src", "dst", "w")
    tree = graphs.spanning_tree(near).collect()
    assert len(tree) == len(at) - 1 and sum(q.w for q in tree) == pytest.approx(length)


def test_crowded_tiles_are_split(spark):
    r = random.Random(6)
    pts = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(100)] + [(100 + i, 500 + r.uniform(0, 1), 500 + r.uniform(0, 1)) for i in range(1400)]
    p, levels = triangulation.quadrants(spark.createDataFrame(pts, "id long, x double, y double"), 250.0, 100)
    sizes = p.groupBy("lv", "__cx", "__cy").count().collect()
    assert sum(q["count"] for q in sizes) == 1500 and max(q["count"] for q in sizes) <= 100 and len(levels) > 3
    begun = triangulation.surroundings(p, levels, 250.0)
    held = begun.groupBy("lv", "tx", "ty").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).collect()
    assert len(held) == len(sizes) and sum(q.own for q in held) == 1500 and max(q.n for q in held) <= 9 * 100 + 9 * 16
    # the tiles that a disc touches hold all points inside it
    discs = spark.createDataFrame([(0, 500.5, 500.5, 0.04), (1, 400.0, 480.0, 14400.0), (2, -50.0, 0.0, 1e6)], "k long, x double, y double, r2 double")
    met = triangulation.tiles_of(discs, levels, 250.0, (0.0, 0.0), (1000.0, 1000.0)).join(p.drop("x", "y"), ["lv", "__cx", "__cy"]).select("k", "id").collect()
    assert len(met) == len(set(met))
    for k, x, y, r2 in discs.collect():
        assert {i for i, a, b in pts if (a - x) ** 2 + (b - y) ** 2 <= r2} <= {q.id for q in met if q.k == k}


def test_points_in_a_line_have_no_triangle(spark):
    assert triangulation.triangles(spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(9)], "id long, x double, y double")).count() == 0


def test_knn_join(spark):
    pts, qs = scattered(120, 3), [(i, x * 2 - 30, y) for i, x, y in scattered(40, 8)]
    p = spark.createDataFrame(pts, "sid long, sx double, sy double")
    q = spark.createDataFrame(qs, "id long, x double, y double")
    for k in (1, 5, 200):
        got: dict = {}
        for t in joins.knn_join(q, p, k).collect():
            got.setdefault(t.query, []).append((t.rank, t.point))
        for i, x, y in qs:
            want = sorted((((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in pts)[:k]
            assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert joins.knn_join(q, p.limit(0), 2).count() == 0 and joins.knn_join(q.limit(0), p, 2).count() == 0
    assert joins.knn_join(q, p.limit(1), 2).count() == len(qs)


@pytest.mark.parametrize("k", [1, 3])
def test_knn_join_where_points_crowd(spark, monkeypatch, k):
    monkeypatch.setattr(joins, "HEAVY", 4)
    monkeypatch.setattr(joins, "FEW", 0)
    r = random.Random(3)
    points = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(40)] + [(100 + i, 50 + r.gauss(0, 0.1), 50 + r.gauss(0, 0.1)) for i in range(60)] + [(300 + i, 7.0, 7.0) for i in range(30)]
    queries = [(i, r.uniform(-20, 120), r.uniform(-20, 120)) for i in range(40)] + [(100 + i, 50 + r.gauss(0, 0.2), 50 + r.gauss(0, 0.2)) for i in range(40)] + [(200, 7.0, 7.0), (305, 7.0, 7.0)]
    p = spark.createDataFrame(points, "sid long, sx double, sy double")
    sizes = [cells.count() for _, cells in joins.crowded(p.toDF("point", "__px", "__py"), 20.0, 6, 9)]
    assert len(sizes) == 9 and sizes[-1] == 1  # thirty at one place
    for same in (k == 3,):
        got = {}
        for q in joins.knn_join(spark.createDataFrame(queries, "id long, x double, y double"), p, k, exclude_same=same).collect():
            got.setdefault(q.query, []).append((q.rank, q.point, q.d2))
        for i, x, y in queries:
            want = sorted((((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in points if not (same and i == j)))[:k]
            mine = sorted(got[i])
            assert [j for _, j, _ in mine] == [j for _, j in want] and [n for n, *_ in mine] == list(range(1, k + 1))
            assert [d for *_, d in mine] == pytest.approx([d for d, _ in want])


def test_mean_shift_like_the_sequential_one(spark):
    r = random.Random(6)
    pts = [(i, r.gauss(30 * (i % 3), 4), r.gauss(10, 4)) for i in range(60)]
    got = {q.id: (q.mode, q.x, q.y) for q in statistics.mean_shift(spark.createDataFrame(pts, "id long, x double, y double"), 12.0).collect()}
    modes, want = [], {}
    for i, x, y in pts:
        for _ in range(200):
            near = [(a, b) for _, a, b in pts if (a - x) ** 2 + (b - y) ** 2 <= 144]
            nx, ny = sum(a for a, _ in near) / len(near), sum(b for _, b in near) / len(near)
            d, x, y = math.hypot(nx - x, ny - y), nx, ny
            if d < 1e-6:
                break
        k = next((m for m in modes if math.hypot(m[1] - x, m[2] - y) <= 6), None)
        if k is None:
            modes.append(k := (i, x, y))
        want[i] = k
    assert set(got) == set(want)
    for i, (m, x, y) in want.items():
        assert got[i][0] == m and got[i][1:] == pytest.approx((x, y), abs=1e-6)


def test_distance_thinning_is_greedy(spark):
    pts = scattered(200, 9)
    got = {q.id for q in statistics.distance_thin(spark.createDataFrame(pts, "id long, x double, y double"), 9.0).collect()}
    kept: list = []
    for i, x, y in pts:
        if all(math.hypot(x - a, y - b) >= 9.0 for _, a, b in kept):
            kept.append((i, x, y))
    assert got == {i for i, *_ in kept}


def test_inverse_distance_is_exact_at_samples(spark):
    s = [(5, 1.0, 1.0, 7.0), (2, 1.0, 1.0, 3.0), (3, 4.0, 5.0, 9.0), (4, 0.0, 2.0, 1.0)]
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0)], "id long, x double, y double")
    got = {q.id: q.v for q in statistics.inverse_distance(p, spark.createDataFrame(s, "sid long, sx double, sy double, v double"), block=2).collect()}
    w = [1 / ((2 - x) ** 2 + (2 - y) ** 2) for _, x, y, _ in s]
    assert got[0] == 3.0 and got[1] == pytest.approx(sum(a * v for a, (*_, v) in zip(w, s, strict=True)) / sum(w))


def test_inverse_distance_of_repeated_and_null_sample_ids(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0)], "id long, x double, y double")
    for ids in ((1, 1), (None, None), (1, None)):
        s = spark.createDataFrame([(ids[0], 1.0, 0.0, 10.0), (ids[1], 2.0, 0.0, 20.0)], "sid long, sx double, sy double, v double")
        for block in (1, 4096):
            got = {r.id: r.v for r in statistics.inverse_distance(p, s, block=block).collect()}
            assert got == pytest.approx({1: 12.0, 2: 18.0})
    s = spark.createDataFrame([(None, 3.0, 0.0, 5.0), (4, 3.0, 0.0, 7.0), (4, 3.0, 0.0, 6.0)], "sid long, sx double, sy double, v double")
    assert {r.id: r.v for r in statistics.inverse_distance(p, s, block=1).collect()}[2] == 6.0


def test_distance_transform_without_and_with_cells(spark):
    r = random.Random(2)
    cells = {(i, j): r.random() < 0.05 for i in range(9) for j in range(14)}
    df = spark.createDataFrame([(i, j, b) for (i, j), b in cells.items()], "r long, c long, b boolean")
    got = {(q.r, q.c): q.d2 for q in raster.distance_transform(df, F.col("b")).collect()}
    assert got == {(i, j): min((i - a) ** 2 + (j - b) ** 2 for (a, b), on in cells.items() if on) for i, j in cells}
    assert {q.d2 for q in raster.distance_transform(df, F.lit(False)).collect()} == {None}


def test_turn_costs_count_lengths_and_turns(spark):
    grid = [[1.0, 9.0, 9.0], [1.0, 1.0, 9.0], [9.0, 1.0, 1.0]]
    df = spark.createDataFrame([(0, i, j, grid[i][j]) for i in range(3) for j in range(3)], "g long, r long, c long, v double")
    q = routes.turn_costs(df, "g", 0.0).first()
    assert q.cost == pytest.approx(2 * math.sqrt(2)) and [(p.r, p.c) for p in q.path] == [(0, 0), (1, 1), (2, 2)]
    grid[1][1] = 50.0
    df = spark.createDataFrame([(0, i, j, grid[i][j]) for i in range(3) for j in range(3)], "g long, r long, c long, v double")
    assert routes.turn_costs(df, "g", 0.0).first().cost == pytest.approx(2 + math.sqrt(2))
    assert routes.turn_costs(df, "g", 10.0).first().cost == pytest.approx(2 + math.sqrt(2) + 20)


def test_area_simplification_by_current_areas():
    import numpy as np

    r = random.Random(15)
    area = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
    for _ in range(100):
        p = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(14)]
        left = list(range(14))
        while len(left) > 5:
            left.pop(min(range(1, len(left) - 1), key=lambda k: area(*(p[i] for i in left[k - 1 : k + 2]))))
        assert np.flatnonzero(tracks.removal_order(np.array(p), 5)).tolist() == left


def test_ears_and_pole():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    assert sum(geometry.turn(*(ring[i] for i in t)) / 2 for t in geometry.ears(ring)) == pytest.approx(geometry.ring_area(ring))
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert geometry.inner_pole(square, 0.001)[2] == pytest.approx(2, abs=0.01)


def test_stops_and_compression(spark):
    rows = [(1, i, float(i * 60), 0.0 if i < 10 else (i - 9) * 50.0, 0.0) for i in range(20)]
    f = spark.createDataFrame(rows, "track long, seq long, t double, x double, y double")
    s = tracks.stops(f, 5.0, 300.0).collect()
    assert [(q.first, q.last) for q in s] == [(0, 9)]
    assert [q.seq for q in tracks.compressed(f, 1.0).orderBy("seq").collect()] == [0, 19]
    assert {0, 9, 19} <= {q.seq for q in tracks.compressed(f, 1.0, timed=True).collect()}


def test_times_must_grow(spark):
    f = spark.createDataFrame([(1, 1, 5.0, 0.0, 0.0), (1, 2, 5.0, 1.0, 1.0)], "track long, seq long, t double, x double, y double")
    with pytest.raises(Exception, match="times must grow"):
        tracks.speeds(f).collect()


def test_frechet_and_warp(spark):
    a = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(4)], "track long, seq long, x double, y double")
    b = spark.createDataFrame([(2, i, float(i), 1.0) for i in range(4)], "track long, seq long, x double, y double")
    q = tracks.paired(a, b).select(tracks.coupling("frechet")("line_a", "line_b").alias("f"), tracks.coupling("warp")("line_a", "line_b").alias("w")).first()
    assert (q.f, q.w) == (1.0, 4.0)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 4, 40.0), (1, 5, 50.0), (2, 3, 30.0)], "k long, t long, v double")
    got = {r.name: r.v for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": None}


def test_strahler(spark):
    # two heads meet, then a third joins
    flow = [(0, 0, 1, 1), (0, 2, 1, 1), (1, 1, 2, 1), (1, 3, 2, 1), (2, 1, None, None)]
    got = {(q.r, q.c): q.stream for q in raster.strahler(spark.createDataFrame(flow, "r long, c long, tr long, tc long")).collect()}
    assert got == {(0, 0): 1, (0, 2): 1, (1, 3): 1, (1, 1): 2, (2, 1): 2}


def test_bloom_never_misses(spark):
    t = spark.range(500).select(F.col("id").alias("tile"))
    words = stateful.bloom_bits(t, 1 << 14, 3)
    assert stateful.bloom_seen(t, words, 1 << 14, 3).filter("not seen").count() == 0
    other = spark.range(100000, 101000).select(F.col("id").alias("tile"))
    assert stateful.bloom_seen(other, words, 1 << 14, 3).filter("seen").count() < 50


def test_fat_boxes_stream_like_the_table(spark, tmp_path):
    rows = [(k, i, float(i * (k + 1)), 0.0) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "track long, seq long, x double, y double")
    want = {r.track: r.updates for r in stateful.fat_box_updates(df, 10.0).collect()}
    df.filter("seq < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("seq >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = stateful.fat_box_stream(stream, 10.0).writeStream.outputMode("update").format("memory").queryName("fat").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.track: r.u for r in spark.table("fat").groupBy("track").agg(F.max("updates").alias("u")).collect()} == want


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = stateful.windowed(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win").agg(F.sum("n")).first()[0] == e.count()


def test_geojson_that_is_not_a_line_or_ring(spark):
    bad = ['{"type":"LineString","coordinates":[[1,2]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}', '{"type":"Polygon","coordinates":[]}', "[1,2", '{"type":"Point","coordinates":[1,2]}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "i int, t string")
    assert {q.p for q in df.select(text.geojson_points(F.col("t")).alias("p")).collect()} == {None}
    ok = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[9,9]]]}',)], "t string").select(text.geojson_points(F.col("t")).alias("p")).first().p
    assert [(p.x, p.y) for p in ok] == [(0, 0), (1, 0), (1, 1)]
    feature = spark.range(1).select(text.geojson_geometry(F.lit('{"type":"Topology"}')).alias("g")).first().g
    assert feature is None


def test_allocation_serves_by_regret(spark):
    pts, fac = scattered(90, 12), scattered(6, 13)
    p = spark.createDataFrame(pts, "id long, x double, y double")
    f = spark.createDataFrame(fac, "sid long, sx double, sy double")
    got = {q.id: q.sid for q in nearest.allocate(p, f, 16).collect()}
    order = {i: sorted((math.hypot(x - a, y - b), j) for j, a, b in fac) for i, x, y in pts}
    room, want = dict.fromkeys(range(6), 16), {}
    for i in sorted(order, key=lambda i: (-(order[i][1][0] - order[i][0][0]), i)):
        want[i] = next(j for _, j in order[i] if room[j])
        room[want[i]] -= 1
    assert got == want
    with pytest.raises(ValueError, match="hold every point"):
        nearest.allocate(p, f, 14)


def test_cells_along_hold_every_point_of_the_segment(spark):
    r = random.Random(3)
    seg = [(i, *(r.choice([r.uniform(-50, 50), float(r.randrange(-5, 5) * 10)]) for _ in range(4))) for i in range(60)] + [(60, 5.0, -20.0, 5.0, 30.0), (61, 10.0, 0.0, 10.0, 0.0)]
    cells: dict = {}
    for q in nearest.cells_along(spark.createDataFrame(seg, "id long, x1 double, y1 double, x2 double, y2 double"), 10.0, "x1", "y1", "x2", "y2").collect():
        cells.setdefault(q.id, set()).add((q["__cx"], q["__cy"]))
    for i, a, b, c, d in seg:
        for k in range(101):
            x, y = a + (c - a) * k / 100, b + (d - b) * k / 100
            if any(abs(v / 10 - round(v / 10)) < 1e-9 for v in (x, y)):
                continue  # this sum's own rounding decides the cell
            assert (math.floor(x / 10), math.floor(y / 10)) in cells[i]
