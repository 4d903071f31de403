"""Map matching, allocation, tiles, rasters and ways against brute force."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import matching, nearest, raster, tiles

ROADS = "road long, src long, dst long, x1 double, y1 double, x2 double, y2 double, w double"
FIXES = "track long, seq long, x double, y double"


def roads_of(nodes, links):
    return [(k, a, b, *nodes[a], *nodes[b], math.dist(nodes[a], nodes[b])) for k, (a, b) in enumerate(links)]


def snapped(p, road):
    _, _, _, x1, y1, x2, y2, w = road
    s = max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / (w * w)))
    return math.dist(p, (x1 + s * (x2 - x1), y1 + s * (y2 - y1))), s * w


def dijkstra(roads, start, limit):
    near = {}
    for _, a, b, *_, w in roads:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in near[u]:
            if d + w <= limit and d + w < best.get(v, math.inf):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def brute_match(track, roads, sigma, beta, reach, limit, penalty):
    """The best total of a track, and the score of any given sequence."""
    layers = []
    for p in track:
        c = {r[0]: snapped(p, r) for r in roads}
        c = {k: v for k, v in c.items() if v[0] <= reach}
        if c:
            layers.append((p, c))
    ways = {n: dijkstra(roads, n, limit) for r in roads for n in r[1:3]}

    def cost(a, sa, b, sb, straight):
        if a == b:
            way = abs(sa - sb)
        else:
            ra, rb = roads[a], roads[b]
            way = min((ca + ways[u].get(v, math.inf) + cb for u, ca in ((ra[1], sa), (ra[2], ra[-1] - sa)) for v, cb in ((rb[1], sb), (rb[2], rb[-1] - sb))), default=math.inf)
        return min(penalty, abs(way - straight) / beta)

    def total(seq):
        s = 0.0
        for k, ((p, c), road) in enumerate(zip(layers, seq, strict=True)):
            s -= c[road][0] ** 2 / (2 * sigma**2)
            if k:
                q, e = layers[k - 1]
                s -= cost(seq[k - 1], e[seq[k - 1]][1], road, c[road][1], math.dist(p, q))
        return s

    best = {k: -v[0] ** 2 / (2 * sigma**2) for k, v in layers[0][1].items()}
    for (q, e), (p, c) in zip(layers, layers[1:], strict=False):
        best = {b: max(best[a] - cost(a, e[a][1], b, c[b][1], math.dist(p, q)) for a in e) - c[b][0] ** 2 / (2 * sigma**2) for b in c}
    return max(best.values()), total


@pytest.mark.parametrize("piece", [3, 256])
def test_matching_is_the_best_sequence(spark, monkeypatch, piece):
    monkeypatch.setattr(matching, "PIECE", piece)
    r = random.Random(6)
    nodes = {i * 4 + j: (i * 50 + r.uniform(-9, 9), j * 50 + r.uniform(-9, 9)) for i in range(4) for j in range(4)}
    links = [(a, b) for a in nodes for b in nodes if a < b and math.dist(nodes[a], nodes[b]) < 70 and r.random() < 0.8]
    roads = roads_of(nodes, links)
    tracks = {}
    for t in range(6):
        x, y = r.uniform(0, 150), r.uniform(0, 150)
        for _ in range(25):
            x, y = x + r.gauss(0, 15), y + r.gauss(0, 15)
            tracks.setdefault(t, []).append((x, y))
    rows = [(t, k, *p) for t, ps in tracks.items() for k, p in enumerate(ps)]
    settings = (8.0, 10.0, 30.0, 120.0, 4.0)
    got = matching.matched(spark.createDataFrame(rows, FIXES), spark.createDataFrame(roads, ROADS), *settings).collect()
    for t, ps in tracks.items():
        mine = [x.road for x in sorted((x for x in got if x.track == t), key=lambda x: x.seq)]
        best, total = brute_match(ps, roads, *settings)
        assert total(mine) == pytest.approx(best)


def test_a_track_takes_the_detour_its_links_demand(spark):
    # two parallel roads a little apart, joined only at the far end; one fix jumps nearer to the other road
    nodes = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (200.0, 0.0), 3: (0.0, 12.0), 4: (100.0, 12.0), 5: (200.0, 12.0)}
    roads = roads_of(nodes, [(0, 1), (1, 2), (3, 4), (4, 5), (2, 5)])
    straight = [(10.0 + 15 * k, 7.5 if k == 4 else 1.0) for k in range(12)]
    turn = [(150.0 + 15 * k, 1.0) for k in range(4)] + [(199.0, 6.0)] + [(195.0 - 15 * k, 11.0) for k in range(8)]
    far = [(10.0, 500.0), (20.0, 500.0)]
    rows = [(t, k, *p) for t, ps in enumerate((straight, turn, far)) for k, p in enumerate(ps)]
    got = matching.matched(spark.createDataFrame(rows, FIXES), spark.createDataFrame(roads, ROADS), 5.0, 5.0, 20.0, 300.0, 10.0).collect()
    path = lambda t: [x.road for x in sorted((x for x in got if x.track == t), key=lambda x: x.seq)]
    assert set(path(0)) == {0, 1} and path(0) == sorted(path(0))
    assert [k for k, before in zip(path(1), [None, *path(1)], strict=False) if k != before] == [1, 4, 3, 2]
    assert path(2) == []


def test_ways_are_dijkstras(spark):
    r = random.Random(4)
    nodes = {i: (r.uniform(0, 100), r.uniform(0, 100)) for i in range(40)}
    roads = roads_of(nodes, [(a, b) for a in nodes for b in nodes if a < b and math.dist(nodes[a], nodes[b]) < 22])
    got = {(x.u, x.v): x.dist for x in matching.ways_within(spark.createDataFrame(roads, ROADS), 60.0).collect()}
    want = {(u, v): d for u in {n for x in roads for n in x[1:3]} for v, d in dijkstra(roads, u, 60.0).items()}
    assert got == pytest.approx(want)
    assert matching.matched(spark.createDataFrame([], FIXES), spark.createDataFrame(roads, ROADS), 1.0, 1.0, 1.0, 1.0, 1.0).count() == 0


# allocation


@pytest.mark.parametrize("ranked", [4096, 8])
def test_exchanges_end_where_none_gains(spark, monkeypatch, ranked):
    monkeypatch.setattr(nearest, "RANKED", ranked)
    r = random.Random(12)
    p = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(40)]
    f = [(k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(5)]
    place = {k: (x, y) for k, x, y in f}
    start = [(i, r.randrange(4)) for i, *_ in p]  # nothing at the last facility
    capacity = max(sum(s == k for _, s in start) for k in range(5))
    got = nearest.exchanged(spark.createDataFrame(start, "id long, sid long"), spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(f, "sid long, sx double, sy double"), capacity).collect()
    at = {x.id: x.sid for x in got}
    load = {k: sum(s == k for s in at.values()) for k in place}
    assert sorted(at) == list(range(40)) and max(load.values()) <= capacity
    d = {(i, k): math.dist((x, y), place[k]) for i, x, y in p for k in place}
    assert all(x.d == pytest.approx(d[x.id, x.sid]) for x in got)
    assert sum(d[i, at[i]] for i in at) < sum(d[i, k] for i, k in start)
    for i in at:
        for k in place:
            assert load[k] == capacity or d[i, at[i]] <= d[i, k] + 1e-6
        for j in at:
            assert d[i, at[i]] + d[j, at[j]] <= d[i, at[j]] + d[j, at[i]] + 1e-6


# tiles and polygons


def test_runs_keep_length_and_meet_at_borders(spark):
    r = random.Random(3)
    lines = {0: [(r.uniform(-90, 90), r.uniform(-90, 90)) for _ in range(40)], 1: [(0.0, 0.0), (32.0, 0.0), (32.0, 64.0), (32.0, 64.0), (-32.0, 0.0)], 2: [(16.0, 16.0), (48.0, 48.0)]}
    legs = [(k, i, *a, *b) for k, p in lines.items() for i, (a, b) in enumerate(zip(p, p[1:], strict=False))]
    table = spark.createDataFrame(legs, "line long, seq long, x1 double, y1 double, x2 double, y2 double")
    cut = tiles.runs(tiles.cut(table, [0, 2, 3], 256.0)).collect()
    thin = tiles.vector_tiles(table, [0, 2, 3], 256.0, tolerance=8.0).collect()
    for zoom in (0, 2, 3):
        side = 256 / 2**zoom
        for k, p in lines.items():
            mine = sorted((x for x in cut if (x.zoom, x.line) == (zoom, k)), key=lambda x: x.part)
            assert [x.part for x in mine] == list(range(len(mine)))
            assert sum(x.length for x in mine) == pytest.approx(sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)))
            for x in mine:
                assert all(x.tx * side - 1e-6 <= q.x <= (x.tx + 1) * side + 1e-6 and x.ty * side - 1e-6 <= q.y <= (x.ty + 1) * side + 1e-6 for q in x.points)
            assert all(math.dist(a.points[-1], b.points[0]) < 1e-9 for a, b in zip(mine, mine[1:], strict=False))
    whole = {(x.zoom, x.line, x.part): x for x in cut}
    assert len(whole) == len(cut) == len(thin)
    for x in thin:
        full = whole[x.zoom, x.line, x.part].points
        assert (x.points[0], x.points[-1]) == (full[0], full[-1]) and set(x.points) <= set(full)
    assert sum(len(x.points) for x in thin) < sum(len(x.points) for x in cut)


def test_polygon_cells_by_rule(spark):
    # a square of eight with a hole of four, and a triangle
    ring = lambda i, p: [(i, *a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]
    hole = [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]
    triangle = [(20.2, 0.3), (29.7, 1.1), (23.1, 8.9)]
    edges = spark.createDataFrame(ring(1, square) + ring(1, hole) + ring(2, triangle), "id long, x1 double, y1 double, x2 double, y2 double")
    cells = {rule: {(x.id, x.r, x.c) for x in tiles.rasterized(edges, 1.0, rule).collect()} for rule in ("centre", "touch", "inside")}
    assert sum(i == 1 for i, *_ in cells["centre"]) == 64 - 16
    assert cells["inside"] < cells["centre"] < cells["touch"]

    def inside(x, y):
        n = 0
        for (x1, y1), (x2, y2) in zip(triangle, triangle[1:] + triangle[:1], strict=True):
            if (y1 <= y < y2 or y2 <= y < y1) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                n += 1
        return n % 2 == 1

    assert {(r, c) for i, r, c in cells["centre"] if i == 2} == {(r, c) for r in range(12) for c in range(15, 35) if inside(c + 0.5, r + 0.5)}
    fine = [(r, c, x, y) for r in range(12) for c in range(15, 35) for x, y in [(c + i / 16, r + j / 16) for i in range(17) for j in range(17)]]
    some = {(r, c) for r, c, x, y in fine if inside(x, y)}
    every = {(r, c) for r, c, *_ in fine} - {(r, c) for r, c, x, y in fine if not inside(x, y)}
    assert some <= {(r, c) for i, r, c in cells["touch"] if i == 2}
    assert {(r, c) for i, r, c in cells["inside"] if i == 2} <= every


# ways, shadows and fetch over a raster


def grid(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row) if v is not None], "r long, c long, v double")


def test_ways_over_a_grid(spark):
    r = random.Random(5)
    values = [[None if r.random() < 0.25 else r.choice((1, 2, 5)) for _ in range(18)] for _ in range(14)]
    values[0][0] = values[13][17] = 1
    cells = grid(spark, values)
    far = raster.entry_cost(cells, spark.createDataFrame([(0, 0)], "r long, c long"))
    best, heap = {(0, 0): 0.0}, [(0.0, (0, 0))]
    while heap:
        d, (a, b) = heapq.heappop(heap)
        if d > best[a, b]:
            continue
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                k = (a + i, b + j)
                if (i or j) and 0 <= k[0] < 14 and 0 <= k[1] < 18 and values[k[0]][k[1]] is not None:
                    e = d + values[k[0]][k[1]] * math.hypot(i, j)
                    if e < best.get(k, math.inf) - 1e-12:
                        best[k] = e
                        heapq.heappush(heap, (e, k))
    goals = [(f"{a}-{b}", a, b) for a, b in ((13, 17), (0, 0), (7, 9), (2, 16)) if values[a][b] is not None] + [("none", 50, 50)]
    got = raster.ways_from(far, spark.createDataFrame(goals, "goal string, r long, c long")).collect()
    for name, a, b in goals:
        way = sorted((x for x in got if x.goal == name), key=lambda x: x.step)
        if (a, b) not in best:
            assert way == []
            continue
        assert [x.step for x in way] == list(range(len(way))) and (way[0].r, way[0].c, way[-1].r, way[-1].c) == (0, 0, a, b)
        cost = 0.0
        for p, q in zip(way, way[1:], strict=False):
            assert max(abs(p.r - q.r), abs(p.c - q.c)) == 1
            cost += values[q.r][q.c] * math.hypot(p.r - q.r, p.c - q.c)
        assert cost == pytest.approx(best[a, b])


@pytest.mark.parametrize("azimuth", [0.0, 90.0, 180.0, 270.0])
def test_shadow_of_a_tower(spark, azimuth):
    cells = grid(spark, [[10.0 if (r, c) == (6, 6) else 0.0 for c in range(13)] for r in range(13)])
    got = {(x.r, x.c) for x in raster.cast_shadows(cells, azimuth, math.degrees(math.atan(3.0))).collect()}
    away = (round(math.cos(math.radians(azimuth))), -round(math.sin(math.radians(azimuth))))
    assert got == {(6 + k * away[0], 6 + k * away[1]) for k in (1, 2, 3)}
    with pytest.raises(ValueError):
        raster.cast_shadows(cells, 0.0, 0.0)


def test_fetch_ends_at_land_holes_and_the_edge(spark):
    #            water everywhere but land at (2, 5) and no cell at (4, 3)
    values = [[1.0 if (r, c) == (2, 5) else None if (r, c) == (4, 3) else 0.0 for c in range(7)] for r in range(6)]
    water = F.col("v") == 0
    for azimuth in (0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0):
        got = {(x.r, x.c): x.fetch for x in raster.fetches(grid(spark, values), water, azimuth).collect()}
        dr, dc = -math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
        for r in range(6):
            for c in range(7):
                if values[r][c] != 0:
                    assert (r, c) not in got
                    continue
                last = 0
                for k in range(1, 40):
                    a, b = round(r + k * dr), round(c + k * dc)
                    if not (0 <= a < 6 and 0 <= b < 7) or values[a][b] != 0:
                        break
                    last = k
                assert got[r, c] == last, (azimuth, r, c)
