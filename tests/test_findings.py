"""Findings of the third round, each on the input that showed it."""

from __future__ import annotations

from compare import difference

import __spark_entry__ as entry


def test_directions_one_unit_apart_keep_their_order(spark, tmp_path):
    """Among these sites are 22 whose direction differs by less than Spark's own atan2 is off."""
    spark.range(6000).select("id").withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert not difference(spark, "angularsort", entry.queries()["angularsort"], entry.oracle_sql()["angularsort"], str(tmp_path))


def test_a_rank_computes_its_key_once(spark, monkeypatch):
    """The key of a ranking isn't put into a loop over the slices' bounds; ranks are those of one sort."""
    from pyspark.sql import functions as F

    from gridloom.functions import codes
    from gridloom.operators import nearest

    p = spark.range(3000).select("id", (F.col("id") * 7919 % 1009).alias("x"), (F.col("id") * 104729 % 997).alias("y"))
    ranked = nearest.global_rank(p.withColumn("d", codes.hilbert(F.col("x"), F.col("y"), 10)), ["d", "id"], "n")
    assert "lambda" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(ranked.collect(), key=lambda r: (r["d"], r["id"]))
    assert [r["n"] for r in rows] == list(range(3000))
    back = p.withColumn("c", F.struct(*[c.alias(n) for n, c in zip("xy", codes.hilbert_cell(codes.hilbert(F.col("x"), F.col("y"), 10), 10))]))
    assert back.filter("c.x != x or c.y != y").isEmpty()


def test_points_meet_rings_in_blocks_of_a_crowded_cell(spark, monkeypatch):
    """Points in rings, by either way, are those of the test pair by pair, also where cells are cut into blocks; few pairs are tested."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import joins, nearest

    rng = random.Random(7)
    monkeypatch.setattr(joins, "BLOCK", 40)
    # on a lattice, so that points lie on corners and edges; half of all in one cell
    points = spark.createDataFrame([(i, float(rng.randint(0, 40)), float(rng.randint(0, 40))) if i % 2 else (i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(400)], "id long, x double, y double")
    made = [(i, [(float(x + rng.randint(0, 4)), float(y + rng.randint(0, 4))) for _ in range(rng.randint(3, 7))]) for i, (x, y) in enumerate((rng.choice((0, 3, 20)), rng.choice((0, 3, 20))) for _ in range(150))]
    rings = spark.createDataFrame(made, "id long, ring array<struct<x:double,y:double>>")
    pairs = points.crossJoin(rings.withColumnRenamed("id", "ring_id"))
    rows = lambda df: sorted(map(tuple, df.select("id", "ring_id").collect()))
    want = rows(pairs.filter(joins.in_ring(F.col("x"), F.col("y"), F.col("ring"))))
    assert want and rows(joins.points_in_rings(points, rings, 10.0)) == want
    assert rows(nearest.banded_inside(points, rings, 2.0)) == want
    left = F.forall(joins.ring_edges(F.col("ring")), lambda e: (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (F.col("x") - e["p"]["x"]) >= 0)
    square = [(i, [(0.0 + i, 0.0), (8.0 + i, 1.0), (8.0 + i, 9.0), (0.0 + i, 8.0)]) for i in range(60)]
    rings = spark.createDataFrame(square, "id long, ring array<struct<x:double,y:double>>")
    assert rows(nearest.inside_convex_rings(points, rings, 10.0)) == rows(points.crossJoin(rings.withColumnRenamed("id", "ring_id")).filter(left))
    assert "__cx" in joins.points_in_rings(points, rings, 10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in joins.points_in_rings(points, rings, 10.0)._jdf.queryExecution().optimizedPlan().toString()


def test_variogram_pairs_are_never_rows(spark, monkeypatch):
    """The curve is that of all pairs, with null values and samples at one place, in blocks too; no pair is a row of the plan."""
    import math
    import random
    from collections import defaultdict

    import pytest

    from gridloom.operators import aggregates, joins

    monkeypatch.setattr(joins, "BLOCK", 30)
    monkeypatch.setattr(aggregates, "AT_ONCE", 100)
    rng = random.Random(3)
    rows = [(i, float(rng.randint(-20, 20)), float(rng.randint(-20, 20)), None if i % 9 == 0 else float(rng.randint(0, 5))) for i in range(250)]
    curve = aggregates.semivariogram(spark.createDataFrame(rows, "id long, x double, y double, v double"), 3.0, 4)
    assert "Join Inner" not in curve._jdf.queryExecution().optimizedPlan().toString()
    want = defaultdict(lambda: [0, []])
    for i, (_, ax, ay, av) in enumerate(rows):
        for _, bx, by, bv in rows[:i]:
            if (ax - bx) ** 2 + (ay - by) ** 2 < 144:
                at = want[math.floor(math.hypot(ax - bx, ay - by) / 3)]
                at[0] += 1
                at[1] += [(av - bv) ** 2] if av is not None and bv is not None else []
    got = {r["lag"]: (r["pairs"], r["gamma"]) for r in curve.collect()}
    assert got == {k: (n, pytest.approx(sum(s) / len(s) / 2)) for k, (n, s) in want.items()}


def test_every_deep_context_is_a_candidate():
    """No context of four words is left out by its hash."""
    import numpy as np

    from gridloom.llm import suffix_tree

    keys = suffix_tree.tokens(" ".join(f"w{i}" for i in range(300)))
    h, at = suffix_tree.deep_contexts(keys, suffix_tree.SELECT)
    assert at.tolist() == list(range(suffix_tree.DEEP, len(keys))) and len(np.unique(h)) == len(h)


def test_a_word_is_encoded_where_it_is_asked_for():
    """Each word is encoded once, and a cache that is emptied between texts gives the same ids."""
    import public_tokenizers

    from gridloom.llm import packing

    asked = []
    known = packing.Known(lambda w: asked.append(w) or w.upper())
    assert b"".join(map(known.__getitem__, [b"a", b"b", b"a"])) == b"ABA" and asked == [b"a", b"b"]
    with open(public_tokenizers.path(packing.VOCABULARY), encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    texts = ["The end, of <|endoftext|> all", "été déjà vu!", "", "of all the rest"] * 2
    first = [words.ids(t) for t in texts]
    words.words.clear()
    assert [words.ids(t) for t in texts] == first


def close(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * (1 + abs(y))) for x, y in zip(a, b, strict=True))


def scattered(spark, n, m):
    """Points and sites on a lattice, so that some coincide; one point and one site without a place."""
    import random

    rng = random.Random(11)
    at = lambda: float(rng.randint(0, 60))
    points = spark.createDataFrame([(i, at(), at()) for i in range(n)] + [(n, None, 3.0)], "id long, x double, y double")
    sites = spark.createDataFrame([(i, at(), at()) for i in range(m)] + [(m, 2.0, None)], "sid long, sx double, sy double")
    return points, sites


def test_bearings_and_ranges_are_summed_in_blocks(spark, monkeypatch):
    """Fixes from blocks are those from tables of all bearings and ranges, the first sites in reach are those of a ranking, and no pair is a row."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gridloom.operators import joins, positioning

    monkeypatch.setattr(joins, "BLOCK", 30)
    points, sites = scattered(spark, 60, 90)
    near = joins.join_within(points, sites, 20.0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    ranked = near.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("sid"))).filter("i <= 2").select("id", "sid", "i")
    assert rows(joins.first_within(points, sites, 20.0, 2)) == rows(ranked)

    off = lambda i, s: ((i * 31 + s * 17) % 21 - 10) * 0.02
    seen = near.select("id", F.col("sx").alias("lx"), F.col("sy").alias("ly"), F.pmod(positioning.bearing_of(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) + off(F.col("id"), F.col("sid")), F.lit(360.0)).alias("bearing"))
    want = rows(positioning.bearing_fixes(seen).filter("n > 2"))
    got = rows(positioning.bearing_fixes_within(points, sites, 20.0, off, 1e-12).filter("n > 2"))
    assert len(want) > 40 and len(got) == len(want) and all(map(close, got, want))
    ranges = near.select("id", "sx", "sy", (F.sqrt("d2") + off(F.col("id"), F.col("sid"))).alias("distance"))
    pick = lambda df: rows(df.filter("x is not null and moved <= 1e-7").select("id", "n", "x", "y", "residual", "dilution"))
    want, got = pick(positioning.range_fixes(ranges)), pick(positioning.range_fixes_within(points, sites, 20.0, off))
    assert len(want) > 40 and len(got) == len(want) and all(map(close, got, want))
    for name in ("azimuthaccuracy_fix", "huffmodel"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "BETWEEN" not in plan


def test_huff_shares_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    import math

    from pyspark.sql import functions as F

    from gridloom.operators import joins, statistics

    monkeypatch.setattr(joins, "BLOCK", 30)
    points, sites = scattered(spark, 80, 70)
    points, stores = points.filter("x is not null"), sites.withColumn("size", (F.col("sid") % 9 + 1).cast("double"))
    p, s, want = points.collect(), stores.filter("sy is not null").collect(), {}
    for a in p:
        pull = {b.sid: b.size / max((a.x - b.sx) ** 2 + (a.y - b.sy) ** 2, 1e-18) for b in s}
        for k, v in pull.items():
            want[k] = want.get(k, 0.0) + v / math.fsum(pull.values())
    got = {r.sid: r.share for r in statistics.huff(points, stores).collect()}
    assert got.pop(70) is None  # a store without a place
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 for k in want)


def test_couplings_of_blocks_are_those_pair_by_pair(spark, monkeypatch):
    """Lines of one place and of many, in several blocks, by both distances; pairs are walked together."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import tracks

    monkeypatch.setattr(tracks, "LINES", 7)
    rng = random.Random(3)
    fixes = spark.createDataFrame([(t, k, rng.uniform(0, 9), rng.uniform(0, 9)) for t in range(20) for k in range(rng.choice((1, 2, 5, 30)))], "track long, seq long, x double, y double")
    for kind in ("frechet", "warp"):
        one = tracks.paired(fixes, fixes).filter("a < b").select("a", "b", tracks.coupling(kind)("line_a", "line_b").alias("distance"))
        want, got = (sorted(map(tuple, df.select("a", "b", "distance").collect())) for df in (one, tracks.couplings(fixes, kind)))
        assert len(want) == 190 and len(got) == 190 and all(map(close, got, want))
    plan = entry.queries()["frechet"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "ArrowEvalPython" not in plan


def ragged(spark, rows, columns):
    """A raster with holes."""
    import random

    rng = random.Random(5)
    return spark.createDataFrame([(r, c, float(rng.randint(0, 40))) for r in range(rows) for c in range(columns) if rng.random() > 0.05 or (r, c) == (17, 9)], "r long, c long, v double")


def test_sky_is_read_from_tiles(spark):
    """The share of the sky is that of the rays' steps joined to their cells, over the edges of tiles; steps are no rows."""
    from pyspark.sql import functions as F

    from gridloom.operators import raster

    cells = ragged(spark, 30, 23)
    up = raster.rays(cells, 16, 9).groupBy("r", "c", "k").agg(F.max((F.col("h") - F.col("v")) / (F.hypot(F.col("rr") - F.col("r"), F.col("cc") - F.col("c")) * 10.0)).alias("t"))
    s = up.groupBy("r", "c").agg(F.sum(F.when(F.col("t") > 0, F.col("t") / F.sqrt(1 + F.col("t") * F.col("t"))).otherwise(0.0)).alias("s"))
    want = sorted(map(tuple, cells.join(s, ["r", "c"], "left").select("r", "c", 1 - F.coalesce("s", F.lit(0.0)) / 16).collect()))
    out = raster.sky_view(cells, 16, 9, 10.0, 8)
    got = sorted(map(tuple, out.select("r", "c", "sky").collect()))
    assert len(want) == len(got) and all(map(close, got, want))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_viewshed_reads_runs_of_cells(spark):
    """What is seen is what no cell of the line between hides, step by step, in all directions and over the edges of tiles."""
    import math

    from gridloom.operators import raster

    cells = ragged(spark, 41, 30)
    v, (r0, c0) = {(q.r, q.c): q.v for q in cells.collect()}, (17, 9)
    z, want = v[r0, c0] + 25.0, set()
    for (r, c), h in v.items():
        n = max(abs(r - r0), abs(c - c0))
        line = [(r0 + round((r - r0) * s / n), c0 + round((c - c0) * s / n)) for s in range(1, n)]
        slope = lambda q: (v[q] - z) / math.hypot(q[0] - r0, q[1] - c0)
        if n and not any(q in v and slope(q) > slope((r, c)) for q in line):
            want.add((r, c))
    for tile in (8, 64):
        out = raster.viewshed(cells, r0, c0, 25.0, tile)
        assert set(map(tuple, out.collect())) == want
    assert 100 < len(want) < len(v) - 100 and "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()


def test_sights_meet_few_walls_first(spark, monkeypatch):
    """Open lines are those that no wall at all crosses, whichever part of the walls they meet first."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import joins, nearest

    rng = random.Random(2)
    lines = lambda n, reach: spark.createDataFrame([(i, x, y, x + rng.uniform(-reach, reach), y + rng.uniform(-reach, reach)) for i, x, y in ((i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n))], "id long, x1 double, y1 double, x2 double, y2 double")
    sights, walls = lines(200, 30.0), lines(300, 6.0)
    both = [df.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")]) for df, s in ((sights, "a"), (walls, "b"))]
    shut = {r.a for r in both[0].crossJoin(both[1]).filter(joins.segments_cross("a_", "b_")).select("a").collect()}
    monkeypatch.setattr(nearest, "FIRST_WALLS", 2)
    assert {r.id for r in nearest.unblocked(sights, walls, 10.0).collect()} == set(range(200)) - shut and 20 < len(shut) < 180


def test_dear_rows_are_dealt_over_tasks(spark):
    """One file of boxes isn't one task."""
    from gridloom.operators import scratch

    assert scratch.dealt_out(spark.range(95).coalesce(1), 10).rdd.getNumPartitions() == 10
    assert "Repartition" in entry.queries()["quadkey_cover"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_medoids_and_tours_hold_no_square(spark, monkeypatch):
    """Medoids from blocks, and tours whose distances are computed where they are asked for, are those of whole matrices; groups of one and two points too."""
    import random

    import numpy as np

    from gridloom.operators import joins, routes

    monkeypatch.setattr(joins, "BLOCK", 20)
    rng = random.Random(9)
    rows = [(g, i, rng.uniform(0, 9), rng.uniform(0, 9)) for i, g in enumerate([0] * 45 + [1] * 30 + [2] + [3] * 2)]
    points = spark.createDataFrame(rows, "region long, id long, x double, y double")
    want, trips = set(), {}
    for g in range(4):
        ids = [i for h, i, _, _ in rows if h == g]
        p = np.array([r[2:] for r in rows if r[0] == g])
        d = np.hypot(p[:, None, 0] - p[:, 0], p[:, None, 1] - p[:, 1])
        chosen = [int(d.sum(axis=0).argmin())]
        while len(chosen) < min(3, len(p)):
            chosen.append(int(np.minimum(d[:, chosen].min(axis=1)[:, None], d).sum(axis=0).argmin()))
        while True:
            swaps = [(d[:, [*chosen[:s], j, *chosen[s + 1 :]]].min(axis=1).sum(), s, j) for s in range(len(chosen)) for j in range(len(p))]
            best = min(swaps)
            if best[0] >= d[:, chosen].min(axis=1).sum() - 1e-9:
                break
            chosen[best[1]] = best[2]
        own = d[:, chosen].argmin(axis=1)
        want |= {(g, ids[m], int((own == s).sum())) for s, m in enumerate(chosen)}
        order = [0]
        while len(order) < len(p):
            order.append(min(set(range(len(p))) - set(order), key=lambda j: (d[order[-1], j], j)))
        trips[g] = d[order, np.roll(order, -1)].sum()
    out = routes.medoids(points, "region", 3)
    assert set(map(tuple, out.collect())) == want
    got = {r.region: r for r in routes.tours(points, "region").collect()}
    assert all(abs(got[g].nearest - trips[g]) < 1e-9 and got[g].improved <= trips[g] + 1e-9 for g in range(4)) and got[0].improved < trips[0]


def test_spreads_pass_only_rims_that_fell(spark):
    """Least costs over a narrow grid with holes, whose tiles are longer than wide, are those of one heap over all cells; a grid is never broadcast on the way back."""
    import heapq
    import math

    from gridloom.operators import raster

    cells = ragged(spark, 60, 3)
    v = {(q.r, q.c): q.v for q in cells.collect()}
    best, heap = {min(v): 0.0}, [(0.0, min(v))]
    while heap:
        x, (r, c) = heapq.heappop(heap)
        for k in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]:
            if k in v and (y := x + v[k] * math.dist(k, (r, c))) < best.get(k, math.inf):
                best[k] = y
                heapq.heappush(heap, (y, k))
    start = spark.createDataFrame([(*min(v), 0.0)], "r long, c long, cost double")
    out = raster.spread_from(cells, start, lambda x, a, b, length: x + b * length, tile=4)
    got = {(q.r, q.c): q.cost for q in out.collect()}
    assert got.keys() == v.keys() and all((got[k] is None) == (k not in best) and (k not in best or abs(got[k] - best[k]) < 1e-9) for k in v)
    plan = raster.way_back(out)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_ways_cross_parts_of_a_network(spark, monkeypatch):
    """Distances and betweenness of a network cut into small parts and blocks of sources are those of the whole; rounds are as many as parts passed, not as edges."""
    import heapq
    import random

    from gridloom.operators import graphs

    monkeypatch.setattr(graphs, "PART", 12)
    monkeypatch.setattr(graphs, "SOURCES", 9)
    rng = random.Random(4)
    at = [(i, float(i % 6) * 10 + rng.random(), float(i // 6) * 10 + rng.random()) for i in range(36)]
    line = {(i, j): float(rng.randint(1, 2)) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j != i + 1 or j % 6)}
    near = {i: [] for i in range(36)}
    for (i, j), w in line.items():
        near[i].append((j, w))
        near[j].append((i, w))
    far, score = {}, dict.fromkeys(near, 0.0)
    for s in near:
        d, heap, order = {s: 0.0}, [(0.0, s)], []
        while heap:
            x, u = heapq.heappop(heap)
            if x > d[u]:
                continue
            order.append(u)
            for v, w in near[u]:
                if x + w < d.get(v, 1e9):
                    d[v] = x + w
                    heapq.heappush(heap, (x + w, v))
        paths, owed = {s: 1}, dict.fromkeys(near, 0.0)
        for v in order[1:]:
            paths[v] = sum(paths[u] for u, w in near[v] if d[u] + w == d[v])
        for v in reversed(order[1:]):
            for u, w in near[v]:
                if d[u] + w == d[v]:
                    owed[u] += paths[u] / paths[v] * (1 + owed[v])
            score[v] += owed[v] / 2
        far |= {(s, v): x for v, x in d.items()}
    both = graphs.both_ways(spark.createDataFrame([(i, j, w) for (i, j), w in line.items()], "src long, dst long, w double"))
    sources = spark.createDataFrame([(i,) for i in range(36)], "source long")
    parts = graphs.parts_of(spark.createDataFrame(at, "id long, x double, y double")).cache()
    assert [r["count"] for r in parts.groupBy("part").count().collect()] == [12] * 3
    assert {(r.source, r.node): r.dist for r in graphs.shortest(both, sources, rounds=9, parts=parts).collect()} == far
    assert {(r.source, r.node): r.dist for r in graphs.shortest(both, sources, 6.0, parts=parts).collect()} == {k: x for k, x in far.items() if x <= 6}
    got = {r.node: r.score for r in graphs.betweenness(both, sources, parts).collect()}
    assert all(abs(got.get(v, 0.0) - x) < 1e-9 for v, x in score.items())


def test_clusters_and_thinning_make_no_pairs(spark, monkeypatch):
    """Clusters and greedy thinning of crowds with copies, bridges and points without a place are those of all pairs; cells linked by a single pair of cores are one cluster."""
    import math
    import random

    from gridloom.operators import joins, statistics

    monkeypatch.setattr(joins, "BLOCK", 30)
    monkeypatch.setattr(statistics, "self_join_within", None)
    rng = random.Random(2)
    at = [(rng.gauss(cx, 4), rng.gauss(cy, 4)) for cx, cy in ((0, 0), (40, 0), (0, 60)) for _ in range(70)] + [(7.0, 7.0)] * 20 + [(rng.uniform(-50, 90), rng.uniform(-50, 90)) for _ in range(60)]
    # two crowds of which only one pair of cores is near enough
    at += [(200 + rng.uniform(0, 3), 200 + rng.uniform(0, 5)) for _ in range(40)] + [(209.5 + rng.uniform(0, 3), 200 + rng.uniform(0, 5)) for _ in range(40)] + [(203.1, 206.0), (209.1, 206.0)]
    rng.shuffle(at)
    pts = [(i, x, y) for i, (x, y) in enumerate(at)]
    lost = [(900, None, 1.0), (901, math.nan, 1.0), (902, math.nan, 1.0)]
    df = spark.createDataFrame(pts + lost, "id long, x double, y double")
    near = {i: [j for j, a, b in pts if (a - x) * (a - x) + (b - y) * (b - y) <= 36] for i, x, y in pts}
    core, label, k = {i for i in near if len(near[i]) >= 4}, {}, 0
    for i in sorted(core):
        k += i not in label
        todo = [i] if i not in label else []
        while todo:
            j = todo.pop()
            if label.setdefault(j, k) == k:
                todo += [m for m in near[j] if m in core and m not in label]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in near} | {i: -1 for i, *_ in lost}
    assert {r.id: r.cluster for r in statistics.dbscan(df, 6.0, 4).collect()} == want
    kept = []
    for i, x, y in pts:
        if all((a - x) * (a - x) + (b - y) * (b - y) >= 36 for _, a, b in kept):
            kept.append((i, x, y))
    assert sorted(r.id for r in statistics.distance_thin(df, 6.0).collect()) == [i for i, *_ in kept] + [900, 901, 902]


def test_pairs_meet_in_bounded_blocks(spark, monkeypatch):
    """Boxes that touch, with borders and blocks, and weights of neighbours are those of all pairs; pairs are not brought together for their weights."""
    import random

    from gridloom.operators import joins, statistics

    monkeypatch.setattr(joins, "PAIRED", 7)
    rng = random.Random(6)
    made = [(i, float(x), float(y), float(x + rng.randint(0, 6)), float(y + rng.randint(0, 6))) for i, (x, y) in enumerate((rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(90))]
    b = spark.createDataFrame(made, "id long, min_x double, min_y double, max_x double, max_y double")
    touch = {(p[0], q[0]) for p in made for q in made if p[0] < q[0] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    out = joins.box_join(b, b, 5.0, ordered=True)
    assert sorted(map(tuple, out.collect())) == sorted(touch) and "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().executedPlan().toString()
    pts = [(p[0], p[1], p[2]) for p in made]
    monkeypatch.setattr(statistics, "PAIRED", 7)
    near = {i: [j for j, a, c in pts if j != i and (a - x) ** 2 + (c - y) ** 2 <= 9] for i, x, y in pts}
    out = statistics.neighbour_weights(spark.createDataFrame(pts, "id long, x double, y double"), 3.0)
    assert sorted(map(tuple, out.collect())) == sorted((i, j, 1 / len(v)) for i, v in near.items() for j in v)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_triangulation_looks_near_the_new_point_only(monkeypatch):
    """Points round a ring, with a lattice inside and repeats: circles are empty, the hull is covered, and hull edges are not all looked at for each point."""
    import math
    import random

    from gridloom.operators import geometry, triangulation

    asked, side_of = [], triangulation.side_of
    monkeypatch.setattr(triangulation, "side_of", lambda *a: asked.append(1) or side_of(*a))
    rng = random.Random(8)
    pts = [(100 * math.cos(k / 30), 100 * math.sin(k / 30)) for k in range(188)] + [(float(x), float(y)) for x in range(-40, 41, 8) for y in range(-40, 41, 8)]
    rng.shuffle(pts)
    pts += pts[:20]
    found = triangulation.triangulate(pts)
    assert len(asked) < 20 * len(pts)
    tri = [t for t in found if triangulation.OUTSIDE not in t]
    assert len({v for t in tri for v in t}) == len(pts) - 20 and len(found) - len(tri) == len(geometry.hull(pts))
    assert not any(triangulation.encloses(*(pts[v] for v in t), p) for t in tri for p in pts)
    area = lambda a, b, c: ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
    assert abs(sum(area(*(pts[v] for v in t)) for t in tri) - abs(geometry.ring_area(geometry.hull(pts)))) < 1e-6


def test_exchanges_take_few_rounds_beyond_one_group(spark, monkeypatch):
    """Groups exchange to their end, then only points that can still gain meet: no exchange and no move gains after a few rounds."""
    import math
    import random

    import numpy as np

    from gridloom.operators import nearest

    rounds, grouped = [], nearest.grouped
    monkeypatch.setattr(nearest, "grouped", lambda taking, *rest: rounds.append(taking.count()) or grouped(taking, *rest))
    monkeypatch.setattr(nearest, "RANKED", 128)
    r = random.Random(21)
    p = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(1500)]
    f = [(k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(6)]
    got = nearest.exchanged(spark.createDataFrame([(i, i % 6) for i, *_ in p], "id long, sid long"), spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(f, "sid long, sx double, sy double"), 255).collect()
    assert rounds[0] == 1500 and len(rounds) <= 12
    at = np.array([q.sid for q in sorted(got, key=lambda q: q.id)])
    d = np.array([[math.dist(q[1:], s[1:]) for s in f] for q in p])
    load, gain = np.bincount(at, minlength=6), d[np.arange(1500), at][:, None] - d
    assert len(at) == 1500 and load.max() <= 255
    most = np.array([gain[at == a].max(axis=0) for a in range(6)])
    apart = ~np.eye(6, dtype=bool)
    assert (most + most.T)[apart].max() <= 1e-6 and most[:, load < 255].max() <= 1e-6


def test_deep_positions_are_packed_and_come_back():
    """What is shuffled of a position takes under 13 bytes (28 before), comes back as it was, and contexts don't reach from text to text."""
    import numpy as np

    from gridloom.llm import suffix_tree

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 100_000) for _ in range(250)] + ["", " \t ", "one two", "x" * 300 + " a b c D d"]
    (keys, n), *more = suffix_tree.streams(texts[:3])
    assert not more and n.tolist() == [401] * 3
    parts = list(suffix_tree.streams(texts))
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    assert len(parts) > 1 and (keys == np.concatenate([suffix_tree.tokens(t) for t in texts])).all() and n.tolist() == [len(t.split()) + 1 for t in texts]
    assert len(set(suffix_tree.tokens(texts[-1]).tolist())) == 6
    h, at = suffix_tree.deep_contexts(keys, 1)
    assert len(h) == sum(max(0, len(t.split()) + 1 - suffix_tree.DEEP) for t in texts)
    words, number = np.unique(keys, return_inverse=True)
    rank = np.where(number % 5 > 0, number, 0)
    state, row, train = rank % 1500, np.repeat(np.arange(len(n)), n) + 2**34, np.repeat(rng.random(len(n)) < 0.9, n)
    deep = suffix_tree.Deep(3, 1)
    deep.add(keys, rank, state, row, train)
    sent = deep.passed()
    got = [np.concatenate(x) for x in zip(*map(suffix_tree.unpacked, sent.itertuples(index=False)), strict=True)]
    want = (h >> np.uint64(8), rank[at], state[at], row[at], train[at], np.where(rank[at] == 0, keys[at], np.uint64(0)))
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))
    assert sum(len(x) for c in ("steps", "packed", "keys") for x in sent[c]) < 13 * len(h)


def test_suffix_tree_keeps_large_ids_beside_null_ones(spark):
    from gridloom.llm import suffix_tree

    big = 2**60 + 1
    got = suffix_tree.score(spark.createDataFrame([(big, "a b c d e"), (None, "a b c d f"), (big + 1, None)], "doc_id long, text string").coalesce(1)).collect()
    assert sorted((q.doc_id or 0, q.n_tokens) for q in got) == [(0, 6), (big, 6), (big + 1, 1)]


def test_a_days_sun_is_laid_out_as_arrays(spark):
    """A day of minutes is no array of the plan; places of several days, and places that aren't told, get what the minutes one by one give."""
    import math

    from pyspark.sql import functions as F

    from gridloom.functions import astronomy

    rows = [(i, 50.0 + i % 3, (i * 37 % 160) - 80.0, (i * 71 % 360) - 180.0) for i in range(40)] + [(40, 50.0, None, 1.0), (41, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, midnight double, lat double, lon double")
    day = df.select("id", astronomy.sun_day(F.col("midnight"), F.col("lat"), F.col("lon")).alias("s")).select("id", "s.*")
    assert "lambda" not in day._jdf.queryExecution().optimizedPlan().toString()
    minutes = df.filter("id < 40").crossJoin(spark.range(1440).withColumnRenamed("id", "m")).withColumn("t", F.col("midnight") + F.col("m") / 1440.0)
    minutes = minutes.select("id", "m", F.round(astronomy.sun_elevation(F.col("t"), F.col("lat"), F.col("lon")), 9).alias("e"), astronomy.sun_azimuth(F.col("t"), F.col("lat"), F.col("lon")).alias("a")).toPandas()
    for q in day.collect():
        if q.id >= 40:
            assert q.noon is None and q.rise is None and q.set is None
            continue
        e, a = (minutes[minutes["id"] == q.id].sort_values("m")[c].to_numpy() for c in "ea")
        up, down = [m for m in range(1, 1440) if e[m - 1] < 0 <= e[m]], [m for m in range(1, 1440) if e[m - 1] >= 0 > e[m]]
        assert q.noon == e.argmax()
        assert (q.rise is None) == (not up) and (not up or math.isclose(q.rise, a[up[0]], abs_tol=1e-6))
        assert (q.set is None) == (not down) and (not down or math.isclose(q.set, a[down[-1] - 1], abs_tol=1e-6))


def test_a_days_light_is_summed_as_arrays(spark):
    """The steps of a day are no array of the plan; the sum is that of the steps one by one, and nothing where a place isn't told."""
    import math

    from pyspark.sql import functions as F

    from gridloom.functions import astronomy

    df = spark.createDataFrame([(i, i * 9 % 365, (i * 37 % 160) - 80.0, float(i % 50), i * 7.0 % 360) for i in range(40)] + [(40, 3, None, 1.0, 1.0)], "id long, day long, lat double, slope double, aspect double")
    own = df.select("*", *[astronomy.daily_beam(*[F.col(c) for c in ("day", "lat", "slope", "aspect")], t, step=20).alias(n) for n, t in (("bare", None), ("beam", 0.7))])
    assert "lambda" not in own._jdf.queryExecution().optimizedPlan().toString()
    for q in own.collect():
        if q.lat is None:
            assert q.bare is None and q.beam is None
            continue
        p, d, b, g = map(math.radians, (q.lat, 23.44 * math.sin(math.radians(360.0 * (284 + q.day) / 365)), q.slope, q.aspect))
        bare = beam = 0.0
        for m in range(0, 1440, 20):
            h = math.radians(m / 4 - 180)
            up = math.sin(p) * math.sin(d) + math.cos(p) * math.cos(d) * math.cos(h)
            facing = -math.cos(d) * math.sin(h) * math.sin(b) * math.sin(g) + (math.cos(p) * math.sin(d) - math.sin(p) * math.cos(d) * math.cos(h)) * math.sin(b) * math.cos(g) + up * math.cos(b)
            if up > 0 and facing > 0:
                bare, beam = bare + facing, beam + facing * 0.7 ** (1 / up)
        assert math.isclose(q.bare, bare * 1361.0 * 1200 / 1e6, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(q.beam, beam * 1361.0 * 1200 / 1e6, rel_tol=1e-9, abs_tol=1e-12)


def test_winding_meets_rings_in_cells(spark, tmp_path, monkeypatch):
    """Points that rings wind round are those of the test pair by pair, on corners and edges and for rings that cross themselves; no ring meets all points."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import joins

    rng = random.Random(11)
    monkeypatch.setattr(joins, "BLOCK", 40)
    points = spark.createDataFrame([(i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(300)], "id long, x double, y double")
    made = [(i, [(float(x + rng.randint(0, 6)), float(y + rng.randint(0, 6))) for _ in range(rng.randint(3, 8))]) for i, (x, y) in enumerate((rng.randint(0, 24), rng.randint(0, 24)) for _ in range(80))]
    rings = spark.createDataFrame(made, "id long, ring array<struct<x:double,y:double>>")
    pairs = points.crossJoin(rings.withColumnRenamed("id", "ring_id")).filter(joins.winding(F.col("x"), F.col("y"), F.col("ring")) != 0)
    rows = lambda df: sorted(map(tuple, df.select("id", "ring_id").collect()))
    assert rows(pairs) and rows(joins.rings_met(points, rings, 10.0, joins.wound)) == rows(pairs)
    for t, n in (("customer", 300), ("supplier", 20)):
        spark.range(n).withColumnRenamed("id", f"{t[0]}_{'cust' if t[0] == 'c' else 'supp'}key").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    plan = entry.queries()["winding"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "__cx" in plan and "aggregate(" not in plan


def test_inverse_distance_meets_blocks(spark):
    """Weighted means over blocks of both sides, as arrays, are those of all samples; no array of samples is joined to a point, and blocks are dealt over many tasks."""
    import math
    import random

    from gridloom.operators import joins, statistics

    rng = random.Random(3)
    pts = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)] + [(60, 1.0, 2.0)]
    s = [(i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 5)) for i in range(70)] + [(80, 1.0, 2.0, 4.0), (79, 1.0, 2.0, 3.0), (81, None, 2.0, 9.0), (82, 3.0, 3.0, None)]
    df = statistics.inverse_distance(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(s, "sid long, sx double, sy double, v double"), power=3.0, block=16)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and f"RepartitionByExpression [__cx#" in plan and f", {joins.TASKS}" in plan
    got = {r.id: r.v for r in df.collect()}
    told = [r for r in s if None not in r]
    for i, x, y in pts[:-1]:
        w = [1 / math.hypot(x - a, y - b) ** 3 for _, a, b, _ in told]
        assert math.isclose(got[i], sum(p * r[3] for p, r in zip(w, told, strict=True)) / sum(w), rel_tol=1e-9)
    assert got[60] == 3.0 and len(got) == len(pts)


def test_union_of_boxes_goes_by_cells(spark, monkeypatch):
    """The area is that of unit squares under any box, where cells are split, covered and swept in several strips; boxes never meet strips as rows."""
    import random

    from gridloom.operators import aggregates

    rng = random.Random(5)
    monkeypatch.setattr(aggregates, "HELD", 6)
    monkeypatch.setattr(aggregates, "STRIPS", 40)
    made = [(x, y, x + rng.randint(0, 9), y + rng.randint(0, 9)) for x, y in ((rng.randint(-20, 30), rng.randint(-20, 30)) for _ in range(150))] + [(0, 0, 12, 12)] * 3 + [(100, 100, 101, 101)] * 9
    boxes = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(made)], "id long, min_x double, min_y double, max_x double, max_y double")
    want = {(x, y) for a, b, c, d in made for x in range(a, c) for y in range(b, d)}
    area = aggregates.union_area(boxes, 16.0)
    assert area.first()[0] == len(want)
    assert "Join Inner" not in area._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_on_a_sphere_writes_its_rounds(spark):
    """Nearest by great circle are those of all pairs, also for queries far from all points; the cells of a side are never broadcast and no round is computed anew for the next."""
    import random

    from gridloom.functions import geodesy
    from gridloom.operators import nearest
    from pyspark.sql import functions as F

    rng = random.Random(8)
    q = spark.createDataFrame([(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(60)], "id long, lat double, lon double")
    p = spark.createDataFrame([(i, rng.uniform(-20, 20), rng.uniform(-30, 30)) for i in range(300)], "pid long, plat double, plon double")
    km = geodesy.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    want = {r.id: r.m for r in q.crossJoin(p).groupBy("id").agg(F.min(km).alias("m")).collect()}
    near = nearest.nearest_on_sphere(q, p)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.km for r in near.collect()} == want
    assert "BroadcastHashJoin" not in nearest.join_within_3d(*[d.select("id", *[F.lit(0.5).alias(c) for c in cs]) for d, cs in ((q, "xyz"), (q, ("sx", "sy", "sz")))], 1.0)._jdf.queryExecution().executedPlan().toString()


def test_joined_points_are_counted_without_pairs(spark, tmp_path):
    """The counts are those of the SQL, and no pair is a row of the plan."""
    for t, n in (("customer", 700), ("supplier", 90)):
        spark.range(n).withColumnRenamed("id", f"{t[0]}_{'cust' if t[0] == 'c' else 'supp'}key").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    run = entry.queries()["spatialjoin"]
    assert not difference(spark, "spatialjoin", run, entry.oracle_sql()["spatialjoin"], str(tmp_path))
    plan = run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsIn" in plan and "d2" not in plan


def test_pairs_in_reach_come_from_blocks(spark, monkeypatch):
    """Pairs in the plane and in space are those of all pairs, the boundary included, where cells are cut into blocks; bearings' errors are rounded as in the SQL and no join gives them."""
    import random

    from gridloom.operators import joins

    rng = random.Random(4)
    monkeypatch.setattr(joins, "PAIRED", 7)
    at = lambda n: [(i, *(float(rng.randint(0, 12)) for _ in range(3))) for i in range(n)]
    p, s = at(80), at(50)
    left, right = spark.createDataFrame(p + [(99, None, 1.0, 1.0)], "id long, x double, y double, z double"), spark.createDataFrame(s, "sid long, sx double, sy double, sz double")
    for axes in ("xy", "xyz"):
        d2 = {(a[0], b[0]): sum((a[k] - b[k]) ** 2 for k in range(1, len(axes) + 1)) for a in p for b in s}
        got = joins.reached(left, right, 3.0, axes, {"d2": lambda v: v})
        assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = got.collect()
        assert {(r.id, r.sid): r.d2 for r in rows} == {k: v for k, v in d2.items() if v <= 9} and len(rows) == sum(v <= 9 for v in d2.values())


def test_all_distances_are_dealt_over_tasks(spark, tmp_path):
    """A table of one file gives its pairs in many tasks, and the distances of the SQL."""
    spark.range(1200).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    run = entry.queries()["distancematrix"]
    assert run(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    assert not difference(spark, "distancematrix", run, entry.oracle_sql()["distancematrix"], str(tmp_path))


def test_flows_are_summed_in_blocks(spark, tmp_path, monkeypatch):
    """The exponent and the number of flows are those of the SQL, also where sites are several blocks; no pair is a row of the plan."""
    from gridloom.operators import statistics

    spark.range(9000).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    run = entry.queries()["gravityfit"]
    assert "Join Inner" not in run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(statistics, "PAIRS", 1 << 16)
    assert not difference(spark, "gravityfit", run, entry.oracle_sql()["gravityfit"], str(tmp_path))


def test_ripleys_pairs_are_never_rows(spark, monkeypatch):
    """K at each radius is that of all pairs, copies and the boundary included, in blocks too; a radius without pairs gives no row."""
    import random

    from gridloom.operators import joins, statistics

    rng = random.Random(6)
    monkeypatch.setattr(joins, "BLOCK", 20)
    at = [(i, float(rng.randint(-20, 30)), float(rng.randint(-20, 30))) for i in range(200)] + [(200, 3.0, 4.0), (201, 3.0, 4.0)]
    df = spark.createDataFrame(at, "id long, x double, y double")
    d2 = [(a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 for a in at for b in at if a[0] < b[0]]
    k = statistics.ripley_k(df, [3.0, 5.0, 10.0], 2500.0)
    assert "Join Inner" not in k._jdf.queryExecution().optimizedPlan().toString()
    assert {r.r: r.k for r in k.collect()} == {r: round(2500 * 2 * sum(v <= r * r for v in d2) / (202 * 201.0), 4) for r in (3.0, 5.0, 10.0)}
    assert statistics.ripley_k(df.limit(1), [3.0], 2500.0).count() == 0


def test_blocks_of_one_table_meet_once(spark, monkeypatch):
    """Boxes that touch, each two once and the smaller id first, are those of all pairs where cells are several blocks; two blocks are not sent to one another twice."""
    import random

    from gridloom.operators import joins

    rng = random.Random(9)
    monkeypatch.setattr(joins, "PAIRED", 9)
    made = [(i, x, y, x + rng.randint(0, 6), y + rng.randint(0, 6)) for i, (x, y) in enumerate((rng.randint(-10, 20), rng.randint(-10, 20)) for _ in range(120))]
    boxes = spark.createDataFrame([(i, *map(float, b)) for i, *b in made], "id long, min_x double, min_y double, max_x double, max_y double")
    rows = joins.box_join(boxes, boxes, 8.0, True, {"first": lambda a, b: a["min_x"]}).collect()
    want = {(a[0], b[0]): a[1] for a in made for b in made if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(rows) == len(want) and {(r.a, r.b): r.first for r in rows} == want
    sent = []
    monkeypatch.setattr(joins, "met_in_cells", lambda left, right, *more, **how: sent.append(how) or left)
    joins.box_join(boxes, boxes, 8.0, True)
    assert sent == [{"itself": True}]


def test_crossing_segments_come_from_blocks(spark, monkeypatch):
    """Pairs of crossing segments, also those that touch, overlap or are points, are those of all pairs, and where they cross is on both; no join gives pairs."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import joins, nearest

    rng = random.Random(10)
    monkeypatch.setattr(joins, "PAIRED", 9)
    made = [(i, x, y, x + rng.randint(-5, 5), y + rng.randint(-5, 5)) for i, (x, y) in enumerate((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(90))]
    segments = spark.createDataFrame([(i, *map(float, s)) for i, *s in made], "id long, x1 double, y1 double, x2 double, y2 double")
    sides = [segments.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")]) for s in "ab"]
    want = sorted(map(tuple, sides[0].crossJoin(sides[1]).filter(joins.segments_cross("a_", "b_") & (F.col("a") < F.col("b"))).select("a", "b").collect()))
    got = joins.crossing_pairs(segments, 4.0)
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert want and sorted(map(tuple, got.collect())) == want
    for r in nearest.crossing_points(segments, 4.0).collect():
        for i in (r.a, r.b):
            _, x1, y1, x2, y2 = made[i]
            assert abs((x2 - x1) * (r.y - y1) - (y2 - y1) * (r.x - x1)) < 1e-4


def test_nearest_boxes_come_from_blocks(spark, monkeypatch):
    """The nearest boxes, of many that hold a site those of smallest id, are those of all pairs in blocks too; no pair of site and box is a row."""
    import random

    from gridloom.operators import joins, nearest

    rng = random.Random(12)
    monkeypatch.setattr(joins, "BLOCK", 15)
    made = [(i, x, y, x + rng.randint(0, 60), y + rng.randint(0, 60)) for i, (x, y) in enumerate((rng.randint(0, 200), rng.randint(0, 200)) for _ in range(100))]
    at = [(i, rng.randint(-60, 300), rng.randint(-60, 300)) for i in range(60)]
    boxes = spark.createDataFrame([(i, *map(float, b)) for i, *b in made], "id long, min_x double, min_y double, max_x double, max_y double")
    near = nearest.nearest_boxes(spark.createDataFrame([(i, float(x), float(y)) for i, x, y in at], "sid long, sx double, sy double"), boxes, 4)
    got = {}
    for r in near.collect():
        got.setdefault(r.query, []).append((r.rank, r.box))
    for i, x, y in at:
        d = sorted((max(a - x, 0, x - c) ** 2 + max(b - y, 0, y - e) ** 2, k) for k, a, b, c, e in made)[:4]
        assert [b for _, b in sorted(got[i])] == [k for _, k in d]


def test_neighbours_of_cells_are_not_broadcast(spark, tmp_path):
    """The cells' neighbours, eight rows for each cell of a small file, go to no driver."""
    from pyspark.sql import functions as F

    from gridloom.operators import raster

    spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), (F.col("id") * 7 % 11).alias("k")).coalesce(1).write.parquet(f"{tmp_path}/cells.parquet")
    cells = spark.read.parquet(f"{tmp_path}/cells.parquet")
    axis = raster.medial_axis(cells, F.col("k") > 2)
    for df in (axis, raster.degrees_of(axis)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Generate explode" in plan
        assert not any("BroadcastHashJoin [r" in line and "LeftAnti" not in line and "LeftOuter" not in line for line in plan.splitlines())


def test_duplicates_are_grouped_without_pairs(spark, monkeypatch):
    """Groups of points over steps of the radius, the boundary and copies included, are those of all pairs; no two points are joined."""
    import math
    import random

    from gridloom.operators import joins, statistics

    monkeypatch.setattr(joins, "self_join_within", None)
    monkeypatch.setattr(statistics, "self_join_within", None)
    rng = random.Random(13)
    at = [(i, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(220)] + [(220, 100.0, 100.0), (221, 103.0, 104.0), (222, 103.0, 104.0)]
    root = {i: i for i, *_ in at}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, x, y in at:
        for j, a, b in at:
            if (a - x) ** 2 + (b - y) ** 2 <= 25:
                u, v = sorted((find(i), find(j)))
                root[v] = u
    df = spark.createDataFrame(at + [(300, None, 1.0), (301, math.nan, 1.0)], "id long, x double, y double")
    assert {r.id: r.root for r in statistics.near_groups(df, 5.0).collect()} == {i: find(i) for i in root} | {300: 300, 301: 301}


def test_overlapping_spans_come_from_blocks(spark, monkeypatch):
    """Spans that touch, each two once, are those of all pairs, with equal starts, copies and spans of no length, where buckets are several blocks; no join gives pairs."""
    import random

    from gridloom.operators import joins

    rng = random.Random(14)
    monkeypatch.setattr(joins, "PAIRED", 8)
    made = [(i, x, x + rng.randint(0, 6)) for i, x in enumerate(rng.randint(-10, 25) for _ in range(110))]
    rng.shuffle(made)
    spans = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in made], "id long, lo double, hi double")
    got = joins.overlapping(spans, 2.0)
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0]) for a in made for b in made if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])


def test_octree_broadcasts_no_cells(spark, tmp_path):
    """The cells of space that sites are dealt to, 27 rows for each of a small file, go to no driver, and pairs are those of the SQL."""
    for t, n in (("customer", 600), ("supplier", 90)):
        spark.range(n).withColumnRenamed("id", f"{t[0]}_{'cust' if t[0] == 'c' else 'supp'}key").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    run = entry.queries()["octree"]
    assert "Join Inner" not in run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not difference(spark, "octree", run, entry.oracle_sql()["octree"], str(tmp_path))


def test_sight_lines_are_blocked_before_they_are_rows(spark, monkeypatch):
    """Pairs that walls near their ends leave open hold every pair that no wall parts and few others; with those that the other walls block gone, the pairs are those of all walls."""
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import joins, nearest

    rng = random.Random(15)
    monkeypatch.setattr(nearest, "SEERS", 64)
    sites = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(150)]
    made = [(i, x, y, x + rng.uniform(-14, 14), y + rng.uniform(-14, 14)) for i, (x, y) in enumerate((rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(120))]
    places, walls = spark.createDataFrame(sites, "sid long, x double, y double"), spark.createDataFrame(made, "id long, x1 double, y1 double, x2 double, y2 double")
    both = places.toDF("src", "a_x1", "a_y1").crossJoin(places.toDF("dst", "a_x2", "a_y2")).filter("src < dst")
    blocked = both.crossJoin(walls.toDF("id", "b_x1", "b_y1", "b_x2", "b_y2")).filter(joins.segments_cross("a_", "b_")).select("src", "dst").distinct()
    want = {tuple(r) for r in both.join(blocked, ["src", "dst"], "left_anti").select("src", "dst").collect()}
    near = nearest.sight_pairs(places, walls).cache()
    rows = [(r.src, r.dst) for r in near.collect()]
    assert len(rows) == len(set(rows)) and want <= set(rows) and len(rows) < 150 * 149 / 2 / 4
    lines = near.withColumn("id", F.col("src") * 1000 + F.col("dst"))
    assert {divmod(r.id, 1000) for r in nearest.unblocked(lines, walls, 10.0).collect()} == want
    assert {(r.src, r.dst) for r in nearest.sight_pairs(places.limit(20), walls.limit(0)).collect()} == {(a[0], b[0]) for a in sites[:20] for b in sites[:20] if a[0] < b[0]}


def test_points_climb_in_tiles(spark, monkeypatch):
    """Ends of climbing points are those of the steps over all points one by one, where points leave their tile and tiles are cut; means over a disc are those of its points, and no pair is a row."""
    import math
    import random

    import numpy as np

    from gridloom.operators import statistics

    rng = random.Random(16)
    x, y = np.array([(rng.gauss(0, 30), rng.uniform(-50, 50)) for _ in range(3000)] + [(5.0, 5.0)] * 40).T
    lattice = statistics.Lattice(x, y, 0.1)
    px, py = np.array([(rng.uniform(-90, 90), rng.uniform(-60, 60)) for _ in range(200)] + [(x[7] + 20.0, y[7])]).T
    near = [np.hypot(x - a, y - b) <= 20.0 for a, b in zip(px, py, strict=True)]
    told = np.array([n.any() for n in near])
    with np.errstate(invalid="ignore"):
        mx, my = lattice.means(px, py, 20.0)
    assert np.allclose(mx[told], [x[n].mean() for n in near if n.any()], atol=1e-9) and np.allclose(my[told], [y[n].mean() for n in near if n.any()], atol=1e-9)
    monkeypatch.setattr(statistics, "CLIMBERS", 9)
    monkeypatch.setattr(statistics, "join_within", None)
    pts = [(i, rng.gauss(40 * (i % 3), 9), rng.gauss(-10, 9)) for i in range(120)]
    ends = {r.id: (r.x, r.y) for r in statistics.climbed(spark.createDataFrame(pts + [(900, None, 1.0)], "id long, x double, y double"), 8.0, 200, 1e-6).collect()}
    assert set(ends) == {i for i, *_ in pts}
    for i, a, b in pts:
        for _ in range(200):
            close = [(u, v) for _, u, v in pts if (u - a) ** 2 + (v - b) ** 2 <= 64]
            na, nb = sum(u for u, _ in close) / len(close), sum(v for _, v in close) / len(close)
            moved, a, b = math.hypot(na - a, nb - b), na, nb
            if moved < 1e-6:
                break
        assert math.isclose(ends[i][0], a, abs_tol=1e-6) and math.isclose(ends[i][1], b, abs_tol=1e-6)
