"""Places by least squares, axes and tree tops, equal strips, variogram fits and the sun, against brute force and laws."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import astronomy
from gridloom.operators import aggregates, geometry, positioning, raster


def test_bearing_fixes(spark):
    r = random.Random(1)
    rows, true = [], {}
    for i in range(20):
        true[i] = x, y = r.uniform(0, 100), r.uniform(0, 100)
        for _ in range(r.randrange(2, 6)):
            lx, ly = r.uniform(0, 100), r.uniform(0, 100)
            rows.append((i, lx, ly, math.degrees(math.atan2(lx - x, ly - y)) % 360))
    rows += [(50, 0.0, 0.0, 10.0), (51, 0.0, 0.0, 30.0), (51, 5.0, 0.0, 30.0)]
    got = {q.id: q for q in positioning.bearing_fixes(spark.createDataFrame(rows, "id long, lx double, ly double, bearing double")).collect()}
    for i, (x, y) in true.items():
        assert (got[i].x, got[i].y) == pytest.approx((x, y), abs=1e-6) and got[i].residual < 1e-6
    assert got[50].x is None and got[51].x is None


def test_range_fixes_are_least_squares(spark):
    r = random.Random(2)
    rows = []
    for i in range(12):
        x, y = r.uniform(20, 80), r.uniform(20, 80)
        for _ in range(6):
            sx, sy = r.uniform(0, 100), r.uniform(0, 100)
            rows.append((i, sx, sy, max(0.0, math.dist((x, y), (sx, sy)) + r.gauss(0, 1))))
    rows += [(90, 0.0, 0.0, 5.0), (90, 9.0, 0.0, 5.0), (91, 0.0, 0.0, 5.0), (91, 5.0, 5.0, 3.0), (91, 10.0, 10.0, 9.0)]
    got = {q.id: q for q in positioning.range_fixes(spark.createDataFrame(rows, "id long, sx double, sy double, distance double")).collect()}
    assert got[90].x is None and got[91].x is None
    for i in range(12):
        own = [(a, b, d) for k, a, b, d in rows if k == i]
        q = got[i]
        cost = lambda x, y: sum((math.dist((x, y), (a, b)) - d) ** 2 for a, b, d in own)  # noqa: B023, E731
        assert q.moved <= 1e-7 and q.residual == pytest.approx(math.sqrt(cost(q.x, q.y) / 6), rel=1e-6)
        assert all(cost(q.x + e, q.y + f) >= cost(q.x, q.y) - 1e-9 for e in (-0.01, 0, 0.01) for f in (-0.01, 0, 0.01))
        g = np.array([[(q.x - a) / math.dist((q.x, q.y), (a, b)), (q.y - b) / math.dist((q.x, q.y), (a, b))] for a, b, _ in own])
        assert q.dilution == pytest.approx(math.sqrt(np.trace(np.linalg.inv(g.T @ g))), rel=1e-5)


def cells_of(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "r long, c long, v double")


def test_axis_against_the_definition(spark):
    r = random.Random(3)
    mask = [[2 <= i <= 12 and 2 <= j <= 17 and not (i > 8 and j > 9) and r.random() > 0.02 for j in range(20)] for i in range(15)]
    out = [(i, j) for i in range(15) for j in range(20) if not mask[i][j]]
    d = [[min(math.dist((i, j), k) for k in out) for j in range(20)] for i in range(15)]
    near = lambda i, j: [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    want = {(i, j) for i in range(15) for j in range(20) if mask[i][j] and not any(0 <= a < 15 and 0 <= b < 20 and d[a][b] >= d[i][j] + math.dist((a, b), (i, j)) - 1e-9 for a, b in near(i, j))}
    axis = raster.medial_axis(cells_of(spark, mask), F.col("v") > 0)
    assert {(q.r, q.c) for q in axis.collect()} == want
    degree = {k: sum(n in want for n in near(*k)) for k in want}
    got = {(q.r, q.c): q for q in raster.degrees_of(axis).collect()}
    assert {k: q.degree for k, q in got.items()} == degree
    assert all(q.kind == ("end" if q.degree <= 1 else "junction" if q.degree >= 3 else "line") for q in got.values())
    left = set(want)
    for _ in range(3):
        left = {k for k in left if sum(n in left for n in near(*k)) > 1}
    assert {(q.r, q.c) for q in raster.peeled(axis, 3).collect()} == left
    assert raster.medial_axis(cells_of(spark, [[1, 1], [1, 1]]), F.col("v") > 0).count() == 0


def test_tree_tops_of_equal_and_taller_trees(spark):
    grid = [[0.0] * 9 for _ in range(9)]
    grid[1][1] = grid[1][2] = 6.0  # equal: the first stays
    grid[5][5], grid[5][7], grid[8][0] = 25.0, 24.0, 6.0  # a tall tree's window reaches two cells, and so does the other's
    heights = cells_of(spark, grid).withColumnRenamed("v", "height")
    assert {(q.r, q.c) for q in raster.tree_tops(heights, 5.0, 20.0, 2).collect()} == {(1, 1), (5, 5), (8, 0)}
    assert {(q.r, q.c) for q in raster.tree_tops(heights, 5.0, 100.0, 2).collect()} == {(1, 1), (5, 5), (5, 7), (8, 0)}


@pytest.mark.parametrize("ring", [[(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 3.0), (3.0, 3.0), (3.0, 9.0), (0.0, 9.0)], [(1.0, 2.0), (7.0, 3.0), (4.0, 11.0)]])
def test_equal_strips(ring):
    whole = abs(geometry.ring_area(ring))
    for direction in (0, 30, 90, 137.5, 250):
        nx, ny = math.cos(math.radians(direction)), math.sin(math.radians(direction))
        found = geometry.equal_strips(ring, 5, direction)
        assert [a for _, a in found] == pytest.approx([whole / 5] * 5, rel=1e-9)
        offsets = [o for o, _ in found]
        assert offsets == sorted(offsets) and offsets[-1] == pytest.approx(max(nx * x + ny * y for x, y in ring))
        r = random.Random(direction)
        low, high = min(x for x, _ in ring), max(max(p) for p in ring)
        inside = lambda x, y: sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2
        points = [(r.uniform(low, high), r.uniform(0, high)) for _ in range(20000)]
        points = [p for p in points if inside(*p)]
        assert sum(nx * x + ny * y <= offsets[1] for x, y in points) / len(points) == pytest.approx(0.4, abs=0.02)
    assert geometry.equal_strips([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 3, 0.0) == []


def test_variogram_fit_finds_its_model(spark):
    model = lambda h: 2 + 5 * (1 - math.exp(-3 * h / 42))
    curve = spark.createDataFrame([(k, 100, model((k + 0.5) * 5)) for k in range(30)], "lag long, pairs long, gamma double")
    (fit,) = aggregates.fitted_variogram(curve, 5.0, 100.0).collect()
    sill = sum(model((k + 0.5) * 5) for k in range(20, 30)) / 10
    assert (fit.sill, fit.nugget) == pytest.approx((sill, model(2.5)))
    errors = {k: sum(100 * (fit.nugget + (fit.sill - fit.nugget) * (1 - math.exp(-3 * (j + 0.5) * 5 / (k / 2))) - model((j + 0.5) * 5)) ** 2 for j in range(30)) for k in range(1, 201)}
    assert fit.reach == min(errors, key=lambda k: (errors[k], k)) / 2
    assert aggregates.fitted_variogram(curve.limit(2), 5.0, 100.0).count() == 0


def test_sun_of_a_day(spark):
    # the equinox and the northern solstice of 2000 at places with and without a night
    days = {"equinox": datetime(2000, 3, 20), "solstice": datetime(2000, 6, 21)}
    rows = [(k, (d - datetime(2000, 1, 1, 12)) / timedelta(days=1), lat, lon) for k, d in days.items() for lat, lon in ((0.0, 0.0), (51.5, 0.0), (-33.9, 18.4), (80.0, 10.0))]
    df = spark.createDataFrame(rows, "day string, midnight double, lat double, lon double")
    got = {(q.day, q.lat): q for q in df.select("*", astronomy.sun_day(F.col("midnight"), F.col("lat"), F.col("lon")).alias("s")).select("*", "s.*").collect()}
    for lat in (0.0, 51.5, -33.9):
        q = got["equinox", lat]
        assert q.rise == pytest.approx(90, abs=1) and q.set == pytest.approx(270, abs=1)
        assert q.noon == pytest.approx(727 - 4 * q.lon, abs=2)  # the sun is some seven minutes late
    q = got["solstice", 51.5]
    amplitude = math.degrees(math.acos(math.sin(math.radians(23.44)) / math.cos(math.radians(51.5))))
    assert q.rise == pytest.approx(amplitude, abs=0.5) and q.set == pytest.approx(360 - amplitude, abs=0.5)
    assert got["solstice", 80.0].rise is None and got["solstice", 80.0].set is None


def test_beam_of_a_day(spark):
    df = spark.createDataFrame([(80, 0.0, 0.0, 180.0), (80, 45.0, 45.0, 180.0), (172, 80.0, 0.0, 0.0), (355, 80.0, 0.0, 0.0)], "day long, lat double, slope double, aspect double")
    beam = [r[0] for r in df.select(astronomy.daily_beam(F.col("day"), F.col("lat"), F.col("slope"), F.col("aspect"))).collect()]
    # overhead at noon on the equator the day's sum is the constant times two days' radii: 1361 * 86400 / pi
    assert beam[0] == pytest.approx(1361 * 86400 / math.pi / 1e6, rel=1e-3)
    assert beam[1] == pytest.approx(beam[0], rel=0.02)  # a slope that faces the noon sun
    assert beam[2] > beam[0] and beam[3] == 0
    thin = [r[0] for r in df.select(astronomy.daily_beam(F.col("day"), F.col("lat"), F.col("slope"), F.col("aspect"), 0.7)).collect()]
    assert all(a < b or a == b == 0 for a, b in zip(thin, beam, strict=True))
    with pytest.raises(ValueError):
        astronomy.daily_beam(F.col("day"), F.col("lat"), F.col("slope"), F.col("aspect"), step=7)


# codes, rings and masks


def test_quadkey_cover_is_exact_and_least(spark):
    from gridloom.functions import codes

    r = random.Random(8)
    boxes = [(0, 0, 15, 15), (0, 0, 0, 0), (3, 5, 12, 6), (8, 8, 15, 15)] + [(min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])) for p, q in (((r.randrange(16), r.randrange(16)), (r.randrange(16), r.randrange(16))) for _ in range(25))]
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "id long, a long, b long, c long, d long")
    got = {}
    for q in df.select("id", F.explode(codes.quadkey_cover(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 4)).alias("k")).select("id", "k.*").collect():
        assert len(q.key) == q.level
        got.setdefault(q.id, []).append(q.key)
    tiles = lambda key: {(x, y) for x in range(16) for y in range(16) if "".join(str((x >> b & 1) + 2 * (y >> b & 1)) for b in (3, 2, 1, 0)).startswith(key)}
    for k, (x0, y0, x1, y1) in enumerate(boxes):
        cover = [t for key in got[k] for t in tiles(key)]
        assert sorted(cover) == sorted((x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
        parents = [key[:-1] for key in got[k] if key]
        assert all(parents.count(p) < 4 for p in parents)


def test_front_coding_comes_back(spark):
    from gridloom.functions import codes

    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab") for _ in range(6))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, hash string").withColumn("block", F.substring("hash", 1, 1))
    coded = codes.front_coded(df, "hash", "block", 6)
    assert coded.filter("shared > 0").count() > 150
    back = codes.front_decoded(coded, "block", ["hash", "id"], 6).collect()
    assert sorted((q.id, q.code) for q in back) == sorted(rows)
    broken = spark.createDataFrame([(1, "x", 0, "ab"), (2, "x", 3, "c")], "id long, block string, shared long, suffix string")
    assert [q.code for q in codes.front_decoded(broken, "block", ["id"], 6).orderBy("id").collect()] == ["ab", None]


def test_masks_wider_than_a_word_and_squares_of_any_size(spark):
    r = random.Random(9)
    grid = [[r.random() < 0.5 for _ in range(150)] for _ in range(5)]
    words = raster.bit_words(cells_of(spark, grid), a=F.col("v") > 0)
    got = {q.r: q.n for q in words.groupBy("r").agg(F.sum(F.bit_count("a")).alias("n")).collect()}
    assert got == {k: sum(row) for k, row in enumerate(grid)}
    whole = [(q.side, q.i, q.j, q.b) for q in raster.uniform_squares(cells_of(spark, [[1] * 130 for _ in range(130)]), F.col("v") > 0).collect()]
    assert whole == [(256, 0, 0, 1)]
    spot = cells_of(spark, [[int((i, j) == (0, 0)) for j in range(128)] for i in range(128)])
    sizes = sorted(q.side for q in raster.uniform_squares(spot, F.col("v") > 0).collect())
    assert sizes == sorted([1] * 4 + [s for s in (2, 4, 8, 16, 32, 64) for _ in range(3)])


def test_offset_ring_has_its_area():
    ring = geometry.hull([(0.0, 0.0), (7.0, 1.0), (9.0, 6.0), (3.0, 8.0), (-1.0, 4.0)])
    perimeter = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    for steps in (1, 4, 16):
        out = geometry.offset_ring(ring, 2.0, steps)
        turns = [math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(b[1] - a[1], b[0] - a[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True)]
        fans = sum(steps * math.sin(t % (2 * math.pi) / steps) / 2 * 4 for t in turns)
        assert abs(geometry.ring_area(out)) == pytest.approx(abs(geometry.ring_area(ring)) + 2 * perimeter + fans)
    with pytest.raises(ValueError):
        geometry.offset_ring(ring, -1.0)


def test_similarity_recovers_its_own(spark):
    r = random.Random(2)
    p = [(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(30)]
    rows = [(x, y, 2 * x - 3 * y + 1, 3 * x + 2 * y - 4) for x, y in p]
    fit, gap = positioning.similarity(df := spark.createDataFrame(rows, "x double, y double, u double, v double"))
    assert tuple(fit.first()) == pytest.approx((2, 3, 1, -4))
    assert df.join(F.broadcast(fit)).agg(F.max(gap)).first()[0] < 1e-9
