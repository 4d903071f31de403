"""Delaunay triangulation of one point set by tiles, and what is read off it: Voronoi edges, shapes, circles and proximity graphs.

Tiles that hold too many points are split, so a cluster is many small tiles. A tile triangulates its own points with those of the tiles round it. Whether a
triangle holds for the whole set is then a join: a point of other tiles inside its circle is given to the tile, which triangulates anew, until no circle holds
a point. So tiles agree over their seams and no task holds more than a tile's surroundings.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import circumcircle, hulls
from gridloom.operators.joins import cell, density_side
from gridloom.operators.scratch import settle

#: Points that a tile has on average; one with more than CROWD times as many is split, at most DEEPEST times (each time the side shrinks by 4).
TILE_POINTS, CROWD, DEEPEST = 96.0, 4, 20
#: The corner at infinity: a triangle (a, b, OUTSIDE) stands for the open half plane left of a to b, beyond the hull.
OUTSIDE = -1
TRIANGLES = "a long, b long, c long, ax double, ay double, bx double, by double, cx double, cy double, x double, y double, r2 double"


def side_of(a: tuple[float, float], b: tuple[float, float], p: tuple[float, float]) -> int:
    """1 if p lies left of a to b, -1 right, 0 on the line: exactly, in rationals where rounding could decide."""
    ux, uy, vx, vy = b[0] - a[0], p[1] - a[1], b[1] - a[1], p[0] - a[0]
    d = ux * uy - vx * vy
    if abs(d) <= 1e-14 * (abs(ux * uy) + abs(vx * vy)) or not d:
        (ax, ay), (bx, by), (px, py) = (tuple(map(Fraction, q)) for q in (a, b, p))
        d = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (d > 0) - (d < 0)


def encloses(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float], p: tuple[float, float]) -> bool:
    """Whether the circle round a counter-clockwise triangle holds p inside, in rationals."""
    px, py = map(Fraction, p)
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(q[0]) - px, Fraction(q[1]) - py) for q in (a, b, c))
    return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0


def triangulate(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Counter-clockwise triangles of indices, and for each hull edge one with OUTSIDE; none if all points lie on a line.

    Points come one by one; triangles whose circle (or half plane) holds the new one give way to a fan round it. Its nearest point is a corner of one of them, and they lie
    side by side, so the search begins there and looks at their neighbours only. Tests near zero are made in
    rationals, so lattices and points in a line are no trouble; of four points exactly on a circle either diagonal may come.
    """
    n = len(points)
    second = next((j for j in range(1, n) if points[j] != points[0]), n)
    third = next((k for k in range(second + 1, n) if side_of(points[0], points[second], points[k])), n)
    if third >= n:
        return []
    a, b, c = (0, second, third) if side_of(points[0], points[second], points[third]) > 0 else (0, third, second)
    points = [(float(x), float(y)) for x, y in points]
    # the third corner of the triangle at each directed edge, one neighbour of each point, and the points that came so far
    apex: dict[tuple[int, int], int] = {}
    beside_: dict[int, int] = {}
    came, xs, ys = [a, b, c], np.full(n, np.inf), np.full(n, np.inf)

    def add(u: int, v: int, w: int) -> None:
        apex[u, v], apex[v, w], apex[w, u] = w, u, v
        beside_[u], beside_[v], beside_[w] = v, w, u

    def holds(u: int, v: int, w: int, p: tuple[float, float]) -> bool:
        while w != OUTSIDE and OUTSIDE in (u, v):
            u, v, w = v, w, u
        if w == OUTSIDE:
            d, e = points[u], points[v]
            side = side_of(d, e, p)
            return side > 0 or side == 0 and (p[0] - d[0]) * (p[0] - e[0]) + (p[1] - d[1]) * (p[1] - e[1]) < 0
        (ux, uy), (vx, vy), (wx, wy), (px, py) = points[u], points[v], points[w], p
        ux, uy, vx, vy, wx, wy = ux - px, uy - py, vx - px, vy - py, wx - px, wy - py
        us, vs, ws = ux * ux + uy * uy, vx * vx + vy * vy, wx * wx + wy * wy
        vw, wv, uw, wu, uv, vu = vx * wy, vy * wx, ux * wy, uy * wx, ux * vy, uy * vx
        det = us * (vw - wv) - vs * (uw - wu) + ws * (uv - vu)
        if abs(det) <= 1e-13 * (us * (abs(vw) + abs(wv)) + vs * (abs(uw) + abs(wu)) + ws * (abs(uv) + abs(vu))):
            return encloses(points[u], points[v], points[w], p)
        return det > 0

    def first(near: int, p: tuple[float, float]) -> tuple[int, int, int] | None:
        u = start = beside_[near]
        while True:
            w = apex[near, u]
            if holds(near, u, w, p):
                return near, u, w
            if (u := w) == start:
                return next(((d, e, f) for (d, e), f in apex.items() if holds(d, e, f, p)), None)

    for t in ((a, b, c), (b, a, OUTSIDE), (c, b, OUTSIDE), (a, c, OUTSIDE)):
        add(*t)
    for k, i in enumerate(came):
        xs[k], ys[k] = points[i]
    for i in range(n):
        if i in (0, second, third):
            continue
        p, m = points[i], len(came)
        dx, dy = xs[:m] - p[0], ys[:m] - p[1]
        near = int((dx * dx + dy * dy).argmin())
        if points[came[near]] == p or (t := first(came[near], p)) is None:
            continue
        edges, rim = [(t[0], t[1]), (t[1], t[2]), (t[2], t[0])], []
        gone = set(edges)
        while edges:
            e, f = edges.pop()
            if (f, e) in gone:
                continue
            g = apex[f, e]
            if holds(f, e, g, p):
                gone |= {(f, e), (e, g), (g, f)}
                edges += [(e, g), (g, f)]
            else:
                rim.append((e, f))
        for e in gone:
            del apex[e]
        for e, f in rim:
            add(e, f, i)
        xs[m], ys[m] = p
        came.append(i)
    found = set()
    for (u, v), w in apex.items():
        while w != OUTSIDE and (OUTSIDE in (u, v) or w < max(u, v)):
            u, v, w = v, w, u
        found.add((u, v, w))
    return sorted(found)


def in_circle(x: Column, y: Column) -> Column:
    return F.pow(x - F.col("x"), 2) + F.pow(y - F.col("y"), 2) - F.col("r2") * (1 - 1e-12)


def circle_cells(circles: DataFrame, side: float, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Cells of the extent that a circle (x, y, r2) touches, column by column, so a wide circle deals few where it is only a sliver of the extent."""
    r = F.sqrt("r2")
    first, last = (F.greatest(cell(F.col("x") - r, side), cell(F.lit(low[0]), side)), F.least(cell(F.col("x") + r, side), cell(F.lit(high[0]), side)))
    cols = circles.filter(first <= last).withColumn("__cx", F.explode(F.sequence(first, last)))
    near = F.greatest(F.lit(0.0), F.col("__cx") * side - F.col("x"), F.col("x") - (F.col("__cx") + 1) * side)
    half = F.sqrt(F.greatest(F.lit(0.0), F.col("r2") - near * near))
    below = F.greatest(cell(F.col("y") - half, side) - 1, cell(F.lit(low[1]), side))
    above = F.least(cell(F.col("y") + half, side) + 1, cell(F.lit(high[1]), side))
    return cols.filter(below <= above).withColumn("__cy", F.explode(F.sequence(below, above)))


def in_cells(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({"__cx": cell(F.col("x"), side), "__cy": cell(F.col("y"), side)})


def with_steps(df: DataFrame) -> DataFrame:
    """Each row nine times, with the step ``s`` (i, j) to its own cell and those round it."""
    return df.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))


def beside(cells: DataFrame) -> DataFrame:
    """Cells of ``cells`` (__cx, __cy) and those round them, once each."""
    return with_steps(cells.select("__cx", "__cy")).select((F.col("__cx") + F.col("s.i")).alias("__cx"), (F.col("__cy") + F.col("s.j")).alias("__cy")).distinct()


def quadrants(points: DataFrame, side: float, most: float) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their tile lv, __cx, __cy; cells of each level with __cx, __cy, whether they are split, and ``one`` of their points).

    ``points`` (id, x, y) has each place once. A cell with more than ``most`` points is split into sixteen, level by level; each level counts only what lies in split cells.
    Sides shrink by powers of two, so cells lie exactly inside those they come from.
    """
    levels: list[DataFrame] = []
    tiles, left = None, points.select("id", "x", "y")
    while True:
        lv = len(levels)
        keyed = in_cells(left, side / 4**lv)
        split = F.count("*") > most if lv < DEEPEST else F.lit(False)
        levels.append(settle(keyed.groupBy("__cx", "__cy").agg(split.alias("split"), F.min(F.struct("id", "x", "y")).alias("one")), lv))
        own = keyed.join(levels[-1].filter("not split"), ["__cx", "__cy"], "left_semi").select("id", "x", "y", F.lit(lv).alias("lv"), "__cx", "__cy")
        tiles = own if tiles is None else tiles.union(own)
        crowd = levels[-1].filter("split")
        if crowd.isEmpty():
            return settle(tiles), levels
        left = settle(keyed.join(crowd, ["__cx", "__cy"], "left_semi").select("id", "x", "y"), lv)


def surroundings(p: DataFrame, levels: list[DataFrame], side: float) -> DataFrame:
    """(lv, tx, ty, id, x, y, own, known): what each tile begins with. That is its own points, those of the cells of its size round it, and of split cells there one
    point for each sixteenth: a wide tile beside a cluster doesn't take the cluster. ``known`` tells whether no cell round it is split."""
    sets = None
    for lv, nodes in enumerate(levels):
        s, last = side / 4**lv, lv + 1 == len(levels)
        tiles = nodes.filter("not split").select(F.lit(lv).alias("lv"), F.col("__cx").alias("tx"), F.col("__cy").alias("ty"), F.lit(True).alias("known"))
        near = p.filter(F.col("lv") <= lv).select("id", "x", "y")
        if lv:
            near = in_cells(near, s * 4).join(beside(levels[lv - 1].filter("split")), ["__cx", "__cy"], "left_semi").select("id", "x", "y")
        near = in_cells(near, s)
        if not last:
            dense = beside(nodes.filter("split")).select(F.col("__cx").alias("tx"), F.col("__cy").alias("ty"), F.lit(True).alias("dense"))
            tiles = tiles.drop("known").join(dense, ["tx", "ty"], "left").select("lv", "tx", "ty", F.col("dense").isNull().alias("known"))
            parts = levels[lv + 1].select("one.*", F.shiftright("__cx", 2).alias("__cx"), F.shiftright("__cy", 2).alias("__cy"))
            near = near.unionByName(parts)
        shown = with_steps(near).select((F.col("__cx") + F.col("s.i")).alias("tx"), (F.col("__cy") + F.col("s.j")).alias("ty"), "id", "x", "y", ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
        shown = shown.join(tiles, ["tx", "ty"]).select("lv", "tx", "ty", "id", "x", "y", "own", "known")
        sets = shown if sets is None else sets.union(shown)
    return sets


def tiles_of(discs: DataFrame, levels: list[DataFrame], side: float, low: tuple[float, float], high: tuple[float, float], full: Column | None = None) -> DataFrame:
    """Rows of ``discs`` (x, y, r2) with each tile (lv, __cx, __cy) that they touch, going down the levels of cells.

    Where ``full`` holds for a split cell (of side __s, with its point ``one``), the disc stops there and has that point as ``one``, which is null elsewhere.
    """
    rows = circle_cells(discs, side, low, high).withColumn("lv", F.lit(0))
    none = F.lit(None).cast("struct<id:long,x:double,y:double>")
    if len(levels) == 1:
        return rows.withColumn("one", none)
    state = lambda lv, x, y, done, one: F.struct(F.lit(lv).cast("int").alias("lv") if isinstance(lv, int) else lv.alias("lv"), x.alias("__cx"), y.alias("__cy"), F.lit(done).alias("done"), one.alias("one"))
    rows = rows.withColumns({"done": F.lit(False), "one": none})
    for lv, nodes in enumerate(levels):
        s = side / 4**lv
        n = nodes.select(F.col("__cx").alias("__nx"), F.col("__cy").alias("__ny"), "split", F.col("one").alias("__one"))
        met = rows.join(n, ~F.col("done") & (F.col("__cx") == F.col("__nx")) & (F.col("__cy") == F.col("__ny")), "left").filter("done or split is not null").withColumn("__s", F.lit(s))
        stops = F.lit(False) if full is None else F.coalesce(full, F.lit(False))
        parts = F.array(*[state(lv + 1, F.col("__cx") * 4 + i, F.col("__cy") * 4 + j, False, none) for i in range(4) for j in range(4)])
        stay = lambda at, one: F.array(state(at, F.col("__cx"), F.col("__cy"), True, one))
        go = F.when(F.col("done"), stay(F.col("lv"), F.col("one"))).when(~F.col("split"), stay(lv, none)).when(stops, stay(lv, F.col("__one"))).otherwise(parts)
        rows = met.withColumn("__go", F.explode(go)).drop("lv", "__cx", "__cy", "done", "one", "__nx", "__ny", "split", "__one", "__s").select("*", "__go.*").drop("__go")
        gap = lambda c, v, w=s / 4: F.greatest(F.lit(0.0), F.col(c) * w - F.col(v), F.col(v) - (F.col(c) + 1) * w)
        rows = rows.filter(F.col("done") | (F.pow(gap("__cx", "x"), 2) + F.pow(gap("__cy", "y"), 2) <= F.col("r2") * (1 + 1e-9)))
    return settle(rows.drop("done"))


def triangles(points: DataFrame, per_tile: float = TILE_POINTS) -> DataFrame:
    """The Delaunay triangles of all ``points`` (id, x, y): corners a < b < c with their places, circumcentre x, y and squared radius r2.

    Points at one place count once, by their smallest id. A tile keeps the triangles whose smallest corner is its own. A triangle is final if no point
    lies in its circle; beyond a hull edge no vertex of the whole set's hull may lie.
    """
    spark = points.sparkSession
    p = settle(points.groupBy("x", "y").agg(F.min("id").alias("id")), 0)
    side = density_side(p, "x", "y", per_tile)
    hull = settle(hulls(p.select("x", "y", F.lit(0).cast("long").alias("one")), "one").join(p, ["x", "y"]).select("id", "x", "y"), 0)
    if hull.count() < 3:
        return spark.createDataFrame([], TRIANGLES)
    low_x, low_y, high_x, high_y = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    p, levels = quadrants(p, side, CROWD * per_tile)
    sets, tile = surroundings(p, levels, side), ["lv", "tx", "ty"]
    sets = settle(sets) if len(levels) > 1 else sets
    names = [x.split()[0] for x in TRIANGLES.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        known, g = bool(g["known"].any()), g.sort_values(["id", "own"], ascending=[True, False]).drop_duplicates("id")
        key = (lv, tx, ty) = tuple(int(g[k].iloc[0]) for k in tile)
        s = side / 4**lv
        at, ids, own = list(zip(g["x"], g["y"], strict=True)), g["id"].tolist(), g["own"].tolist()
        found = triangulate(at)
        rows = [] if found else [(*key, *[None] * 12, False, False)]
        for t in found:
            if not any(v != OUTSIDE and own[v] for v in t):
                continue
            if t[2] == OUTSIDE:
                rows.append((*key, ids[t[0]], ids[t[1]], None, *at[t[0]], *at[t[1]], None, None, None, None, None, False, False))
                continue
            t = sorted(t)
            x, y, r2 = circumcircle(*(at[v] for v in t))
            r = math.sqrt(r2)
            inside = not math.isfinite(r) or known and (tx - 1) * s <= x - r and x + r <= (tx + 2) * s and (ty - 1) * s <= y - r and y + r <= (ty + 2) * s
            rows.append((*key, *(ids[v] for v in t), *at[t[0]], *at[t[1]], *at[t[2]], x, y, r2, inside, own[t[0]]))
        return pd.DataFrame(rows, columns=[*tile, *names, "inside", "mine"]).astype({k: "Int64" for k in "abc"})

    # a point of a cell that the circle holds whole and by a wide margin will do; circles much wider than their triangle are rounded too much for that
    reach = lambda c, v: F.greatest(F.abs(F.col(v) - F.col(c) * F.col("__s")), F.abs(F.col(v) - (F.col(c) + 1) * F.col("__s")))
    holds = F.pow(reach("__cx", "x"), 2) + F.pow(reach("__cy", "y"), 2) < F.col("r2") * (1 - 1e-6)
    sound = F.col("r2") < 1e12 * (F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    full = holds & sound & ~F.col("__one.id").isin(F.col("a"), F.col("b"), F.col("c"))
    done = None
    while True:
        found = settle(sets.groupBy(*tile).applyInPandas(run, f"lv int, tx long, ty long, {TRIANGLES}, inside boolean, mine boolean"), 0)
        discs = found.filter("c is not null and not inside").withColumnRenamed("lv", "tl")
        circles = tiles_of(discs, levels, side, (low_x, low_y), (high_x, high_y), full)
        place = lambda k: (F.col(f"{k}id").alias("qid"), F.col(f"{k}x").alias("qx"), F.col(f"{k}y").alias("qy"))
        corner = ("tl", "tx", "ty", "a", "b", "c", "x", "y", "r2")
        q = p.select("lv", "__cx", "__cy", *(F.col(k).alias(f"q{k}") for k in ("id", "x", "y")))
        met = circles.filter("one is null").join(q, ["lv", "__cx", "__cy"]).select(*corner, "qid", "qx", "qy")
        if len(levels) > 1:
            met = met.union(circles.filter("one is not null").select(*corner, *place("one.")))
        deep = met.withColumn("depth", in_circle(F.col("qx"), F.col("qy"))).filter("depth < 0 and qid != a and qid != b and qid != c")
        more = deep.groupBy("tl", "tx", "ty", "a", "b", "c").agg(F.min(F.struct("depth", "qid", "qx", "qy")).alias("m")).select(F.col("tl").alias("lv"), "tx", "ty", "m.qid", "m.qx", "m.qy")
        # a hull has few vertices and has been brought together in one task already
        h = F.broadcast(hull.select(*(F.col(k).alias(f"q{k}") for k in ("id", "x", "y"))))
        left = (F.col("bx") - F.col("ax")) * (F.col("qy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("qx") - F.col("ax"))
        beyond = found.filter("c is null and a is not null").join(h).withColumn("depth", left).filter("depth > 1e-9 and qid != a and qid != b")
        beyond = beyond.groupBy(*tile, "a", "b").agg(F.max(F.struct("depth", "qid", "qx", "qy")).alias("m")).select(*tile, "m.qid", "m.qx", "m.qy")
        flat = found.filter("a is null").join(h).select(*tile, "qid", "qx", "qy")  # all in a line: any hull corner off it will do
        # what a tile has already is only held to be inside by rounding, in the wide circles along the hull
        held = sets.select(*tile, F.col("id").alias("qid"))
        more = settle(more.union(beyond).union(flat).distinct().join(held, [*tile, "qid"], "left_anti"), 0)
        again = more.select(*tile).distinct()
        ready = found.filter("mine").join(again, tile, "left_anti").select(*names)
        done = ready if done is None else done.union(ready)
        if more.isEmpty():
            return settle(done, 0)
        added = more.select(*tile, F.col("qid").alias("id"), F.col("qx").alias("x"), F.col("qy").alias("y"), F.lit(False).alias("own"), F.lit(False).alias("known"))
        sets = settle(sets.join(again, tile).unionByName(added), 0)


def edges(tri: DataFrame) -> DataFrame:
    """(a, b, ax, ay, bx, by, n, sides): each edge a < b once; n is 1 on the boundary, ``sides`` has the opposite corners and circumcentres."""
    place = lambda k: (F.col(k), F.col(f"{k}x"), F.col(f"{k}y"))
    one = lambda p, q, o: F.struct(*[v.alias(n) for v, n in zip((*place(p), *place(q), *place(o)), ("a", "ax", "ay", "b", "bx", "by", "o", "ox", "oy"), strict=True)], F.col("x").alias("x"), F.col("y").alias("y"), F.col("r2").alias("r2"))
    e = tri.select(F.explode(F.array(one("a", "b", "c"), one("b", "c", "a"), one("a", "c", "b"))).alias("e")).select("e.*")
    return e.groupBy("a", "b", "ax", "ay", "bx", "by").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("o", "ox", "oy", "x", "y", "r2"))).alias("sides"))  # two at most


def gabriel(tri: DataFrame) -> DataFrame:
    """(src, dst, w): Delaunay edges whose diametral circle is empty: neither opposite corner sees the edge at more than a right angle."""
    blocks = F.exists("sides", lambda s: (F.col("ax") - s["ox"]) * (F.col("bx") - s["ox"]) + (F.col("ay") - s["oy"]) * (F.col("by") - s["oy"]) < -1e-9)
    return edges(tri).filter(~blocks).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).alias("w"), "ax", "ay", "bx", "by")


def relative_neighbours(points: DataFrame, near: DataFrame, per_tile: float = TILE_POINTS) -> DataFrame:
    """Gabriel edges with an empty lune: no third point is nearer to both ends than they are to one another. Lunes meet the points of the tiles that they touch."""
    p = settle(points.groupBy("x", "y").agg(F.min("id").alias("id")))
    side = density_side(p, "x", "y", per_tile)
    low_x, low_y, high_x, high_y = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if low_x is None:
        return near.select("src", "dst", "w")
    p, levels = quadrants(p, side, CROWD * per_tile)
    w2 = F.col("w") * F.col("w")
    lunes = near.withColumns({"x": (F.col("ax") + F.col("bx")) / 2, "y": (F.col("ay") + F.col("by")) / 2, "r2": w2 * 0.75})
    own = p.select("lv", "__cx", "__cy", F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = lambda k: F.pow(F.col("ox") - F.col(f"{k}x"), 2) + F.pow(F.col("oy") - F.col(f"{k}y"), 2)
    met = tiles_of(lunes, levels, side, (low_x, low_y), (high_x, high_y)).join(own, ["lv", "__cx", "__cy"])
    blocked = met.filter((F.col("o") != F.col("src")) & (F.col("o") != F.col("dst")) & (F.greatest(d("a"), d("b")) < w2 * (1 - 1e-12))).select("src", "dst").distinct()
    return near.join(blocked, ["src", "dst"], "left_anti").select("src", "dst", "w")
