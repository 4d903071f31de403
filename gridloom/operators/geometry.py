"""Computational geometry of point groups and rings: partial results per slice where they merge, one group per task otherwise."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Points = list[tuple[float, float]]


def turn(o: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: Points) -> Points:
    """Convex hull, counter-clockwise from the leftmost lowest point; points on its edges are dropped."""
    p = sorted(set(points))
    if len(p) < 3:
        return p
    half = []
    for order in (p, p[::-1]):
        side: Points = []
        for q in order:
            while len(side) > 1 and turn(side[-2], side[-1], q) <= 0:
                side.pop()
            side.append(q)
        half.append(side[:-1])
    return half[0] + half[1]


def hulls(points: DataFrame, key: str, slices: int = 64) -> DataFrame:
    """(key, pos, x, y): the hull of each group. Slices of a group give their own hulls first, so the last step sees few points."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        h = hull(list(zip(g["x"], g["y"], strict=True)))
        return pd.DataFrame({key: g[key].iloc[0], "pos": range(len(h)), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    schema = f"{key} long, pos int, x double, y double"
    part = points.withColumn("slice", F.pmod(F.xxhash64("x", "y"), F.lit(slices))).groupBy(key, "slice").applyInPandas(run, schema)
    return part.groupBy(key).applyInPandas(run, schema)


def per_hull(hulls_: DataFrame, key: str, f, schema: str) -> DataFrame:
    """A function of each hull's points in order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        return pd.DataFrame([(g[key].iloc[0], *f(list(zip(g["x"], g["y"], strict=True))))], columns=[c.split()[0] for c in schema.split(", ")])

    return hulls_.groupBy(key).applyInPandas(run, schema)


def diameter(p: Points) -> tuple[float]:
    return (max(math.dist(a, b) for a in p for b in p),)


def min_rectangle(p: Points) -> tuple[float, float]:
    """Area and longer side of the least rectangle: one of its sides lies on a hull edge. Of rectangles of equal area, as all of a triangle are, the one of the
    shortest longer side."""
    found = []
    for a, b in zip(p, p[1:] + p[:1], strict=True):
        n = math.dist(a, b)
        if n:
            ux, uy = (b[0] - a[0]) / n, (b[1] - a[1]) / n
            s, t = [q[0] * ux + q[1] * uy for q in p], [q[1] * ux - q[0] * uy for q in p]
            w, h = max(s) - min(s), max(t) - min(t)
            found.append((w * h, max(w, h)))
    least = min((a for a, _ in found), default=0.0)
    return least, min((s for a, s in found if a <= least * (1 + 1e-9)), default=0.0)


def least_circle(p: Points) -> tuple[float, float, float]:
    """Smallest enclosing circle, by random incremental construction."""
    q = p[:]
    random.Random(0).shuffle(q)
    inside = lambda c, a: math.dist(c[:2], a) <= c[2] + 1e-9
    two = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b) / 2)

    def three(a, b, c):
        d = 2 * turn(a, b, c)
        if abs(d) < 1e-12:
            return max((two(a, b), two(b, c), two(a, c)), key=lambda k: k[2])
        s = [k[0] ** 2 + k[1] ** 2 for k in (a, b, c)]
        x = (s[0] * (b[1] - c[1]) + s[1] * (c[1] - a[1]) + s[2] * (a[1] - b[1])) / d
        y = (s[0] * (c[0] - b[0]) + s[1] * (a[0] - c[0]) + s[2] * (b[0] - a[0])) / d
        return x, y, math.dist((x, y), a)

    c = (*q[0], 0.0)
    for i, a in enumerate(q):
        if not inside(c, a):
            c = (*a, 0.0)
            for j, b in enumerate(q[:i]):
                if not inside(c, b):
                    c = two(a, b)
                    for k in q[:j]:
                        if not inside(c, k):
                            c = three(a, b, k)
    return c


def circumcircle(a, b, c) -> tuple[float, float, float]:
    """(x, y, squared radius), reckoned from a, so small triangles far from the origin lose no digits; infinite if the corners lie on a line."""
    d = 2 * turn(a, b, c)
    if not d:
        return math.inf, math.inf, math.inf
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    u, v = ux * ux + uy * uy, vx * vx + vy * vy
    x, y = (vy * u - uy * v) / d, (ux * v - vx * u) / d
    return a[0] + x, a[1] + y, x * x + y * y


def ears(ring: Points) -> list[tuple[int, int, int]]:
    """A simple ring's n - 2 triangles."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    order, out = list(range(len(ring))) if area > 0 else list(range(len(ring)))[::-1], []
    while len(order) > 3:
        for i in range(len(order)):
            a, b, c = order[i - 1], order[i], order[(i + 1) % len(order)]
            t = [ring[k] for k in (a, b, c)]
            if turn(*t) > 0 and not any(k not in (a, b, c) and all(turn(t[j], t[(j + 1) % 3], ring[k]) >= 0 for j in range(3)) for k in order):
                out.append((a, b, c))
                order.pop(i)
                break
        else:
            raise ValueError("the ring is not simple")
    return [*out, tuple(order)]


def inner_pole(ring: Points, precision: float) -> tuple[float, float, float]:
    """The point farthest from the ring's edge, inside it: squares are split, the most promising first."""
    import heapq

    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))

    def depth(x: float, y: float) -> float:
        inside, best = False, math.inf
        for (ax, ay), (bx, by) in edges:
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
            dx, dy = bx - ax, by - ay
            s = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy or 1)))
            best = min(best, math.hypot(x - ax - s * dx, y - ay - s * dy))
        return best if inside else -best

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    h = max(max(xs) - min(xs), max(ys) - min(ys)) / 2
    x, y = (max(xs) + min(xs)) / 2, (max(ys) + min(ys)) / 2
    best = (depth(x, y), x, y)
    heap = [(-(best[0] + h * math.sqrt(2)), x, y, h)]
    while heap and -heap[0][0] - best[0] > precision:
        _, x, y, h = heapq.heappop(heap)
        h /= 2
        for a in (x - h, x + h):
            for b in (y - h, y + h):
                d = depth(a, b)
                best = max(best, (d, a, b))
                heapq.heappush(heap, (-(d + h * math.sqrt(2)), a, b, h))
    return best[1], best[2], best[0]


def on_rings(f, schema: str):
    """A column function of a ring (array of points), computed in Arrow batches; f gives a tuple in the schema's order."""
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(rings: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f([(p["x"], p["y"]) for p in r]) for r in rings], columns=names)

    return run


def below(ring: Points, nx: float, ny: float, offset: float) -> Points:
    """The part of a ring where nx x + ny y is at most ``offset``; a concave ring may keep seams of no width along the cut."""
    high = [nx * x + ny * y - offset for x, y in ring]
    out: Points = []
    for (p, h), (q, k) in zip(zip(ring, high, strict=True), zip(ring[1:] + ring[:1], high[1:] + high[:1], strict=True), strict=True):
        if h <= 0:
            out.append(p)
        if h * k < 0:
            t = h / (h - k)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def share_offset(ring: Points, share: float, direction: float) -> float:
    """Where a cut across ``direction`` (degrees from the x axis) leaves that share of the ring's area behind it.

    Between two neighbouring corners along the direction the area behind a cut is a quadratic of its place, so three areas give the place exactly;
    corners are halved until one such stretch is left.
    """
    nx, ny = math.cos(math.radians(direction)), math.sin(math.radians(direction))
    behind = lambda offset: abs(ring_area(below(ring, nx, ny, offset)))
    stops = sorted({nx * x + ny * y for x, y in ring})
    want = share * abs(ring_area(ring))
    low, high = 0, len(stops) - 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if behind(stops[mid]) < want else (low, mid)
    a, b = stops[low], stops[high]
    start, middle, end = behind(a), behind((a + b) / 2), behind(b)
    bend = 2 * (start + end - 2 * middle)
    slope, gap = end - start - bend, want - start
    root = slope + math.sqrt(max(0.0, slope * slope + 4 * bend * gap))
    return a + (b - a) * (min(1.0, max(0.0, 2 * gap / root)) if root > 0 else 0.0)


def equal_strips(ring: Points, count: int, direction: float) -> list[tuple[float, float]]:
    """(offset, area) of the strips of equal area across a direction, the nearest first; offset is where a strip ends."""
    nx, ny = math.cos(math.radians(direction)), math.sin(math.radians(direction))
    if len(ring) < 3 or not ring_area(ring):
        return []
    ends = [share_offset(ring, k / count, direction) for k in range(1, count)] + [max(nx * x + ny * y for x, y in ring)]
    areas = [abs(ring_area(below(ring, nx, ny, e))) for e in ends[:-1]] + [abs(ring_area(ring))]
    return [(e, a - b) for e, a, b in zip(ends, areas, [0.0, *areas[:-1]], strict=True)]


def on_strips(count: int):
    """A column function of a ring and a direction: its equal strips; none of a ring without area."""

    @F.pandas_udf("array<struct<offset:double,area:double>>")
    def run(rings: pd.Series, directions: pd.Series) -> pd.Series:
        return pd.Series([[{"offset": o, "area": a} for o, a in equal_strips([(p["x"], p["y"]) for p in r], count, d)] for r, d in zip(rings, directions, strict=True)], dtype=object)

    return run


def clip_ring(ring: Points, window: Points) -> Points:
    """A ring clipped to a convex counter-clockwise window, one edge after another."""
    out = ring
    for a, b in zip(window, window[1:] + window[:1], strict=True):
        now, out = out, []
        for p, q in zip(now, now[1:] + now[:1], strict=True):
            s, t = turn(a, b, p), turn(a, b, q)
            if s >= 0:
                out.append(p)
            if (s > 0) != (t > 0) and s != t and s * t < 0:
                k = s / (s - t)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
    return out


def ring_area(ring: Points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if ring else 0.0


def minkowski(a: Points, b: Points) -> Points:
    """Sum of two convex counter-clockwise rings: all their edges in order of direction, from the sum of the lowest corners on.

    Edges of one direction are joined; rings of one or two points are allowed.
    """
    lowest = lambda r: min(r, key=lambda p: (p[1], p[0]))
    steps = [(q[0] - p[0], q[1] - p[1]) for r in (a, b) for p, q in zip(r, r[1:] + r[:1], strict=True) if p != q]
    steps.sort(key=lambda e: math.atan2(e[1], e[0]) % (2 * math.pi))
    x, y = (u + v for u, v in zip(lowest(a), lowest(b), strict=True))
    out: Points = [(x, y)]
    for i, (dx, dy) in enumerate(steps[:-1]):
        x, y = x + dx, y + dy
        nx, ny = steps[i + 1]
        if abs(dx * ny - dy * nx) > 1e-12 * (abs(dx) + abs(dy)) * (abs(nx) + abs(ny)) or dx * nx + dy * ny < 0:
            out.append((x, y))
    return out


def steiner_area(area: Column, perimeter: Column, distance: float) -> Column:
    """Area of a convex ring's buffer."""
    return area + perimeter * distance + math.pi * distance * distance


def offset_ring(ring: Points, distance: float, steps: int = 8) -> Points:
    """The buffer's ring of a convex counter-clockwise one: at every corner an arc of ``steps`` chords from the normal of the edge before to that of the edge after."""
    if distance < 0 or steps < 1:
        raise ValueError("the distance must not be negative, with one chord or more")
    normals = [math.atan2(p[0] - q[0], q[1] - p[1]) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    out: Points = []
    for (x, y), before, after in zip(ring, normals[-1:] + normals[:-1], normals, strict=True):
        sweep = (after - before) % (2 * math.pi)
        out += [(x + distance * math.cos(before + sweep * k / steps), y + distance * math.sin(before + sweep * k / steps)) for k in range(steps + 1)]
    return out
