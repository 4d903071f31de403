"""Trajectories and lines: windows where order alone matters, one group per track where the algorithm is sequential."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def by_time() -> Window:
    return Window.partitionBy("track").orderBy("seq")


def speeds(fixes: DataFrame, ceiling: float | None = None) -> DataFrame:
    """Speed from the fix before; a time that doesn't grow is an error. With a ceiling, whether it is implausible."""
    w = by_time()
    dt = F.col("t") - F.lag("t").over(w)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    speed = F.when(dt > 0, F.try_divide(step, dt)).when(dt.isNotNull(), F.raise_error(F.lit("times must grow along a track")).cast("double"))
    out = fixes.withColumn("speed", speed)
    return out if ceiling is None else out.withColumn("implausible", F.col("speed") > ceiling)


def per_track(fixes: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One group per track, in order: a track's own fixes are what a task holds."""
    return fixes.groupBy("track").applyInPandas(lambda g: f(g.sort_values("seq")), schema)


def stops(fixes: DataFrame, radius: float, dwell: float) -> DataFrame:
    """(track, first, last, x, y): runs of fixes within the radius of their first one for at least ``dwell``; runs don't overlap.

    A run begins at an anchor; an anchor that fails moves on by one fix."""

    def found(g: pd.DataFrame) -> pd.DataFrame:
        seq, t, x, y = (g[c].to_numpy() for c in ("seq", "t", "x", "y"))
        out, i, n = [], 0, len(g)
        while i < n:
            away = np.flatnonzero(np.hypot(x[i:] - x[i], y[i:] - y[i]) > radius)
            j = i + int(away[0]) if len(away) else n
            if t[j - 1] - t[i] >= dwell and j - i > 1:
                out.append((g["track"].iloc[0], seq[i], seq[j - 1], x[i:j].mean(), y[i:j].mean()))
                i = j
            else:
                i += 1
        return pd.DataFrame(out, columns=["track", "first", "last", "x", "y"])

    return per_track(fixes, found, "track long, first long, last long, x double, y double")


def kept_mask(points: np.ndarray, tolerance: float, gap: Callable[[np.ndarray, int, int], np.ndarray]) -> np.ndarray:
    """Douglas and Peucker: split at the worst point while it is farther than the tolerance; a stack instead of recursion."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            d = gap(points, a, b)
            k = int(d.argmax())
            if d[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def chord_gap(p: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distance of the points between to the segment."""
    q, d = p[a + 1 : b, :2] - p[a, :2], p[b, :2] - p[a, :2]
    n = d @ d
    s = np.clip(q @ d / n, 0, 1) if n else np.zeros(len(q))
    return np.hypot(*(q - s[:, None] * d).T)


def timed_gap(p: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distance of the points between to where a steady mover would be at their time."""
    s = (p[a + 1 : b, 2] - p[a, 2]) / (p[b, 2] - p[a, 2])
    return np.hypot(*(p[a + 1 : b, :2] - p[a, :2] - s[:, None] * (p[b, :2] - p[a, :2])).T)


def compressed(fixes: DataFrame, tolerance: float, timed: bool = False) -> DataFrame:
    """The fixes that simplification keeps."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return g[kept_mask(g[["x", "y", "t"]].to_numpy(float), tolerance, timed_gap if timed else chord_gap)]

    return per_track(fixes.select("track", "seq", "t", "x", "y"), run, "track long, seq long, t double, x double, y double")


def removal_order(points: np.ndarray, keep: int, least: float = np.inf) -> np.ndarray:
    """Which points stay when the inner point of the least current triangle with its neighbours goes, again and again, until ``keep`` points
    are left or the least area is ``least`` or more. Areas are always the current ones; of equal areas the first point goes."""
    import heapq

    n = len(points)
    prv, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    area = lambda i: abs((points[nxt[i]][0] - points[prv[i]][0]) * (points[i][1] - points[prv[i]][1]) - (points[i][0] - points[prv[i]][0]) * (points[nxt[i]][1] - points[prv[i]][1])) / 2
    now = {i: area(i) for i in range(1, n - 1)}
    heap = [(a, i) for i, a in now.items()]
    heapq.heapify(heap)
    left = n
    while heap and left > max(keep, 2):
        a, i = heapq.heappop(heap)
        if not alive[i] or now[i] != a:
            continue
        if a >= least:
            break
        alive[i] = False
        left -= 1
        p, q = prv[i], nxt[i]
        nxt[p], prv[q] = q, p
        for k in (p, q):
            if 0 < k < n - 1 and alive[k]:
                now[k] = area(k)
                heapq.heappush(heap, (now[k], k))
    return np.array(alive)


def thinned_by_area(fixes: DataFrame, keep: int = 2, least: float = np.inf) -> DataFrame:
    """The fixes that area simplification keeps: down to ``keep`` of a track, or until no triangle is smaller than ``least``."""
    if keep < 2 or least < 0:
        raise ValueError("keep two points at least, and give no negative area")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return g[removal_order(g[["x", "y"]].to_numpy(float), keep, least)]

    return per_track(fixes.select("track", "seq", "x", "y"), run, "track long, seq long, x double, y double")


def kalman(fixes: DataFrame, process: float, noise: float) -> DataFrame:
    """Forward constant-velocity filter per axis; the first output is the first fix."""

    def axis(t: np.ndarray, z: np.ndarray) -> np.ndarray:
        s, p, out = np.array([z[0], 0.0]), np.eye(2) * noise, [z[0]]
        for i in range(1, len(z)):
            dt = t[i] - t[i - 1]
            f = np.array([[1.0, dt], [0.0, 1.0]])
            q = process * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            s, p = f @ s, f @ p @ f.T + q
            k = p[:, 0] / (p[0, 0] + noise)
            s, p = s + k * (z[i] - s[0]), p - np.outer(k, p[0])
            out.append(s[0])
        return np.array(out)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t = g["t"].to_numpy(float)
        t = (t - t[0]) / 3600
        return pd.DataFrame({"track": g["track"], "seq": g["seq"], "x": axis(t, g["x"].to_numpy(float)), "y": axis(t, g["y"].to_numpy(float))})

    return per_track(fixes, run, "track long, seq long, x double, y double")


def smoothed(fixes: DataFrame, half: int) -> DataFrame:
    """Centred moving averages, shorter at the ends."""
    w = by_time().rowsBetween(-half, half)
    return fixes.withColumns({"sx": F.avg("x").over(w), "sy": F.avg("y").over(w)})


def measures(fixes: DataFrame) -> DataFrame:
    """Length along the track up to each fix."""
    w = by_time()
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return fixes.withColumn("__step", step).withColumn("m", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def legs(fixes: DataFrame) -> DataFrame:
    """Segments between consecutive fixes: (track, seq, x1, y1, x2, y2, m1, m2)."""
    w = by_time()
    m = measures(fixes)
    out = m.select("track", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.col("m").alias("m1"), F.lead("m").over(w).alias("m2"))
    return out.filter("x2 is not null")


def snapped(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(track, id): for each point of a track the nearest place on its line: distance, measure, and side (left positive)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = dx * dx + dy * dy
    s = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, n)))).otherwise(0.0)
    near = points.join(lines, "track").withColumn("s", s)
    d = F.hypot(F.col("x") - F.col("x1") - F.col("s") * dx, F.col("y") - F.col("y1") - F.col("s") * dy)
    side = F.signum(dx * (F.col("y") - F.col("y1")) - dy * (F.col("x") - F.col("x1")))
    best = near.groupBy("track", "id").agg(F.min(F.struct(d.alias("d"), "seq", (F.col("m1") + F.col("s") * (F.col("m2") - F.col("m1"))).alias("m"), side.alias("side"))).alias("b"))
    return best.select("track", "id", "b.d", "b.m", "b.side")


def located(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """Positions at measures along each track's line."""
    s = F.when(F.col("m2") > F.col("m1"), F.try_divide(F.col("m") - F.col("m1"), F.col("m2") - F.col("m1"))).otherwise(0.0)
    on = lines.join(marks, "track").filter((F.col("m") >= F.col("m1")) & (F.col("m") < F.col("m2")))
    return on.select("track", "id", (F.col("x1") + s * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + s * (F.col("y2") - F.col("y1"))).alias("y"))


def curvatures(fixes: DataFrame) -> DataFrame:
    """Menger curvature at inner fixes: four times the triangle's area over the product of its sides."""
    w = by_time()
    ax, ay, bx, by = F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w)
    x, y = F.col("x"), F.col("y")
    product = F.hypot(x - ax, y - ay) * F.hypot(bx - x, by - y) * F.hypot(bx - ax, by - ay)
    return fixes.withColumn("curvature", F.when(product > 0, F.try_divide(2 * F.abs((x - ax) * (by - ay) - (bx - ax) * (y - ay)), product))).filter("curvature is not null")


def cut_corners(fixes: DataFrame) -> DataFrame:
    """One pass of corner cutting: each leg gives the points at a quarter and three quarters."""
    q = lambda v, s: (F.col(f"{v}1") * (1 - s) + F.col(f"{v}2") * s).alias(v)
    leg = legs(fixes)
    return leg.select("track", (2 * F.col("seq")).alias("seq"), q("x", 0.25), q("y", 0.25)).union(leg.select("track", (2 * F.col("seq") + 1).alias("seq"), q("x", 0.75), q("y", 0.75)))


def divider_walk(fixes: DataFrame, span: float) -> DataFrame:
    """Steps of a divider of fixed span along each track."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y"]].to_numpy(float)
        at, i, n = p[0], 1, 0
        while i < len(p):
            far = np.flatnonzero(np.hypot(*(p[i:] - at).T) >= span)
            if not len(far):
                break
            k = i + int(far[0])
            a = p[k - 1] if k > i or np.hypot(*(p[k - 1] - at)) < span else at
            d, f = p[k] - a, a - at
            qa, qb, qc = d @ d, 2 * (f @ d), f @ f - span * span
            s = (-qb + math.sqrt(max(0.0, qb * qb - 4 * qa * qc))) / (2 * qa)
            at, i, n = a + min(1.0, max(s, 1e-12)) * d, k, n + 1
        return pd.DataFrame({"track": [g["track"].iloc[0]], "steps": [n], "rest": [float(np.hypot(*(p[-1] - at)))]})

    return per_track(fixes, run, "track long, steps long, rest double")


def box_counts(points: DataFrame, sides: list[float]) -> DataFrame:
    """Occupied boxes by side; the slope of the logarithms is the dimension."""
    s = points.select("x", "y", F.explode(F.array(*[F.lit(v) for v in sides])).alias("side"))
    return s.select("side", F.floor(F.col("x") / F.col("side")).alias("i"), F.floor(F.col("y") / F.col("side")).alias("j")).distinct().groupBy("side").agg(F.count("*").alias("boxes"))


def paired(a: DataFrame, b: DataFrame, blocks: int = 16) -> DataFrame:
    """(a, b, line_a, line_b): every line of one side with every line of the other, as arrays of points in order.

    All pairs are what is asked for, so give the lines to compare; they meet over pairs of blocks, an equi-join that spreads over blocks * blocks keys.
    """
    line = lambda df, n: df.groupBy(F.col("track").alias(n)).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias(f"line_{n}"))
    own, each = lambda n: F.pmod(F.xxhash64(n), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = line(a, "a").withColumn("__i", own("a")).withColumn("__j", each)
    right = line(b, "b").withColumn("__j", own("b")).withColumn("__i", each)
    return left.join(right, ["__i", "__j"]).drop("__i", "__j")


def coupling(kind: str) -> Callable[..., Column]:
    """Discrete Frechet distance or dynamic time warping of two arrays of points, in Arrow batches."""

    @F.pandas_udf("double")
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for p, q in zip(left, right, strict=True):
                a, b = (np.array([(r["x"], r["y"]) for r in s]) for s in (p, q))
                d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
                row = np.maximum.accumulate(d[0]) if kind == "frechet" else np.cumsum(d[0])
                for i in range(1, len(a)):
                    new = np.empty_like(row)
                    new[0] = max(row[0], d[i, 0]) if kind == "frechet" else row[0] + d[i, 0]
                    for j in range(1, len(b)):
                        low = min(row[j], row[j - 1], new[j - 1])
                        new[j] = max(low, d[i, j]) if kind == "frechet" else low + d[i, j]
                    row = new
                out.append(float(row[-1]))
            yield pd.Series(out)

    return f


#: Lines of a block that meets others, and entries of the arrays that a diagonal of their pairs fills at most.
LINES, DIAGONAL = 256, 1 << 16


def couplings(fixes: DataFrame, kind: str) -> DataFrame:
    """(a, b, distance) of every two tracks a < b: discrete Frechet distance or dynamic time warping.

    All pairs are what is asked for. Each two blocks of tracks meet once; their pairs are walked together, diagonal by diagonal, as arrays over the pairs, so a step of the walk serves
    many pairs, and pairs become rows only with their distance.
    """
    n = fixes.select("track").distinct().count()
    blocks = max(1, -(-n // LINES))
    line = fixes.filter("track is not null").groupBy("track").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("line"))
    line = line.select("track", F.pmod(F.xxhash64("track"), F.lit(blocks)).alias("own"), F.transform("line", lambda p: p["x"]).alias("x"), F.transform("line", lambda p: p["y"]).alias("y"))
    left = line.select("track", "x", "y", F.col("own").alias("i"), F.explode(F.sequence("own", F.lit(blocks - 1).cast("long"))).alias("j"))
    # columns of its own, as a cogroup can't tell those of one table apart
    right = line.select(*[F.col(c).alias(c) for c in ("track", "x", "y")], F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"))

    def run(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = (f.iloc[np.argsort([len(x) for x in f["x"]], kind="stable")] for f in (p, q))
        out = []
        # lines of like length share an array
        for s in range(0, len(p), 16):
            a = padded(p.iloc[s : s + 16])
            at = 0
            while at < len(q):
                step = max(1, DIAGONAL // (len(a[1]) * len(a[0][0])))
                b = padded(q.iloc[at : at + step])
                i, j = (v.ravel() for v in np.meshgrid(p["track"].to_numpy()[s : s + 16], q["track"].to_numpy()[at : at + step], indexing="ij"))
                d = walked(*a, *b, kind).ravel()
                keep = i < j if key[0] == key[1] else np.ones(len(i), dtype=bool)
                out.append(pd.DataFrame({"a": np.minimum(i, j)[keep], "b": np.maximum(i, j)[keep], "distance": d[keep]}))
                at += step
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": []})

    of = fixes.schema["track"].dataType.simpleString()
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, f"a {of}, b {of}, distance double")


def padded(lines: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The lines' places, (2, longest, lines), and their lengths; a shorter line stays at its last place."""
    size = np.array([len(x) for x in lines["x"]])
    at = np.minimum(np.arange(size.max())[:, None], size - 1)
    flat = np.array([np.concatenate([np.asarray(v, dtype=float) for v in lines[c]]) for c in "xy"])
    return flat[:, at + np.concatenate([[0], np.cumsum(size)[:-1]])], size


def walked(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, kind: str) -> np.ndarray:
    """The coupling distance of each line of one side with each of the other. Cell (i, k - i) of diagonal k needs two cells of the diagonal before and one of that before it."""
    rows, columns = p.shape[1], q.shape[1]
    back = np.ascontiguousarray(q[:, ::-1])
    shape = (rows + 1, len(n), len(m))
    # entry i + 1 is row i, so the row before the first is there and out of reach, as is what isn't reached yet
    before, last, new, free, d = *(np.full(shape, np.inf) for _ in range(3)), np.empty(shape), np.empty(shape)
    ends, out = n[:, None] + m - 2, np.empty((len(n), len(m)))
    for k in range(int(ends.max()) + 1):
        lo, hi = max(0, k - columns + 1), min(k, rows - 1) + 1
        s, t = slice(lo, hi), slice(columns - 1 - k + lo, columns - 1 - k + hi)
        x, y = free[s], d[s]
        np.subtract(p[0, s, :, None], back[0, t, None, :], out=x)
        np.multiply(x, x, out=x)
        np.subtract(p[1, s, :, None], back[1, t, None, :], out=y)
        np.multiply(y, y, out=y)
        np.add(x, y, out=x)
        if k:
            np.minimum(last[lo + 1 : hi + 1], last[s], out=y)
            np.minimum(y, before[s], out=y)
        else:
            y[...] = 0
        if kind == "frechet":
            np.maximum(x, y, out=new[lo + 1 : hi + 1])  # of squares
        else:
            np.sqrt(x, out=x)
            np.add(x, y, out=new[lo + 1 : hi + 1])
        i, j = np.nonzero(ends == k)
        out[i, j] = new[n[i], i, j]
        before, last, new = last, new, before
    return np.sqrt(out) if kind == "frechet" else out


def reckoned(fixes: DataFrame, bias: float) -> DataFrame:
    """(track, legs, run, miss, along, across): each track reckoned from its legs' headings (clockwise from north), speeds and times, with headings ``bias`` degrees off: how
    far its end is from the true one, and that along and across the true track's overall direction. Tracks that end where they began have no direction and are left out.
    """
    w = by_time()
    leg = fixes.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).filter("dx is not null")
    heading, run = F.atan2("dx", "dy"), F.hypot("dx", "dy")
    off = heading + math.radians(bias)
    ends = leg.groupBy("track").agg(F.count("*").alias("legs"), F.sum(run).alias("run"), F.sum("dx").alias("ex"), F.sum("dy").alias("ey"), F.sum(run * F.sin(off)).alias("bx"), F.sum(run * F.cos(off)).alias("by"))
    far, mx, my = F.hypot("ex", "ey"), F.col("bx") - F.col("ex"), F.col("by") - F.col("ey")
    return ends.filter(far > 0).select("track", "legs", "run", F.hypot(mx, my).alias("miss"), ((mx * F.col("ex") + my * F.col("ey")) / far).alias("along"), ((my * F.col("ex") - mx * F.col("ey")) / far).alias("across"))
