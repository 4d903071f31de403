"""Spatial joins as equi-joins on grid cells: one side is dealt to the cells it may match, Spark joins on the cell.

Cells are ordinary join keys: Catalyst picks broadcast or sort-merge, and adaptive execution splits cells that hold too much.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scratch import settle


def cell(c: Column, side: float) -> Column:
    return F.floor(c / side).cast("long")


def around(c: Column, side: float, reach: float) -> Column:
    """All cells of one axis within ``reach``."""
    return F.sequence(cell(c - reach, side), cell(c + reach, side))


def cells_of(df: DataFrame, low_x: Column, low_y: Column, high_x: Column, high_y: Column, side: float) -> DataFrame:
    """One row per cell that the closed box touches, as __cx and __cy."""
    return df.withColumn("__cx", F.explode(F.sequence(cell(low_x, side), cell(high_x, side)))).withColumn("__cy", F.explode(F.sequence(cell(low_y, side), cell(high_y, side))))


def join_within(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "sx", ry: str = "sy") -> DataFrame:
    """Pairs within ``radius``, the boundary included, with d2. The right side is dealt to at most nine cells; no pair comes twice."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    near = cells_of(right, F.col(rx) - radius, F.col(ry) - radius, F.col(rx) + radius, F.col(ry) + radius, radius)
    own = left.withColumns({"__cx": cell(F.col(lx), radius), "__cy": cell(F.col(ly), radius)})
    d2 = (F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry))
    return own.join(near, ["__cx", "__cy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop("__cx", "__cy")


def self_join_within(df: DataFrame, radius: float, key: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (a, b, d2) of a < b within the radius."""
    right = df.select(F.col(key).alias("b"), F.col(x).alias("__bx"), F.col(y).alias("__by"))
    return join_within(df.select(F.col(key).alias("a"), F.col(x).alias("__ax"), F.col(y).alias("__ay")), right, radius, "__ax", "__ay", "__bx", "__by").filter("a < b").select("a", "b", "d2")


def density_side(points: DataFrame, x: str, y: str, per_cell: float) -> float:
    """Side of square cells that hold ``per_cell`` points on average: one aggregate over two columns."""
    n, a, b, c, d = points.agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return max(math.sqrt(max((b - a) * (d - c), 1e-12) * per_cell / n), max(b - a, d - c, 1e-9) / 1e6) if n else 1.0


#: Points that a cell of a k-nearest join holds before it is split, for each neighbour asked for, and how often cells are split (sides shrink by 4 each time): so often
#: before points at one place are thinned out, and so often at most.
HEAVY, DEEP, DEEPEST = 256, 4, 12
#: Pairs up to which the queries that are left open are compared with all points.
FEW = 1_000_000


def crowded(points: DataFrame, side: float, most: int, deepest: int) -> list[tuple[float, DataFrame]]:
    """Cells of ``points`` (__px, __py) with more than ``most`` points, as (side, cells), level by level: a crowded cell is counted anew in cells of a quarter of
    the side until none is crowded. Each level counts only what lies in crowded cells of the one before."""
    levels: list[tuple[float, DataFrame]] = []
    while len(levels) < deepest:
        keyed = points.withColumns({"__cx": cell(F.col("__px"), side), "__cy": cell(F.col("__py"), side)})
        cells = settle(keyed.groupBy("__cx", "__cy").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("__cx", "__cy"), len(levels))
        if cells.isEmpty():
            break
        levels.append((side, cells))
        points, side = keyed.join(cells, ["__cx", "__cy"], "left_semi").select("point", "__px", "__py"), side / 4
    return levels


def first_of_place(points: DataFrame, k: int) -> DataFrame:
    """Of the points (point, __px, __py) at one place the ``k`` first, which is all that can be among k nearest."""
    at = Window.partitionBy("__px", "__py").orderBy("point")
    return points.withColumn("__n", F.row_number().over(at)).filter(F.col("__n") <= k).drop("__n")


def knn_join(queries: DataFrame, points: DataFrame, k: int, qid: str = "id", qx: str = "x", qy: str = "y", pid: str = "sid", px: str = "sx", py: str = "sy", exclude_same: bool = False) -> DataFrame:
    """The k nearest points of each query: (query, point, d2, rank), ties by point id.

    A round compares each query with the nine cells round it; it is done if its k-th distance is at most a cell's side,
    as nothing nearer can lie outside. The others meet cells four times as wide. Queries begin at a side that fits their own cell: where points crowd, cells
    are split by counts until they hold a bounded number, and rounds go from the narrowest cells up. Each round's result is
    written with its open queries, so no round computes those before it anew, and rounds end when no query is open: nearly all are done in their first.
    Queries outside a crowd whose nine cells reach into it still meet all of its points there.
    """
    left = queries.select(F.col(qid).alias("query"), F.col(qx).alias("__qx"), F.col(qy).alias("__qy"))
    right = points.select(F.col(pid).alias("point"), F.col(px).alias("__px"), F.col(py).alias("__py"))
    both = right.select(F.col("__px").alias("x"), F.col("__py").alias("y"), F.lit(True).alias("p")).union(left.select("__qx", "__qy", F.lit(False)))
    own = lambda f, v: f(F.when(F.col("p"), F.col(v)))
    n, m, a, b, c, e, *ends = both.agg(F.count_if("p"), F.count_if(~F.col("p")), own(F.min, "x"), own(F.max, "x"), own(F.min, "y"), own(F.max, "y"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n or not m:
        return left.join(right, F.lit(False)).select("query", "point", F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    area, reach = max((b - a) * (e - c), 1e-12), max(b - a, e - c, 1e-9)
    side = max(math.sqrt(area * max(8.0, 2.0 * k) / n), reach / 1e6)
    extent = max(ends[1] - ends[0], ends[3] - ends[2], 1e-9)
    levels = crowded(right, side, HEAVY * k, DEEP) if n > 16 * HEAVY * k else []
    if len(levels) == DEEP:
        right = settle(first_of_place(right, k + 1))
        levels = crowded(right, side, HEAVY * k, DEEPEST)
    left = left.withColumn("__level", F.lit(0))
    for wide, cells in levels:
        inside = cells.withColumn("__in", F.lit(1))
        left = left.withColumns({"__cx": cell(F.col("__qx"), wide), "__cy": cell(F.col("__qy"), wide)}).join(inside, ["__cx", "__cy"], "left")
        left = left.select("query", "__qx", "__qy", (F.col("__level") + F.coalesce("__in", F.lit(0))).alias("__level"))
    waiting, open_, found, i = settle(left) if levels else left, None, None, 0
    sides = [side / 4**j for j in range(len(levels) + 1)]
    level = len(levels)
    while True:
        wide = sides[level] if level >= 0 else side
        own_queries = waiting.filter(F.col("__level") == level).drop("__level") if level >= 0 else None
        active = own_queries if open_ is None else open_ if own_queries is None else open_.union(own_queries)
        whole = level <= 0 and wide >= extent
        near_points = beside(right, *levels[level - 1]) if level > 0 else right
        ranked = settle(compared(active, near_points, k, wide, exclude_same, whole), i)
        ready = ranked.filter("__done and point is not null").select("query", "point", "d2", "rank")
        found = ready if found is None else found.union(ready)
        open_ = ranked.filter("not __done").select("query", "__qx", "__qy").distinct()
        level, i = level - 1, i + 1
        if whole:
            return found
        if level < 0:
            left_over = open_.count()
            if not left_over:
                return found
            # a few that are left meet all points at once
            side = side * 4 if side * 4 < extent and left_over * n > FEW else extent * 1.000001


def beside(points: DataFrame, side: float, cells: DataFrame) -> DataFrame:
    """The points in ``cells`` and in the cells round them."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    wide = cells.select("__cx", "__cy", steps.alias("s")).select((F.col("__cx") + F.col("s.i")).alias("__cx"), (F.col("__cy") + F.col("s.j")).alias("__cy")).distinct()
    return points.withColumns({"__cx": cell(F.col("__px"), side), "__cy": cell(F.col("__py"), side)}).join(wide, ["__cx", "__cy"], "left_semi").select("point", "__px", "__py")


def compared(queries: DataFrame, points: DataFrame, k: int, side: float, exclude_same: bool, whole: bool) -> DataFrame:
    """(query, __qx, __qy, point, d2, rank, __done): the k nearest of the points in the nine cells round each query, which a query without any keeps as nulls; __done
    tells whether they are the nearest of all."""
    near = cells_of(points, F.col("__px") - side, F.col("__py") - side, F.col("__px") + side, F.col("__py") + side, side)
    own = queries.withColumns({"__qcx": cell(F.col("__qx"), side), "__qcy": cell(F.col("__qy"), side)})
    meet = (F.col("__qcx") == F.col("__cx")) & (F.col("__qcy") == F.col("__cy"))
    d2 = (F.col("__qx") - F.col("__px")) * (F.col("__qx") - F.col("__px")) + (F.col("__qy") - F.col("__py")) * (F.col("__qy") - F.col("__py"))
    pairs = own.join(near, meet & (F.col("query") != F.col("point")) if exclude_same else meet, "left").select("query", "__qx", "__qy", "point", d2.alias("d2"))
    best = Window.partitionBy("query").orderBy(F.col("d2").asc_nulls_last(), "point")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # the k-th is the last of those kept, so one more pass over the same sorted rows tells whether a query is done
    mine = Window.partitionBy("query")
    done = F.lit(True) if whole else F.coalesce((F.count("point").over(mine) == k) & (F.max("d2").over(mine) <= side * side), F.lit(False))
    return ranked.withColumn("__done", done)


def nearest(queries: DataFrame, points: DataFrame, **names: str) -> DataFrame:
    return knn_join(queries, points, 1, **names).drop("rank")


def stab_join(spans: DataFrame, values: DataFrame, width: float, lo: str = "lo", hi: str = "hi", at: str = "at") -> DataFrame:
    """Closed spans with the values they hold; spans are dealt to the buckets they cross."""
    dealt = spans.withColumn("__b", F.explode(F.sequence(cell(F.col(lo), width), cell(F.col(hi), width))))
    return values.withColumn("__b", cell(F.col(at), width)).join(dealt, "__b").filter(F.col(at).between(F.col(lo), F.col(hi))).drop("__b")


def overlapping(spans: DataFrame, width: float) -> DataFrame:
    """(a, b) of a < b of closed spans (id, lo, hi) that touch. A span is dealt to the buckets it crosses, and once more to that of its start, where it meets those that began no later; blocks
    meet as arrays sorted by start, so only pairs of the result are looked at, and none is sorted or kept."""
    own = spans.select("id", "lo", "hi").filter("lo <= hi")
    began = own.withColumns({"__cx": F.explode(F.sequence(cell(F.col("lo"), width), cell(F.col("hi"), width))), "__cy": F.pmod(F.xxhash64("id"), F.lit(1).cast("long"))})
    new = own.select("id", "lo", cell(F.col("lo"), width).alias("__cx"), F.pmod(F.xxhash64("id"), F.lit(1).cast("long")).alias("__cy"))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values(["lo", "id"])
        (ids, lo, hi), (its, starts) = (tuple(f[c].to_numpy() for c in names) for f, names in ((p, ("id", "lo", "hi")), (q, ("id", "lo"))))
        first, last = np.searchsorted(starts, lo, "left"), np.searchsorted(starts, hi, "right")
        n = np.maximum(last - first, 0)
        i = np.repeat(np.arange(len(p)), n)
        j = np.arange(len(i)) + np.repeat(first - np.cumsum(n) + n, n)
        # of two that begin together the smaller id is the earlier
        a, b, tied = ids[i], its[j], lo[i] == starts[j]
        keep = ~tied | (a < b)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    kind = spans.schema["id"].dataType.simpleString()
    return met_in_cells(began, new, "id", "id", run, f"a {kind}, b {kind}", PAIRED, TASKS)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(p: str, q: str) -> Column:
    """Whether two closed segments with columns {p}x1 .. {q}y2 share a point; touching and overlapping count."""
    c = {n: F.col(n) for n in (f"{s}{v}{k}" for s in (p, q) for v in "xy" for k in "12")}
    ax, ay, bx, by = c[f"{p}x1"], c[f"{p}y1"], c[f"{p}x2"], c[f"{p}y2"]
    cx, cy, dx, dy = c[f"{q}x1"], c[f"{q}y1"], c[f"{q}x2"], c[f"{q}y2"]
    o1, o2, o3, o4 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy), orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    on = lambda x, y, x1, y1, x2, y2: x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    return ((o1 != o2) & (o3 != o4)) | ((o1 == 0) & on(cx, cy, ax, ay, bx, by)) | ((o2 == 0) & on(dx, dy, ax, ay, bx, by)) | ((o3 == 0) & on(ax, ay, cx, cy, dx, dy)) | ((o4 == 0) & on(bx, by, cx, cy, dx, dy))


def ring_edges(ring: Column) -> Column:
    """A ring's edges as structs p, q; the last goes back to the first point."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.element_at(ring, F.when(i + 1 == F.size(ring), 1).otherwise(i + 2)).alias("q")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test: half-open in y, strictly left of the crossing, so left and bottom edges are inside."""

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(ring_edges(ring), crosses)) % 2 == 1


def winding(x: Column, y: Column, ring: Column) -> Column:
    """Winding number of the ring round the point."""

    def turn(e: Column) -> Column:
        p, q = e["p"], e["q"]
        left = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
        return F.when((p["y"] <= y) & (q["y"] > y) & (left > 0), 1).when((p["y"] > y) & (q["y"] <= y) & (left < 0), -1).otherwise(0)

    return F.aggregate(F.transform(ring_edges(ring), turn), F.lit(0), lambda a, b: a + b)


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


#: Rows of one side that a task compares at once in a cell; where there are more, blocks of both sides meet.
BLOCK = 20_000


def one_cell(key: str) -> dict[str, Column]:
    """One cell for all rows, where all of both sides meet; a literal wouldn't do, as the optimizer puts it in a key's place and deals the rows out once more."""
    return {c: F.pmod(F.xxhash64(key), F.lit(1).cast("long")) for c in ("__cx", "__cy")}


def met_in_cells(left: DataFrame, right: DataFrame, left_key: str, right_key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int | None = None, tasks: int | None = None, at: list[str] | None = None, itself: bool = False) -> DataFrame:
    """``run`` on what both sides, dealt to cells (``at``; __cx, __cy), have in each cell, as arrays. A crowded cell is cut by hashes of the keys into blocks of about ``block`` (BLOCK) rows of a
    side, and every block of one side meets every block of the other, so no task holds a cell that grows with the input. ``tasks``, where pairs are many and bytes few: so many at any size. ``itself``: both sides
    are one table, and two blocks meet once, so ``run`` gets each pair of rows of two blocks in one order only, and a block with itself where __i is __j."""
    at, block = at or ["__cx", "__cy"], block or BLOCK
    over = lambda df, n: df.groupBy(*at).agg(F.ceil(F.count("*") / block).alias(n)).filter(F.col(n) > 1)
    # at most one row for a block of the input
    cut = over(left, "__m").withColumn("__n", F.lit(1).cast("long")).unionByName(over(right, "__n").withColumn("__m", F.lit(1).cast("long")))
    cut = F.broadcast(cut.groupBy(*at).agg(F.max("__m").alias("__m"), F.max("__n").alias("__n")))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    a = left.join(cut, at, "left").withColumns({"__i": own(left_key, "__m"), "__j": each("__n")}).drop("__m", "__n")
    a = a.filter("__i <= __j") if itself else a
    b = right.join(cut, at, "left").withColumns({"__i": each("__m"), "__j": own(right_key, "__n")}).drop("__m", "__n")
    b = b.filter("__i <= __j") if itself else b
    by, b = [*at, "__i", "__j"], b.toDF(*b.columns)  # both sides may come from one table
    if tasks:
        a, b = a.repartition(tasks, *by), b.repartition(tasks, *by)
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(run, schema)


#: Rows of a side of two blocks whose pairs all may be rows of the result.
PAIRED = 4_096


#: Pairs of rows that a task lays out as one array, and tasks that blocks are dealt over where a few MB have very many pairs.
PAIRS, TASKS = 1 << 18, 128


def paired(m: int, n: int, hit: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of both blocks, of ``m`` and ``n`` rows, for each pair that ``hit`` finds; it is asked for some rows of the first at a time."""
    step = max(1, PAIRS // max(n, 1))
    found = [(k + i, j) for k in range(0, m if n else 0, step) for i, j in [np.nonzero(hit(slice(k, k + step)))]]
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (zip(*found, strict=True) if found else ((), ())))


def reach_sums(left: DataFrame, right: DataFrame, radius: float, terms: Callable[..., list[np.ndarray]], names: list[str]) -> DataFrame:
    """(id, n, <names>): over the rows of ``right`` (sid, sx, sy) within ``radius`` of each row of ``left`` (id, x, y and more), their number and the sums of ``terms``, which gets
    the columns of both sides as arrays with an entry for each pair. Pairs are never rows: blocks meet in cells as wide as the radius, and a block gives one row for each of its ids."""
    mine, its = left.columns, right.columns
    own = left.filter("x is not null and y is not null").withColumns({"__cx": cell(F.col("x"), radius), "__cy": cell(F.col("y"), radius)})
    near = cells_of(right, F.col("sx") - radius, F.col("sy") - radius, F.col("sx") + radius, F.col("sy") + radius, radius)

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a, b = {c: p[c].to_numpy() for c in mine}, {c: q[c].to_numpy() for c in its}
        sums, step = np.zeros((len(names) + 1, len(p))), max(1, PAIRS // max(len(q), 1))
        for k in range(0, len(p) if len(q) else 0, step):
            l = {c: v[k : k + step] for c, v in a.items()}  # noqa: E741
            dx, dy = l["x"][:, None] - b["sx"], l["y"][:, None] - b["sy"]
            i, j = np.nonzero(dx * dx + dy * dy <= radius * radius)
            for m, v in enumerate([None, *terms({c: v[i] for c, v in l.items()}, {c: v[j] for c, v in b.items()})]):
                sums[m, k : k + step] = np.bincount(i, v, len(l["x"]))
        met = sums[0] > 0
        return pd.DataFrame({"id": a["id"][met], "n": sums[0, met].astype(np.int64), **{c: v[met] for c, v in zip(names, sums[1:], strict=True)}})

    schema = f"id {left.schema['id'].dataType.simpleString()}, n long" + "".join(f", {c} double" for c in names)
    parts = met_in_cells(own, near, "id", "sid", run, schema, tasks=TASKS)
    return parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to so many places, halves away from zero, as SQL does."""
    return np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5) / 10.0**digits, v) + 0.0


def reached(left: DataFrame, right: DataFrame, radius: float, axes: str = "xy", values: dict[str, Callable[..., np.ndarray]] | None = None) -> DataFrame:
    """(id, sid, <values>) of the rows of ``right`` (sid, sx, sy, ...) within ``radius`` of each row of ``left`` (id, x, y, ...); ``values`` get the squared distances of the pairs found. Blocks meet
    as arrays in cells as wide as the radius and give the rows of the result, for results too large to be sorted, kept or worked on row by row."""
    names, values = [f"__c{a}" for a in axes], values or {}
    own = left.select("id", *axes).withColumns({f"__c{a}": cell(F.col(a), radius) for a in axes}).dropna(subset=names)
    near = right.select("sid", *[f"s{a}" for a in axes])
    for a in axes:
        near = near.withColumn(f"__c{a}", F.explode(F.sequence(cell(F.col(f"s{a}") - radius, radius), cell(F.col(f"s{a}") + radius, radius))))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        u, v = [p[a].to_numpy() for a in axes], [q[f"s{a}"].to_numpy() for a in axes]
        d2 = lambda i, j: sum((x[i] - y[j]) * (x[i] - y[j]) for x, y in zip(u, v, strict=True))
        i, j = paired(len(p), len(q), lambda k: sum((x[k, None] - y) ** 2 for x, y in zip(u, v, strict=True)) <= radius * radius)
        return pd.DataFrame({"id": p["id"].to_numpy()[i], "sid": q["sid"].to_numpy()[j], **({c: f(d2(i, j)) for c, f in values.items()} if values else {})})

    kinds = [left.schema["id"].dataType.simpleString(), right.schema["sid"].dataType.simpleString()]
    return met_in_cells(own, near, "id", "sid", run, f"id {kinds[0]}, sid {kinds[1]}" + "".join(f", {c} double" for c in values), PAIRED, TASKS, names)


def first_within(left: DataFrame, right: DataFrame, radius: float, k: int) -> DataFrame:
    """(id, sid, i): of the rows of ``right`` (sid, sx, sy) within ``radius`` of each row of ``left`` (id, x, y) the ``k`` of smallest sid, numbered from 1. Blocks meet in cells as wide as the
    radius; a row leaves the search once it has its ``k``, so few of the pairs are looked at and none is a row."""
    own = left.select("id", "x", "y").filter("x is not null and y is not null").withColumns({"__cx": cell(F.col("x"), radius), "__cy": cell(F.col("y"), radius)})
    near = cells_of(right.select("sid", "sx", "sy"), F.col("sx") - radius, F.col("sy") - radius, F.col("sx") + radius, F.col("sy") + radius, radius)

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        q = q.sort_values("sid")
        x, y, sx, sy = (f[c].to_numpy() for f, c in ((p, "x"), (p, "y"), (q, "sx"), (q, "sy")))
        open_, had, at, of = np.arange(len(p)), np.zeros(len(p), dtype=np.int64), [], []
        for s in range(0, len(q), 64):
            dx, dy = x[open_, None] - sx[s : s + 64], y[open_, None] - sy[s : s + 64]
            hit = dx * dx + dy * dy <= radius * radius
            hit &= np.cumsum(hit, axis=1) + had[open_, None] <= k
            i, j = np.nonzero(hit)
            at.append(open_[i])
            of.append(s + j)
            had[open_] += hit.sum(axis=1)
            open_ = open_[had[open_] < k]
            if not len(open_):
                break
        at, of = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (at, of))
        return pd.DataFrame({"id": p["id"].to_numpy()[at], "sid": q["sid"].to_numpy()[of]})

    ids = [left.schema["id"].dataType.simpleString(), right.schema["sid"].dataType.simpleString()]
    found = met_in_cells(own, near, "id", "sid", run, f"id {ids[0]}, sid {ids[1]}")
    return found.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("sid"))).filter(F.col("i") <= k)


def box_join(left: DataFrame, right: DataFrame, side: float, ordered: bool = False, values: dict[str, Callable[..., np.ndarray]] | None = None, more: tuple[str, ...] = (), test: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(a, b, <values>) of closed boxes that touch, or only each two of one table once, as a < b, if ``ordered``; ``values`` get the columns of both boxes of each pair (``more`` too), and so does
    ``test``, which may tell that a pair is none. Boxes meet in the cells they cover, and a pair counts in the cell of its common lower corner only: in each direction one of both begins there. Blocks
    meet as arrays, so a task holds the pairs of two blocks at most."""
    names, values = ("min_x", "min_y", "max_x", "max_y"), values or {}
    begins = lambda df: df.withColumns({"ox": cell(F.col("min_x"), side) == F.col("__cx"), "oy": cell(F.col("min_y"), side) == F.col("__cy")})
    dealt = lambda df: begins(cells_of(df.select("id", *names, *more), *[F.col(n) for n in names], side))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a, b = ({c: f[c].to_numpy() for c in ("id", *names, *more, "ox", "oy")} for f in (p, q))
        alone = ordered and len(p) > 0 and p["__i"].iloc[0] == p["__j"].iloc[0]

        def hit(k: slice) -> np.ndarray:
            own = {c: v[k, None] for c, v in a.items()}
            on = (own["min_x"] <= b["max_x"]) & (b["min_x"] <= own["max_x"]) & (own["min_y"] <= b["max_y"]) & (b["min_y"] <= own["max_y"])
            on &= (own["ox"] | b["ox"]) & (own["oy"] | b["oy"])
            return on & ((own["id"] < b["id"]) if alone else (own["id"] != b["id"])) if ordered else on

        i, j = paired(len(p), len(q), hit)
        x, y = ({c: f[c][k] for c in ("id", *(names if values or test else ()), *more)} for f, k in ((a, i), (b, j)))
        if ordered and not alone:
            swap = x["id"] > y["id"]
            x, y = ({c: np.where(swap, g[c], f[c]) for c in x} for f, g in ((x, y), (y, x)))
        if test:
            on = test(x, y)
            x, y = ({c: v[on] for c, v in f.items()} for f in (x, y))
        return pd.DataFrame({"a": x["id"], "b": y["id"], **{c: f(x, y) for c, f in values.items()}})

    kinds = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    return met_in_cells(dealt(left), dealt(right), "id", "id", run, f"a {kinds[0]}, b {kinds[1]}" + "".join(f", {c} double" for c in values), PAIRED, TASKS, itself=ordered)


def crossed(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """``segments_cross`` of arrays of segments (x1, y1, x2, y2)."""
    turn = lambda p, q, k: np.sign((p["x2"] - p["x1"]) * (q[f"y{k}"] - p["y1"]) - (p["y2"] - p["y1"]) * (q[f"x{k}"] - p["x1"]))
    between = lambda v, u, w: (v >= np.minimum(u, w)) & (v <= np.maximum(u, w))
    on = lambda p, q, k: between(q[f"x{k}"], p["x1"], p["x2"]) & between(q[f"y{k}"], p["y1"], p["y2"])
    turns = [(turn(p, q, k), p, q, k) for p, q in ((a, b), (b, a)) for k in (1, 2)]
    hit = (turns[0][0] != turns[1][0]) & (turns[2][0] != turns[3][0])
    for o, p, q, k in turns:
        hit |= (o == 0) & on(p, q, k)
    return hit


def crossing_pairs(segments: DataFrame, side: float, values: dict[str, Callable[..., np.ndarray]] | None = None, test: Callable[..., np.ndarray] = crossed) -> DataFrame:
    """Pairs (a, b, <values>) of a < b of crossing segments: those whose boxes touch, block by block as arrays."""
    ends = ("x1", "y1", "x2", "y2")
    boxes = segments.select("id", *[f(f"{v}1", f"{v}2").alias(f"{n}_{v}") for n, f in (("min", F.least), ("max", F.greatest)) for v in "xy"], *ends)
    return box_join(boxes, boxes, side, True, values, ends, test)


def rings_met(points: DataFrame, rings: DataFrame, side: float, inside: Callable[..., np.ndarray]) -> DataFrame:
    """(id, ring_id) of points ``inside`` (x, y, x1, y1, x2, y2) of rings, whose edges are columns: rings are dealt to the cells of their box, and
    only points whose y lies in a ring's are tested."""
    e = ring_edges(F.col("ring"))
    edge = lambda end, axis: F.transform(e, lambda s: s[end][axis]).alias(f"{end}{axis}")
    r = rings.select(F.col("id").alias("ring_id"), "ring")
    r = r.select("ring_id", *[edge(end, axis) for end in "pq" for axis in "xy"], *[c.alias(n) for n, c in zip(("x0", "y0", "x9", "y9"), ring_box(F.col("ring")), strict=True)])
    r = cells_of(r, F.col("x0"), F.col("y0"), F.col("x9"), F.col("y9"), side).drop("x0", "y0", "x9", "y9")
    own = points.select("id", "x", "y").withColumns({"__cx": cell(F.col("x"), side), "__cy": cell(F.col("y"), side)}).filter("__cx is not null and __cy is not null")
    ids = [points.schema["id"].dataType.simpleString(), rings.schema["id"].dataType.simpleString()]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("y", kind="stable")
        found = p["id"].to_numpy()
        x, y, at, of = p["x"].to_numpy(float), p["y"].to_numpy(float), [], []
        for i, (x1, y1, x2, y2) in enumerate(zip(q["px"], q["py"], q["qx"], q["qy"], strict=True)) if len(p) else ():
            lo, hi = np.searchsorted(y, y1.min(), "left"), np.searchsorted(y, y1.max(), "right")
            near = lo + np.flatnonzero((x[lo:hi] >= x1.min()) & (x[lo:hi] <= x1.max()))
            hit = near[inside(x[near, None], y[near, None], x1, y1, x2, y2)]
            at.append(hit)
            of.append(np.full(len(hit), i))
        at, of = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (at, of))
        return pd.DataFrame({"id": found[at], "ring_id": q["ring_id"].to_numpy()[of]})

    return met_in_cells(own, r, "id", "ring_id", run, f"id {ids[0]}, ring_id {ids[1]}", tasks=TASKS)


def crossed_oddly(x: np.ndarray, y: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """``in_ring`` of a column of points and a row of edges."""
    spans = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.count_nonzero(spans & (x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1), axis=1) % 2 == 1


def points_in_rings(points: DataFrame, rings: DataFrame, side: float) -> DataFrame:
    """(id, ring_id) of points inside rings by ``in_ring``, cell by cell."""
    return rings_met(points, rings, side, crossed_oddly)


def wound(x: np.ndarray, y: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether ``winding`` isn't 0, of a column of points and a row of edges."""
    left = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    up, down = (y1 <= y) & (y2 > y) & (left > 0), (y1 > y) & (y2 <= y) & (left < 0)
    return np.count_nonzero(up, axis=1) != np.count_nonzero(down, axis=1)


def shoelace(ring: Column) -> Column:
    """Signed area, counter-clockwise positive."""
    return F.aggregate(F.transform(ring_edges(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]), F.lit(0.0), lambda a, b: a + b) / 2


def perimeter(ring: Column) -> Column:
    return F.aggregate(F.transform(ring_edges(ring), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])), F.lit(0.0), lambda a, b: a + b)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    def moment(axis: str) -> Column:
        return F.aggregate(F.transform(ring_edges(ring), lambda e: (e["p"][axis] + e["q"][axis]) * (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])), F.lit(0.0), lambda a, b: a + b)

    area = shoelace(ring)
    return moment("x") / (6 * area), moment("y") / (6 * area)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its keys at or before it: both sides in one sorted pass, no range join."""
    l = left.select(*keys, at, F.struct(*[c for c in left.columns if c not in (*keys, at)]).alias("__l"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(*keys, at, F.struct(*values).alias("__r"), F.lit(0).alias("__side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1").select(*keys, at, "__l.*", *[F.col("__last")[v].alias(v) for v in values])


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``pairs`` (a, b).

    Each node hooks to its least neighbour if that is smaller, hooks are followed to their ends, and pairs are rewritten to the ends without
    those that have met; at most half of the nodes are left for the next round.
    """
    edges = settle(pairs.select("a", "b").filter("a != b").distinct())
    labels = nodes.select("node", F.col("node").alias("root"))
    i = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = settle(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("end")), i)
        while True:
            far = ends.select(F.col("node").alias("end"), F.col("end").alias("far"))
            jumped = settle(ends.join(far, "end").select("node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")), i)
            if jumped.filter("moved").isEmpty():
                break
            ends = jumped.select("node", "end")
        labels = settle(labels.join(ends.select(F.col("node").alias("root"), "end"), "root", "left").select("node", F.coalesce("end", "root").alias("root")), i)
        edges = edges.join(ends.select(F.col("node").alias("a"), F.col("end").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b")
        edges, i = settle(edges.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), i), i + 1
    return labels
