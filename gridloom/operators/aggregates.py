"""Binning, zonal and circular aggregates: hash aggregation on cell keys, partial on the map side."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.joins import cell, cells_of


def hex_key(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Cube coordinates (q, r) of the flat-top hexagon that holds a point: all three are rounded, and the worst is given by the others."""
    q, r = x * (2.0 / 3) / size, (-x / 3 + y * (math.sqrt(3) / 3)) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -rq - rs).otherwise(rr).cast("long")


def hex_bins(points: DataFrame, size: float) -> DataFrame:
    q, r = hex_key(F.col("x"), F.col("y"), size)
    return points.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))


def dense_counts(points: DataFrame, side: float, n: int) -> DataFrame:
    """Counts of an n by n grid of cells, empty ones too: a small grid from a range, joined to the counts."""
    grid = points.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("long").alias("cy"), (F.col("id") % n).alias("cx"))
    counts = points.groupBy(cell(F.col("x"), side).alias("cx"), cell(F.col("y"), side).alias("cy")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("n", F.lit(0)).alias("n"))


def kernel_density(points: DataFrame, side: float, bandwidth: float, n: int) -> DataFrame:
    """Gaussian density at cell centres within four bandwidths; points are dealt to the cells they reach and summed per cell."""
    reach = 4 * bandwidth
    dealt = cells_of(points, F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach, side)
    d2 = F.pow((F.col("__cx") + 0.5) * side - F.col("x"), 2) + F.pow((F.col("__cy") + 0.5) * side - F.col("y"), 2)
    inside = F.col("__cx").between(0, n - 1) & F.col("__cy").between(0, n - 1) & (d2 <= reach * reach)
    weight = F.exp(-d2 / (2 * bandwidth * bandwidth)) / (2 * math.pi * bandwidth * bandwidth)
    return dealt.filter(inside).groupBy(F.col("__cx").alias("cx"), F.col("__cy").alias("cy")).agg(F.sum(weight).alias("density"))


def merged_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Islands of closed spans that overlap or touch: (keys, lo, hi, n). A span begins one if it starts after all ends before it."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    marked = spans.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("__island")


def depth_pieces(spans: DataFrame, *keys: str) -> DataFrame:
    """Pieces of the line with the number of spans over them: a running sum over ends, of which pieces of no length are dropped."""
    ends = spans.select(*keys, F.col("lo").alias("at"), F.lit(1).alias("step")).union(spans.select(*keys, F.col("hi").alias("at"), F.lit(-1).alias("step"))).groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("at")
    pieces = ends.withColumns({"until": F.lead("at").over(order), "depth": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return pieces.filter("depth > 0 and until > at").select(*keys, "at", "until", "depth")


#: Boxes of a cell whose union a task takes at once, how often cells that hold more are split, and entries of the array that some strips fill.
HELD, FINEST, STRIPS = 256, 12, 1 << 20


def union_area(boxes: DataFrame, side: float) -> DataFrame:
    """Area under boxes, each place counted once. Boxes are cut at the borders of square cells. A cell that one box covers is settled, so is one with few boxes, by strips between the boxes'
    edges; cells that hold many are split in sixteen, with the boxes that are in them, so a crowd of boxes goes where its cells are covered and never meets as pairs."""
    from gridloom.operators.scratch import settle

    left, done, i = boxes.select(F.col("min_x").alias("a"), F.col("max_x").alias("b"), F.col("min_y").alias("lo"), F.col("max_y").alias("hi")), None, 0
    while True:
        x, y = F.col("__cx") * side, F.col("__cy") * side
        dealt = cells_of(left, F.col("a"), F.col("lo"), F.col("b"), F.col("hi"), side)
        dealt = dealt.select("__cx", "__cy", F.greatest("a", x).alias("a"), F.least("b", x + side).alias("b"), F.greatest("lo", y).alias("lo"), F.least("hi", y + side).alias("hi")).filter("a < b and lo < hi").distinct()
        dealt = settle(dealt, i)
        full = (F.col("b") - F.col("a") >= side) & (F.col("hi") - F.col("lo") >= side)
        cells = settle(dealt.groupBy("__cx", "__cy").agg(F.count("*").alias("n"), F.bool_or(full).alias("full")), i)
        few = F.lit(True) if i == FINEST else F.col("n") <= HELD
        swept = dealt.join(cells.filter(~F.col("full") & few).select("__cx", "__cy"), ["__cx", "__cy"], "left_semi").groupBy("__cx", "__cy").applyInPandas(covered, "area double")
        area = cells.filter("full").select(F.lit(side * side).alias("area")).union(swept)
        done = area if done is None else done.union(area)
        many = cells.filter(~F.col("full") & ~few).select("__cx", "__cy")
        if many.isEmpty():
            return done.agg(F.sum("area").alias("area"))
        left, side, i = dealt.join(many, ["__cx", "__cy"], "left_semi").select("a", "b", "lo", "hi"), side / 4, i + 1


def covered(boxes: pd.DataFrame) -> pd.DataFrame:
    """The area under boxes (a, b, lo, hi): how many lie over each piece between their edges, some strips of x at a time."""
    xs, ys = (np.unique(boxes[list(c)].to_numpy()) for c in (("a", "b"), ("lo", "hi")))
    first, last, low, high = (np.searchsorted(e, boxes[c].to_numpy()) for e, c in ((xs, "a"), (xs, "b"), (ys, "lo"), (ys, "hi")))
    wide, tall, area, over = np.append(np.diff(xs), 0.0), np.diff(ys), 0.0, np.zeros(len(ys), dtype=np.int64)
    step = max(1, STRIPS // len(ys))
    for s in range(0, len(xs), step):
        change = np.zeros((min(step, len(xs) - s), len(ys)), dtype=np.int64)
        for ends, sign in ((first, 1), (last, -1)):
            k = (ends >= s) & (ends < s + step)
            np.add.at(change, (ends[k] - s, low[k]), sign)
            np.add.at(change, (ends[k] - s, high[k]), -sign)
        change[0] += over
        depth = np.cumsum(change, axis=0)
        over = depth[-1]
        area += float(wide[s : s + step] @ (np.cumsum(depth, axis=1)[:, :-1] > 0) @ tall)
    return pd.DataFrame({"area": [area]})


def circular(angle: Column) -> dict[str, Column]:
    """Aggregates of a bearing in degrees: mean direction, length of the mean vector, and deviation."""
    s, c = F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))
    length = F.hypot(s, c)
    return {"mean": F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0)), "length": length, "std": F.degrees(F.sqrt(-2 * F.log(length)))}


def deviational_ellipse(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Centre, half axes and bearing of the major axis from the covariances: one aggregate, then a closed form."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"))
    mid, gap = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    bearing = F.pmod(90 - F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2, F.lit(180.0))
    return m.select("mx", "my", F.sqrt(mid + gap).alias("major"), F.sqrt(mid - gap).alias("minor"), bearing.alias("bearing"))


#: Pairs that are compared at once in a task.
AT_ONCE = 1_000_000


def semivariogram(samples: DataFrame, lag: float, n: int, value: str = "v") -> DataFrame:
    """Half the mean squared difference of pairs by distance, up to n lags. Pairs meet in cells of half the farthest lag's width, each in one cell: a sample is dealt to its own and to
    those before it in reach. A cell's pairs are added up by lag as arrays, block by block, so a cell gives n rows and no pair is a row."""
    from gridloom.operators.joins import met_in_cells

    reach = lag * n
    side = reach / 2
    own = samples.select("id", "x", "y", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.col(value).isNotNull().alias("has"), cell(F.col("x"), side).alias("__cx"), cell(F.col("y"), side).alias("__cy")).filter("__cx is not null and __cy is not null")
    before = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) >= (0, 0)])
    dealt = own.withColumn("s", F.explode(before)).select(*[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "v", "has")], (F.col("__cx") - F.col("s.i")).alias("__cx"), (F.col("__cy") - F.col("s.j")).alias("__cy"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("same"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # a distance that rounds to the farthest lag's end counts there; what is beyond or no pair counts in the last place, which is dropped
        pairs, told, total = np.zeros(n + 2, dtype=np.int64), np.zeros(n + 2, dtype=np.int64), np.zeros(n + 2)
        for same, far in b.groupby("same"):
            i, x, y, v, has = (a[c].to_numpy() for c in ("id", "x", "y", "v", "has"))
            bi, bx, by, bv, bhas = (far[f"b_{c}"].to_numpy() for c in ("id", "x", "y", "v", "has"))
            step = max(1, AT_ONCE // len(bi))
            for k in range(0, len(i), step):
                part = slice(k, k + step)
                dx, dy = x[part, None] - bx, y[part, None] - by
                d2 = dx * dx + dy * dy
                fits = (d2 < reach**2) & ((i[part, None] < bi) if same else (i[part, None] != bi))
                at = np.where(fits, np.sqrt(d2) / lag, n + 1).astype(np.int64).ravel()
                found = np.bincount(at, minlength=n + 2)
                pairs += found
                both = has[part, None] & bhas
                told += found if both.all() else np.bincount(at, both.ravel(), minlength=n + 2).astype(np.int64)
                total += np.bincount(at, (both * (v[part, None] - bv) ** 2).ravel(), minlength=n + 2)
        return pd.DataFrame({"lag": np.arange(n + 1), "pairs": pairs[:-1], "told": told[:-1], "total": total[:-1]})[pairs[:-1] > 0]

    sums = met_in_cells(own, dealt, "id", "b_id", run, "lag long, pairs long, told long, total double").groupBy("lag").agg(*[F.sum(c).alias(c) for c in ("pairs", "told", "total")])
    return sums.select("lag", "pairs", (F.try_divide("total", "told") / 2).alias("gamma"))


def fitted_variogram(curve: DataFrame, lag: float, farthest: float, steps: int = 200) -> DataFrame:
    """(nugget, sill, reach, error): the exponential model nugget + (sill - nugget) (1 - exp(-3 h / reach)) nearest to ``curve`` (lag, pairs, gamma), whose
    lags are steps of ``lag``.

    The sill is the mean of the far third of the lags, the nugget the first lag's value, at most the sill; the reach is the best of ``steps`` even steps up to
    ``farthest`` by squares weighted with pairs, the smallest of equal ones. A curve has one row a lag, so all reaches are tried in one join of lags with steps. Fewer than three lags give no row.
    """
    if lag <= 0 or farthest <= 0 or steps < 2:
        raise ValueError("lag and farthest reach must be positive, with two steps or more")
    ends = F.array_sort(F.collect_list(F.struct("lag", "gamma")))
    far = lambda c: F.slice(c, F.floor(2 * F.size(c) / 3).cast("int") + 1, F.size(c))
    shape = curve.agg(ends.alias("curve")).filter(F.size("curve") >= 3)
    total = F.aggregate(far(F.col("curve")), F.lit(0.0), lambda s, x: s + x["gamma"])
    shape = shape.withColumn("sill", total / F.size(far(F.col("curve")))).withColumn("nugget", F.greatest(F.lit(0.0), F.least(F.col("curve")[0]["gamma"], F.col("sill"))))
    tried = shape.select("nugget", "sill", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")).withColumn("reach", F.col("k") * (farthest / steps))
    model = F.col("nugget") + (F.col("sill") - F.col("nugget")) * (1 - F.exp(-3 * (F.col("lag") + 0.5) * lag / F.col("reach")))
    # a few lags beside a few hundred reaches, whatever the number of samples
    errors = tried.join(F.broadcast(curve.select("lag", "pairs", "gamma"))).groupBy("nugget", "sill", "reach").agg(F.sum(F.col("pairs") * F.pow(model - F.col("gamma"), 2)).alias("error"))
    return errors.agg(F.min(F.struct("error", "reach", "nugget", "sill")).alias("m")).filter("m is not null").select("m.nugget", "m.sill", "m.reach", "m.error")



def geometric_median(points: DataFrame, rounds: int = 60, tolerance: float = 1e-9) -> tuple[float, float]:
    """Weiszfeld's iteration: one aggregate a round; a point that is hit is returned."""
    x, y = points.agg(F.avg("x"), F.avg("y")).first()
    for i in range(rounds):
        if i == rounds - 1:
            warnings.warn(f"the median has not settled after {rounds} rounds", stacklevel=2)
        d = F.hypot(F.col("x") - x, F.col("y") - y)
        w = F.when(d > 0, F.try_divide(F.lit(1.0), d))
        sx, sy, s = points.agg(F.sum(w * F.col("x")), F.sum(w * F.col("y")), F.sum(w)).first()
        if not s or math.hypot(sx / s - x, sy / s - y) < tolerance:
            break
        x, y = sx / s, sy / s
    return x, y


def zone_spread(cells: DataFrame, totals: DataFrame, weight: Column) -> DataFrame:
    """A zone's total over its cells in proportion to a weight, evenly where all weights are zero."""
    zone = Window.partitionBy("zone")
    both = cells.withColumn("__w", weight).join(totals, "zone")
    share = F.when(F.sum("__w").over(zone) > 0, F.try_divide(F.col("__w"), F.sum("__w").over(zone))).otherwise(1 / F.count("*").over(zone))
    return both.withColumn("value", F.col("total") * share).drop("__w")


def detours(p: Column, q: Column) -> dict[str, Column]:
    """What a way of ``p`` columns and ``q`` rows over cells is longer than the straight line, as a share: over square cells by edges or by corners too, and over
    hexagons, whose axes lie 60 degrees apart."""
    a, b = F.abs(p), F.abs(q)
    straight, slanted = F.sqrt((p * p + q * q).cast("double")), F.sqrt((p * p + q * q + p * q).cast("double"))
    corners = F.greatest(a, b) + (math.sqrt(2) - 1) * F.least(a, b)
    return {"edges": (a + b) / straight - 1, "corners": corners / straight - 1, "hexes": (a + b + F.abs(p + q)) / 2 / slanted - 1}
