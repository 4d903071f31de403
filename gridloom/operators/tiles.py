"""Vector tiles and rasterized polygons: lines cut into runs at tile borders, polygons as cells by scan lines, both as joins and arrays of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.tracks import chord_gap, kept_mask

POINTS = "array<struct<x:double,y:double>>"


def borders(a: Column, b: Column, side: Column) -> Column:
    """Places in (0, 1) where the way from ``a`` to ``b`` crosses multiples of ``side``."""
    first, last = F.floor(F.least(a, b) / side) + 1, F.ceil(F.greatest(a, b) / side) - 1
    at = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: (i * side - a) / (b - a))
    return F.when(first <= last, F.filter(at, lambda t: (t > 0) & (t < 1))).otherwise(F.array().cast("array<double>"))


def cut(legs: DataFrame, zooms: list[int], extent: float) -> DataFrame:
    """(zoom, tx, ty, line, seq, k, x1, y1, x2, y2): every leg (line, seq, x1, y1, x2, y2) in pieces, each in one tile of side extent / 2**zoom.

    A piece belongs to the tile of its middle, so nothing is lost or counted twice, also where a leg runs along a border or meets a corner.
    """
    z = legs.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms]))).withColumn("side", extent / F.pow(2.0, "zoom"))
    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), borders(F.col("x1"), F.col("x2"), F.col("side")), borders(F.col("y1"), F.col("y2"), F.col("side")))))
    z = z.withColumn("at", at)
    z = z.select("*", F.posexplode(F.slice("at", 1, F.size("at") - 1)).alias("k", "t1")).withColumn("t2", F.element_at("at", F.col("k") + 2))
    along = lambda v, t: F.when(t == 1, F.col(f"{v}2")).otherwise(F.col(f"{v}1") + t * (F.col(f"{v}2") - F.col(f"{v}1")))
    tile = lambda v: F.floor(along(v, (F.col("t1") + F.col("t2")) / 2) / F.col("side")).cast("long")
    return z.select("zoom", tile("x").alias("tx"), tile("y").alias("ty"), "line", "seq", "k", along("x", F.col("t1")).alias("x1"), along("y", F.col("t1")).alias("y1"), along("x", F.col("t2")).alias("x2"), along("y", F.col("t2")).alias("y2"))


def runs(pieces: DataFrame) -> DataFrame:
    """(zoom, tx, ty, line, part, points, length): consecutive pieces of a line in one tile as one run of points; parts count along the line from 0.

    Zooms, lines and parts are keys, so a task holds what one line has in one tile at a time.
    """
    order = Window.partitionBy("zoom", "line").orderBy("seq", "k")
    moved = F.coalesce((F.lag("tx").over(order) != F.col("tx")) | (F.lag("ty").over(order) != F.col("ty")), F.lit(False))
    parts = pieces.withColumn("moved", moved.cast("long")).withColumn("part", F.sum("moved").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.array_sort(F.collect_list(F.struct("seq", "k", "x1", "y1", "x2", "y2")))
    length = F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    out = parts.groupBy("zoom", "tx", "ty", "line", "part").agg(whole.alias("whole"), length.alias("length"))
    start = F.array(F.struct(F.col("whole")[0]["x1"].alias("x"), F.col("whole")[0]["y1"].alias("y")))
    return out.select("zoom", "tx", "ty", "line", "part", F.concat(start, F.transform("whole", lambda p: F.struct(p["x2"].alias("x"), p["y2"].alias("y")))).alias("points"), "length")


def simplified(points: str, tolerance: Column) -> Column:
    """The points that Douglas and Peucker keep; both ends stay, so runs still meet at the borders of their tiles."""

    @F.pandas_udf(POINTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lines, tolerances in batches:
            out = []
            for line, far in zip(lines, tolerances, strict=True):
                keep = kept_mask(np.array([(p["x"], p["y"]) for p in line]), far, chord_gap)
                out.append([p for p, k in zip(line, keep, strict=True) if k])
            yield pd.Series(out, dtype=object)

    return run(points, tolerance)


def vector_tiles(legs: DataFrame, zooms: list[int], extent: float, pixels: int = 256, tolerance: float = 1.0) -> DataFrame:
    """(zoom, tx, ty, line, part, points, length): runs cut at the tiles' borders and simplified to ``tolerance`` pixels of their tile; length is that of
    the run before it was simplified."""
    far = extent / F.pow(2.0, "zoom") * tolerance / pixels
    return runs(cut(legs, zooms, extent)).withColumn("points", simplified("points", far))


# polygons as cells


def filled_cells(edges: DataFrame, size: float) -> DataFrame:
    """(id, r, c): cells whose centre is inside by the parity of crossings; ``edges`` (id, x1, y1, x2, y2) are those of all rings of a polygon, holes included.

    Every edge gives its crossing with the scan line of each row of centres (half-open in y), crossings of a row are paired from the left, and a pair fills the centres
    from one to the other, both included. Work grows with edges times rows and with filled cells, never with a polygon's box.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low / size - 0.5), F.ceil(high / size - 0.5) - 1
    rows = edges.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    y = (F.col("r") + 0.5) * size
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    order = Window.partitionBy("id", "r").orderBy("x")
    pairs = rows.select("id", "r", x.alias("x")).withColumns({"n": F.row_number().over(order), "to": F.lead("x").over(order)}).filter("n % 2 = 1 and to is not null")
    start, end = F.ceil(F.col("x") / size - 0.5), F.floor(F.col("to") / size - 0.5)
    # two pairs may meet in one centre
    return pairs.filter(start <= end).select("id", "r", F.explode(F.sequence(start, end)).alias("c")).distinct()


def edge_cells(edges: DataFrame, size: float) -> DataFrame:
    """(id, r, c): closed cells that an edge meets: column by column, the rows between where the edge enters and leaves the column."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    cols = edges.withColumn("c", F.explode(F.sequence(F.ceil(low / size) - 1, F.floor(high / size))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x1")) / dx))
    t = [F.when(dx == 0, F.lit(e)).otherwise(at((F.col("c") + i) * size)) for i, e in ((0, 0.0), (1, 1.0))]
    y = [F.when(k == 1, F.col("y2")).otherwise(F.col("y1") + k * dy) for k in t]
    cols = cols.select("id", "c", F.least(*y).alias("y_low"), F.greatest(*y).alias("y_high"))
    return cols.select("id", F.explode(F.sequence(F.ceil(F.col("y_low") / size) - 1, F.floor(F.col("y_high") / size))).alias("r"), "c").distinct()


def rasterized(edges: DataFrame, size: float, rule: str) -> DataFrame:
    """(id, r, c) by rule: ``centre``; ``touch``, the centre rule and every cell that an edge meets; ``inside``, the centre rule without those."""
    if size <= 0 or rule not in ("centre", "touch", "inside"):
        raise ValueError("the size must be positive and the rule centre, touch or inside")
    filled = filled_cells(edges, size)
    if rule == "centre":
        return filled
    met = edge_cells(edges, size)
    return filled.union(met.select("id", "r", "c")).distinct() if rule == "touch" else filled.join(met, ["id", "r", "c"], "left_anti")
