"""Queries of S7 and S10: masks, rasters, terrain and hydrology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import raster as ras
from gridloom.operators.statistics import STRAIGHT, shifted
from gridloom.plans.catalog import query
from gridloom.sources.fixtures import points, raster, recursive, sql

NEAR8 = "abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)"
NEAR4 = "abs(a.r-b.r)+abs(a.c-b.c) = 1"
CROSS = "cells a JOIN cells n ON n.r=a.r-1 AND n.c=a.c JOIN cells s ON s.r=a.r+1 AND s.c=a.c JOIN cells w ON w.r=a.r AND w.c=a.c-1 JOIN cells e ON e.r=a.r AND e.c=a.c+1"
CORNERS = CROSS + " JOIN cells nw ON nw.r=a.r-1 AND nw.c=a.c-1 JOIN cells ne ON ne.r=a.r-1 AND ne.c=a.c+1 JOIN cells sw ON sw.r=a.r+1 AND sw.c=a.c-1 JOIN cells se ON se.r=a.r+1 AND se.c=a.c+1"
GX, GY = "(ne.v+2*e.v+se.v-nw.v-2*w.v-sw.v)/8", "(sw.v+2*s.v+se.v-nw.v-2*n.v-ne.v)/8"


@query("terrain", sql(f"SELECT a.r, a.c, round(degrees(atan(sqrt(((e.v-w.v)/2)**2+((s.v-n.v)/2)**2))), 6) AS slope, round(CASE WHEN e.v=w.v AND s.v=n.v THEN -1.0 ELSE degrees(atan2(-(e.v-w.v)/2, -(s.v-n.v)/2))+360-360*floor((degrees(atan2(-(e.v-w.v)/2, -(s.v-n.v)/2))+360)/360) END, 5) AS aspect FROM {CROSS}", "cells"))
def terrain(spark: SparkSession, d: str) -> DataFrame:
    return ras.gradient(raster(spark, d)).select("r", "c", F.round("slope", 6).alias("slope"), F.round("aspect", 5).alias("aspect"))


@query("aspectnoise", sql(f"SELECT a.r, a.c, round({GX}, 6)+0.0 AS gx, round({GY}, 6)+0.0 AS gy FROM {CORNERS}", "cells"))
def aspectnoise(spark: SparkSession, d: str) -> DataFrame:
    return ras.horn(raster(spark, d)).select("r", "c", (F.round("gx", 6) + 0.0).alias("gx"), (F.round("gy", 6) + 0.0).alias("gy"))


def s_clamped(dr: int, dc: int) -> str:
    return f"(SELECT b.v FROM cells b WHERE b.r = least(greatest(a.r+({dr}), e.r0), e.r1) AND b.c = least(greatest(a.c+({dc}), e.c0), e.c1))"


S_FRAME = ", ".join(f"{s_clamped(*o)} AS {n}" for n, o in {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}.items())
S_DX, S_DY = "((ne+2*e+se)-(nw+2*w+sw))/8", "((nw+2*n+ne)-(sw+2*s+se))/8"


@query("hillshade", sql(f"WITH e AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells), g AS (SELECT a.r, a.c, {S_FRAME} FROM cells a, e), k AS (SELECT r, c, {S_DX} AS dx, {S_DY} AS dy FROM g) SELECT r, c, round(greatest(0.0, sin(radians(45))*cos(atan(sqrt(dx*dx+dy*dy))) + cos(radians(45))*sin(atan(sqrt(dx*dx+dy*dy)))*cos(radians(315)-atan2(-dx, -dy))), 6) AS shade FROM k", "cells"))
def hillshade(spark: SparkSession, d: str) -> DataFrame:
    return ras.hillshade(raster(spark, d)).select("r", "c", F.round("shade", 6).alias("shade"))


@query("terrainroughness", sql(f"SELECT a.r, a.c, round(sqrt(sum((a.v-b.v)**2)), 6) AS tri, round(any_value(a.v)-avg(b.v), 6)+0.0 AS tpi FROM cells a JOIN cells b ON {NEAR8} GROUP BY a.r, a.c", "cells"))
def terrainroughness(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    near = c.join(shifted(c, ras.ROUND, "v"), ["r", "c"])
    return near.groupBy("r", "c").agg(F.round(F.sqrt(F.sum(F.pow(F.col("v") - F.col("n_v"), 2))), 6).alias("tri"), (F.round(F.first("v") - F.avg("n_v"), 6) + 0.0).alias("tpi"))


DROP = f"SELECT a.r, a.c, b.r AS tr, b.c AS tc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.v-b.v)/(CASE WHEN a.r <> b.r AND a.c <> b.c THEN sqrt(2) ELSE 1.0 END) DESC, list_position(['-1_0','-1_1','0_1','1_1','1_0','1_-1','0_-1','-1_-1'], (b.r-a.r)::VARCHAR || '_' || (b.c-a.c)::VARCHAR)) AS pick FROM cells a JOIN cells b ON {NEAR8} WHERE a.v > b.v"


@query("flowdirection", sql(f"SELECT a.r, a.c, f.tr, f.tc FROM cells a LEFT JOIN ({DROP}) f ON a.r=f.r AND a.c=f.c AND pick=1", "cells"))
def flowdirection(spark: SparkSession, d: str) -> DataFrame:
    return ras.descent(raster(spark, d))


@query("basins", sql(f"WITH RECURSIVE fl AS (SELECT a.r, a.c, f.tr, f.tc FROM cells a LEFT JOIN ({DROP}) f ON a.r=f.r AND a.c=f.c AND pick=1), w AS (SELECT r, c, r AS sr, c AS sc FROM fl WHERE tr IS NULL UNION ALL SELECT fl.r, fl.c, w.sr, w.sc FROM fl JOIN w ON fl.tr=w.r AND fl.tc=w.c) SELECT sr, sc, count(*) AS n FROM w GROUP BY sr, sc", "cells").replace("WITH cells", "WITH RECURSIVE cells").replace(", RECURSIVE fl", ", fl"))
def basins(spark: SparkSession, d: str) -> DataFrame:
    return ras.outlets(ras.descent(raster(spark, d))).groupBy("sr", "sc").agg(F.count("*").alias("n"))


@query("flowaccumulation", sql(f"WITH RECURSIVE fl AS (SELECT a.r, a.c, f.tr, f.tc FROM cells a LEFT JOIN ({DROP}) f ON a.r=f.r AND a.c=f.c AND pick=1), w AS (SELECT r, c, tr, tc, r AS pr, c AS pc FROM fl UNION ALL SELECT w.r, w.c, fl.tr, fl.tc, fl.r, fl.c FROM w JOIN fl ON w.tr=fl.r AND w.tc=fl.c) SELECT pr AS r, pc AS c, count(*) AS n FROM w GROUP BY pr, pc", "cells").replace("WITH cells", "WITH RECURSIVE cells").replace(", RECURSIVE fl", ", fl"))
def flowaccumulation(spark: SparkSession, d: str) -> DataFrame:
    return ras.accumulation(ras.settle(ras.descent(raster(spark, d)), 0))


@query("streamorder", None)
def streamorder(spark: SparkSession, d: str) -> DataFrame:
    return ras.strahler(ras.settle(ras.descent(raster(spark, d)), 0)).select("r", "c", "stream")


S_FLOW = f"fl AS (SELECT a.r, a.c, a.v, f.tr, f.tc FROM cells a LEFT JOIN ({DROP}) f ON a.r=f.r AND a.c=f.c AND pick=1), w AS (SELECT r, c, tr, tc, r AS pr, c AS pc FROM fl UNION ALL SELECT w.r, w.c, fl.tr, fl.tc, fl.r, fl.c FROM w JOIN fl ON w.tr=fl.r AND w.tc=fl.c), ch AS (SELECT pr AS r, pc AS c, count(*) >= 6 AS channel FROM w GROUP BY pr, pc), b AS (SELECT fl.r, fl.c, fl.v AS base FROM fl JOIN ch USING (r, c) WHERE channel OR tr IS NULL UNION ALL SELECT fl.r, fl.c, b.base FROM fl JOIN ch USING (r, c) JOIN b ON fl.tr=b.r AND fl.tc=b.c WHERE NOT channel)"


@query("hand", sql(f"WITH RECURSIVE {S_FLOW} SELECT r, c, channel, round(v-base, 6) AS height FROM b JOIN fl USING (r, c) JOIN ch USING (r, c)", "cells").replace("WITH cells", "WITH RECURSIVE cells").replace(", RECURSIVE fl", ", fl"))
def hand(spark: SparkSession, d: str) -> DataFrame:
    """Height above the nearest drainage: the first cell on the way down that the flow of six cells passes."""
    return ras.height_above_drainage(raster(spark, d), 6).select("r", "c", "channel", F.round("height", 6).alias("height"))


def s_spread(name: str, start: str, cost: str, step: str) -> str:
    """Least costs over the eight neighbours as a keyed recursion: cells whose cost fell pass it on, until none falls."""
    return f"{name}(r, c, cost) USING KEY (r, c) AS (SELECT r, c, {cost} FROM cells WHERE {start} UNION SELECT b.r, b.c, min({step}) AS cost FROM {name} w JOIN cells a ON a.r=w.r AND a.c=w.c JOIN cells b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) LEFT JOIN recurring.{name} o ON o.r=b.r AND o.c=b.c GROUP BY b.r, b.c, o.cost HAVING o.cost IS NULL OR min({step}) < o.cost - 1e-12)"


LENGTH = "sqrt((a.r-b.r)**2+(a.c-b.c)**2)"
CORNER = "r = 0 AND c = 0"
MEAN_COST, ENTRY_COST = f"w.cost+(a.v+b.v)/2*{LENGTH}", f"w.cost+b.v*{LENGTH}"
RIM = "r = (SELECT min(r) FROM cells) OR r = (SELECT max(r) FROM cells) OR c = (SELECT min(c) FROM cells) OR c = (SELECT max(c) FROM cells)"


@query("sinkfill", recursive("WITH " + s_spread("f", RIM, "v", "greatest(b.v, w.cost)") + " SELECT r, c, round(cost-v, 6) AS depth FROM f JOIN cells USING (r, c)", "cells"))
def sinkfill(spark: SparkSession, d: str) -> DataFrame:
    return ras.fill_sinks(raster(spark, d)).select("r", "c", F.round(F.col("filled") - F.col("v"), 6).alias("depth"))


def source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0)], "r long, c long")


@query("costdistance", recursive("WITH " + s_spread("f", CORNER, "0.0::DOUBLE", MEAN_COST) + " SELECT r, c, round(cost, 6) AS cost FROM f", "cells"))
def costdistance(spark: SparkSession, d: str) -> DataFrame:
    return ras.cost_distance(raster(spark, d), source(spark)).select("r", "c", F.round("cost", 6).alias("cost"))


@query("isochrone", recursive("WITH " + s_spread("f", CORNER, "0.0::DOUBLE", MEAN_COST) + " SELECT r, c, CAST(floor(cost/2500) AS BIGINT) AS band FROM f", "cells"))
def isochrone(spark: SparkSession, d: str) -> DataFrame:
    """The band of cost that each cell lies in."""
    far = ras.cost_distance(raster(spark, d), source(spark))
    return far.select("r", "c", F.floor(F.col("cost") / 2500).alias("band"))


#: The neighbour that each cost came from, ties to the first in row order, and the ways followed back from the goals.
BACK = f", g AS (SELECT f.r, f.c, f.cost, n.r AS pr, n.c AS pc, row_number() OVER (PARTITION BY f.r, f.c ORDER BY n.r, n.c) AS i FROM f JOIN cells b ON b.r=f.r AND b.c=f.c JOIN f n ON abs(n.r-f.r) <= 1 AND abs(n.c-f.c) <= 1 AND (n.r <> f.r OR n.c <> f.c) WHERE f.cost > 0 AND abs(n.cost+b.v*sqrt((n.r-f.r)**2+(n.c-f.c)**2)-f.cost) <= 1e-9*(1+f.cost)), goals AS (SELECT 'row' AS goal, CAST(0 AS BIGINT) AS r, max(c) AS c FROM cells UNION ALL SELECT 'corner', max(r), max(c) FROM cells UNION ALL (SELECT 'farthest', r, c FROM f ORDER BY cost DESC, r, c LIMIT 1)), way AS (SELECT goal, CAST(0 AS BIGINT) AS back, r, c FROM goals UNION ALL SELECT goal, back+1, pr, pc FROM way JOIN g USING (r, c) WHERE g.i = 1) SELECT goal, max(back) OVER (PARTITION BY goal)-back AS step, r, c, round(cost, 6) AS cost FROM way JOIN f USING (r, c)"


@query("gridpath", recursive("WITH " + s_spread("f", CORNER, "0.0::DOUBLE", ENTRY_COST) + BACK, "cells"))
def gridpath(spark: SparkSession, d: str) -> DataFrame:
    """Least-cost ways from the first cell to the last of the first row, the last of all, and the farthest."""
    cells = raster(spark, d)
    far = ras.settle(ras.entry_cost(cells, source(spark)))
    edge = cells.agg(F.max("r").alias("r"), F.max("c").alias("c"))
    goals = edge.select(F.lit("row").alias("goal"), F.lit(0).cast("long").alias("r"), "c").union(edge.select(F.lit("corner"), "r", "c"))
    goals = goals.union(far.orderBy(F.desc("cost"), "r", "c").limit(1).select(F.lit("farthest"), "r", "c"))
    return ras.ways_from(far, goals).select("goal", "step", "r", "c", F.round("cost", 6).alias("cost"))


@query("corridor", recursive("WITH " + s_spread("f", CORNER, "0.0::DOUBLE", MEAN_COST) + ", " + s_spread("g", "r = 2 AND c = 63", "0.0::DOUBLE", MEAN_COST) + ", s AS (SELECT r, c, f.cost+g.cost AS s FROM f JOIN g USING (r, c)) SELECT r, c, round(s, 6) AS s FROM s WHERE s <= (SELECT min(s) FROM s)*1.05", "cells"))
def corridor(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    a = ras.cost_distance(c, source(spark)).select("r", "c", F.col("cost").alias("a"))
    b = ras.cost_distance(c, spark.createDataFrame([(2, 63)], "r long, c long")).select("r", "c", F.col("cost").alias("b"))
    both = a.join(b.hint("merge"), ["r", "c"]).withColumn("s", F.col("a") + F.col("b"))
    best = both.agg(F.min("s").alias("best"))
    return both.join(F.broadcast(best)).filter(F.col("s") <= F.col("best") * 1.05).select("r", "c", F.round("s", 6).alias("s"))


@query("distancetransform", sql("SELECT a.r, a.c, min((a.r-b.r)**2+(a.c-b.c)**2)::BIGINT AS d2 FROM cells a, cells b WHERE b.k > 45 GROUP BY a.r, a.c", "cells"))
def distancetransform(spark: SparkSession, d: str) -> DataFrame:
    return ras.distance_transform(raster(spark, d), F.col("k") > 45)


@query("rasterbuffer", sql("SELECT DISTINCT a.r, a.c FROM cells a, cells b WHERE b.k > 48 AND (a.r-b.r)**2+(a.c-b.c)**2 <= 9", "cells"))
def rasterbuffer(spark: SparkSession, d: str) -> DataFrame:
    return ras.distance_transform(raster(spark, d), F.col("k") > 48).filter("d2 <= 9").select("r", "c")


#: The shape's cells whose disc no neighbour's disc covers.
AXIS = "WITH e AS (SELECT a.r, a.c, min((a.r-b.r)**2+(a.c-b.c)**2)::BIGINT AS d2 FROM cells a, cells b WHERE NOT b.k > 4 GROUP BY a.r, a.c), m AS (SELECT r, c, d2 FROM e WHERE d2 > 0 AND NOT EXISTS (SELECT 1 FROM e n WHERE abs(n.r-e.r) <= 1 AND abs(n.c-e.c) <= 1 AND (n.r <> e.r OR n.c <> e.c) AND sqrt(n.d2) >= sqrt(e.d2)+sqrt((n.r-e.r)**2+(n.c-e.c)**2)-1e-9))"


@query("medialaxis", sql(AXIS + " SELECT r, c, d2 FROM m", "cells"))
def medialaxis(spark: SparkSession, d: str) -> DataFrame:
    return ras.medial_axis(raster(spark, d), F.col("k") > 4)


@query("medialaxis_nodes", sql(AXIS + ", p AS (SELECT r, c FROM m WHERE d2 >= 4), n AS (SELECT a.r, a.c, count(b.r) AS degree FROM p a LEFT JOIN p b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c) SELECT *, CASE WHEN degree <= 1 THEN 'end' WHEN degree >= 3 THEN 'junction' ELSE 'line' END AS kind FROM n", "cells"))
def medialaxis_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ends and junctions of the axis where it lies at least two deep."""
    return ras.degrees_of(ras.medial_axis(raster(spark, d), F.col("k") > 4).filter("d2 >= 4"))


PEELED = ", p0 AS (SELECT r, c FROM m WHERE d2 >= 2)" + "".join(f", p{k} AS (SELECT a.r, a.c FROM p{k - 1} a JOIN p{k - 1} b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c HAVING count(*) > 1)" for k in (1, 2)) + " SELECT r, c FROM p2"


@query("medialaxis_peeled", sql(AXIS + PEELED, "cells"))
def medialaxis_peeled(spark: SparkSession, d: str) -> DataFrame:
    """The axis without what two rounds of peeling its ends take."""
    return ras.peeled(ras.medial_axis(raster(spark, d), F.col("k") > 4).filter("d2 >= 2"), 2)


#: Sides of a cell by case of its corners over the level: top, right, bottom, left; saddles by the mean of the corners.
SIDES = ", ".join(f"({k}, {m}, '{p}', '{q}')" for k, m, p, q in [(1, -1, "l", "t"), (14, -1, "l", "t"), (2, -1, "t", "r"), (13, -1, "t", "r"), (4, -1, "r", "b"), (11, -1, "r", "b"), (8, -1, "b", "l"), (7, -1, "b", "l"), (3, -1, "l", "r"), (12, -1, "l", "r"), (6, -1, "t", "b"), (9, -1, "t", "b"), (5, 1, "t", "r"), (5, 1, "b", "l"), (10, 0, "t", "r"), (10, 0, "b", "l"), (5, 0, "l", "t"), (5, 0, "r", "b"), (10, 1, "l", "t"), (10, 1, "r", "b")])
ISO = f"WITH q AS (SELECT a.r, a.c, a.v AS a, b.v AS b, e.v AS e, g.v AS g FROM cells a JOIN cells b ON b.r=a.r AND b.c=a.c+1 JOIN cells e ON e.r=a.r+1 AND e.c=a.c+1 JOIN cells g ON g.r=a.r+1 AND g.c=a.c), k AS (SELECT *, (a >= 925.5)::INT+2*(b >= 925.5)::INT+4*(e >= 925.5)::INT+8*(g >= 925.5)::INT AS k, ((a+b+e+g)/4 >= 925.5)::INT AS m FROM q), p AS (SELECT r, c, k, m, unnest([{{'s': 't', 'x': c+(925.5-a)/(b-a), 'y': r+0.0}}, {{'s': 'r', 'x': c+1.0, 'y': r+(925.5-b)/(e-b)}}, {{'s': 'b', 'x': c+(925.5-g)/(e-g), 'y': r+1.0}}, {{'s': 'l', 'x': c+0.0, 'y': r+(925.5-a)/(g-a)}}]) AS p FROM k) SELECT x.r, x.c, round(x.p.x, 6) AS x1, round(x.p.y, 6) AS y1, round(y.p.x, 6) AS x2, round(y.p.y, 6) AS y2 FROM (VALUES {SIDES}) z(k, m, p, q) JOIN p x ON x.k = z.k AND (z.m < 0 OR z.m = x.m) AND x.p.s = z.p JOIN p y ON y.r = x.r AND y.c = x.c AND y.p.s = z.q"


@query("marchingsquares", sql(ISO, "cells"))
def marchingsquares(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the line at 925.5."""
    return ras.isolines(raster(spark, d), 925.5).select("r", "c", *[F.round(v, 6).alias(v) for v in ("x1", "y1", "x2", "y2")])


@query("viewshed", sql("WITH o AS (SELECT v+20 AS z FROM cells WHERE r=1 AND c=10), t AS (SELECT r, c, greatest(abs(r-1), abs(c-10)) AS n, (v-z)/sqrt((r-1)**2+(c-10)**2) AS slope FROM cells, o WHERE r<>1 OR c<>10), b AS (SELECT t.r, t.c, slope, 1+round_even((t.r-1)*s/n, 0) AS rr, 10+round_even((t.c-10)*s/n, 0) AS cc FROM t, range(1, 64) q(s) WHERE s < n) SELECT r, c FROM t EXCEPT SELECT b.r, b.c FROM b JOIN cells h ON h.r=rr AND h.c=cc, o WHERE (h.v-z)/sqrt((rr-1)**2+(cc-10)**2) > slope", "cells"))
def viewshed(spark: SparkSession, d: str) -> DataFrame:
    return ras.viewshed(raster(spark, d), 1, 10, 20.0)


SKY = "WITH x AS (SELECT r, c, v, way, r+CAST(round_even(-cos(way*pi()/8)*s, 0) AS BIGINT) AS rr, c+CAST(round_even(sin(way*pi()/8)*s, 0) AS BIGINT) AS cc FROM cells, range(16) p(way), range(1, 65) q(s)), y AS (SELECT x.r, x.c, way, max((b.v-x.v)/(sqrt((rr-x.r)**2+(cc-x.c)**2)*10)) AS t FROM x JOIN cells b ON b.r = rr AND b.c = cc GROUP BY x.r, x.c, way), h AS (SELECT r, c, sum(CASE WHEN t > 0 THEN t/sqrt(1+t*t) ELSE 0 END) AS s FROM y GROUP BY r, c) SELECT cells.r, cells.c, round(1-coalesce(s, 0)/16, 6) AS sky FROM cells LEFT JOIN h USING (r, c)"


@query("skyview", sql(SKY, "cells"))
def skyview(spark: SparkSession, d: str) -> DataFrame:
    return ras.sky_view(raster(spark, d)).select("r", "c", F.round("sky", 6).alias("sky"))


#: Steps of one side from each cell of water, the cell nearest to each, and the first that is land or none.
AZIMUTHS = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]
STOPS = "WITH a AS (SELECT r, c, azimuth, k, r - CAST(round_even(k*cos(radians(azimuth)), 0) AS BIGINT) AS rr, c + CAST(round_even(k*sin(radians(azimuth)), 0) AS BIGINT) AS cc FROM cells, (SELECT unnest([0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]) AS azimuth), range(1, 200) q(k) WHERE cells.k <= 40) SELECT a.r, a.c, azimuth::DOUBLE AS azimuth, CAST(min(a.k)-1 AS BIGINT) AS fetch FROM (SELECT r, c, azimuth, k, rr, cc FROM a) a LEFT JOIN cells b ON b.r = rr AND b.c = cc AND b.k <= 40 WHERE b.r IS NULL GROUP BY a.r, a.c, azimuth"


@query("windfetch", sql(STOPS.replace("range(1, 200) q(k) WHERE cells.k <= 40", "range(1, 200) q(s) WHERE cells.k <= 40").replace("azimuth, k, r -", "azimuth, s AS k, r -").replace("round_even(k*", "round_even(s*"), "cells"))
def windfetch(spark: SparkSession, d: str) -> DataFrame:
    """Open water from each cell of it, in eight directions."""
    cells, out = raster(spark, d), None
    for azimuth in AZIMUTHS:
        one = ras.fetches(cells, F.col("k") <= 40, azimuth).select("r", "c", F.lit(azimuth).alias("azimuth"), "fetch")
        out = one if out is None else out.union(one)
    return out


#: Digital lines as scan_lines makes them: the cells of water and the next cell ahead that isn't, for the fifteen directions round 30 degrees.
BEAMS = "WITH o AS (SELECT k*6.0 AS off, radians(30+k*6.0) AS a FROM range(-8, 9) q(k)), d AS (SELECT off, sin(a) AS e, -cos(a) AS s, abs(sin(a)) >= abs(cos(a)) AS flat FROM o), l AS (SELECT off, r, c, cells.k <= 40 AS wet, CASE WHEN flat THEN abs(e) ELSE abs(s) END AS long, CASE WHEN flat THEN c*sign(e) ELSE r*sign(s) END AS at, CASE WHEN flat THEN r-round_even(c*(s/e), 0) ELSE c-round_even(r*(e/s), 0) END AS line FROM cells, d), n AS (SELECT a.off, a.r, a.c, any_value(a.long) AS long, coalesce(min(b.at) FILTER (WHERE NOT b.wet), max(b.at)+1, any_value(a.at)+1)-any_value(a.at) AS n FROM l a LEFT JOIN l b ON a.off = b.off AND a.line = b.line AND b.at > a.at WHERE a.wet GROUP BY a.off, a.r, a.c) SELECT r, c, round(sum(cos(radians(off))*(ceil((n-0.5)/long)-1))/sum(cos(radians(off))), 6) AS fetch FROM n GROUP BY r, c"


@query("windfetch_effective", sql(BEAMS, "cells"))
def windfetch_effective(spark: SparkSession, d: str) -> DataFrame:
    """Fetch towards 30 degrees, the directions beside it weighed in."""
    return ras.effective_fetch(raster(spark, d), F.col("k") <= 40, 30.0, 48.0, 6.0).select("r", "c", F.round("fetch", 6).alias("fetch"))


LIT = "SELECT DISTINCT a.r, a.c, q.azimuth FROM cells a JOIN (SELECT unnest([0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0])::DOUBLE AS azimuth) q ON TRUE JOIN cells b ON (b.c-a.c = CAST(round_even(sin(radians(q.azimuth))*greatest(abs(b.r-a.r), abs(b.c-a.c))*CASE WHEN q.azimuth % 90 = 0 THEN 1 ELSE sqrt(2) END, 0) AS BIGINT) AND a.r-b.r = CAST(round_even(cos(radians(q.azimuth))*greatest(abs(b.r-a.r), abs(b.c-a.c))*CASE WHEN q.azimuth % 90 = 0 THEN 1 ELSE sqrt(2) END, 0) AS BIGINT)) WHERE (b.r <> a.r OR b.c <> a.c) AND b.v > a.v + tan(radians(80))*sqrt((b.r-a.r)**2+(b.c-a.c)**2) + 1e-9"


@query("shadowcast", sql(LIT, "cells"))
def shadowcast(spark: SparkSession, d: str) -> DataFrame:
    """Cells in the shadow of a sun 80 degrees up, in eight directions."""
    cells, out = raster(spark, d), None
    for azimuth in AZIMUTHS:
        one = ras.cast_shadows(cells, azimuth, 80.0).select("r", "c", F.lit(azimuth).alias("azimuth"))
        out = one if out is None else out.union(one)
    return out


#: The digital line towards 250 degrees, whose longer axis is west.
SLANTED = "WITH l AS (SELECT r, c, v, -c AS at, r-round_even(c*(-cos(radians(250))/sin(radians(250))), 0) AS line, c*sin(radians(250))-r*cos(radians(250)) AS along FROM cells) SELECT a.r, a.c FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.line = a.line AND b.at > a.at AND b.v > a.v + tan(radians(75))*(b.along-a.along) + 1e-9)"


@query("shadowcast_slanted", sql(SLANTED, "cells"))
def shadowcast_slanted(spark: SparkSession, d: str) -> DataFrame:
    """Shadows of a sun 75 degrees up towards 250 degrees."""
    return ras.cast_shadows(raster(spark, d), 250.0, 75.0)


@query("sealevel", sql(f"WITH RECURSIVE w AS (SELECT r, c FROM cells WHERE c = 0 AND v < 930 UNION SELECT b.r, b.c FROM w a JOIN cells b ON {NEAR4} WHERE b.v < 930) SELECT r, c FROM w", "cells").replace("WITH cells", "WITH RECURSIVE cells").replace(", RECURSIVE w", ", w"))
def sealevel(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    return ras.flood(c, 930.0, c.filter("c = 0"))


@query("rasterlabel", sql("WITH RECURSIVE m AS (SELECT r, c FROM cells WHERE k > 25), reach AS (SELECT r, c, r AS fr, c AS fc FROM m UNION SELECT m.r, m.c, fr, fc FROM reach JOIN m ON abs(m.r-reach.r)+abs(m.c-reach.c) = 1) SELECT r, c, min(fr*2147483648+fc) AS patch FROM reach GROUP BY r, c", "cells").replace("WITH cells", "WITH RECURSIVE cells").replace(", RECURSIVE m", ", m"))
def rasterlabel(spark: SparkSession, d: str) -> DataFrame:
    return ras.patches(raster(spark, d).filter("k > 25")).select("r", "c", "patch")


@query("cutfill", sql("SELECT round(sum(greatest(v-925, 0)), 4) AS cut, round(sum(greatest(925-v, 0)), 4) AS fill FROM cells", "cells"))
def cutfill(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).agg(F.round(F.sum(F.greatest(F.col("v") - 925, F.lit(0.0))), 4).alias("cut"), F.round(F.sum(F.greatest(925 - F.col("v"), F.lit(0.0))), 4).alias("fill"))


SHIFTED = "WITH e AS (SELECT max(r) AS mr, max(c) AS mc FROM cells), p AS (SELECT a::DOUBLE AS azimuth, s::DOUBLE AS shift FROM (VALUES (0.0), (30.0), (90.0), (225.0)) q(a), (VALUES (0.3), (0.8)) t(s)), w AS (SELECT azimuth, shift, v, mr, mc, least(greatest(r-shift*sin(radians(azimuth)), 0.0), mr) AS y, least(greatest(c-shift*cos(radians(azimuth)), 0.0), mc) AS x FROM cells, e, p WHERE r BETWEEN 1 AND mr-1 AND c BETWEEN 1 AND mc-1), z AS (SELECT azimuth, shift, w.v, (1-(y-floor(y)))*((1-(x-floor(x)))*a.v+(x-floor(x))*b.v)+(y-floor(y))*((1-(x-floor(x)))*cc.v+(x-floor(x))*d.v) AS z FROM w JOIN cells a ON a.r=floor(y) AND a.c=floor(x) JOIN cells b ON b.r=floor(y) AND b.c=least(floor(x)+1, mc) JOIN cells cc ON cc.r=least(floor(y)+1, mr) AND cc.c=floor(x) JOIN cells d ON d.r=least(floor(y)+1, mr) AND d.c=least(floor(x)+1, mc)), g AS (SELECT sqrt(avg(((e.v-w.v)/2)**2+((s.v-n.v)/2)**2)) AS g FROM cells m JOIN cells e ON e.r=m.r AND e.c=m.c+1 JOIN cells w ON w.r=m.r AND w.c=m.c-1 JOIN cells s ON s.c=m.c AND s.r=m.r+1 JOIN cells n ON n.c=m.c AND n.r=m.r-1) SELECT azimuth, shift, round(sqrt(avg((z-v)**2)), 6) AS rms, round(shift*any_value(g)/sqrt(2), 6) AS law FROM z, g GROUP BY azimuth, shift"


@query("verticalerror", sql(SHIFTED, "cells"))
def verticalerror(spark: SparkSession, d: str) -> DataFrame:
    """What a shift of the surface does to its heights, by direction."""
    e = ras.shift_errors(raster(spark, d), [0.3, 0.8], [0.0, 30.0, 90.0, 225.0], 1)
    return e.select("azimuth", "shift", F.round("rms", 6).alias("rms"), F.round("law", 6).alias("law"))


@query("rastershift", sql("SELECT dy, dx, round(corr(a.v, b.v), 6) AS ncc FROM range(-2, 3) p(dy), range(-2, 3) q(dx), cells a JOIN cells b ON b.r=a.r+dy AND b.c=a.c+dx GROUP BY dy, dx", "cells"))
def rastershift(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    both = c.join(shifted(c, ras.window_offsets(2), "v"), ["r", "c"])
    return both.groupBy(F.col("dr").cast("long").alias("dy"), F.col("dc").cast("long").alias("dx")).agg(F.round(F.corr("v", "n_v"), 6).alias("ncc"))


#: Windows of three over tiles of sixteen with halos of none to two cells, twice, beside the whole grid (its one tile is -1).
MEAN = "{n} AS (SELECT a.h, a.tr, a.tc, a.r, a.c, avg(b.v) AS v FROM {p} a JOIN {p} b ON a.h=b.h AND a.tr=b.tr AND a.tc=b.tc AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 GROUP BY a.h, a.tr, a.tc, a.r, a.c)"
SEAMS = "WITH t AS (SELECT h, tr, tc, r, c, v FROM cells, range(3) q(h), range(-1, 30) x(tr), range(-1, 30) y(tc) WHERE r BETWEEN tr*16-h AND tr*16+15+h AND c BETWEEN tc*16-h AND tc*16+15+h UNION ALL SELECT -1, -1, -1, r, c, v FROM cells), " + MEAN.format(n="m1", p="t") + ", " + MEAN.format(n="m2", p="m1") + " SELECT p.h::INTEGER AS halo, count(*) FILTER (WHERE abs(p.v-w.v) > 1e-9) AS cells, round(max(abs(p.v-w.v)), 6)+0.0 AS worst FROM m2 p JOIN m2 w ON w.h = -1 AND p.h >= 0 AND p.r = w.r AND p.c = w.c AND p.tr = p.r//16 AND p.tc = p.c//16 GROUP BY p.h HAVING count(*) FILTER (WHERE abs(p.v-w.v) > 1e-9) > 0"


@query("tileseams", sql(SEAMS, "cells"))
def tileseams(spark: SparkSession, d: str) -> DataFrame:
    """Cells that differ where tiles are filtered one by one, by halo; a halo of two leaves none."""
    cells, out = raster(spark, d), None
    for halo in range(3):
        one = ras.seams(cells, 16, halo, 1, 2).groupBy(F.lit(halo).alias("halo")).agg(F.count("*").alias("cells"), (F.round(F.max(F.abs(F.col("whole") - F.col("pieced"))), 6) + 0.0).alias("worst"))
        out = one if out is None else out.union(one)
    return out


@query("cutfill_prisms", sql("WITH d AS (SELECT r, c, v-925 AS v FROM cells), p AS (SELECT unnest([(a.v+b.v+e.v)/6, (a.v+e.v+f.v)/6]) AS q FROM d a JOIN d b ON b.r=a.r AND b.c=a.c+1 JOIN d e ON e.r=a.r+1 AND e.c=a.c+1 JOIN d f ON f.r=a.r+1 AND f.c=a.c) SELECT round(sum(greatest(-q, 0)), 4) AS cut, round(sum(greatest(q, 0)), 4) AS fill FROM p", "cells"))
def cutfill_prisms(spark: SparkSession, d: str) -> DataFrame:
    """Earth to move to the level of 925, by prisms over triangles."""
    p = ras.prisms(raster(spark, d).select("r", "c", (F.col("v") - 925).alias("v")))
    return p.select(F.round("cut", 4).alias("cut"), F.round("fill", 4).alias("fill"))


@query("landcoverchange_majority", sql("WITH n AS (SELECT a.r, a.c, a.k%3 AS own, b.k%3 AS k, count(*) AS n FROM cells a JOIN cells b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 GROUP BY 1, 2, 3, 4) SELECT r, c, k FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, k = own DESC, k) AS i FROM n) WHERE i = 1", "cells"))
def landcoverchange_majority(spark: SparkSession, d: str) -> DataFrame:
    """Classes smoothed by the majority of their windows."""
    return ras.majority(raster(spark, d).select("r", "c", (F.col("k") % 3).alias("k")))


PATHS = "WITH e AS (SELECT r, min(c) AS a, max(c) AS b FROM cells GROUP BY r), p AS (SELECT e.r, a, b, x.v+5 AS tx, y.v+5 AS rx FROM e JOIN cells x ON x.r=e.r AND x.c=a JOIN cells y ON y.r=e.r AND y.c=b), g AS (SELECT p.r, c, tx+(rx-tx)*(c-a)/(b-a)-1000.0*(c-a)*(b-c)/(2*6371.0088*4/3)-v AS gap FROM p JOIN cells USING (r)) SELECT r, round(min(gap), 4) AS clearance, arg_min(c, (gap, c)) AS lowest FROM g GROUP BY r"


@query("radiohorizon_clearance", sql(PATHS, "cells"))
def radiohorizon_clearance(spark: SparkSession, d: str) -> DataFrame:
    """Along each row, cells a kilometre apart: how far the ray between masts of five metres at its ends clears the ground, the earth's bulge taken off."""
    from gridloom.functions import astronomy

    row = Window.partitionBy("r")
    end = lambda f: f("v", "c").over(row) + 5
    p = raster(spark, d).withColumns({"a": F.min("c").over(row), "b": F.max("c").over(row), "tx": end(F.min_by), "rx": end(F.max_by)})
    gap = astronomy.ray_height(F.col("tx"), F.col("rx"), F.col("b") - F.col("a"), F.col("c") - F.col("a"), 4.0 / 3) - F.col("v")
    return p.withColumn("gap", gap).groupBy("r").agg(F.round(F.min("gap"), 4).alias("clearance"), F.min(F.struct("gap", "c")).alias("m")).select("r", "clearance", F.col("m.c").alias("lowest"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Laser returns: a slope to the east, and on most points a crown of a height told by the id."""
    crown = F.when(F.col("id") % 4 != 0, 2.0 + F.col("id") * 31 % 30).otherwise(0.0)
    return points(spark, d).select("x", "y", (F.col("x") * 0.05 + crown).alias("z"))


CANOPY = "WITH l AS (SELECT x, y, x*0.05+CASE WHEN id%4 <> 0 THEN 2.0+id*31%30 ELSE 0.0 END AS z FROM points), h AS (SELECT CAST(floor(y/40) AS BIGINT) AS r, CAST(floor(x/40) AS BIGINT) AS c, max(z) AS top, min(z) AS ground, max(z)-min(z) AS height FROM l GROUP BY 1, 2)"


@query("lidarheights", sql(CANOPY + " SELECT r, c, round(top, 6) AS top, round(ground, 6) AS ground, round(height, 6) AS height FROM h", "points"))
def lidarheights(spark: SparkSession, d: str) -> DataFrame:
    """Surface, terrain and canopy of laser returns."""
    return ras.canopy(returns(spark, d), 40.0).select("r", "c", *[F.round(v, 6).alias(v) for v in ("top", "ground", "height")])


@query("lidarheights_tops", sql(CANOPY + ", t AS (SELECT *, least(1+CAST(floor(height/15) AS INT), 3) AS reach FROM h WHERE height >= 5) SELECT r, c, round(height, 6) AS height, reach FROM t WHERE NOT EXISTS (SELECT 1 FROM h n WHERE abs(n.r-t.r) <= reach AND abs(n.c-t.c) <= reach AND (n.r <> t.r OR n.c <> t.c) AND (n.height > t.height OR n.height = t.height AND (n.r < t.r OR n.r = t.r AND n.c < t.c)))", "points"))
def lidarheights_tops(spark: SparkSession, d: str) -> DataFrame:
    """Tree tops of the canopy."""
    tops = ras.tree_tops(ras.canopy(returns(spark, d), 40.0), 5.0, 15.0, 3)
    return tops.select("r", "c", F.round("height", 6).alias("height"), "reach")


@query("latticecircle", sql("SELECT r, count(*) AS n FROM range(1, 21) q(r), range(-20, 21) a(x), range(-20, 21) b(y) WHERE x*x+y*y <= r*r GROUP BY r", "points"))
def latticecircle(spark: SparkSession, d: str) -> DataFrame:
    r = spark.range(1, 21).select(F.col("id").alias("r"))
    xy = r.withColumn("x", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    return xy.groupBy("r").agg(F.sum(2 * F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("x") * F.col("x"))) + 1).cast("long").alias("n"))


@query("bresenham", sql("WITH l AS (SELECT id, CAST(trunc(x) AS BIGINT) AS x0, CAST(trunc(y) AS BIGINT) AS y0, CAST(trunc(x) AS BIGINT)+id%17-8 AS x1, CAST(trunc(y) AS BIGINT)+id%23-11 AS y1 FROM points), n AS (SELECT *, greatest(abs(x1-x0), abs(y1-y0)) AS n FROM l) SELECT id, CAST(x0+round_even((x1-x0)*s/n, 0) AS BIGINT) AS x, CAST(y0+round_even((y1-y0)*s/n, 0) AS BIGINT) AS y FROM n, range(0, 12) q(s) WHERE n > 0 AND s <= n", "points"))
def bresenham(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the straight line between two cells, a step of the longer axis each."""
    p = points(spark, d).select("id", F.col("x").cast("long").alias("x0"), F.col("y").cast("long").alias("y0"))
    p = p.withColumns({"dx": F.col("id") % 17 - 8, "dy": F.col("id") % 23 - 11}).withColumn("n", F.greatest(F.abs("dx"), F.abs("dy"))).filter("n > 0")
    p = p.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return p.select("id", (F.col("x0") + F.rint(F.col("dx") * F.col("s") / F.col("n"))).cast("long").alias("x"), (F.col("y0") + F.rint(F.col("dy") * F.col("s") / F.col("n"))).cast("long").alias("y"))


@query("morphology", sql(f"SELECT DISTINCT b.r, b.c FROM cells a JOIN cells b ON a.r=b.r AND a.c=b.c OR {NEAR4} WHERE a.k > 45", "cells"))
def morphology(spark: SparkSession, d: str) -> DataFrame:
    """Dilation by a cross."""
    c = raster(spark, d)
    grown = shifted(c.filter("k > 45"), (*STRAIGHT, (0, 0)), "k").select("r", "c").distinct()
    return grown.join(c.select("r", "c"), ["r", "c"], "left_semi")


@query("morphology_erode", sql(f"SELECT a.r, a.c FROM cells a JOIN cells b ON a.r=b.r AND a.c=b.c OR {NEAR4} WHERE a.k > 15 GROUP BY a.r, a.c HAVING count(*) = 5 AND min(b.k) > 15", "cells"))
def morphology_erode(spark: SparkSession, d: str) -> DataFrame:
    """Erosion by a cross: off the grid counts as unset."""
    c = raster(spark, d).filter("k > 15")
    return ras.around(c, STRAIGHT, "k").groupBy("r", "c").agg(F.count("*").alias("n")).filter("n = 4").select("r", "c")


CROSS_ELEMENT = (*STRAIGHT, (0, 0))
S_NEAR5 = "abs(a.r-b.r)+abs(a.c-b.c) <= 1"


@query("morphology_open", sql(f"WITH s AS (SELECT r, c FROM cells WHERE k > 15), e AS (SELECT a.r, a.c FROM s a JOIN s b ON {S_NEAR5} GROUP BY a.r, a.c HAVING count(*) = 5) SELECT DISTINCT a.r, a.c FROM cells a JOIN e b ON {S_NEAR5}", "cells"))
def morphology_open(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    return ras.opened(c.filter("k > 15"), c, CROSS_ELEMENT)


@query("morphology_close", sql(f"WITH g AS (SELECT DISTINCT a.r, a.c FROM cells a JOIN cells b ON {S_NEAR5} WHERE b.k > 45) SELECT a.r, a.c FROM g a JOIN g b ON {S_NEAR5} GROUP BY a.r, a.c HAVING count(*) = 5", "cells"))
def morphology_close(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    return ras.closed(c.filter("k > 45"), c, CROSS_ELEMENT)


@query("regrid_nearest", sql("SELECT r*3+i AS r, c*3+j AS c, v FROM cells, range(3) a(i), range(3) b(j)", "cells"))
def regrid_nearest(spark: SparkSession, d: str) -> DataFrame:
    return ras.upsampled(raster(spark, d).select("r", "c", "v"), 3)


S_FINE = "WITH e AS (SELECT max(r) AS mr, max(c) AS mc FROM cells), f AS (SELECT fr, fc, (fr+0.5)/3-0.5 AS y, (fc+0.5)/3-0.5 AS x, mr, mc FROM e, range((SELECT (mr+1)*3 FROM e)) a(fr), range((SELECT (mc+1)*3 FROM e)) b(fc)), q AS (SELECT *, CAST(least(greatest(floor(y), 0), mr) AS BIGINT) AS r0, CAST(least(greatest(floor(x), 0), mc) AS BIGINT) AS c0 FROM f), t AS (SELECT *, least(r0+1, mr) AS r1, least(c0+1, mc) AS c1, least(greatest(y-r0, 0.0), 1.0) AS ty, least(greatest(x-c0, 0.0), 1.0) AS tx FROM q)"


@query("regrid_bilinear", sql(S_FINE + " SELECT fr AS r, fc AS c, round((a.v*(1-tx)+b.v*tx)*(1-ty)+(g.v*(1-tx)+h.v*tx)*ty, 6) AS v FROM t JOIN cells a ON a.r=r0 AND a.c=c0 JOIN cells b ON b.r=r0 AND b.c=c1 JOIN cells g ON g.r=r1 AND g.c=c0 JOIN cells h ON h.r=r1 AND h.c=c1", "cells"))
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return ras.upsampled(raster(spark, d).select("r", "c", "v"), 3, bilinear=True).select("r", "c", F.round("v", 6).alias("v"))


@query("mapalgebra", sql("SELECT r, c, round(v*2-k, 6) AS local, CASE WHEN v < 920 THEN 0 WHEN v < 940 THEN 1 ELSE 2 END AS klass FROM cells", "cells"))
def mapalgebra(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).select("r", "c", F.round(F.col("v") * 2 - F.col("k"), 6).alias("local"), F.when(F.col("v") < 920, 0).when(F.col("v") < 940, 1).otherwise(2).alias("klass"))


@query("mapalgebra_focal", sql("SELECT a.r, a.c, max(b.v) AS high FROM cells a JOIN cells b ON abs(a.r-b.r) <= 2 AND abs(a.c-b.c) <= 2 GROUP BY a.r, a.c", "cells"))
def mapalgebra_focal(spark: SparkSession, d: str) -> DataFrame:
    """Focal maximum, which two sliding windows give."""
    along, down = Window.partitionBy("r").orderBy("c").rangeBetween(-2, 2), Window.partitionBy("c").orderBy("r").rangeBetween(-2, 2)
    return raster(spark, d).withColumn("m", F.max("v").over(along)).select("r", "c", F.max("m").over(down).alias("high"))


@query("nodata", sql("WITH h AS (SELECT r, c, CASE WHEN k%7=0 THEN NULL ELSE v END AS v FROM cells), m AS (SELECT avg(v) AS m FROM h) SELECT round(avg(v), 6) AS ignored, round(avg(coalesce(v, 0)), 6) AS zero, round(stddev_pop(coalesce(v, m)), 6) AS filled_std, count(*)-count(v) AS holes FROM h, m", "cells"))
def nodata(spark: SparkSession, d: str) -> DataFrame:
    h = raster(spark, d).withColumn("v", F.when(F.col("k") % 7 != 0, F.col("v")))
    m = h.agg(F.avg("v").alias("m"))
    return h.join(F.broadcast(m)).agg(F.round(F.avg("v"), 6).alias("ignored"), F.round(F.avg(F.coalesce("v", F.lit(0.0))), 6).alias("zero"), F.round(F.stddev_pop(F.coalesce("v", "m")), 6).alias("filled_std"), (F.count("*") - F.count("v")).alias("holes"))


@query("integralimage", sql("SELECT a.r, a.c, round(sum(b.v), 4) AS s, count(*) AS n FROM cells a JOIN cells b ON abs(a.r-b.r) <= 3 AND abs(a.c-b.c) <= 3 GROUP BY a.r, a.c", "cells"))
def integralimage(spark: SparkSession, d: str) -> DataFrame:
    return ras.box_sums(raster(spark, d), 3).select("r", "c", F.round("s", 4).alias("s"), "n")


@query("summedarea", sql("SELECT r, c, round(sum(t) OVER (PARTITION BY c ORDER BY r), 4) AS s FROM (SELECT r, c, sum(v) OVER (PARTITION BY r ORDER BY c) AS t FROM cells)", "cells"))
def summedarea(spark: SparkSession, d: str) -> DataFrame:
    return ras.summed_area(raster(spark, d)).select("r", "c", F.round("s", 4).alias("s"))


@query("pyramid", sql("SELECT z, r>>z AS r, c>>z AS c, round(avg(v), 6) AS mean, max(v) AS high, count(*) AS n FROM cells, range(1, 4) q(z) GROUP BY ALL", "cells"))
def pyramid(spark: SparkSession, d: str) -> DataFrame:
    """Three levels from one pass: sums and counts add up, so each level is made from the one below."""
    level = raster(spark, d).select("r", "c", F.col("v").alias("s"), F.lit(1).cast("long").alias("n"), F.col("v").alias("high"))
    out = None
    for z in range(1, 4):
        level = level.groupBy(F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("high").alias("high"))
        part = level.select(F.lit(z).cast("long").alias("z"), "r", "c", F.round(F.col("s") / F.col("n"), 6).alias("mean"), "high", "n")
        out = part if out is None else out.union(part)
    return out


@query("regrid", sql("SELECT a.r//3 AS r, a.c//3 AS c, round(avg(v), 6) AS mean FROM cells a GROUP BY 1, 2", "cells"))
def regrid(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).groupBy(F.floor(F.col("r") / 3).alias("r"), F.floor(F.col("c") / 3).alias("c")).agg(F.round(F.avg("v"), 6).alias("mean"))


@query("categoricalresample", sql("SELECT r, c, klass FROM (SELECT r//4 AS r, c//4 AS c, k%5 AS klass, row_number() OVER (PARTITION BY r//4, c//4 ORDER BY count(*) DESC, k%5) AS o FROM cells GROUP BY r//4, c//4, k%5) WHERE o = 1", "cells"))
def categoricalresample(spark: SparkSession, d: str) -> DataFrame:
    """The majority class of each block, the smallest on a tie."""
    n = raster(spark, d).groupBy(F.floor(F.col("r") / 4).alias("r"), F.floor(F.col("c") / 4).alias("c"), (F.col("k") % 5).alias("klass")).agg(F.count("*").alias("n"))
    return n.groupBy("r", "c").agg(F.max(F.struct("n", -F.col("klass"))).alias("m")).select("r", "c", (-F.col("m.col2")).alias("klass"))


@query("landcoverchange", sql("WITH t AS (SELECT k%3 AS a, (k*7+r)%3 AS b, count(*) AS n FROM cells GROUP BY 1, 2), s AS (SELECT sum(n) AS t, sum(CASE WHEN a=b THEN n ELSE 0 END) AS o FROM t), e AS (SELECT sum(x.n*1.0*y.n) AS e FROM (SELECT a, sum(n) AS n FROM t GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM t GROUP BY b) y ON x.a=y.b) SELECT round(1-o/t, 6) AS changed, round((o/t-e/(t*t))/(1-e/(t*t)), 6) AS kappa FROM s, e", "cells"))
def landcoverchange(spark: SparkSession, d: str) -> DataFrame:
    t = raster(spark, d).groupBy((F.col("k") % 3).alias("a"), ((F.col("k") * 7 + F.col("r")) % 3).alias("b")).agg(F.count("*").alias("n"))
    s = t.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("o"))
    e = t.groupBy("a").agg(F.sum("n").alias("x")).join(t.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y")), "a").agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    chance = F.col("e") / (F.col("t") * F.col("t"))
    return s.join(e).select(F.round(1 - F.col("o") / F.col("t"), 6).alias("changed"), F.round((F.col("o") / F.col("t") - chance) / (1 - chance), 6).alias("kappa"))


@query("rasterrle", sql("WITH b AS (SELECT r, c, CASE WHEN k > 25 THEN 1 ELSE 0 END AS b FROM cells), n AS (SELECT *, CASE WHEN b <> lag(b) OVER (PARTITION BY r ORDER BY c) THEN 1 ELSE 0 END AS new FROM b), g AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY c ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT r, min(c) AS start, count(*) AS length, any_value(b) AS b FROM g GROUP BY r, run", "cells"))
def rasterrle(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("r").orderBy("c")
    b = raster(spark, d).select("r", "c", F.when(F.col("k") > 25, 1).otherwise(0).alias("b"))
    b = b.withColumn("new", F.when(F.col("b") != F.lag("b").over(w), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("r", "run").agg(F.min("c").alias("start"), F.count("*").alias("length"), F.first("b").alias("b")).drop("run")


@query("rasterbits", sql("SELECT r, CAST(sum(CASE WHEN k > 25 THEN 1 ELSE 0 END) AS BIGINT) AS ones, CAST(sum(CASE WHEN k > 25 AND k%2=0 THEN 1 ELSE 0 END) AS BIGINT) AS both FROM cells GROUP BY r", "cells"))
def rasterbits(spark: SparkSession, d: str) -> DataFrame:
    """A row's set cells, and those that a second mask has too."""
    words = ras.bit_words(raster(spark, d), a=F.col("k") > 25, b=F.col("k") % 2 == 0)
    return words.groupBy("r").agg(F.sum(F.bit_count("a")).alias("ones"), F.sum(F.bit_count(F.col("a").bitwiseAND(F.col("b")))).alias("both"))


@query("regionquadtree", sql("WITH e AS (SELECT CAST(ceil(log2(1+greatest(max(r), max(c)))) AS INT) AS top FROM cells), l AS (SELECT s, r >> s AS i, c >> s AS j, min(CASE WHEN k > 10 THEN 1 ELSE 0 END) AS lo, max(CASE WHEN k > 10 THEN 1 ELSE 0 END) AS hi FROM cells, e, range(0, 20) q(s) WHERE s <= top GROUP BY 1, 2, 3) SELECT CAST(1 AS BIGINT) << a.s AS side, a.i, a.j, a.lo AS b FROM l a LEFT JOIN l p ON p.s = a.s+1 AND p.i = a.i >> 1 AND p.j = a.j >> 1 WHERE a.lo = a.hi AND (p.s IS NULL OR p.lo <> p.hi)", "cells"))
def regionquadtree(spark: SparkSession, d: str) -> DataFrame:
    """Uniform squares of a mask, as large as they come."""
    return ras.uniform_squares(raster(spark, d), F.col("k") > 10)
