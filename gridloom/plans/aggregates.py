"""Queries of S4, S6, S7 and S13: binning, zonal summaries, selection, set operations and statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import aggregates as agg
from gridloom.operators import joins, nearest, statistics, tiles
from gridloom.plans.catalog import query
from gridloom.sources.fixtures import boxes, places, points, raster, recursive, rings, segments, sites, spans, sql

S3 = "sqrt(3)"
HEX = "WITH a AS (SELECT x*(2.0/3)/25 AS q, (-x/3 + y*sqrt(3)/3)/25 AS r FROM points), b AS (SELECT q, r, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q-r, 0) AS rs FROM a), c AS (SELECT *, abs(rq-q) AS dq, abs(rr-r) AS dr, abs(rs+q+r) AS ds FROM b) SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr-rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dr > ds AND NOT (dq > dr AND dq > ds) THEN -rq-rs ELSE rr END AS BIGINT) AS r, count(*) AS n FROM c GROUP BY 1, 2"


@query("hexbin", sql(HEX, "points"))
def hexbin(spark: SparkSession, d: str) -> DataFrame:
    return agg.hex_bins(points(spark, d), 25.0)


@query("hexgrid", sql(HEX.replace("count(*) AS n FROM c GROUP BY 1, 2", "CAST((abs(CASE WHEN dq > dr AND dq > ds THEN -rr-rs ELSE rq END) + abs(CASE WHEN dr > ds AND NOT (dq > dr AND dq > ds) THEN -rq-rs ELSE rr END) + abs((CASE WHEN dq > dr AND dq > ds THEN -rr-rs ELSE rq END) + (CASE WHEN dr > ds AND NOT (dq > dr AND dq > ds) THEN -rq-rs ELSE rr END)))/2 AS BIGINT) AS steps FROM c"), "points"))
def hexgrid(spark: SparkSession, d: str) -> DataFrame:
    q, r = agg.hex_key(F.col("x"), F.col("y"), 25.0)
    return points(spark, d).select(q.alias("q"), r.alias("r")).withColumn("steps", ((F.abs("q") + F.abs("r") + F.abs(F.col("q") + F.col("r"))) / 2).cast("long"))


STEPS_OF = "WITH d AS (SELECT id, CAST(floor(x/25) AS BIGINT)-20 AS p, CAST(floor(y/25) AS BIGINT)-20 AS q FROM points), s AS (SELECT * FROM d WHERE p <> 0 OR q <> 0) SELECT id, round((abs(p)+abs(q))/sqrt(p*p+q*q)-1, 6) AS edges, round((greatest(abs(p), abs(q))+(sqrt(2)-1)*least(abs(p), abs(q)))/sqrt(p*p+q*q)-1, 6)+0.0 AS corners, round((abs(p)+abs(q)+abs(p+q))/2/sqrt(p*p+q*q+p*q)-1, 6)+0.0 AS hexes FROM s"


@query("hexvssquare", sql(STEPS_OF, "points"))
def hexvssquare(spark: SparkSession, d: str) -> DataFrame:
    """How much longer than the straight line a way over cells is, from the middle to each point's cell: square cells by edges, by corners too, and hexagons."""
    p, q = (joins.cell(F.col(v), 25.0) - 20 for v in "xy")
    cells = points(spark, d).select("id", p.alias("p"), q.alias("q")).filter("p != 0 or q != 0")
    return cells.select("id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in agg.detours(F.col("p"), F.col("q")).items()])


@query("heatmap", sql("WITH g AS (SELECT i AS cx, j AS cy, (i+0.5)*20 AS gx, (j+0.5)*20 AS gy FROM range(50) a(i), range(50) b(j)) SELECT cx, cy, round(sum(exp(-((gx-x)**2+(gy-y)**2)/800)/(2*pi()*400)), 8) AS density FROM g, points WHERE (gx-x)**2+(gy-y)**2 <= 6400 GROUP BY cx, cy", "points"))
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return agg.kernel_density(points(spark, d), 20.0, 20.0, 50).select("cx", "cy", F.round("density", 8).alias("density"))


DENSE = "WITH g AS (SELECT i AS cx, j AS cy FROM range(20) a(i), range(20) b(j)), c AS (SELECT g.cx, g.cy, count(p.id) AS n FROM g LEFT JOIN points p ON floor(p.x/50) = g.cx AND floor(p.y/50) = g.cy GROUP BY g.cx, g.cy)"


@query("quadratcount", sql(DENSE + " SELECT round(var_samp(n)/avg(n), 6) AS vmr, round(sum((n-m)**2/m), 4) AS chi2, count_if(n = 0) AS empty FROM c, (SELECT avg(n) AS m FROM c)", "points"))
def quadratcount(spark: SparkSession, d: str) -> DataFrame:
    c = agg.dense_counts(points(spark, d), 50.0, 20)
    m = c.agg(F.avg("n").alias("m"))
    return c.join(F.broadcast(m)).agg(F.round(F.var_samp("n") / F.avg("n"), 6).alias("vmr"), F.round(F.sum(F.pow(F.col("n") - F.col("m"), 2) / F.col("m")), 4).alias("chi2"), F.count_if(F.col("n") == 0).alias("empty"))


@query("cellsizechoice", sql(DENSE + " SELECT round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_share, round(exp(-avg(n)), 6) AS law, round(1000/sqrt(sum(n)/2), 6) AS rule FROM c", "points"))
def cellsizechoice(spark: SparkSession, d: str) -> DataFrame:
    return agg.dense_counts(points(spark, d), 50.0, 20).agg(F.round(F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)), 6).alias("empty_share"), F.round(F.exp(-F.avg("n")), 6).alias("law"), F.round(1000 / F.sqrt(F.sum("n") / 2), 6).alias("rule"))


@query("maup", sql("WITH c AS (SELECT avg(x+id%50) AS u, avg(y+id%70) AS v, count(*) AS n FROM points GROUP BY floor(x/100), floor(y/100)) SELECT round(corr(u, v), 6) AS r, round(regr_slope(v, u), 6) AS slope, count(*) AS cells FROM c", "points"))
def maup(spark: SparkSession, d: str) -> DataFrame:
    c = points(spark, d).groupBy(joins.cell(F.col("x"), 100.0).alias("cx"), joins.cell(F.col("y"), 100.0).alias("cy")).agg(F.avg(F.col("x") + F.col("id") % 50).alias("u"), F.avg(F.col("y") + F.col("id") % 70).alias("v"))
    return c.agg(F.round(F.corr("u", "v"), 6).alias("r"), F.round(F.regr_slope("v", "u"), 6).alias("slope"), F.count("*").alias("cells"))


@query("centroidassignment", sql("SELECT CAST(floor((min_x+max_x)/2/100) AS BIGINT) AS cx, CAST(floor((min_y+max_y)/2/100) AS BIGINT) AS cy, count(*) AS n, sum(id) AS total FROM boxes GROUP BY 1, 2", "boxes"))
def centroidassignment(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy(joins.cell((F.col("min_x") + F.col("max_x")) / 2, 100.0).alias("cx"), joins.cell((F.col("min_y") + F.col("max_y")) / 2, 100.0).alias("cy")).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("arealsplit", sql("SELECT i AS cx, j AS cy, round(sum(id*(least(max_x, (i+1)*100)-greatest(min_x, i*100))*(least(max_y, (j+1)*100)-greatest(min_y, j*100))/((max_x-min_x)*(max_y-min_y))), 4) AS total FROM boxes, range(12) a(i), range(12) b(j) WHERE max_x > i*100 AND min_x < (i+1)*100 AND max_y > j*100 AND min_y < (j+1)*100 GROUP BY 1, 2", "boxes"))
def arealsplit(spark: SparkSession, d: str) -> DataFrame:
    b = joins.cells_of(boxes(spark, d), F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), 100.0)
    w = F.least("max_x", (F.col("__cx") + 1) * 100.0) - F.greatest("min_x", F.col("__cx") * 100.0)
    h = F.least("max_y", (F.col("__cy") + 1) * 100.0) - F.greatest("min_y", F.col("__cy") * 100.0)
    return b.filter((w > 0) & (h > 0)).groupBy(F.col("__cx").alias("cx"), F.col("__cy").alias("cy")).agg(F.round(F.sum(F.col("id") * w * h / ((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))), 4).alias("total"))


@query("dasymetric", sql("WITH z AS (SELECT r, c, v, k, r//4*100+c//8 AS zone FROM cells), t AS (SELECT zone, sum(v) AS total FROM z GROUP BY zone) SELECT r, c, round(total*(CASE WHEN sum(CASE WHEN k > 25 THEN k ELSE 0 END) OVER w > 0 THEN (CASE WHEN k > 25 THEN k ELSE 0 END)/sum(CASE WHEN k > 25 THEN k ELSE 0 END) OVER w ELSE 1.0/count(*) OVER w END), 6) AS value FROM z JOIN t USING (zone) WINDOW w AS (PARTITION BY zone)", "cells"))
def dasymetric(spark: SparkSession, d: str) -> DataFrame:
    z = raster(spark, d).withColumn("zone", F.floor(F.col("r") / 4) * 100 + F.floor(F.col("c") / 8))
    totals = z.groupBy("zone").agg(F.sum("v").alias("total"))
    return agg.zone_spread(z, totals, F.when(F.col("k") > 25, F.col("k")).otherwise(0)).select("r", "c", F.round("value", 6).alias("value"))


@query("zonalstats", sql("SELECT r//4*100+c//8 AS zone, count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(stddev_pop(v), 6) AS std FROM cells GROUP BY 1", "cells"))
def zonalstats(spark: SparkSession, d: str) -> DataFrame:
    z = raster(spark, d).groupBy((F.floor(F.col("r") / 4) * 100 + F.floor(F.col("c") / 8)).alias("zone"))
    return z.agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.stddev_pop("v"), 6).alias("std"))


def parcels(spark: SparkSession, d: str) -> DataFrame:
    """edges(id, x1, y1, x2, y2) of polygons with a hole: the sites' rings and the same at half the size."""
    e = rings(spark, d).join(sites(spark, d).select(F.col("sid").alias("id"), "sx", "sy"), "id").select("id", "sx", "sy", F.explode(joins.ring_edges(F.col("ring"))).alias("e"))
    e = e.withColumn("scale", F.explode(F.array(F.lit(1.0), F.lit(0.5))))
    place = lambda end, v: (F.col(f"s{v}") + F.col("scale") * (F.col(f"e.{end}.{v}") - F.col(f"s{v}"))).alias(f"{v}{1 if end == 'p' else 2}")
    return e.select("id", place("p", "x"), place("p", "y"), place("q", "x"), place("q", "y"))


#: The same edges, the cells of side 5 round each polygon, whether an odd number of edges lies right of the centre, and whether an edge meets the closed cell.
R_SLAB = "CASE WHEN {d} = 0 THEN {z} ELSE {f}(({c}*5-{p})/{d}, (({c}+1)*5-{p})/{d}) END"
R_ENTER, R_LEAVE = (", ".join(R_SLAB.format(d=f"({v}2-{v}1)", z=z, f=f, c=c, p=f"{v}1") for v, c in (("x", "c"), ("y", "r"))) for f, z in (("least", "0.0"), ("greatest", "1.0")))
CELLED = f"WITH w AS (SELECT e.id, sx+k*(x1-sx) AS x1, sy+k*(y1-sy) AS y1, sx+k*(x2-sx) AS x2, sy+k*(y2-sy) AS y2 FROM edges e JOIN sites s ON s.sid = e.id, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) q(k)), b AS (SELECT id, floor(min(x1)/5) AS c0, floor(max(x1)/5) AS c1, floor(min(y1)/5) AS r0, floor(max(y1)/5) AS r1 FROM w GROUP BY id), g AS (SELECT id, CAST(r0+j AS BIGINT) AS r, CAST(c0+i AS BIGINT) AS c FROM b, range(-1, 24) p(i), range(-1, 24) q(j) WHERE c0+i <= c1 AND r0+j <= r1), f AS (SELECT g.id, r, c, count(*) FILTER (WHERE (y1 <= (r+0.5)*5 AND (r+0.5)*5 < y2 OR y2 <= (r+0.5)*5 AND (r+0.5)*5 < y1) AND x1+((r+0.5)*5-y1)*(x2-x1)/(y2-y1) > (c+0.5)*5) % 2 = 1 AS inside, bool_or(greatest(x1, x2) >= c*5 AND least(x1, x2) <= (c+1)*5 AND greatest(y1, y2) >= r*5 AND least(y1, y2) <= (r+1)*5 AND greatest(0.0, {R_ENTER}) <= least(1.0, {R_LEAVE})) AS met FROM g JOIN w USING (id) GROUP BY g.id, r, c) SELECT id, r, c FROM f WHERE "


@query("rasterize", sql(CELLED + "inside", "edges", "sites"))
def rasterize(spark: SparkSession, d: str) -> DataFrame:
    """Cells of side 5 whose centre lies in a polygon, its hole left out."""
    return tiles.rasterized(parcels(spark, d), 5.0, "centre")


@query("rasterize_touch", sql(CELLED + "inside OR met", "edges", "sites"))
def rasterize_touch(spark: SparkSession, d: str) -> DataFrame:
    """Those and every cell that an edge meets."""
    return tiles.rasterized(parcels(spark, d), 5.0, "touch")


@query("rasterize_inside", sql(CELLED + "inside AND NOT met", "edges", "sites"))
def rasterize_inside(spark: SparkSession, d: str) -> DataFrame:
    """Only cells that no edge meets."""
    return tiles.rasterized(parcels(spark, d), 5.0, "inside")


S_SLAB = "CASE WHEN {d} = 0 THEN {z} ELSE {f}(({c}*50-{p})/{d}, (({c}+1)*50-{p})/{d}) END"
S_ENTER, S_LEAVE = (", ".join(S_SLAB.format(d=f"({v}2-{v}1)", z=z, f=f, c=c, p=f"{v}1") for v, c in (("x", "cx"), ("y", "cy"))) for f, z in (("least", "0.0"), ("greatest", "1.0")))


@query("linedensity", sql(f"WITH p AS (SELECT cx, cy, least(1.0, {S_LEAVE}) - greatest(0.0, {S_ENTER}) AS part, sqrt((x2-x1)**2+(y2-y1)**2) AS len FROM segments, range(-2, 24) a(cx), range(-2, 24) b(cy) WHERE cx BETWEEN floor(least(x1, x2)/50) AND floor(greatest(x1, x2)/50) AND cy BETWEEN floor(least(y1, y2)/50) AND floor(greatest(y1, y2)/50)) SELECT cx, cy, round(sum(part*len), 5) AS length FROM p WHERE part > 0 GROUP BY cx, cy", "segments"))
def linedensity(spark: SparkSession, d: str) -> DataFrame:
    return statistics.line_density(segments(spark, d), 50.0)


@query("classbreaks", sql("WITH b AS (SELECT min(v) AS lo, max(v) AS hi FROM cells) SELECT CAST(least(floor((v-lo)/(hi-lo)*5), 4) AS BIGINT) AS klass, count(*) AS n FROM cells, b GROUP BY 1", "cells"))
def classbreaks(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    b = c.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return c.join(F.broadcast(b)).groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 5), F.lit(4)).cast("long").alias("klass")).agg(F.count("*").alias("n"))


@query("classbreaks_quantile", sql("WITH o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM cells) SELECT k, v FROM o, range(1, 5) q(k) WHERE i = CAST(ceil(n*k/5.0) AS BIGINT)", "cells"))
def classbreaks_quantile(spark: SparkSession, d: str) -> DataFrame:
    c = raster(spark, d)
    n = c.count()
    ranks = nearest.global_rank(c, ["v", "r", "c"], "i")
    want = spark.createDataFrame([(k, -(-n * k // 5) - 1) for k in range(1, 5)], "q long, i long")
    return ranks.join(F.broadcast(want), "i").select(F.col("q").alias("k"), "v")


#: Sums over the sorted distinct values, then every way to cut them in four.
NATURAL = "WITH h AS (SELECT CAST(k AS DOUBLE) AS v, count(*) AS n FROM cells GROUP BY k), s AS (SELECT v, row_number() OVER o - 1 AS i, sum(n) OVER w AS n, sum(n*v) OVER w AS t, sum(n*v*v) OVER w AS q FROM h WINDOW o AS (ORDER BY v), w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), f AS (SELECT 0 AS j, 0.0 AS n, 0.0 AS t, 0.0 AS q UNION ALL SELECT i+1, n, t, q FROM s), c AS (SELECT a.j AS a, b.j AS b, b.q-a.q-(b.t-a.t)**2/(b.n-a.n) AS cost FROM f a JOIN f b ON a.j < b.j), m AS (SELECT x.b AS i, y.b AS j, z.b AS k FROM c x JOIN c y ON x.a = 0 AND y.a = x.b JOIN c z ON z.a = y.b JOIN c u ON u.a = z.b AND u.b = (SELECT max(j) FROM f) ORDER BY x.cost+y.cost+z.cost+u.cost LIMIT 1)"


@query("jenks", sql(NATURAL + " SELECT g AS k, v AS start FROM (SELECT unnest([1, 2, 3]) AS g, unnest([i, j, k]) AS place FROM m) JOIN s ON s.i = place", "cells"))
def jenks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.jenks_breaks(raster(spark, d), "k", 4)


@query("hypsometry", sql("SELECT round((avg(v)-min(v))/(max(v)-min(v)), 6) AS integral, round(avg(CASE WHEN v >= 925 THEN 1.0 ELSE 0.0 END), 6) AS above FROM cells", "cells"))
def hypsometry(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).agg(F.round((F.avg("v") - F.min("v")) / (F.max("v") - F.min("v")), 6).alias("integral"), F.round(F.avg(F.when(F.col("v") >= 925, 1.0).otherwise(0.0)), 6).alias("above"))


@query("pointcounting", sql("SELECT round(avg(CASE WHEN (x-500)**2+(y-500)**2 <= 90000 THEN 1.0 ELSE 0.0 END)*1e6, 2) AS area FROM points", "points"))
def pointcounting(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).agg(F.round(F.avg(F.when(F.pow(F.col("x") - 500, 2) + F.pow(F.col("y") - 500, 2) <= 90000, 1.0).otherwise(0.0)) * 1e6, 2).alias("area"))


@query("variogram", sql("SELECT CAST(floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/20) AS BIGINT) AS lag, count(*) AS pairs, round(avg((a.id%37-b.id%37)**2)/2, 6) AS gamma FROM points a, points b WHERE a.id < b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 10000 GROUP BY 1", "points"))
def variogram(spark: SparkSession, d: str) -> DataFrame:
    return agg.semivariogram(points(spark, d).withColumn("v", (F.col("id") % 37).cast("double")), 20.0, 5).select("lag", "pairs", F.round("gamma", 6).alias("gamma"))


VARIOGRAM_FIT = "WITH v AS (SELECT CAST(floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/10) AS BIGINT) AS lag, count(*) AS pairs, avg((a.z-b.z)**2)/2 AS gamma FROM w a JOIN w b ON a.id < b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 10000 GROUP BY 1), s AS (SELECT avg(gamma) FILTER (WHERE i > floor(2*n/3)) AS sill, min(gamma) FILTER (WHERE i = 1) AS first FROM (SELECT gamma, row_number() OVER (ORDER BY lag) AS i, count(*) OVER () AS n FROM v)), m AS (SELECT sill, greatest(0, least(first, sill)) AS nugget FROM s), e AS (SELECT nugget, sill, k*2.0 AS reach, sum(pairs*(nugget+(sill-nugget)*(1-exp(-3*(lag+0.5)*10/(k*2.0)))-gamma)**2) AS error FROM m, range(1, 201) q(k), v GROUP BY nugget, sill, k) SELECT round(nugget, 6) AS nugget, round(sill, 6) AS sill, arg_min(reach, (error, reach)) AS reach FROM e GROUP BY nugget, sill"


@query("variogram_fit", sql("WITH w AS (SELECT id, x, y, sin(x/60)*10+cos(y/45)*8+id%5 AS z FROM points), " + VARIOGRAM_FIT[5:], "points"))
def variogram_fit(spark: SparkSession, d: str) -> DataFrame:
    """Nugget, sill and reach of a smooth field with noise."""
    field = F.sin(F.col("x") / 60) * 10 + F.cos(F.col("y") / 45) * 8 + F.col("id") % 5
    curve = agg.semivariogram(points(spark, d).withColumn("z", field), 10.0, 10, "z")
    return agg.fitted_variogram(curve, 10.0, 400.0).select(F.round("nugget", 6).alias("nugget"), F.round("sill", 6).alias("sill"), "reach")


@query("bearingstats", sql("WITH m AS (SELECT avg(sin(radians(lon1*85/180+85))) AS s, avg(cos(radians(lon1*85/180+85))) AS c FROM places) SELECT round(degrees(atan2(s, c))+360-360*floor((degrees(atan2(s, c))+360)/360), 6) AS mean, round(sqrt(s*s+c*c), 6) AS length, round(degrees(sqrt(-2*ln(sqrt(s*s+c*c)))), 6) AS std FROM m", "places"))
def bearingstats(spark: SparkSession, d: str) -> DataFrame:
    """Bearings are drawn together to half a circle, so that they have a mean."""
    return places(spark, d).agg(*[F.round(c, 6).alias(n) for n, c in agg.circular(F.col("lon1") * 85 / 180 + 85).items()])


@query("geocentroid", sql("WITH m AS (SELECT avg(cos(radians(lat1))*cos(radians(lon1*50/180+10))) AS x, avg(cos(radians(lat1))*sin(radians(lon1*50/180+10))) AS y, avg(sin(radians(lat1))) AS z FROM places) SELECT round(degrees(atan2(z, sqrt(x*x+y*y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon, round(sqrt(x*x+y*y+z*z), 6) AS concentration FROM m", "places"))
def geocentroid(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.functions import geodesy

    v = geodesy.unit_vector(F.col("lat1"), F.col("lon1") * 50 / 180 + 10)  # drawn together to one side of the sphere
    m = places(spark, d).agg(*[F.avg(c).alias(n) for n, c in zip("xyz", v, strict=True)])
    lat, lon = geodesy.from_vector(F.col("x"), F.col("y"), F.col("z"))
    return m.select(F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"), F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 6).alias("concentration"))


@query("sdellipse", sql("WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM (SELECT x*0.7 AS x, y FROM points)) SELECT round(mx, 5) AS mx, round(my, 5) AS my, round(sqrt((a+b)/2+sqrt(((a-b)/2)**2+c*c)), 5) AS major, round(sqrt((a+b)/2-sqrt(((a-b)/2)**2+c*c)), 5) AS minor, round(90-degrees(atan2(2*c, a-b))/2-180*floor((90-degrees(atan2(2*c, a-b))/2)/180), 4) AS bearing FROM m", "points"))
def sdellipse(spark: SparkSession, d: str) -> DataFrame:
    e = agg.deviational_ellipse(points(spark, d).withColumn("x", F.col("x") * 0.7))
    return e.select(*[F.round(c, 5).alias(c) for c in ("mx", "my", "major", "minor")], F.round("bearing", 4).alias("bearing"))


MEDIAN = "WITH m(n, x, y) AS (SELECT 0, avg(x), avg(y) FROM points UNION ALL SELECT m.n+1, sum(p.x/sqrt((p.x-m.x)**2+(p.y-m.y)**2))/sum(1/sqrt((p.x-m.x)**2+(p.y-m.y)**2)), sum(p.y/sqrt((p.x-m.x)**2+(p.y-m.y)**2))/sum(1/sqrt((p.x-m.x)**2+(p.y-m.y)**2)) FROM m, points p WHERE m.n < 60 AND (p.x <> m.x OR p.y <> m.y) GROUP BY m.n) SELECT round(arg_max(x, n), 4) AS x, round(arg_max(y, n), 4) AS y FROM m"


@query("spatialmedian", recursive(MEDIAN, "points"))
def spatialmedian(spark: SparkSession, d: str) -> DataFrame:
    x, y = agg.geometric_median(points(spark, d))
    return spark.createDataFrame([(round(x, 4), round(y, 4))], "x double, y double")


@query("medoid", sql("SELECT a.id, round(sum(sqrt((a.sx-b.sx)**2+(a.sy-b.sy)**2)), 4) AS total FROM (SELECT sid AS id, sx, sy FROM sites) a, sites b GROUP BY a.id ORDER BY 2, 1 LIMIT 1", "sites"))
def medoid(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    other = F.broadcast(s.select(F.col("sx").alias("ox"), F.col("sy").alias("oy")))
    return s.join(other).groupBy(F.col("sid").alias("id")).agg(F.round(F.sum(F.hypot(F.col("sx") - F.col("ox"), F.col("sy") - F.col("oy"))), 4).alias("total")).orderBy("total", "id").limit(1)


@query("unionarea", sql("WITH b AS (SELECT * FROM boxes), e AS (SELECT DISTINCT pos FROM (SELECT min_x AS pos FROM b UNION ALL SELECT max_x FROM b)), s AS (SELECT pos, lead(pos) OVER (ORDER BY pos) AS nxt FROM e), o AS (SELECT s.pos, s.nxt, min_y AS lo, max_y AS hi FROM s JOIN b ON min_x <= s.pos AND max_x >= s.nxt), n AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY pos ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM o), g AS (SELECT *, sum(new) OVER (PARTITION BY pos ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM n) SELECT round(sum(w), 3) AS area FROM (SELECT (nxt-pos)*(max(hi)-min(lo)) AS w FROM g GROUP BY pos, nxt, isl)", "boxes"))
def unionarea(spark: SparkSession, d: str) -> DataFrame:
    return agg.union_area(boxes(spark, d), 100.0).select(F.round("area", 3).alias("area"))


ISLANDS = "WITH k AS (SELECT id%10 AS line, lo, hi FROM spans), n AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM n)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select((F.col("id") % 10).alias("line"), "lo", "hi")


@query("segmentcover", sql(ISLANDS + " SELECT line, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, count(*) AS n FROM g GROUP BY line, isl", "spans"))
def segmentcover(spark: SparkSession, d: str) -> DataFrame:
    return agg.merged_spans(lines(spark, d), "line").select("line", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("segmentcover_depth", sql("WITH k AS (SELECT id%10 AS line, lo, hi FROM spans), e AS (SELECT line, pos, sum(s) AS s FROM (SELECT line, lo AS pos, 1 AS s FROM k UNION ALL SELECT line, hi, -1 FROM k) GROUP BY line, pos), p AS (SELECT line, pos, lead(pos) OVER w AS until, sum(s) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM e WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, max(depth) AS deepest, round(sum(until-pos), 5) AS covered FROM p WHERE depth > 0 AND until > pos GROUP BY line", "spans").replace("max(depth)", "CAST(max(depth) AS BIGINT)"))
def segmentcover_depth(spark: SparkSession, d: str) -> DataFrame:
    return agg.depth_pieces(lines(spark, d), "line").groupBy("line").agg(F.max("depth").alias("deepest"), F.round(F.sum(F.col("until") - F.col("at")), 5).alias("covered"))


STREET = "WITH e AS (SELECT degrees(atan2(x2-x1, y2-y1)) AS b FROM segments WHERE x1 <> x2 OR y1 <> y2), w AS (SELECT b+360-360*floor((b+360)/360) AS b FROM e UNION ALL SELECT b+180-360*floor((b+180)/360) FROM e), h AS (SELECT CAST(floor((b+5-360*floor((b+5)/360))/10) AS BIGINT) AS bin, count(*) AS n FROM w GROUP BY 1)"


@query("streetorientation", sql(STREET + " SELECT round(-sum(p*ln(p)), 6) AS entropy, round(1-((-sum(p*ln(p))-ln(4))/(ln(36)-ln(4)))**2, 6) AS orientation FROM (SELECT n/sum(n) OVER () AS p FROM h)", "segments"))
def streetorientation(spark: SparkSession, d: str) -> DataFrame:
    b = segments(spark, d).filter("x1 != x2 or y1 != y2").select(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("b"))
    both = b.select(F.explode(F.array(F.pmod(F.col("b") + 360, F.lit(360.0)), F.pmod(F.col("b") + 180, F.lit(360.0)))).alias("b"))
    bins = both.groupBy(F.floor(F.pmod(F.col("b") + 5, F.lit(360.0)) / 10).alias("bin")).agg(F.count("*").alias("n"))  # 36 rows
    p = bins.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    h = -F.sum(F.col("p") * F.log("p"))
    return p.agg(F.round(h, 6).alias("entropy"), F.round(1 - F.pow((h - math.log(4)) / (math.log(36) - math.log(4)), 2), 6).alias("orientation"))


# S6: selection and sampling


@query("skyline", sql("SELECT id FROM points a WHERE NOT EXISTS (SELECT 1 FROM points b WHERE b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))", "points"))
def skyline(spark: SparkSession, d: str) -> DataFrame:
    return statistics.skyline(points(spark, d))


@query("thinning", sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY floor(x/60), floor(y/60) ORDER BY (x-(floor(x/60)+0.5)*60)**2+(y-(floor(y/60)+0.5)*60)**2, id) AS k FROM points) WHERE k = 1", "points"))
def thinning(spark: SparkSession, d: str) -> DataFrame:
    return statistics.grid_thin(points(spark, d), 60.0)


@query("thinning_distance", None)
def thinning_distance(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distance_thin(points(spark, d), 40.0)


@query("spatialsample", sql("SELECT id FROM points WHERE id % 7 = 3", "points"))
def spatialsample(spark: SparkSession, d: str) -> DataFrame:
    """The systematic design: every seventh, from the fourth."""
    return points(spark, d).filter("id % 7 = 3").select("id")


def s_farthest(k: int) -> str:
    """Each step's centre as a table of its own."""
    steps = ["c0 AS (SELECT id, x, y, 0.0 AS d2 FROM points ORDER BY id LIMIT 1)"]
    for i in range(1, k):
        near = ", ".join(f"(SELECT (p.x-x)**2+(p.y-y)**2 FROM c{j})" for j in range(i))
        steps.append(f"c{i} AS (SELECT id, x, y, d2 FROM (SELECT id, x, y, least({near}, 1e300) AS d2 FROM points p) ORDER BY d2 DESC, id LIMIT 1)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, id, round(sqrt(d2), 6) AS distance FROM c{i}" for i in range(k))


S_SCRAMBLE = "(id*7919+12345)%100003"


def scramble():
    return (F.col("id") * 7919 + 12345) % 100003


@query("spatialsample_random", sql(f"SELECT id FROM points ORDER BY {S_SCRAMBLE}, id LIMIT 50", "points"))
def spatialsample_random(spark: SparkSession, d: str) -> DataFrame:
    return statistics.design_sample(points(spark, d), "random", 100.0, 50, scramble())


@query("spatialsample_stratified", sql(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY floor(x/100), floor(y/100) ORDER BY {S_SCRAMBLE}, id) AS k FROM points) WHERE k = 1", "points"))
def spatialsample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return statistics.design_sample(points(spark, d), "stratified", 100.0, 0, scramble())


@query("spatialsample_systematic", sql(f"WITH o AS (SELECT min({S_SCRAMBLE})%1000/1000*100 AS o FROM points) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY floor(x/100), floor(y/100) ORDER BY (x-floor(x/100)*100-o)**2+(y-floor(y/100)*100-o)**2, id) AS k FROM points, o) WHERE k = 1", "points"))
def spatialsample_systematic(spark: SparkSession, d: str) -> DataFrame:
    return statistics.design_sample(points(spark, d), "systematic", 100.0, 0, scramble())


@query("kcenter", sql(s_farthest(6), "points"))
def kcenter(spark: SparkSession, d: str) -> DataFrame:
    return statistics.farthest_first(points(spark, d), 6)


@query("suitability", sql("WITH s AS (SELECT r, c, 0.6*(v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()) + 0.4*(k-min(k) OVER ())/(max(k) OVER ()-min(k) OVER ()) AS s FROM cells) SELECT r, c, round(s, 6) AS score FROM s ORDER BY s DESC, r DESC, c DESC LIMIT 20", "cells"))
def suitability(spark: SparkSession, d: str) -> DataFrame:
    return statistics.overlay(raster(spark, d), {"v": 0.6, "k": 0.4}).orderBy(F.desc("score"), F.desc("r"), F.desc("c")).limit(20).select("r", "c", F.round("score", 6).alias("score"))


RANKED = "WITH s AS (SELECT r, c, (v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()) AS a, (k-min(k) OVER ())/(max(k) OVER ()-min(k) OVER ()) AS b FROM cells), t AS (SELECT row_number() OVER (ORDER BY round(0.6*a+0.4*b, 9), r, c) AS i, row_number() OVER (ORDER BY round(0.3*a+0.7*b, 9), r, c) AS j, count(*) OVER () AS n FROM s) SELECT round(1-6*sum((i-j)**2)/(any_value(n)*(any_value(n)**2-1.0)), 6) AS rho, round(count_if(i > n*0.9 AND j > n*0.9)/count_if(i > n*0.9), 6) AS shared FROM t"


@query("suitability_ranks", sql(RANKED, "cells"))
def suitability_ranks(spark: SparkSession, d: str) -> DataFrame:
    """How alike two weightings rank the cells, and how much of the best tenth they share."""
    both = [statistics.overlay(raster(spark, d), w).select("r", "c", F.round("score", 9).alias(n)) for n, w in (("s", {"v": 0.6, "k": 0.4}), ("t", {"v": 0.3, "k": 0.7}))]
    ranked = nearest.global_rank(nearest.global_rank(both[0].join(both[1], ["r", "c"]), ["s", "r", "c"], "i"), ["t", "r", "c"], "j")
    return statistics.rank_agreement(ranked, 0.1)


# S13: spatial statistics


@query("nearestneighbourindex", sql("WITH n AS (SELECT sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS m FROM points a, points b WHERE a.id <> b.id GROUP BY a.id) SELECT round(avg(m)/(0.5/sqrt(count(*)/1e6)), 6) AS ratio FROM n", "points"))
def nearestneighbourindex(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    near = joins.knn_join(p, p, 1, pid="id", px="x", py="y", exclude_same=True)
    return near.agg(F.round(F.avg(F.sqrt("d2")) / (0.5 / F.sqrt(F.count("*") / 1e6)), 6).alias("ratio"))


@query("ripleyk", sql("SELECT r, round(1e6*count(*)/(max(n)*(max(n)-1.0)), 4) AS k FROM points a, points b, (SELECT count(*) AS n FROM points), (SELECT unnest([20.0, 40.0, 60.0]) AS r) WHERE a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= r*r GROUP BY r", "points"))
def ripleyk(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ripley_k(points(spark, d), [20.0, 40.0, 60.0], 1e6)


ROOK = "cells a JOIN cells b ON abs(a.r-b.r)+abs(a.c-b.c) = 1"


@query("morani", sql(f"WITH m AS (SELECT avg(v) AS m, count(*) AS n, sum((v-(SELECT avg(v) FROM cells))**2) AS s FROM cells) SELECT round(max(n)*sum((a.v-m)*(b.v-m))/(count(*)*max(s)), 6) AS i, round(-1.0/(max(n)-1), 6) AS expected FROM {ROOK}, m", "cells"))
def morani(spark: SparkSession, d: str) -> DataFrame:
    return statistics.moran(raster(spark, d))


@query("gearyc", sql(f"WITH m AS (SELECT count(*) AS n, sum((v-(SELECT avg(v) FROM cells))**2) AS s FROM cells) SELECT round((max(n)-1)*sum((a.v-b.v)**2)/(2*count(*)*max(s)), 6) AS c FROM {ROOK}, m", "cells"))
def gearyc(spark: SparkSession, d: str) -> DataFrame:
    return statistics.geary(raster(spark, d))


@query("getisord", sql("WITH m AS (SELECT avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM cells), w AS (SELECT a.r, a.c, sum(b.v) AS t, count(*) AS k FROM cells a JOIN cells b ON abs(a.r-b.r)+abs(a.c-b.c) <= 1 GROUP BY a.r, a.c) SELECT r, c, round((t-m*k)/(s*sqrt((n*k-k*k)/(n-1.0))), 6) AS z FROM w, m", "cells"))
def getisord(spark: SparkSession, d: str) -> DataFrame:
    return statistics.getis_ord(raster(spark, d))


@query("spatialweights", sql("WITH w AS (SELECT a.id AS i, b.id AS j FROM points a, points b WHERE a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 900) SELECT i, j, round(1.0/count(*) OVER (PARTITION BY i), 6) AS w FROM w", "points"))
def spatialweights(spark: SparkSession, d: str) -> DataFrame:
    return statistics.neighbour_weights(points(spark, d), 30.0).select("i", "j", F.round("w", 6).alias("w"))


@query("idw", sql("SELECT id, round(coalesce(arg_min(v, sid) FILTER (x = sx AND y = sy), sum(v/((x-sx)**2+(y-sy)**2)) FILTER (x <> sx OR y <> sy)/sum(1/((x-sx)**2+(y-sy)**2)) FILTER (x <> sx OR y <> sy)), 6) AS v FROM (SELECT *, CAST(sid%17 AS DOUBLE) AS v FROM points, sites) GROUP BY id", "points", "sites"))
def idw(spark: SparkSession, d: str) -> DataFrame:
    return statistics.inverse_distance(points(spark, d), sites(spark, d).withColumn("v", (F.col("sid") % 17).cast("double"))).select("id", F.round("v", 6).alias("v"))


@query("dbscan", sql("WITH RECURSIVE near AS (SELECT a.id AS a, b.id AS b FROM points a, points b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 900), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4), link AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), reach AS (SELECT a, a AS root FROM core UNION SELECT link.b, root FROM reach JOIN link ON reach.a = link.a), own AS (SELECT a, min(root) AS root FROM reach GROUP BY a), named AS (SELECT a, dense_rank() OVER (ORDER BY root) AS cluster FROM own) SELECT p.id, coalesce((SELECT cluster FROM named WHERE named.a = p.id), (SELECT min(cluster) FROM near JOIN named ON near.b = named.a WHERE near.a = p.id), -1) AS cluster FROM points p", "points").replace("WITH points", "WITH RECURSIVE points").replace(", RECURSIVE near", ", near"))
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return statistics.dbscan(points(spark, d), 30.0, 4)


LLOYD = "WITH c(n, k, x, y, m) AS (SELECT 0, CAST(row_number() OVER (ORDER BY sid)-1 AS INTEGER), sx, sy, CAST(0 AS BIGINT) FROM (SELECT * FROM sites ORDER BY sid LIMIT 5) UNION ALL SELECT c.n+1, c.k, coalesce(s.x, c.x), coalesce(s.y, c.y), coalesce(s.m, 0) FROM c LEFT JOIN (SELECT k, avg(px) AS x, avg(py) AS y, count(*) AS m FROM (SELECT any_value(p.x) AS px, any_value(p.y) AS py, arg_min(c.k, ((p.x-c.x)**2+(p.y-c.y)**2, c.k)) AS k FROM points p, c GROUP BY p.id) GROUP BY k) s ON s.k = c.k WHERE c.n < 20) SELECT k AS centre, round(x, 4) AS x, round(y, 4) AS y, m AS n FROM c WHERE n = 20"


@query("kmeans", recursive(LLOYD, "points", "sites"))
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    s = [(r.sid, r.sx, r.sy) for r in sites(spark, d).orderBy("sid").limit(5).collect()]
    return statistics.lloyd(points(spark, d), s, 20)


@query("meanshift", None)
def meanshift(spark: SparkSession, d: str) -> DataFrame:
    """Members of each mode."""
    return statistics.mean_shift(points(spark, d), 120.0).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.first("x"), 3).alias("x"), F.round(F.first("y"), 3).alias("y"))


@query("kriging", None)
def kriging(spark: SparkSession, d: str) -> DataFrame:
    return statistics.kriging(points(spark, d), sites(spark, d).withColumn("v", (F.col("sid") % 17).cast("double")), 8, 1.0, 200.0)


@query("huffmodel", sql("SELECT sid, round(sum(p), 6) AS share FROM (SELECT sid, ((sid%9+1)/greatest((x-sx)**2+(y-sy)**2, 1e-18))/sum((sid%9+1)/greatest((x-sx)**2+(y-sy)**2, 1e-18)) OVER (PARTITION BY id) AS p FROM points, sites) GROUP BY sid", "points", "sites"))
def huffmodel(spark: SparkSession, d: str) -> DataFrame:
    return statistics.huff(points(spark, d), sites(spark, d).withColumn("size", (F.col("sid") % 9 + 1).cast("double")))


@query("gravityfit", sql("WITH f AS (SELECT (a.sid%9+1)*(b.sid%9+1)*1000.0/sqrt((a.sx-b.sx)**2+(a.sy-b.sy)**2) AS flow, (a.sid%9+1) AS o, (b.sid%9+1) AS e, sqrt((a.sx-b.sx)**2+(a.sy-b.sy)**2) AS d FROM sites a, sites b WHERE a.sid <> b.sid) SELECT round(-regr_slope(ln(flow/(o*e)), ln(d)), 6) AS beta, count(*) AS pairs FROM f WHERE flow > 0.5", "sites"))
def gravityfit(spark: SparkSession, d: str) -> DataFrame:
    return statistics.gravity_beta(sites(spark, d).withColumn("size", (F.col("sid") % 9 + 1).cast("double")))
