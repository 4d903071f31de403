"""Queries of profiles, tours, labels, grid routes and the remaining scalars."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geodesy
from gridloom.operators import geometry as geo
from gridloom.operators import graphs, nearest, positioning, routes, tracks
from gridloom.plans.catalog import query
from gridloom.plans.joins import CROSS
from gridloom.plans.scalar import U1
from gridloom.plans.shapes import AWAY, grouped
from gridloom.sources.fixtures import places, raster, recursive, rings, segments, sites, sql


@query("routeprofile", sql("SELECT r, round(sum(greatest(s, 0)), 4) AS ascent, round(sum(greatest(-s, 0)), 4) AS descent, round(max(abs(s)), 4) AS steepest FROM (SELECT r, v-lag(v) OVER (PARTITION BY r ORDER BY c) AS s FROM cells) WHERE s IS NOT NULL GROUP BY r", "cells"))
def routeprofile(spark: SparkSession, d: str) -> DataFrame:
    return routes.profiles(raster(spark, d)).select("r", *[F.round(c, 4).alias(c) for c in ("ascent", "descent", "steepest")])


SLAB = "CASE WHEN {d} = 0 THEN {z} ELSE {f}(({c}*50-{p})/{d}, (({c}+1)*50-{p})/{d}) END"


def slabs(f: str, z: str) -> str:
    return ", ".join(SLAB.format(d=f"({v}2-{v}1)", z=z, f=f, c=c, p=f"{v}1") for v, c in (("x", "cx"), ("y", "cy")))


@query("gridtraversal", sql(f"SELECT id, cx, cy FROM segments, range(-2, 24) a(cx), range(-2, 24) b(cy) WHERE cx BETWEEN floor(least(x1, x2)/50) AND floor(greatest(x1, x2)/50) AND cy BETWEEN floor(least(y1, y2)/50) AND floor(greatest(y1, y2)/50) AND least(1.0, {slabs('greatest', '1.0')}) - greatest(0.0, {slabs('least', '0.0')}) > 1e-9", "segments"))
def gridtraversal(spark: SparkSession, d: str) -> DataFrame:
    return routes.crossed_cells(segments(spark, d), 50.0)


#: Two hundred steps of the longitude's iteration, WGS84 (fixed values), and the series for the length.
W_F, W_B = "(1/298.257223563)", "6356752.314245179"
GEODESIC = f"WITH p AS MATERIALIZED (SELECT id, atan((1-{W_F})*tan(radians(lat1))) AS u, atan((1-{W_F})*tan(radians(lat2))) AS w, radians(lon2-lon1) AS d FROM places), i(id, n, lam, moved) AS (SELECT id, 0, d, 1.0::DOUBLE FROM p UNION ALL SELECT id, n+1, new, abs(new-lam) FROM (SELECT id, n, lam, d+(1-k)*{W_F}*a*(sigma+k*s*(m+k*c*(-1+2*m*m))) AS new FROM (SELECT *, CASE WHEN 1-a*a > 0 THEN c-2*sin(u)*sin(w)/(1-a*a) ELSE 0 END AS m, {W_F}/16*(1-a*a)*(4+{W_F}*(4-3*(1-a*a))) AS k FROM (SELECT *, atan2(s, c) AS sigma, CASE WHEN s > 0 THEN cos(u)*cos(w)*sin(lam)/s ELSE 0 END AS a FROM (SELECT i.id, n, lam, u, w, d, sqrt((cos(w)*sin(lam))**2+(cos(u)*sin(w)-sin(u)*cos(w)*cos(lam))**2) AS s, sin(u)*sin(w)+cos(u)*cos(w)*cos(lam) AS c FROM i JOIN p ON p.id = i.id WHERE n < 200)))))"
METRES = f", l AS (SELECT id, arg_max(lam, n) AS new, arg_max(lam, n) FILTER (WHERE n < 200) AS lam, arg_max(moved, n) AS moved FROM i GROUP BY id), s AS (SELECT l.id, moved, u, w, sqrt((cos(w)*sin(lam))**2+(cos(u)*sin(w)-sin(u)*cos(w)*cos(lam))**2) AS s, sin(u)*sin(w)+cos(u)*cos(w)*cos(lam) AS c, lam FROM l JOIN p USING (id)), a AS (SELECT *, 1-CASE WHEN s > 0 THEN (cos(u)*cos(w)*sin(lam)/s)**2 ELSE 0 END AS q FROM s), m AS (SELECT *, CASE WHEN q > 0 THEN c-2*sin(u)*sin(w)/q ELSE 0 END AS m, q*(6378137.0**2-{W_B}**2)/{W_B}**2 AS e FROM a), r AS (SELECT *, 1+e/16384*(4096+e*(-768+e*(320-175*e))) AS big, e/1024*(256+e*(-128+e*(74-47*e))) AS small FROM m) SELECT id, CASE WHEN moved < 1e-9 THEN round({W_B}*big*(atan2(s, c)-small*s*(m+small/4*(c*(-1+2*m*m)-small/6*m*(-3+4*s*s)*(-3+4*m*m)))), 2) END AS metres FROM r"


@query("vincenty", recursive(GEODESIC + METRES, "places"))
def vincenty(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("id", F.round(routes.vincenty("lat1", "lon1", "lat2", "lon2"), 2).alias("metres"))


FACES = ", ".join(f"({i}, {a!r}, {b!r}, {c!r})" for i, (a, b, c) in enumerate(routes.faces()))


@query("geodesicgrid", sql(f"SELECT id, CAST(arg_max(k, ({U1[0]})*a+({U1[1]})*b+({U1[2]})*c) AS BIGINT) AS face FROM places, (VALUES {FACES}) f(k, a, b, c) GROUP BY id", "places"))
def geodesicgrid(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("id", routes.face_of(geodesy.unit_vector(F.col("lat1"), F.col("lon1"))).alias("face"))


@query("azimuthaccuracy", sql("SELECT id, sid, round(sqrt((x-sx)**2+(y-sy)**2)*radians(0.5), 6) AS error FROM points, sites WHERE (x-sx)*(x-sx)+(y-sy)*(y-sy) <= 10000", "points", "sites"))
def azimuthaccuracy(spark: SparkSession, d: str) -> DataFrame:
    """Sideways error of a bearing that is half a degree off, for sites in reach."""
    from gridloom.operators.joins import half_up, reached
    from gridloom.sources.fixtures import points

    half = math.radians(0.5)
    return reached(points(spark, d), sites(spark, d), 100.0, values={"error": lambda d2: half_up(np.sqrt(d2) * half, 6)})

    return join_within(points(spark, d), sites(spark, d), 100.0).select("id", "sid", F.round(F.sqrt("d2") * F.radians(F.lit(0.5)), 6).alias("error"))


#: Bearings from every point to the sites within 150, up to a fifth of a degree off.
SEEN = "WITH o AS (SELECT id, x, y, sx AS lx, sy AS ly, degrees(atan2(sx-x, sy-y)) + ((id*31+sid*17)%21-10)*0.02 AS b0 FROM points, sites WHERE (x-sx)*(x-sx)+(y-sy)*(y-sy) <= 22500), s AS (SELECT *, b0-360*floor(b0/360) AS b FROM o)"
NORMAL = SEEN + ", k AS (SELECT *, cos(radians(b)) AS cb, -sin(radians(b)) AS sb, cos(radians(b))*lx-sin(radians(b))*ly AS q FROM s), n AS (SELECT id, count(*) AS n, sum(cb*cb) AS a, sum(cb*sb) AS b, sum(sb*sb) AS d, sum(cb*q) AS e, sum(sb*q) AS f FROM k GROUP BY id), p AS (SELECT id, n, (e*d-b*f)/(a*d-b*b) AS px, (a*f-e*b)/(a*d-b*b) AS py FROM n WHERE n > 1 AND a*d-b*b > 0.01), r AS (SELECT p.id, degrees(atan2(lx-px, ly-py))-b+180 AS g FROM p JOIN s USING (id)) SELECT id, n, round(any_value(px), 3)+0.0 AS px, round(any_value(py), 3)+0.0 AS py, round(sqrt(avg((g-360*floor(g/360)-180)**2)), 5) AS residual FROM p JOIN r USING (id) GROUP BY id, n"


def sighting_error(i, s):
    """Degrees that the bearing from point ``i`` to site ``s`` is off."""
    return ((i * 31 + s * 17) % 21 - 10) * 0.02


@query("resection", sql(NORMAL, "points", "sites"))
def resection(spark: SparkSession, d: str) -> DataFrame:
    """Places from bearings to all landmarks in reach by least squares; left out where the bearings are nearly parallel."""
    from gridloom.sources.fixtures import points

    fixes = positioning.bearing_fixes_within(points(spark, d), sites(spark, d), 150.0, sighting_error, 0.01)
    return fixes.select("id", "n", (F.round("x", 3) + 0.0).alias("px"), (F.round("y", 3) + 0.0).alias("py"), F.round("residual", 5).alias("residual"))


PAIRED = SEEN.replace("SELECT id, x, y,", "SELECT id, sid, x, y,") + ", k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sid) AS i FROM s), p AS (SELECT a.id, a.x, a.y, a.lx AS ax, a.ly AS ay, c.lx AS bx, c.ly AS bb, sin(radians(a.b+180)) AS ux, cos(radians(a.b+180)) AS uy, sin(radians(c.b+180)) AS vx, cos(radians(c.b+180)) AS vy FROM k a JOIN k c ON a.id = c.id AND a.i = 1 AND c.i = 2), d AS (SELECT *, uy*vx-ux*vy AS det FROM p), t AS (SELECT *, ((bb-ay)*vx-(bx-ax)*vy)/det AS t FROM d WHERE abs(det) > 0.05) SELECT id, round(ax+t*ux, 3)+0.0 AS px, round(ay+t*uy, 3)+0.0 AS py, round(sqrt((ax+t*ux-x)**2+(ay+t*uy-y)**2), 4) AS miss, round(sqrt(2.0)*sqrt((x-ax)**2+(y-ay)**2)*radians(0.1)/abs(det), 4) AS law FROM t"


@query("azimuthaccuracy_fix", sql(PAIRED, "points", "sites"))
def azimuthaccuracy_fix(spark: SparkSession, d: str) -> DataFrame:
    """Each point from the bearings that its first two stations in reach take of it: the fix, its miss, and the miss that a tenth of a degree would give."""
    from gridloom.operators.joins import first_within
    from gridloom.sources.fixtures import points

    p, near = points(spark, d), sites(spark, d)
    first = first_within(p, near, 150.0, 2).join(p, "id").join(near.select("sid", F.col("sx").alias("lx"), F.col("sy").alias("ly")), "sid")
    true = positioning.bearing_of(F.col("x"), F.col("y"), F.col("lx"), F.col("ly"))
    first = first.withColumn("bearing", F.pmod(true + sighting_error(F.col("id"), F.col("sid")), F.lit(360.0)))
    side = lambda i, p: first.filter(F.col("i") == i).select("id", "x", "y", F.col("lx").alias(f"{p}x"), F.col("ly").alias(f"{p}y"), (F.col("bearing") + 180).alias(f"{p}_bearing"))
    pairs = side(1, "a").join(side(2, "b").drop("x", "y"), "id")
    sine = F.abs(F.sin(F.radians(F.col("a_bearing") - F.col("b_bearing"))))
    px, py = positioning.crossing_of(*[F.col(c) for c in ("ax", "ay", "a_bearing", "bx", "by", "b_bearing")])
    fixes = pairs.filter(sine > 0.05).withColumns({"px": px, "py": py, "law": positioning.fix_miss(F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")), F.lit(0.1), F.degrees(F.asin(sine)))})
    return fixes.select("id", (F.round("px", 3) + 0.0).alias("px"), (F.round("py", 3) + 0.0).alias("py"), F.round(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")), 4).alias("miss"), F.round("law", 4).alias("law"))


@query("simplifyarea", None)
def simplifyarea(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    def run(ring):
        keep = tracks.kept_mask(np.array([*ring, ring[0]]), 4.0, tracks.chord_gap)[:-1]
        left = [p for p, k in zip(ring, keep, strict=True) if k]
        return len(left), abs(geo.ring_area(left)) / abs(geo.ring_area(ring))

    f = geo.on_rings(run, "points long, share double")
    return rings(spark, d).select("id", f("ring").alias("s")).select("id", "s.points", F.round("s.share", 6).alias("share"))


@query("labelplacement", None)
def labelplacement(spark: SparkSession, d: str) -> DataFrame:
    return routes.labels(grouped(spark, d), "region", 18.0, 6.0)


@query("tour", None)
def tour(spark: SparkSession, d: str) -> DataFrame:
    return routes.tours(grouped(spark, d), "region").select("region", F.round("nearest", 4).alias("nearest"), F.round("improved", 4).alias("improved"))


@query("kmedoids", None)
def kmedoids(spark: SparkSession, d: str) -> DataFrame:
    return routes.medoids(grouped(spark, d), "region", 3)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Grids of 16 columns."""
    return raster(spark, d).withColumn("grid", F.floor(F.col("c") / 16))


@query("turncost", None)
def turncost(spark: SparkSession, d: str) -> DataFrame:
    return routes.turn_costs(blocks(spark, d), "grid", 100.0).select("grid", F.round("cost", 4).alias("cost"))


@query("fastmarching", None)
def fastmarching(spark: SparkSession, d: str) -> DataFrame:
    return routes.marching(blocks(spark, d), "grid").select("r", "c", F.round("t", 4).alias("t"))


def sight_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sites that see one another past all walls."""
    s = sites(spark, d).select("sid", F.col("sx").alias("x"), F.col("sy").alias("y"))
    pairs = graphs.settle(nearest.sight_pairs(s, segments(spark, d)).withColumn("id", F.shiftleft("src", 31) + F.col("dst")))
    seen = pairs.join(nearest.unblocked(pairs.select("id", "x1", "y1", "x2", "y2"), segments(spark, d), 50.0), "id", "left_semi")
    return seen.select("src", "dst", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("w"))


SIGHT = f"SELECT a.src, a.dst, sqrt((a.x1-a.x2)**2+(a.y1-a.y2)**2) AS w FROM (SELECT p.sid AS src, q.sid AS dst, p.sx AS x1, p.sy AS y1, q.sx AS x2, q.sy AS y2 FROM sites p JOIN sites q ON p.sid < q.sid) a WHERE NOT EXISTS (SELECT 1 FROM segments b WHERE {CROSS})"


@query("visibilitygraph_edges", sql(f"SELECT src, dst, round(w, 6) AS w FROM ({SIGHT}) q", "sites", "segments"))
def visibilitygraph_edges(spark: SparkSession, d: str) -> DataFrame:
    return sight_lines(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


SEEN_FROM = f"WITH e AS ({SIGHT}), g AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)" + AWAY


@query("visibilitygraph", recursive(SEEN_FROM + " SELECT node, round(dist, 5) AS dist FROM f", "sites", "segments"))
def visibilitygraph(spark: SparkSession, d: str) -> DataFrame:
    """Ways from the first site over all pairs that see one another."""
    g = graphs.settle(graphs.both_ways(sight_lines(spark, d)), 0)
    return graphs.shortest(g, spark.createDataFrame([(0,)], "source long")).select("node", F.round("dist", 5).alias("dist"))
