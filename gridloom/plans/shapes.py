"""Queries of S1, S5, S7, S9, S11 and S12: codecs, tracks, state, networks and constructed geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codes, geodesy
from gridloom.operators import geometry as geo
from gridloom.operators import graphs, joins, matching, positioning, tiles, tracks, triangulation
from gridloom.plans.catalog import query
from gridloom.plans.scalar import S_GX, S_GY, s_geohash
from gridloom.sources import text
from gridloom.sources.fixtures import boxes, fixes, places, points, recursive, rings, sites, sql
from gridloom.streaming import stateful

TW = "WINDOW w AS (PARTITION BY track ORDER BY seq)"
LAG = f"WITH g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM fixes {TW})"


@query("speedprofile", sql(LAG + " SELECT track, count(*) AS n, round(avg(sqrt((x-px)**2+(y-py)**2)/(t-pt)), 6) AS mean, round(max(sqrt((x-px)**2+(y-py)**2)/(t-pt)), 4) AS top FROM g WHERE pt IS NOT NULL GROUP BY track", "fixes"))
def speedprofile(spark: SparkSession, d: str) -> DataFrame:
    return tracks.speeds(fixes(spark, d)).filter("speed is not null").groupBy("track").agg(F.count("*").alias("n"), F.round(F.avg("speed"), 6).alias("mean"), F.round(F.max("speed"), 4).alias("top"))


RECKONED = LAG + ", l AS (SELECT track, seq, x-px AS dx, y-py AS dy FROM g WHERE pt IS NOT NULL), t AS (SELECT track, count(*) AS legs, sum(sqrt(dx*dx+dy*dy)) AS run, sum(dx) AS ex, sum(dy) AS ey, sum(dx*cos(radians(5))+dy*sin(radians(5))) AS bx, sum(dy*cos(radians(5))-dx*sin(radians(5))) AS b_y FROM l GROUP BY track) SELECT track, legs, round(run, 4) AS run, round(sqrt((bx-ex)**2+(b_y-ey)**2), 4) AS miss, round(((bx-ex)*ex+(b_y-ey)*ey)/sqrt(ex*ex+ey*ey), 4)+0.0 AS along, round((-(bx-ex)*ey+(b_y-ey)*ex)/sqrt(ex*ex+ey*ey), 4)+0.0 AS across FROM t WHERE ex*ex+ey*ey > 0"


@query("deadreckoning", sql(RECKONED, "fixes"))
def deadreckoning(spark: SparkSession, d: str) -> DataFrame:
    """Where each track would end if its compass were five degrees off: the miss, along and across the way made good."""
    r = tracks.reckoned(fixes(spark, d), 5.0)
    return r.select("track", "legs", F.round("run", 4).alias("run"), F.round("miss", 4).alias("miss"), (F.round("along", 4) + 0.0).alias("along"), (F.round("across", 4) + 0.0).alias("across"))


@query("gpsjitter", sql("SELECT track, seq, round(avg(x) OVER w, 5) AS sx, round(avg(y) OVER w, 5) AS sy FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "fixes"))
def gpsjitter(spark: SparkSession, d: str) -> DataFrame:
    return tracks.smoothed(fixes(spark, d), 2).select("track", "seq", F.round("sx", 5).alias("sx"), F.round("sy", 5).alias("sy"))


@query("linearref", sql(LAG + ", m AS (SELECT track, seq, sum(coalesce(sqrt((x-px)**2+(y-py)**2), 0)) OVER (PARTITION BY track ORDER BY seq) AS m FROM g) SELECT track, seq, round(m, 4) AS m FROM m", "fixes"))
def linearref(spark: SparkSession, d: str) -> DataFrame:
    return tracks.measures(fixes(spark, d)).select("track", "seq", F.round("m", 4).alias("m"))


@query("linearref_locate", sql(LAG + ", m AS (SELECT *, sum(coalesce(sqrt((x-px)**2+(y-py)**2), 0)) OVER (PARTITION BY track ORDER BY seq) AS m FROM g), l AS (SELECT track, x AS x1, y AS y1, m AS m1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(m) OVER w AS m2 FROM m " + TW + ") SELECT track, round(x1+(100-m1)/(m2-m1)*(x2-x1), 4) AS x, round(y1+(100-m1)/(m2-m1)*(y2-y1), 4) AS y FROM l WHERE m1 <= 100 AND 100 < m2", "fixes"))
def linearref_locate(spark: SparkSession, d: str) -> DataFrame:
    f = fixes(spark, d)
    marks = f.select("track").distinct().select("track", F.lit(1).alias("id"), F.lit(100.0).alias("m"))
    return tracks.located(marks, tracks.legs(f)).select("track", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("snaptopath", sql(LAG + ", l AS (SELECT track, px, py, x-px AS dx, y-py AS dy FROM g WHERE px IS NOT NULL), q AS (SELECT track, avg(x) AS x, avg(y) AS y FROM fixes GROUP BY track), s AS (SELECT l.*, x, y, CASE WHEN dx*dx+dy*dy > 0 THEN greatest(0.0, least(1.0, ((x-px)*dx+(y-py)*dy)/(dx*dx+dy*dy))) ELSE 0.0 END AS s FROM l JOIN q USING (track)) SELECT track, round(min(sqrt((x-px-s*dx)**2+(y-py-s*dy)**2)), 4) AS d FROM s GROUP BY track", "fixes"))
def snaptopath(spark: SparkSession, d: str) -> DataFrame:
    f = fixes(spark, d)
    q = f.groupBy("track").agg(F.lit(1).alias("id"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return tracks.snapped(q, tracks.legs(f)).select("track", F.round("d", 4).alias("d"))


@query("roadcurvature", sql("WITH g AS (SELECT track, seq, x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS bysy FROM fixes " + TW + "), k AS (SELECT *, sqrt((x-ax)**2+(y-ay)**2)*sqrt((bx-x)**2+(bysy-y)**2)*sqrt((bx-ax)**2+(bysy-ay)**2) AS p FROM g) SELECT track, seq, round(2*abs((x-ax)*(bysy-ay)-(bx-ax)*(y-ay))/p, 6) AS curvature FROM k WHERE p > 0", "fixes"))
def roadcurvature(spark: SparkSession, d: str) -> DataFrame:
    return tracks.curvatures(fixes(spark, d)).select("track", "seq", F.round("curvature", 6).alias("curvature"))


@query("chaikin", sql("WITH g AS (SELECT track, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fixes " + TW + ") SELECT track, 2*seq+k AS seq, round(x*(0.75-k*0.5)+x2*(0.25+k*0.5), 5) AS x, round(y*(0.75-k*0.5)+y2*(0.25+k*0.5), 5) AS y FROM g, range(2) q(k) WHERE x2 IS NOT NULL", "fixes"))
def chaikin(spark: SparkSession, d: str) -> DataFrame:
    return tracks.cut_corners(fixes(spark, d)).select("track", "seq", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("fractaldimension", sql("SELECT side, count(DISTINCT (floor(x/side), floor(y/side))) AS boxes FROM points, (SELECT unnest([10.0, 20.0, 40.0, 80.0]) AS side) GROUP BY side", "points"))
def fractaldimension(spark: SparkSession, d: str) -> DataFrame:
    return tracks.box_counts(points(spark, d), [10.0, 20.0, 40.0, 80.0])


@query("fractaldimension_fit", sql("WITH b AS (SELECT side, count(DISTINCT (floor(x/side), floor(y/side))) AS boxes FROM points, (SELECT unnest([10.0, 20.0, 40.0, 80.0]) AS side) GROUP BY side) SELECT round(-regr_slope(ln(boxes), ln(side)), 6) AS dimension FROM b", "points"))
def fractaldimension_fit(spark: SparkSession, d: str) -> DataFrame:
    """The dimension: how fast boxes grow as their side shrinks."""
    return tracks.box_counts(points(spark, d), [10.0, 20.0, 40.0, 80.0]).agg(F.round(-F.regr_slope(F.log("boxes"), F.log("side")), 6).alias("dimension"))


@query("coastline", None)
def coastline(spark: SparkSession, d: str) -> DataFrame:
    return tracks.divider_walk(fixes(spark, d), 50.0)


@query("stopdetect", None)
def stopdetect(spark: SparkSession, d: str) -> DataFrame:
    return tracks.stops(fixes(spark, d), 60.0, 7200.0)


@query("trackcompress", None)
def trackcompress(spark: SparkSession, d: str) -> DataFrame:
    return tracks.compressed(fixes(spark, d), 40.0, timed=True).select("track", "seq")


@query("douglaspeucker", None)
def douglaspeucker(spark: SparkSession, d: str) -> DataFrame:
    return tracks.compressed(fixes(spark, d), 40.0).select("track", "seq")


@query("visvalingam", None)
def visvalingam(spark: SparkSession, d: str) -> DataFrame:
    return tracks.thinned_by_area(fixes(spark, d), 10).select("track", "seq")


@query("visvalingam_area", None)
def visvalingam_area(spark: SparkSession, d: str) -> DataFrame:
    return tracks.thinned_by_area(fixes(spark, d), least=500.0).select("track", "seq")


FILTERED = "WITH k AS (SELECT track, seq, t, x, 0.0::DOUBLE AS vx, y, 0.0::DOUBLE AS vy, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 100.0::DOUBLE AS c FROM fixes WHERE seq = 1 UNION ALL SELECT track, seq, t, px+a/(a+100)*(zx-px), vx+b/(a+100)*(zx-px), py+a/(a+100)*(zy-py), vy+b/(a+100)*(zy-py), a-a/(a+100)*a, b-a/(a+100)*b, c-b/(a+100)*b FROM (SELECT f.track, f.seq, f.t, f.x AS zx, f.y AS zy, k.x+h*vx AS px, vx, k.y+h*vy AS py, vy, a+2*h*b+h*h*c+h**3/3 AS a, b+h*c+h*h/2 AS b, c+h AS c FROM (SELECT k.*, (f.t-k.t)/3600 AS h FROM k JOIN fixes f ON f.track=k.track AND f.seq=k.seq+1) k JOIN fixes f ON f.track=k.track AND f.seq=k.seq+1) p) SELECT track, seq, round(x, 4) AS x, round(y, 4) AS y FROM k"


@query("kalman", recursive(FILTERED, "fixes").replace("fixes AS (", "fixes AS MATERIALIZED (", 1))
def kalman(spark: SparkSession, d: str) -> DataFrame:
    return tracks.kalman(fixes(spark, d), 1.0, 100.0).select("track", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("frechet", None)
def frechet(spark: SparkSession, d: str) -> DataFrame:
    return tracks.couplings(fixes(spark, d), "frechet").select("a", "b", F.round("distance", 4).alias("distance"))


@query("timewarp", None)
def timewarp(spark: SparkSession, d: str) -> DataFrame:
    return tracks.couplings(fixes(spark, d), "warp").select("a", "b", F.round("distance", 4).alias("distance"))


#: Roads inferred from the fixes, and the shares along and distances of those in reach of each fix.
ROADS = "WITH n AS (SELECT floor(x/100) AS cx, floor(y/100) AS cy, avg(x) AS x, avg(y) AS y FROM fixes GROUP BY 1, 2), roads AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM n a JOIN n b ON b.cx = a.cx+1 AND b.cy = a.cy OR b.cx = a.cx AND b.cy = a.cy+1)"
REACHED = ROADS + ", c AS (SELECT track, seq, x, y, x1, y1, x2-x1 AS dx, y2-y1 AS dy, greatest(0.0, least(1.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)**2+(y2-y1)**2))) AS s FROM fixes, roads), r AS (SELECT track, seq, sqrt((x-x1-s*dx)**2+(y-y1-s*dy)**2) AS d FROM c) SELECT track, seq, count(*) AS roads, round(min(d), 4) AS nearest, round(sum(d), 3) AS total FROM r WHERE d <= 40 GROUP BY track, seq"


@query("mapmatch_candidates", sql(REACHED, "fixes"))
def mapmatch_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Roads within 40 of each fix."""
    f = fixes(spark, d)
    near = matching.candidates(f, matching.network_of(f, 100.0), 40.0)
    return near.groupBy("track", "seq").agg(F.count("*").alias("roads"), F.round(F.min("d"), 4).alias("nearest"), F.round(F.sum("d"), 3).alias("total"))


@query("mapmatch", None)
def mapmatch(spark: SparkSession, d: str) -> DataFrame:
    """The roads of each track's best sequence on the network of all fixes."""
    f = fixes(spark, d)
    m = matching.matched(f, matching.network_of(f, 100.0), 15.0, 20.0, 40.0, 400.0, 6.0)
    return m.select("track", "seq", "road", F.round("d", 4).alias("d"), F.round("along", 4).alias("along"))


@query("densify", sql("WITH p AS (SELECT *, 2*6371.0088*asin(sqrt(least(1.0, sin(radians(lat2-lat1)/2)**2+cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2-lon1)/2)**2))) AS km FROM places) SELECT id, CAST(greatest(1, ceil(km/1500)) AS BIGINT) AS hops FROM p", "places"))
def densify(spark: SparkSession, d: str) -> DataFrame:
    km = geodesy.haversine(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")))
    return places(spark, d).select("id", F.greatest(F.lit(1), F.ceil(km / 1500)).cast("long").alias("hops"))


S_KM = "2*6371.0088*asin(sqrt(least(1.0, sin(radians(lat2-lat1)/2)**2+cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2-lon1)/2)**2)))"
S_ARC = "acos(greatest(-1.0, least(1.0, sin(radians(lat1))*sin(radians(lat2))+cos(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1)))))"


@query("densify_points", sql(f"WITH p AS (SELECT *, CAST(greatest(1, ceil({S_KM}/1500)) AS BIGINT) AS n, {S_ARC} AS g FROM places WHERE lat1 <> lat2 OR lon1 <> lon2), q AS (SELECT *, unnest(range(n+1)) AS k FROM p), w AS (SELECT *, sin((1-k/n)*g)/sin(g) AS a, sin(k/n*g)/sin(g) AS b FROM q), v AS (SELECT id, k, a*cos(radians(lat1))*cos(radians(lon1))+b*cos(radians(lat2))*cos(radians(lon2)) AS x, a*cos(radians(lat1))*sin(radians(lon1))+b*cos(radians(lat2))*sin(radians(lon2)) AS y, a*sin(radians(lat1))+b*sin(radians(lat2)) AS z FROM w) SELECT id, k, round(degrees(atan2(z, sqrt(x*x+y*y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM v", "places"))
def densify_points(spark: SparkSession, d: str) -> DataFrame:
    """Points no more than 1500 km apart along each great circle."""
    p = places(spark, d)
    a = tuple(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))
    p = p.withColumn("n", F.greatest(F.lit(1), F.ceil(geodesy.haversine(*a) / 1500)).cast("long")).filter("lat1 != lat2 or lon1 != lon2")
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    lat, lon = geodesy.intermediate(*a, F.col("k") / F.col("n"))
    return p.select("id", "k", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


# S1


@query("wkt", sql("SELECT id, concat('POINT (', printf('%.3f', x), ' ', printf('%.3f', y), ')') AS wkt FROM points", "points"))
def wkt(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", text.wkt_point(F.col("x"), F.col("y"), 3).alias("wkt"))


@query("wkt_round_trip", sql("SELECT sid AS id, 9 AS points, CAST(TRUE AS BOOLEAN) AS same FROM sites", "sites"))
def wkt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    r = rings(spark, d).withColumn("back", text.wkt_points(text.wkt_polygon(F.col("ring"))))
    return r.select("id", F.size("back").alias("points"), (F.slice("back", 1, 8) == F.col("ring")).alias("same"))


@query("geojsonio", sql("SELECT id, round(lat1, 9) AS lat, round(lon1, 9) AS lon FROM places", "places"))
def geojsonio(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).withColumn("p", text.geojson_coordinates(text.geojson_point(F.col("lat1"), F.col("lon1"))))
    return p.select("id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query("geojson_polygons", sql("SELECT id, CAST(8 AS INTEGER) AS points, round(abs(sum(x1*y2-x2*y1))/2, 4) AS area, round(sum(sqrt((x2-x1)**2+(y2-y1)**2)), 5) AS perimeter, concat('f', id) AS name FROM edges GROUP BY id", "edges"))
def geojson_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Rings, every other one clockwise, written as features and read back: outer rings come back counter-clockwise."""
    r = rings(spark, d).withColumn("ring", F.when(F.col("id") % 2 == 1, F.reverse("ring")).otherwise(F.col("ring")))
    f = r.select("id", text.geojson_feature(text.geojson_polygon(F.col("ring"), joins.shoelace(F.col("ring")) < 0), F.struct(F.concat(F.lit("f"), "id").alias("name"))).alias("feature"))
    back = f.select("id", text.geojson_points(text.geojson_geometry(F.col("feature"))).alias("ring"), F.get_json_object("feature", "$.properties.name").alias("name"))
    return back.select("id", F.size("ring").alias("points"), F.round(joins.shoelace(F.col("ring")), 4).alias("area"), F.round(joins.perimeter(F.col("ring")), 5).alias("perimeter"), "name")


@query("geojson_holes", sql("SELECT id, CAST(2 AS INTEGER) AS rings, round(abs(sum(x1*y2-x2*y1))/2, 4) AS outer_area, round(-abs(sum(x1*y2-x2*y1))/8, 4) AS hole_area FROM edges GROUP BY id", "edges"))
def geojson_holes(spark: SparkSession, d: str) -> DataFrame:
    """Rings with a hole of half their size, written and read back: the outer ring counter-clockwise, the hole clockwise."""
    r = rings(spark, d).join(sites(spark, d).select(F.col("sid").alias("id"), "sx", "sy"), "id")
    half = F.transform("ring", lambda p: F.struct(((p["x"] + F.col("sx")) / 2).alias("x"), ((p["y"] + F.col("sy")) / 2).alias("y")))
    back = r.select("id", text.geojson_parsed_rings(text.geojson_rings(F.array(F.col("ring"), half), joins.shoelace)).alias("back"))
    return back.select("id", F.size("back").alias("rings"), F.round(joins.shoelace(F.col("back")[0]), 4).alias("outer_area"), F.round(joins.shoelace(F.col("back")[1]), 4).alias("hole_area"))


@query("geojson_lines", sql("SELECT track, count(*) AS points, round(sum(x), 4) AS sum_x, round(sum(y*seq), 3) AS sum_yk FROM fixes GROUP BY track HAVING count(*) > 1", "fixes"))
def geojson_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tracks written as lines and read back, point by point in order."""
    f = fixes(spark, d).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("line"))
    back = f.select("track", F.posexplode(text.geojson_points(text.geojson_line(F.col("line")))).alias("k", "p"))
    return back.groupBy("track").agg(F.count("*").alias("points"), F.round(F.sum("p.x"), 4).alias("sum_x"), F.round(F.sum(F.col("p.y") * (F.col("k") + 1)), 3).alias("sum_yk"))


@query("geohashcompress", sql(f"WITH h AS (SELECT id, {s_geohash(S_GX, S_GY)} AS hash FROM places), o AS (SELECT id, hash, lag(hash) OVER (PARTITION BY substr(hash, 1, 1) ORDER BY hash, id) AS prev FROM h) SELECT id, (SELECT count(*) FROM range(1, 7) q(k) WHERE substr(hash, 1, k) = substr(prev, 1, k)) AS shared FROM o", "places"))
def geohashcompress(spark: SparkSession, d: str) -> DataFrame:
    """Front coding: the prefix shared with the code before; blocks begin anew with the first letter, so they are coded apart."""
    return blocked_hashes(spark, d).select("id", "shared")


def blocked_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = places(spark, d).select("id", codes.geohash(F.col("lat1"), F.col("lon1"), 6).alias("hash")).withColumn("block", F.substring("hash", 1, 1))
    return codes.front_coded(h, "hash", "block", 6)


FRONT = f"WITH h AS (SELECT id, {s_geohash(S_GX, S_GY)} AS hash FROM places), o AS (SELECT hash, lag(hash) OVER (PARTITION BY substr(hash, 1, 1) ORDER BY hash, id) AS prev FROM h), s AS (SELECT hash, (SELECT count(*) FROM range(1, 7) q(k) WHERE substr(hash, 1, k) = substr(prev, 1, k)) AS shared FROM o) SELECT substr(hash, 1, 1) AS block, count(*) AS codes, CAST(sum(length(hash)+1) AS BIGINT) AS raw_bytes, CAST(sum(2+length(hash)-shared) AS BIGINT) AS coded_bytes, count(*) AS restored FROM s GROUP BY 1"


@query("geohashcompress_front", sql(FRONT, "places"))
def geohashcompress_front(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each block before and after, and how many codes come back from shared lengths and suffixes alone."""
    coded = blocked_hashes(spark, d)
    back = codes.front_decoded(coded, "block", ["hash", "id"], 6)
    return back.groupBy("block").agg(
        F.count("*").alias("codes"), F.sum(F.length("hash") + 1).alias("raw_bytes"), F.sum(2 + F.length("suffix")).alias("coded_bytes"), F.count_if(F.col("code") == F.col("hash")).alias("restored")
    )


@query("bboxquantize", sql("SELECT id, CAST(floor(min_x/1100*256) AS BIGINT) AS qx0, CAST(floor(min_y/1100*256) AS BIGINT) AS qy0, CAST(ceil(max_x/1100*256) AS BIGINT) AS qx1, CAST(ceil(max_y/1100*256) AS BIGINT) AS qy1 FROM boxes", "boxes"))
def bboxquantize(spark: SparkSession, d: str) -> DataFrame:
    q = lambda f, c: f(F.col(c) / 1100 * 256).cast("long")
    return boxes(spark, d).select("id", q(F.floor, "min_x").alias("qx0"), q(F.floor, "min_y").alias("qy0"), q(F.ceil, "max_x").alias("qx1"), q(F.ceil, "max_y").alias("qy1"))


@query("coordprecision", sql("SELECT id, round(abs(CAST(x AS FLOAT)::DOUBLE-x), 9) AS shift, round_even(x, 1) AS x1 FROM points", "points"))
def coordprecision(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", F.round(F.abs(F.col("x").cast("float").cast("double") - F.col("x")), 9).alias("shift"), F.bround("x", 1).alias("x1"))


#: Legs of all tracks and the tiles of side 512 and 128 that they meet, each with the part of the leg inside.
T_SLAB = "CASE WHEN {d} = 0 THEN {z} ELSE {f}(({c}*side-{p})/{d}, (({c}+1)*side-{p})/{d}) END"
T_ENTER, T_LEAVE = (", ".join(T_SLAB.format(d=f"({v}2-{v}1)", z=z, f=f, c=c, p=f"{v}1") for v, c in (("x", "tx"), ("y", "ty"))) for f, z in (("least", "0.0"), ("greatest", "1.0")))
TILED = f"WITH l AS (SELECT track, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)), b AS (SELECT l.*, zoom, 4096.0/2**zoom AS side FROM l, (VALUES (3), (5)) z(zoom) WHERE x2 IS NOT NULL), t AS (SELECT b.*, floor(least(x1, x2)/side)+i AS tx, floor(least(y1, y2)/side)+j AS ty FROM b, range(8) p(i), range(8) q(j) WHERE floor(least(x1, x2)/side)+i <= floor(greatest(x1, x2)/side) AND floor(least(y1, y2)/side)+j <= floor(greatest(y1, y2)/side)), c AS (SELECT *, greatest(0.0, {T_ENTER}) AS t1, least(1.0, {T_LEAVE}) AS t2 FROM t), k AS (SELECT *, (t2-t1)*sqrt((x2-x1)**2+(y2-y1)**2) AS len FROM c WHERE t1 < t2), m AS (SELECT *, CASE WHEN lag(tx) OVER w <> tx OR lag(ty) OVER w <> ty THEN 1 ELSE 0 END AS moved FROM k WINDOW w AS (PARTITION BY zoom, track ORDER BY seq, t1)), n AS (SELECT *, sum(moved) OVER (PARTITION BY zoom, track ORDER BY seq, t1) AS part FROM m) SELECT zoom, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, track, CAST(part AS BIGINT) AS part, count(*) + 1 AS points, round(sum(len), 4) AS length FROM n GROUP BY zoom, tx, ty, track, part"


def line_legs(spark: SparkSession, d: str) -> DataFrame:
    return tracks.legs(fixes(spark, d)).select(F.col("track").alias("line"), "seq", "x1", "y1", "x2", "y2")


@query("vectortile_clip", sql(TILED, "fixes"))
def vectortile_clip(spark: SparkSession, d: str) -> DataFrame:
    """Tracks in runs cut at the borders of the tiles of two zooms."""
    r = tiles.runs(tiles.cut(line_legs(spark, d), [3, 5], 4096.0))
    return r.select("zoom", "tx", "ty", F.col("line").alias("track"), "part", F.size("points").cast("long").alias("points"), F.round("length", 4).alias("length"))


@query("vectortile", None)
def vectortile(spark: SparkSession, d: str) -> DataFrame:
    """The points that are left of each run at four pixels of its tile."""
    t = tiles.vector_tiles(line_legs(spark, d), [3, 5], 4096.0, tolerance=4.0)
    t = t.select("zoom", "tx", "ty", F.col("line").alias("track"), "part", F.posexplode("points").alias("pos", "p"))
    return t.select("zoom", "tx", "ty", "track", "part", "pos", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query("tilecover", sql("SELECT id, (floor(max_x/50)-floor(min_x/50)+1)*(floor(max_y/50)-floor(min_y/50)+1)::BIGINT AS tiles FROM boxes", "boxes").replace("(floor(max_x/50)-floor(min_x/50)+1)*(floor(max_y/50)-floor(min_y/50)+1)::BIGINT", "CAST((floor(max_x/50)-floor(min_x/50)+1)*(floor(max_y/50)-floor(min_y/50)+1) AS BIGINT)"))
def tilecover(spark: SparkSession, d: str) -> DataFrame:
    b = joins.cells_of(boxes(spark, d), F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), 50.0)
    return b.groupBy("id").agg(F.count("*").alias("tiles"))


# S7, S8: rings


@query("shoelace", sql("SELECT id, round(sum(x1*y2-x2*y1)/2, 4) AS area, round(sum(sqrt((x2-x1)**2+(y2-y1)**2)), 5) AS perimeter FROM edges GROUP BY id", "edges"))
def shoelace(spark: SparkSession, d: str) -> DataFrame:
    return rings(spark, d).select("id", F.round(joins.shoelace(F.col("ring")), 4).alias("area"), F.round(joins.perimeter(F.col("ring")), 5).alias("perimeter"))


@query("compactness", sql("WITH m AS (SELECT id, abs(sum(x1*y2-x2*y1)/2) AS a, sum(sqrt((x2-x1)**2+(y2-y1)**2)) AS p FROM edges GROUP BY id) SELECT id, round(4*pi()*a/p**2, 6) AS polsby, round(2*sqrt(pi()*a)/p, 6) AS schwartzberg FROM m", "edges"))
def compactness(spark: SparkSession, d: str) -> DataFrame:
    r = rings(spark, d).select("id", F.abs(joins.shoelace(F.col("ring"))).alias("a"), joins.perimeter(F.col("ring")).alias("p"))
    return r.select("id", F.round(F.lit(4 * 3.141592653589793) * F.col("a") / (F.col("p") * F.col("p")), 6).alias("polsby"), F.round(2 * F.sqrt(3.141592653589793 * F.col("a")) / F.col("p"), 6).alias("schwartzberg"))


#: The hull's edges of each ring: all its corners lie to the left.
RING_HULL = "WITH v AS (SELECT id, i, x1 AS x, y1 AS y FROM edges), h AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb FROM v a JOIN v b ON a.id=b.id AND a.i <> b.i JOIN v p ON p.id=a.id GROUP BY a.id, a.x, a.y, b.x, b.y HAVING min((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x)) > -1e-9), k AS (SELECT id, sum(ax*bb-bx*ay)/2 AS area, sum(sqrt((ax-bx)**2+(ay-bb)**2)) AS perimeter, max(ax)-min(ax) AS wide, max(ay)-min(ay) AS high FROM h GROUP BY id), g AS (SELECT id, abs(sum(x1*y2-x2*y1))/2 AS own FROM edges GROUP BY id)"


ROUND_RINGS = RING_HULL + ", d AS (SELECT a.id, (a.x+b.x)/2 AS x, (a.y+b.y)/2 AS y, ((a.x-b.x)**2+(a.y-b.y)**2)/4 AS r2 FROM v a JOIN v b ON a.id=b.id AND a.i < b.i UNION ALL SELECT id, ax+(vy*(ux*ux+uy*uy)-uy*(vx*vx+vy*vy))/(2*det), ay+(ux*(vx*vx+vy*vy)-vx*(ux*ux+uy*uy))/(2*det), (((vy*(ux*ux+uy*uy)-uy*(vx*vx+vy*vy))**2+(ux*(vx*vx+vy*vy)-vx*(ux*ux+uy*uy))**2))/(4*det*det) FROM (SELECT a.id, a.x AS ax, a.y AS ay, b.x-a.x AS ux, b.y-a.y AS uy, e.x-a.x AS vx, e.y-a.y AS vy, (b.x-a.x)*(e.y-a.y)-(b.y-a.y)*(e.x-a.x) AS det FROM v a JOIN v b ON a.id=b.id AND a.i < b.i JOIN v e ON e.id=a.id AND b.i < e.i) WHERE abs(det) > 1e-9), w AS (SELECT d.id, d.x, d.y, d.r2 FROM d JOIN v ON v.id=d.id GROUP BY d.id, d.x, d.y, d.r2 HAVING max((v.x-d.x)**2+(v.y-d.y)**2) <= d.r2*(1+1e-9)), c AS (SELECT id, min(r2) AS r2 FROM w GROUP BY id) SELECT id, round(own/(pi()*r2), 6) AS reock, round(own/area, 6) AS hull_ratio FROM k JOIN g USING (id) JOIN c USING (id)"


@query("compactness_hull", sql(ROUND_RINGS, "edges"))
def compactness_hull(spark: SparkSession, d: str) -> DataFrame:
    """Share of the least circle, and of the hull, that a ring fills."""
    f = geo.on_rings(lambda r: (abs(geo.ring_area(r)) / (3.141592653589793 * geo.least_circle(h := geo.hull(r))[2] ** 2), abs(geo.ring_area(r)) / geo.ring_area(h)), "reock double, hull_ratio double")
    return rings(spark, d).select("id", f("ring").alias("s")).select("id", F.round("s.reock", 6).alias("reock"), F.round("s.hull_ratio", 6).alias("hull_ratio"))


@query("centroid", sql("SELECT id, round(sum((x1+x2)*(x1*y2-x2*y1))/(3*sum(x1*y2-x2*y1)), 4) AS x, round(sum((y1+y2)*(x1*y2-x2*y1))/(3*sum(x1*y2-x2*y1)), 4) AS y FROM edges GROUP BY id", "edges"))
def centroid(spark: SparkSession, d: str) -> DataFrame:
    x, y = joins.ring_centroid(F.col("ring"))
    return rings(spark, d).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("convexity", sql(RING_HULL + " SELECT id, round(own/area, 6) AS share FROM k JOIN g USING (id)", "edges"))
def convexity(spark: SparkSession, d: str) -> DataFrame:
    f = geo.on_rings(lambda r: (abs(geo.ring_area(r)) / abs(geo.ring_area(geo.hull(r))),), "share double")
    return rings(spark, d).select("id", F.round(f("ring")["share"], 6).alias("share"))


#: Area of a ring inside the window: what lies below each edge, its height kept between 200 and 800, signed by the edge's direction.
BELOW = "WITH c AS (SELECT id, x1, y1, x2, y2, least(greatest(x1, 200.0), 800.0) AS u, least(greatest(x2, 200.0), 800.0) AS w FROM edges), h AS (SELECT id, u, w, y1+(y2-y1)*(u-x1)/(x2-x1) AS p, y1+(y2-y1)*(w-x1)/(x2-x1) AS q FROM c WHERE u <> w), g AS (SELECT id, w-u AS dx, p, q, least(greatest(p, 200.0), 800.0) AS kp, least(greatest(q, 200.0), 800.0) AS kq, least(greatest((p+q)/2, 200.0), 800.0) AS km FROM h), z AS (SELECT id, CASE WHEN abs(q-p) < 1e-6 THEN dx*(km-200) ELSE dx*((kq-200)**2/2+greatest(q-800, 0)*600-(kp-200)**2/2-greatest(p-800, 0)*600)/(q-p) END AS below FROM g) SELECT sites.sid AS id, round(abs(coalesce(sum(below), 0)), 4) AS area FROM sites LEFT JOIN z ON z.id = sites.sid GROUP BY sites.sid"


@query("sutherlandhodgman", sql(BELOW, "edges"))
def sutherlandhodgman(spark: SparkSession, d: str) -> DataFrame:
    window = [(200.0, 200.0), (800.0, 200.0), (800.0, 800.0), (200.0, 800.0)]
    f = geo.on_rings(lambda r: (geo.ring_area(geo.clip_ring(r, window)),), "area double")
    return rings(spark, d).select("id", F.round(f("ring")["area"], 4).alias("area"))


@query("minkowski", sql(RING_HULL + " SELECT id, round(area+10*(wide+high)+100, 4) AS area FROM k", "edges"))
def minkowski(spark: SparkSession, d: str) -> DataFrame:
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    f = geo.on_rings(lambda r: (geo.ring_area(geo.minkowski(geo.hull(r), square)),), "area double")
    return rings(spark, d).select("id", F.round(f("ring")["area"], 4).alias("area"))


@query("buffer", sql(RING_HULL + " SELECT id, round(area+5*perimeter+25*pi(), 4) AS area FROM k", "edges"))
def buffer(spark: SparkSession, d: str) -> DataFrame:
    f = geo.on_rings(lambda r: (abs(geo.ring_area(h := geo.hull(r))), sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(h, h[1:] + h[:1], strict=True))), "area double, perimeter double")
    h = rings(spark, d).select("id", f("ring").alias("h"))
    return h.select("id", F.round(geo.steiner_area(F.col("h.area"), F.col("h.perimeter"), 5.0), 4).alias("area"))


@query("buffer_ring", None)
def buffer_ring(spark: SparkSession, d: str) -> DataFrame:
    """The ring five beyond each hull, arcs in eight chords: its points and area."""
    f = geo.on_rings(lambda r: (len(o := geo.offset_ring(geo.hull(r), 5.0)), abs(geo.ring_area(o))), "points long, area double")
    return rings(spark, d).select("id", f("ring").alias("o")).select("id", "o.points", F.round("o.area", 4).alias("area"))


@query("earclipping", sql("SELECT id, CAST(count(*)-2 AS BIGINT) AS triangles, round(abs(sum(x1*y2-x2*y1))/2, 4) AS area FROM edges GROUP BY id", "edges"))
def earclipping(spark: SparkSession, d: str) -> DataFrame:
    f = geo.on_rings(lambda r: (len(t := geo.ears(r)), sum(abs(geo.turn(r[a], r[b], r[c])) / 2 for a, b, c in t)), "triangles long, area double")
    return rings(spark, d).select("id", f("ring").alias("e")).select("id", "e.triangles", F.round("e.area", 4).alias("area"))


@query("polylabel", None)
def polylabel(spark: SparkSession, d: str) -> DataFrame:
    f = geo.on_rings(lambda r: geo.inner_pole(r, 0.01), "x double, y double, depth double")
    return rings(spark, d).select("id", f("ring").alias("p")).select("id", F.round("p.depth", 2).alias("depth"))


def strips(spark: SparkSession, d: str) -> DataFrame:
    """Each site's ring in four strips of equal area, across a direction told by its id."""
    f = geo.on_strips(4)
    cut = rings(spark, d).select("id", f("ring", (F.col("id") * 37 % 360).cast("double")).alias("s"))
    return cut.select("id", F.posexplode("s").alias("strip", "s")).select("id", "strip", "s.*")


@query("parcelsplit", None)
def parcelsplit(spark: SparkSession, d: str) -> DataFrame:
    """Where the cuts lie along the direction; the last strip ends where the ring does."""
    return strips(spark, d).select("id", "strip", F.round("offset", 5).alias("offset"))


@query("parcelsplit_areas", sql("SELECT id, strip::INT AS strip, round(abs(sum(x1*y2-x2*y1)/2)/4, 4)+0.0 AS area FROM edges, range(4) q(strip) GROUP BY id, strip", "edges"))
def parcelsplit_areas(spark: SparkSession, d: str) -> DataFrame:
    return strips(spark, d).select("id", "strip", (F.round("area", 4) + 0.0).alias("area"))


# S12: points


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).withColumn("region", joins.cell(F.col("x"), 250.0) * 4 + joins.cell(F.col("y"), 250.0))


#: Hull edges of the points of each region, points in a line with others left out.
REGION_HULL = "WITH q AS (SELECT DISTINCT CAST(floor(x/250)*4+floor(y/250) AS BIGINT) AS region, x, y FROM points), h AS (SELECT a.region, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb FROM q a JOIN q b ON a.region=b.region AND (a.x <> b.x OR a.y <> b.y) JOIN q p ON p.region=a.region GROUP BY a.region, a.x, a.y, b.x, b.y HAVING min((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x)) > -1e-9), m AS (SELECT region, avg(ax) AS mx, avg(ay) AS my FROM h GROUP BY region), u AS (SELECT DISTINCT region, ax, ay FROM h WHERE NOT EXISTS (SELECT 1 FROM h e WHERE e.region = h.region AND abs((e.bx-e.ax)*(h.ay-e.ay)-(e.bb-e.ay)*(h.ax-e.ax)) <= 1e-9 AND (h.ax-e.ax)*(h.ax-e.bx)+(h.ay-e.ay)*(h.ay-e.bb) < 0)), o AS (SELECT u.*, row_number() OVER (PARTITION BY region ORDER BY atan2(ay-my, ax-mx)) AS i, count(*) OVER (PARTITION BY region) AS n FROM u JOIN m USING (region))"


@query("jarvismarch", None)
def jarvismarch(spark: SparkSession, d: str) -> DataFrame:
    return geo.hulls(grouped(spark, d), "region").select("region", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("rotatingcalipers", sql("WITH g AS (SELECT *, CAST(floor(x/250)*4+floor(y/250) AS BIGINT) AS region FROM points) SELECT a.region, round(max(sqrt((a.x-b.x)**2+(a.y-b.y)**2)), 6) AS diameter FROM g a JOIN g b ON a.region=b.region GROUP BY a.region", "points"))
def rotatingcalipers(spark: SparkSession, d: str) -> DataFrame:
    h = geo.hulls(grouped(spark, d), "region")
    return geo.per_hull(h, "region", geo.diameter, "region long, diameter double").select("region", F.round("diameter", 6).alias("diameter"))


@query("minrect", sql(REGION_HULL + ", e AS (SELECT region, ax, ay, bx, bb, (bx-ax)/sqrt((bx-ax)**2+(bb-ay)**2) AS ux, (bb-ay)/sqrt((bx-ax)**2+(bb-ay)**2) AS uy FROM h), t AS (SELECT e.region, e.ax, e.ay, e.bx, e.bb, max(h.ax*ux+h.ay*uy)-min(h.ax*ux+h.ay*uy) AS w, max(h.ay*ux-h.ax*uy)-min(h.ay*ux-h.ax*uy) AS g FROM e JOIN h ON h.region=e.region GROUP BY e.region, e.ax, e.ay, e.bx, e.bb) SELECT t.region, round(any_value(least), 4) AS area, round(min(greatest(w, g)) FILTER (WHERE w*g <= least*(1+1e-9)), 4) AS side FROM t JOIN (SELECT region, min(w*g) AS least FROM t GROUP BY region) l ON l.region = t.region GROUP BY t.region", "points"))
def minrect(spark: SparkSession, d: str) -> DataFrame:
    return geo.per_hull(geo.hulls(grouped(spark, d), "region"), "region", geo.min_rectangle, "region long, area double, side double").select("region", F.round("area", 4).alias("area"), F.round("side", 4).alias("side"))


@query("boundingcircle", sql(REGION_HULL + ", v AS (SELECT region, i, ax AS x, ay AS y FROM o), d AS (SELECT a.region, (a.x+b.x)/2 AS x, (a.y+b.y)/2 AS y, ((a.x-b.x)**2+(a.y-b.y)**2)/4 AS r2 FROM v a JOIN v b ON a.region=b.region AND a.i < b.i UNION ALL SELECT region, ax+(vy*(ux*ux+uy*uy)-uy*(vx*vx+vy*vy))/(2*det), ay+(ux*(vx*vx+vy*vy)-vx*(ux*ux+uy*uy))/(2*det), (((vy*(ux*ux+uy*uy)-uy*(vx*vx+vy*vy))**2+(ux*(vx*vx+vy*vy)-vx*(ux*ux+uy*uy))**2))/(4*det*det) FROM (SELECT a.region, a.x AS ax, a.y AS ay, b.x-a.x AS ux, b.y-a.y AS uy, e.x-a.x AS vx, e.y-a.y AS vy, (b.x-a.x)*(e.y-a.y)-(b.y-a.y)*(e.x-a.x) AS det FROM v a JOIN v b ON a.region=b.region AND a.i < b.i JOIN v e ON e.region=a.region AND b.i < e.i) WHERE abs(det) > 1e-9), w AS (SELECT d.region, d.x, d.y, d.r2 FROM d JOIN v ON v.region=d.region GROUP BY d.region, d.x, d.y, d.r2 HAVING max((v.x-d.x)**2+(v.y-d.y)**2) <= d.r2*(1+1e-9)) SELECT region, round(arg_min(x, r2), 4) AS x, round(arg_min(y, r2), 4) AS y, round(sqrt(min(r2)), 4) AS r FROM w GROUP BY region", "points"))
def boundingcircle(spark: SparkSession, d: str) -> DataFrame:
    return geo.per_hull(geo.hulls(grouped(spark, d), "region"), "region", geo.least_circle, "region long, x double, y double, r double").select("region", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("r", 4).alias("r"))


def mesh(spark: SparkSession, d: str) -> DataFrame:
    """Delaunay triangles of all points."""
    return triangulation.triangles(points(spark, d))


def empty_circles(where: str) -> str:
    """SQL of the table d: pairs of points with an empty circle through both. Centres lie on the bisector, at most ``l`` and at least ``r`` left of its middle, which the
    points to the left and right tell; null where there is none. No point lies between the two. Pairs are tried against a few of the points first, then against all."""
    dot = "(p.x-e.ax)*(p.x-e.bx)+(p.y-e.ay)*(p.y-e.bb)"
    tried = lambda pairs, points: f"SELECT a, b, ax, ay, bx, bb, d, min(t) FILTER (k > 0) AS l, max(t) FILTER (k < 0) AS r FROM (SELECT e.*, (e.bx-e.ax)*(p.y-e.ay)-(e.bb-e.ay)*(p.x-e.ax) AS k, {dot} AS s, s*e.d/2/nullif(k, 0) AS t FROM {pairs} e CROSS JOIN {points} p) GROUP BY ALL HAVING coalesce(max(t) FILTER (k < 0) <= min(t) FILTER (k > 0), true) AND count(*) FILTER (k = 0 AND s < 0) = 0"
    pairs = "SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM points a JOIN points b ON a.id < b.id"
    return f"WITH e0 AS ({pairs} WHERE {where}), few AS (SELECT * FROM points WHERE id%64 = 0), others AS (SELECT * FROM points WHERE id%8 = 0), e1 AS (SELECT * EXCLUDE (l, r) FROM ({tried('e0', 'few')})), e2 AS (SELECT * EXCLUDE (l, r) FROM ({tried('e1', 'others')})), d AS ({tried('e2', 'points')})"


@query("delaunay", None)
def delaunay(spark: SparkSession, d: str) -> DataFrame:
    return mesh(spark, d).select("a", "b", "c")


@query("voronoi", None)
def voronoi(spark: SparkSession, d: str) -> DataFrame:
    """Finite edges: between the circumcentres of the two triangles at each inner edge."""
    e = triangulation.edges(mesh(spark, d)).filter("n = 2")
    end = lambda i, v: F.round(F.col("sides")[i][v], 4)
    return e.select("a", "b", end(0, "x").alias("x1"), end(0, "y").alias("y1"), end(1, "x").alias("x2"), end(1, "y").alias("y2"))


@query("alphashape", sql(empty_circles("(a.x-b.x)**2+(a.y-b.y)**2 <= 32400") + " SELECT a, b FROM d WHERE coalesce(l*l+d*d/4 < 8100, false) <> coalesce(r*r+d*d/4 < 8100, false)", "points"))
def alphashape(spark: SparkSession, d: str) -> DataFrame:
    """Boundary of the triangles whose circle is smaller than 90."""
    return triangulation.edges(mesh(spark, d).filter("r2 < 8100")).filter("n = 1").select("a", "b")


@query("tin", None)
def tin(spark: SparkSession, d: str) -> DataFrame:
    """Mean height, slope and plane area of each triangle of the surface; a triangle that is flat in doubles has no slope."""
    return surface(mesh(spark, d))


def surface(t: DataFrame) -> DataFrame:
    """(a, b, c, height, slope, area) of triangles whose corners' heights are their ids modulo 97."""
    z = lambda v: (F.col(v) % 97).cast("double")
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    p, q, det = z("b") - z("a"), z("c") - z("a"), ux * vy - uy * vx
    slope = F.hypot(F.try_divide(p * vy - q * uy, det), F.try_divide(q * ux - p * vx, det))
    return t.select("a", "b", "c", F.round((z("a") + z("b") + z("c")) / 3, 6).alias("height"), F.round(slope, 4).alias("slope"), F.round(F.abs(det) / 2, 4).alias("area"))


#: Triangles of sites whose circle holds no other site, corners in order.
EMPTY = "WITH t AS (SELECT a.sid AS a, b.sid AS b, c.sid AS c, a.sx AS ax, a.sy AS ay, b.sx-a.sx AS ux, b.sy-a.sy AS uy, c.sx-a.sx AS vx, c.sy-a.sy AS vy FROM sites a JOIN sites b ON a.sid < b.sid JOIN sites c ON b.sid < c.sid), k AS (SELECT *, ux*vy-uy*vx AS det FROM t), m AS (SELECT *, (vy*(ux*ux+uy*uy)-uy*(vx*vx+vy*vy))/(2*det) AS mx, (ux*(vx*vx+vy*vy)-vx*(ux*ux+uy*uy))/(2*det) AS my FROM k WHERE abs(det) > 1e-9), e AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.sid NOT IN (m.a, m.b, m.c) AND (s.sx-m.ax-m.mx)**2+(s.sy-m.ay-m.my)**2 < (m.mx*m.mx+m.my*m.my)*(1-1e-12)))"


@query("delaunay_sites", sql(EMPTY + " SELECT a, b, c, round(ax+mx, 3)+0.0 AS x, round(ay+my, 3)+0.0 AS y FROM e WHERE mx*mx+my*my < 1e8", "sites"))
def delaunay_sites(spark: SparkSession, d: str) -> DataFrame:
    """The sites' triangles and their circles' centres, without circles wider than 10,000, whose centres rounding moves."""
    t = triangulation.triangles(stations(spark, d)).filter("r2 < 1e8")
    return t.select("a", "b", "c", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query("tin_sites", sql(EMPTY + " SELECT a, b, c, round((a%97+b%97+c%97)/3.0, 6) AS height, round(sqrt((((b%97-a%97)*vy-(c%97-a%97)*uy)/det)**2+(((c%97-a%97)*ux-(b%97-a%97)*vx)/det)**2), 4) AS slope, round(abs(det)/2, 4) AS area FROM e WHERE round(abs(det)/2, 4) > 0", "sites"))
def tin_sites(spark: SparkSession, d: str) -> DataFrame:
    """The surface over the sites, without triangles whose area is zero at four digits: three sites nearly in line along the hull."""
    return surface(triangulation.triangles(stations(spark, d))).filter("area > 0")


@query("emptycircle", sql(empty_circles("true") + ", c AS (SELECT (ax+bx)/2-(bb-ay)/d*t AS x, (ay+bb)/2+(bx-ax)/d*t AS y, t*t+d*d/4 AS r2 FROM (SELECT *, unnest([l, r]) AS t FROM d) WHERE t IS NOT NULL), h AS (SELECT * FROM d WHERE l IS NULL OR r IS NULL), i AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE ((h.bx-h.ax)*(c.y-h.ay)-(h.bb-h.ay)*(c.x-h.ax))*(CASE WHEN h.l IS NULL THEN -1 ELSE 1 END) < 0)) SELECT round(x, 4) AS x, round(y, 4) AS y, round(sqrt(r2), 4) AS r FROM i ORDER BY round(r2, 6) DESC, round(x, 4), round(y, 4) LIMIT 1", "points"))
def emptycircle(spark: SparkSession, d: str) -> DataFrame:
    """The largest circle without a site inside, of those round a Voronoi corner inside the sites' hull; of equal ones, to six digits, the leftmost."""
    t = mesh(spark, d)
    h = geo.hulls(points(spark, d).select("x", "y", F.lit(0).cast("long").alias("one")), "one").groupBy("one").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("ring"))
    inside = t.join(F.broadcast(h)).filter(joins.in_ring(t["x"], t["y"], F.col("ring")))
    return inside.orderBy(F.round("r2", 6).desc(), F.round(t["x"], 4), F.round(t["y"], 4)).limit(1).select(F.round(t["x"], 4).alias("x"), F.round(t["y"], 4).alias("y"), F.round(F.sqrt("r2"), 4).alias("r"))


# S11


def network(spark: SparkSession, d: str) -> DataFrame:
    return graphs.neighbour_graph(sites(spark, d).select(F.col("sid").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y")), 3)


#: The three nearest sites of each as a network, and least distances from the first site as a keyed recursion.
NETWORK = "WITH n AS (SELECT a.sid AS a, b.sid AS b, sqrt((a.sx-b.sx)**2+(a.sy-b.sy)**2) AS w, row_number() OVER (PARTITION BY a.sid ORDER BY (a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy), b.sid) AS k FROM sites a JOIN sites b ON a.sid <> b.sid), g AS (SELECT a AS src, b AS dst, w FROM n WHERE k <= 3 UNION SELECT b, a, w FROM n WHERE k <= 3)"
AWAY = ", f(node, dist) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), 0.0::DOUBLE UNION SELECT g.dst, min(f.dist+g.w) AS dist FROM f JOIN g ON g.src = f.node LEFT JOIN recurring.f o ON o.node = g.dst GROUP BY g.dst, o.dist HAVING o.dist IS NULL OR min(f.dist+g.w) < o.dist - 1e-12)"


@query("networkbuffer", recursive(NETWORK + AWAY + " SELECT node, round(dist, 5) AS dist FROM f WHERE dist <= 300", "sites"))
def networkbuffer(spark: SparkSession, d: str) -> DataFrame:
    """Sites within 300 along the network from the first."""
    g = graphs.settle(network(spark, d), 0)
    return graphs.shortest(g, spark.createDataFrame([(0,)], "source long"), 300.0, parts=graphs.parts_of(stations(spark, d))).select("node", F.round("dist", 5).alias("dist"))


@query("detourindex", recursive(NETWORK + AWAY + " SELECT node, round(dist/sqrt((s.sx-o.sx)**2+(s.sy-o.sy)**2), 5) AS detour FROM f JOIN sites s ON s.sid = node JOIN sites o ON o.sid = 0 WHERE dist > 0", "sites"))
def detourindex(spark: SparkSession, d: str) -> DataFrame:
    g = graphs.settle(network(spark, d), 0)
    s = sites(spark, d)
    far = graphs.shortest(g, spark.createDataFrame([(0,)], "source long"), parts=graphs.parts_of(stations(spark, d)))
    at = s.filter("sid = 0").select(F.col("sx").alias("x0"), F.col("sy").alias("y0"))
    return far.join(s, F.col("node") == F.col("sid")).join(F.broadcast(at)).filter("dist > 0").select("node", F.round(F.col("dist") / F.hypot(F.col("sx") - F.col("x0"), F.col("sy") - F.col("y0")), 5).alias("detour"))


@query("betweenness", None)
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    g = graphs.settle(network(spark, d), 0)
    return graphs.betweenness(g, g.select(F.col("src").alias("source")).distinct(), graphs.parts_of(stations(spark, d))).select("node", F.round("score", 5).alias("score"))


def stations(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select(F.col("sid").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y"))


@query("emst", sql("WITH p AS (SELECT a.sid AS a, b.sid AS b, sqrt((a.sx-b.sx)**2+(a.sy-b.sy)**2) AS d FROM sites a JOIN sites b ON a.sid < b.sid), k AS (SELECT *, row_number() OVER (ORDER BY round(d, 9), a, b) AS w FROM p), m0 AS (SELECT a, b, w FROM k UNION ALL SELECT b, a, w FROM k UNION ALL SELECT sid, sid, 0 FROM sites)" + "".join(f", m{k+1} AS (SELECT x.a, y.b, min(greatest(x.w, y.w)) AS w FROM m{k} x JOIN m{k} y ON x.b = y.a GROUP BY x.a, y.b)" for k in range(8)) + " SELECT a AS src, b AS dst, round(d, 6) AS w FROM k JOIN m8 USING (a, b) WHERE k.w = m8.w", "sites"))
def emst(spark: SparkSession, d: str) -> DataFrame:
    """The Euclidean spanning tree: least edges of the Gabriel graph, which holds it."""
    near = triangulation.gabriel(triangulation.triangles(stations(spark, d))).select("src", "dst", F.round("w", 9).alias("w"))  # equal lengths are equal, whatever way they were computed
    near = graphs.settle(near, 0)
    return graphs.spanning_tree(near).select("src", "dst", F.round("w", 6).alias("w"))


S_SITE_PAIRS = "SELECT a.sid AS src, b.sid AS dst FROM sites a JOIN sites b ON a.sid < b.sid WHERE NOT EXISTS (SELECT 1 FROM sites c WHERE c.sid <> a.sid AND c.sid <> b.sid AND "


@query("gabriel", sql(S_SITE_PAIRS + "(c.sx-(a.sx+b.sx)/2)**2+(c.sy-(a.sy+b.sy)/2)**2 < ((a.sx-b.sx)**2+(a.sy-b.sy)**2)/4*(1-1e-12))", "sites"))
def gabriel(spark: SparkSession, d: str) -> DataFrame:
    return triangulation.gabriel(triangulation.triangles(stations(spark, d))).select("src", "dst")


@query("relativeneighbours", sql(S_SITE_PAIRS + "greatest((c.sx-a.sx)**2+(c.sy-a.sy)**2, (c.sx-b.sx)**2+(c.sy-b.sy)**2) < ((a.sx-b.sx)**2+(a.sy-b.sy)**2)*(1-1e-12))", "sites"))
def relativeneighbours(spark: SparkSession, d: str) -> DataFrame:
    s = stations(spark, d)
    return triangulation.relative_neighbours(s, triangulation.gabriel(triangulation.triangles(s))).select("src", "dst")


# S9


@query("bboxcache", None)
def bboxcache(spark: SparkSession, d: str) -> DataFrame:
    return stateful.fat_box_updates(fixes(spark, d), 100.0)


@query("tilecache", None)
def tilecache(spark: SparkSession, d: str) -> DataFrame:
    r = fixes(spark, d).select(F.col("track").alias("session"), "seq", (F.floor(F.col("x") / 60) * 100000 + F.floor(F.col("y") / 60)).alias("tile"))
    return stateful.lru_hits(r, 8)


@query("tilebloom", sql("SELECT count(DISTINCT id) AS added, CAST(0 AS BIGINT) AS missed FROM points", "points"))
def tilebloom(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d).select(F.col("id").alias("tile"))
    seen = stateful.bloom_seen(t, stateful.bloom_bits(t, 1 << 16, 4), 1 << 16, 4)
    return seen.agg(F.count("*").alias("added"), F.count_if(~F.col("seen")).alias("missed"))


@query("windowed_events", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return stateful.windowed(spark.read.parquet(f"{d}/events.parquet"), "6 hours").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("session_events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return stateful.sessions(spark.read.parquet(f"{d}/events.parquet"), "12 hours").select("user_id", "n")


# S8: fits


FIT = "WITH p AS (SELECT x, y, 2*x-3*y+5+id%3 AS u, x+4*y-7-id%2 AS v FROM points), m AS (SELECT count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy, sum(u) AS u, sum(x*u) AS xu, sum(y*u) AS yu FROM p), c AS (SELECT xx-x*x/n AS a, xy-x*y/n AS b, yy-y*y/n AS d, xu-x*u/n AS e, yu-y*u/n AS f FROM m)"


@query("affinefit", sql(FIT + " SELECT round((e*d-f*b)/(a*d-b*b), 6) AS ux, round((a*f-b*e)/(a*d-b*b), 6) AS uy FROM c", "points"))
def affinefit(spark: SparkSession, d: str) -> DataFrame:
    """Least squares from covariances: one aggregate and a closed solution."""
    p = points(spark, d).withColumn("u", 2 * F.col("x") - 3 * F.col("y") + 5 + F.col("id") % 3)
    m = p.agg(F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c"), F.covar_pop("x", "u").alias("e"), F.covar_pop("y", "u").alias("f"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return m.select(F.round((F.col("e") * F.col("c") - F.col("f") * F.col("b")) / det, 6).alias("ux"), F.round((F.col("a") * F.col("f") - F.col("b") * F.col("e")) / det, 6).alias("uy"))


SIMILAR = "WITH p AS (SELECT x, y, 2*x-3*y+5+id%3 AS u, 3*x+2*y-7-id%5+x/50 AS v FROM points), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, (covar_pop(x, u)+covar_pop(y, v))/(var_pop(x)+var_pop(y)) AS a, (covar_pop(x, v)-covar_pop(y, u))/(var_pop(x)+var_pop(y)) AS b FROM p), r AS (SELECT a, b, mu-a*mx+b*my AS c, mv-b*mx-a*my AS d, (a*x-b*y+mu-a*mx+b*my-u)**2+(b*x+a*y+mv-b*mx-a*my-v)**2 AS e FROM p, m) SELECT round(any_value(a), 6) AS a, round(any_value(b), 6) AS b, round(any_value(c), 4) AS c, round(any_value(d), 4) AS d, round(sqrt(avg(e)), 6) AS rms, round(sqrt(max(e)), 6) AS worst FROM r"


@query("affinefit_similarity", sql(SIMILAR, "points"))
def affinefit_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Scale, turn and shift that fit best, and what is left: one aggregate for the fit, one for the residuals."""
    p = points(spark, d).select("x", "y", (2 * F.col("x") - 3 * F.col("y") + 5 + F.col("id") % 3).alias("u"), (3 * F.col("x") + 2 * F.col("y") - 7 - F.col("id") % 5 + F.col("x") / 50).alias("v"))
    fit, gap = positioning.similarity(p)
    return p.join(F.broadcast(fit)).groupBy("a", "b", "c", "d").agg(F.sqrt(F.avg(gap * gap)).alias("rms"), F.max(gap).alias("worst")).select(
        F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"), F.round("d", 4).alias("d"), F.round("rms", 6).alias("rms"), F.round("worst", 6).alias("worst")
    )


#: Distances to the sites within 200, up to a half off; the first guess from squares, and five steps of Gauss and Newton.
RANGED = "WITH r AS (SELECT id, sx, sy, sqrt((x-sx)**2+(y-sy)**2)+((id*13+sid*29)%11-5)*0.1 AS d FROM points, sites WHERE (x-sx)*(x-sx)+(y-sy)*(y-sy) <= 40000), m AS (SELECT id, count(*) AS n, avg(sx) AS mx, avg(sy) AS my, avg(sx*sx+sy*sy-d*d) AS mq FROM r GROUP BY id), l AS (SELECT id, any_value(n) AS n, avg((sx-mx)**2) AS a, avg((sx-mx)*(sy-my)) AS b, avg((sy-my)**2) AS c, avg((sx-mx)*(sx*sx+sy*sy-d*d-mq)/2) AS e, avg((sy-my)*(sx*sx+sy*sy-d*d-mq)/2) AS f FROM r JOIN m USING (id) GROUP BY id), p0 AS (SELECT id, n, (e*c-f*b)/(a*c-b*b) AS x, (a*f-b*e)/(a*c-b*b) AS y FROM l WHERE n >= 3 AND a*c-b*b > 9000000)"
STEP = ", g{i} AS (SELECT id, any_value(n) AS n, any_value(x) AS x, any_value(y) AS y, sum(gx*gx) AS a, sum(gx*gy) AS b, sum(gy*gy) AS c, sum(gx*q) AS e, sum(gy*q) AS f, sqrt(avg(q*q)) AS residual FROM (SELECT id, n, x, y, (x-sx)/sqrt((x-sx)**2+(y-sy)**2) AS gx, (y-sy)/sqrt((x-sx)**2+(y-sy)**2) AS gy, d-sqrt((x-sx)**2+(y-sy)**2) AS q FROM r JOIN p{i} USING (id)) GROUP BY id), p{j} AS (SELECT id, n, x+(e*c-f*b)/(a*c-b*b) AS x, y+(a*f-b*e)/(a*c-b*b) AS y, residual, sqrt((a+c)/(a*c-b*b)) AS dilution FROM g{i})"


@query("trilateration", sql(RANGED + "".join(STEP.format(i=i, j=i + 1) for i in range(12)) + " SELECT id, n, round(x, 4)+0.0 AS px, round(y, 4)+0.0 AS py, round(residual, 5) AS residual, round(dilution, 5) AS dilution FROM p12", "points", "sites"))
def trilateration(spark: SparkSession, d: str) -> DataFrame:
    """Places from noisy distances to all sites in reach by least squares, where at least three sites lie well apart."""
    off = lambda i, s: ((i * 13 + s * 29) % 11 - 5) * 0.1
    p = positioning.range_fixes_within(points(spark, d), sites(spark, d), 200.0, off, least=9_000_000.0).filter("x is not null")
    return p.select("id", "n", (F.round("x", 4) + 0.0).alias("px"), (F.round("y", 4) + 0.0).alias("py"), F.round("residual", 5).alias("residual"), F.round("dilution", 5).alias("dilution"))

