"""Queries over scalar functions: geodesy, projections, codes, time; each beside an independent SQL statement."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import astronomy, codes, geodesy, projections
from gridloom.operators.scratch import dealt_out
from gridloom.plans.catalog import query
from gridloom.sources import fixtures

SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"places": fixtures.places, "points": fixtures.points, "boxes": fixtures.boxes, "segments": fixtures.segments}


def scalar(name: str, columns: Mapping[str, tuple[Callable[[], Column], str]], source: str = "places", digits: int = 6) -> None:
    """Register a query that gives the id and each column, doubles rounded in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = SOURCES[source](spark, sf_dir).select("id", *[c().alias(n) for n, (c, _) in columns.items()])
        return df.select([(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    inner = ", ".join(f"{text} AS {n}" for n, (_, text) in columns.items())
    parts = ["id"] + [n if text.startswith(("CAST(", "'", "substr(", "concat(")) else f"round({n}, {digits}) + 0.0 AS {n}" for n, (_, text) in columns.items()]
    known = all(text for _, text in columns.values())
    query(name, None if not known else fixtures.sql(f"SELECT {', '.join(parts)} FROM (SELECT id, {inner} FROM {source}) q", source))(run)


A1 = lambda: F.col('lat1')
O1 = lambda: F.col('lon1')
A2 = lambda: F.col('lat2')
O2 = lambda: F.col('lon2')
X = lambda: F.col('x')
Y = lambda: F.col('y')
K = F.lit
# columns are made when a query runs: they need a session
R = "6371.0088"


def s_hav(a: str, b: str, c: str, d: str) -> str:
    return f"2*{R}*asin(sqrt(least(1.0, sin(radians({c}-({a}))/2)**2 + cos(radians({a}))*cos(radians({c}))*sin(radians({d}-({b}))/2)**2)))"


def s_mod(x: str, m: str = "360") -> str:
    return f"(({x}) - {m}*floor(({x})/{m}))"


def s_bearing(a: str, b: str, c: str, d: str) -> str:
    return s_mod(f"degrees(atan2(sin(radians({d}-({b})))*cos(radians({c})), cos(radians({a}))*sin(radians({c})) - sin(radians({a}))*cos(radians({c}))*cos(radians({d}-({b}))))) + 360")


HERE = ("lat1", "lon1", "lat2", "lon2")
BACK = ("lat2", "lon2", "lat1", "lon1")
scalar(
    'haversine',
    {
        "km": (lambda: geodesy.haversine(A1(), O1(), A2(), O2()), s_hav(*HERE)),
        "flat_km": (lambda: geodesy.equirectangular(A1(), O1(), A2(), O2()), f"{R}*sqrt((radians(lon2-lon1)*cos((radians(lat1)+radians(lat2))/2))**2 + radians(lat2-lat1)**2)"),
    },
)
scalar(
    'bearing',
    {
        "initial": (lambda: geodesy.initial_bearing(A1(), O1(), A2(), O2()), s_bearing(*HERE)),
        "final": (lambda: geodesy.final_bearing(A1(), O1(), A2(), O2()), s_mod(s_bearing(*BACK) + " + 180")),
    },
)
P2 = f"asin(sin(radians(lat1))*cos(500/{R}) + cos(radians(lat1))*sin(500/{R})*cos(radians(77)))"
scalar(
    'destination',
    {
        "lat": (lambda: geodesy.destination(A1(), O1(), K(77.0), K(500.0))[0], f"degrees({P2})"),
        "lon": (lambda: geodesy.destination(A1(), O1(), K(77.0), K(500.0))[1], s_mod(f"degrees(radians(lon1) + atan2(sin(radians(77))*sin(500/{R})*cos(radians(lat1)), cos(500/{R}) - sin(radians(lat1))*sin({P2}))) + 540") + " - 180"),
    },
)
S_DLAM = "(CASE WHEN abs(radians(lon2-lon1)) > pi() THEN radians(lon2-lon1) - sign(lon2-lon1)*2*pi() ELSE radians(lon2-lon1) END)"
S_DPSI = "(ln(tan(pi()/4+radians(lat2)/2)) - ln(tan(pi()/4+radians(lat1)/2)))"
scalar(
    'rhumbline',
    {
        "km": (lambda: geodesy.rhumb_distance(A1(), O1(), A2(), O2()), f"{R}*sqrt(radians(lat2-lat1)**2 + (CASE WHEN abs({S_DPSI}) > 1e-12 THEN radians(lat2-lat1)/{S_DPSI} ELSE cos(radians(lat1)) END)**2 * {S_DLAM}**2)"),
        "bearing": (lambda: geodesy.rhumb_bearing(A1(), O1(), A2(), O2()), s_mod(f"degrees(atan2({S_DLAM}, {S_DPSI})) + 360")),
    }, digits=5,
)
S_XT = f"(asin(sin(({s_hav('lat1', 'lon1', '10.0', '20.0')})/{R})*sin(radians({s_bearing('lat1', 'lon1', '10.0', '20.0')}) - radians({s_bearing(*HERE)})))*{R})"
scalar(
    'crosstrack',
    {
        "cross_km": (lambda: geodesy.cross_track(A1(), O1(), A2(), O2(), K(10.0), K(20.0)), S_XT),
        "along_km": (lambda: geodesy.along_track(A1(), O1(), A2(), O2(), K(10.0), K(20.0)), f"{R}*acos(greatest(-1.0, least(1.0, cos(({s_hav('lat1', 'lon1', '10.0', '20.0')})/{R})/cos({S_XT}/{R}))))"),
    }, digits=3,
)
scalar(
    'wraplon',
    {
        "lon": (lambda: geodesy.wrap_longitude(O1() * 3), s_mod("lon1*3+180") + "-180"),
        "lat_n": (lambda: geodesy.normalized(A1() * 2, O1())[0], "CASE WHEN wl > 90 THEN 180-wl WHEN wl < -90 THEN -180-wl ELSE wl END".replace("wl", "(" + s_mod("lat1*2+180") + "-180)")),
        "lon_n": (lambda: geodesy.normalized(A1() * 2, O1())[1], s_mod("lon1 + 180 + (CASE WHEN abs(lat1*2) > 90 THEN 180 ELSE 0 END)") + "-180"),
    },
)
scalar(
    'antipode',
    {
        "lat": (lambda: geodesy.antipode(A1(), O1())[0], "-lat1"),
        "lon": (lambda: geodesy.antipode(A1(), O1())[1], "CASE WHEN lon1 <= 0 THEN lon1+180 ELSE lon1-180 END"),
        "residual_km": (lambda: geodesy.haversine(A1(), O1(), A2(), O2()) + geodesy.haversine(*geodesy.antipode(A1(), O1()), A2(), O2()) - math.pi * geodesy.EARTH_RADIUS_KM, s_hav(*HERE) + " + " + s_hav("-lat1", "(CASE WHEN lon1 <= 0 THEN lon1+180 ELSE lon1-180 END)", "lat2", "lon2") + f" - pi()*{R}"),
    },
)
S_ANG = "acos(greatest(-1.0, least(1.0, cos(radians(lat1))*cos(radians(lon1))*cos(radians(lat2))*cos(radians(lon2)) + cos(radians(lat1))*sin(radians(lon1))*cos(radians(lat2))*sin(radians(lon2)) + sin(radians(lat1))*sin(radians(lat2)))))"
WA, WB = f"(sin(0.75*{S_ANG})/sin({S_ANG}))", f"(sin(0.25*{S_ANG})/sin({S_ANG}))"
VX = f"({WA}*cos(radians(lat1))*cos(radians(lon1)) + {WB}*cos(radians(lat2))*cos(radians(lon2)))"
VY = f"({WA}*cos(radians(lat1))*sin(radians(lon1)) + {WB}*cos(radians(lat2))*sin(radians(lon2)))"
VZ = f"({WA}*sin(radians(lat1)) + {WB}*sin(radians(lat2)))"
scalar(
    'interpolate',
    {
        "lat": (lambda: geodesy.intermediate(A1(), O1(), A2(), O2(), K(0.25))[0], f"degrees(atan2({VZ}, sqrt({VX}**2+{VY}**2)))"),
        "lon": (lambda: geodesy.intermediate(A1(), O1(), A2(), O2(), K(0.25))[1], f"degrees(atan2({VY}, {VX}))"),
    },
)
E2 = repr(geodesy.WGS84_E2)
S_N = "(6378137.0/sqrt(1-{e}*sin(radians({p}))**2))"


def s_n(p: str) -> str:
    return S_N.format(e=E2, p=p)


def s_ecef(p: str, q: str, h: str) -> tuple[str, str, str]:
    return f"(({s_n(p)}+{h})*cos(radians({p}))*cos(radians({q})))", f"(({s_n(p)}+{h})*cos(radians({p}))*sin(radians({q})))", f"(({s_n(p)}*(1-{E2})+{h})*sin(radians({p})))"


ECEF = lambda: geodesy.to_ecef(A1(), O1(), K(120.0))
scalar(
    'ecef',
    {
        "x": (lambda: ECEF()[0], s_ecef("lat1", "lon1", "120")[0]),
        "y": (lambda: ECEF()[1], s_ecef("lat1", "lon1", "120")[1]),
        "z": (lambda: ECEF()[2], s_ecef("lat1", "lon1", "120")[2]),
        "geocentric": (lambda: geodesy.geocentric_latitude(A1()), f"degrees(atan((1-{E2})*tan(radians(lat1))))"),
    }, digits=4,
)
ENU = lambda: geodesy.to_enu(geodesy.to_ecef(A1() + 0.1, O1() + 0.1, K(50.0)), A1(), O1(), K(0.0))
DX, DY, DZ = (f"({a} - {b})" for a, b in zip(s_ecef("(lat1+0.1)", "(lon1+0.1)", "50"), s_ecef("lat1", "lon1", "0"), strict=True))
scalar(
    'enu',
    {
        "east": (lambda: ENU()[0], f"{DX}*-sin(radians(lon1)) + {DY}*cos(radians(lon1))"),
        "north": (lambda: ENU()[1], f"{DX}*-sin(radians(lat1))*cos(radians(lon1)) + {DY}*-sin(radians(lat1))*sin(radians(lon1)) + {DZ}*cos(radians(lat1))"),
        "up": (lambda: ENU()[2], f"{DX}*cos(radians(lat1))*cos(radians(lon1)) + {DY}*cos(radians(lat1))*sin(radians(lon1)) + {DZ}*sin(radians(lat1))"),
    }, digits=4,
)
BOX = lambda: geodesy.radius_box(A1(), O1(), K(800.0))
S_DLAT, S_DLON = f"(degrees(800/{R})+1e-12)", f"(CASE WHEN sin(800/{R})/cos(radians(lat1)) >= 1 THEN 180.0 ELSE degrees(asin(least(1.0, sin(800/{R})/cos(radians(lat1))))) END)"
S_WHOLE = f"(lat1-{S_DLAT} <= -90 OR lat1+{S_DLAT} >= 90 OR {S_DLON} >= 180)"
S_BOX = (f"greatest(lat1-{S_DLAT}, -90.0)", f"CASE WHEN {S_WHOLE} THEN -180.0 WHEN lon1-{S_DLON} < -180 THEN lon1-{S_DLON}+360 ELSE lon1-{S_DLON} END", f"least(lat1+{S_DLAT}, 90.0)", f"CASE WHEN {S_WHOLE} THEN 180.0 WHEN lon1+{S_DLON} > 180 THEN lon1+{S_DLON}-360 ELSE lon1+{S_DLON} END")
scalar(
    'radiusbox',
    {
        "south": (lambda: BOX()[0], S_BOX[0]),
        "west": (lambda: BOX()[1], S_BOX[1]),
        "north": (lambda: BOX()[2], S_BOX[2]),
        "east": (lambda: BOX()[3], S_BOX[3]),
    },
)
S_START, S_BACK = s_bearing(*HERE), s_bearing(*BACK)
S_END = s_mod(f"{S_BACK}+180")
S_PEAK = f"degrees(acos(least(1.0, abs(cos(radians(lat1))*sin(radians({S_START}))))))"
S_RISES = f"(({S_START}) < 90 AND ({S_START}) > 0 AND ({S_END}) > 90 AND ({S_END}) < 180 OR ({S_START}) > 270 AND ({S_END}) < 270 AND ({S_END}) > 180)"
S_FALLS = f"(({S_START}) > 90 AND ({S_START}) < 180 AND ({S_END}) < 90 AND ({S_END}) > 0 OR ({S_START}) < 270 AND ({S_START}) > 180 AND ({S_END}) > 270)"
S_SHORT = f"({s_mod('lon2-lon1+180')}-180)"
ARC = lambda: geodesy.arc_box(A1(), O1(), A2(), O2())
scalar(
    'arcbbox',
    {
        "south": (lambda: ARC()[0], f"CASE WHEN {S_FALLS} THEN least(lat1, lat2, -{S_PEAK}) ELSE least(lat1, lat2) END"),
        "west": (lambda: ARC()[1], f"least(lon1, lon1+{S_SHORT})"),
        "north": (lambda: ARC()[2], f"CASE WHEN {S_RISES} THEN greatest(lat1, lat2, {S_PEAK}) ELSE greatest(lat1, lat2) END"),
        "east": (lambda: ARC()[3], f"greatest(lon1, lon1+{S_SHORT})"),
        "vertex": (lambda: geodesy.vertex_latitude(A1(), geodesy.initial_bearing(A1(), O1(), A2(), O2())), f"degrees(acos(least(1.0, abs(sin(radians({s_bearing(*HERE)}))*cos(radians(lat1))))))"),
    },
)
PIECES = lambda: geodesy.dateline_pieces(A1(), O1(), A2(), O2())
scalar(
    'datelinesplit',
    {
        "crosses": (lambda: geodesy.crosses_dateline(O1(), O2()), "CAST(abs(lon2-lon1) > 180 AS BOOLEAN)"),
        "short_delta": (lambda: F.when(F.abs(O2() - O1()) > 180, O2() - O1() - F.signum(O2() - O1()) * 360).otherwise(O2() - O1()), "CASE WHEN abs(lon2-lon1) > 180 THEN lon2-lon1-sign(lon2-lon1)*360 ELSE lon2-lon1 END"),
        "pieces": (lambda: F.size(PIECES()), "CAST(CASE WHEN abs(lon2-lon1) > 180 THEN 2 ELSE 1 END AS INTEGER)"),
        "cut_lat": (lambda: F.when(F.size(PIECES()) == 2, PIECES()[0]["lat2"]), "CASE WHEN lon2-lon1 > 180 THEN lat1+(-180-lon1)/(lon2-lon1-360)*(lat2-lat1) WHEN lon2-lon1 < -180 THEN lat1+(180-lon1)/(lon2-lon1+360)*(lat2-lat1) END"),
        "last_lon": (lambda: F.element_at(PIECES(), -1)["lon1"], "CASE WHEN lon2-lon1 > 180 THEN 180.0 WHEN lon2-lon1 < -180 THEN -180.0 ELSE lon1 END"),
    },
)
NORMAL = lambda: geodesy.cross(geodesy.unit_vector(A1(), O1()), geodesy.unit_vector(A2(), O2()))
U1 = ("cos(radians(lat1))*cos(radians(lon1))", "cos(radians(lat1))*sin(radians(lon1))", "sin(radians(lat1))")
U2 = ("cos(radians(lat2))*cos(radians(lon2))", "cos(radians(lat2))*sin(radians(lon2))", "sin(radians(lat2))")
S_NORMAL = [f"({U1[(i + 1) % 3]}*{U2[(i + 2) % 3]} - {U1[(i + 2) % 3]}*{U2[(i + 1) % 3]})" for i in range(3)]
# the great circle meets the equator where its normal's horizontal part is turned by a right angle
scalar(
    'arcintersect',
    {
        "equator_lon": (lambda: F.when((A1() != A2()) | (O1() != O2()), F.degrees(F.atan2(NORMAL()[0], -NORMAL()[1]))), f"CASE WHEN lat1<>lat2 OR lon1<>lon2 THEN degrees(atan2({S_NORMAL[0]}, -{S_NORMAL[1]})) END"),
    },
)
ARC_ENDS = ((-60.0, -20.0), (70.0, 100.0))
CROSSING = lambda: geodesy.arc_crossing((A1(), O1()), (A2(), O2()), *[(K(a), K(b)) for a, b in ARC_ENDS])


def s_crossing() -> str:
    """The cross product of both planes' normals, either way round, kept where it lies between the ends of both arcs."""
    at = [[math.cos(math.radians(a)) * math.cos(math.radians(b)), math.cos(math.radians(a)) * math.sin(math.radians(b)), math.sin(math.radians(a))] for a, b in ARC_ENDS]
    m = [at[0][(i + 1) % 3] * at[1][(i + 2) % 3] - at[0][(i + 2) % 3] * at[1][(i + 1) % 3] for i in range(3)]
    line = [f"({S_NORMAL[(i + 1) % 3]}*({m[(i + 2) % 3]!r}) - {S_NORMAL[(i + 2) % 3]}*({m[(i + 1) % 3]!r}))" for i in range(3)]
    far = lambda a, b, c, d: s_hav(a, b, c, d)
    on = lambda a, b, c, d: f"abs({far(a, b, 'plat', 'plon')} + {far('plat', 'plon', c, d)} - {far(a, b, c, d)}) <= 0.001"
    ends = [repr(v) for e in ARC_ENDS for v in e]
    return fixtures.sql(f"WITH l AS (SELECT id, lat1, lon1, lat2, lon2, {line[0]} AS x, {line[1]} AS y, {line[2]} AS z FROM places), p AS (SELECT id, lat1, lon1, lat2, lon2, s, degrees(asin(s*z/sqrt(x*x+y*y+z*z))) AS plat, degrees(atan2(s*y, s*x)) AS plon FROM l, (VALUES (1), (-1)) v(s) WHERE x*x+y*y+z*z > 1e-30), h AS (SELECT id, plat, plon FROM p WHERE {on('lat1', 'lon1', 'lat2', 'lon2')} AND {on(*ends)}) SELECT id, round(plat, 6)+0.0 AS lat, round(plon, 6)+0.0 AS lon FROM places LEFT JOIN h USING (id)", "places")


@query("arcintersect_arcs", s_crossing())
def arcintersect_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each great-circle arc crosses a fixed one, null where it doesn't."""
    lat, lon = CROSSING()
    return fixtures.places(spark, sf_dir).select("id", (F.round(lat, 6) + 0.0).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))


scalar(
    'geocircle',
    {
        "cap_km2": (lambda: geodesy.cap_area(F.abs(A1()) * 10 + 1), f"2*pi()*{R}**2*(1-cos((abs(lat1)*10+1)/{R}))"),
        "flat_km2": (lambda: math.pi * F.pow(F.abs(A1()) * 10 + 1, 2), "pi()*(abs(lat1)*10+1)**2"),
    }, digits=3,
)
TRI = lambda: geodesy.triangle_area((A1(), O1()), (A1() + 1.0, O1()), (A1(), O1() + 2.0))
SA, SB, SC = (f"(({s_hav(*q)})/{R})" for q in (("(lat1+1)", "lon1", "lat1", "(lon1+2)"), ("lat1", "lon1", "lat1", "(lon1+2)"), ("lat1", "lon1", "(lat1+1)", "lon1")))
SS = f"(({SA}+{SB}+{SC})/2)"
scalar(
    'sphericalarea',
    {
        "triangle_km2": (lambda: TRI(), f"4*atan(sqrt(greatest(0.0, tan({SS}/2)*tan(({SS}-{SA})/2)*tan(({SS}-{SB})/2)*tan(({SS}-{SC})/2))))*{R}**2"),
        "band": (lambda: geodesy.band_term(A1(), O1(), A2(), O2()), f"radians({s_mod('lon2-lon1+180')}-180)*(2+sin(radians(lat1))+sin(radians(lat2)))"),
    }, digits=3,
)
S_MY = "((1-ln(tan(radians(lat1))+1/cos(radians(lat1)))/pi())/2)"
scalar(
    'mercator',
    {
        "x": (lambda: projections.web_mercator(A1(), O1())[0], "(lon1+180)/360"),
        "y": (lambda: projections.web_mercator(A1(), O1())[1], S_MY),
        "back": (lambda: projections.web_mercator_inverse(*projections.web_mercator(A1(), O1()))[0], "lat1"),
        "inflation": (lambda: projections.area_inflation(A1()), "1/cos(radians(lat1))**2"),
    },
)
S_B = f"(cos(radians(lat1))*sin(radians({s_mod('lon1-9+180')}-180)))"
scalar(
    'transversemercator',
    {
        "x": (lambda: projections.transverse_mercator(A1(), O1(), K(9.0))[0], f"0.9996*{R}*1000*0.5*ln((1+{S_B})/(1-{S_B}))"),
        "y": (lambda: projections.transverse_mercator(A1(), O1(), K(9.0))[1], f"0.9996*{R}*1000*atan2(tan(radians(lat1)), cos(radians({s_mod('lon1-9+180')}-180)))"),
        "scale": (lambda: projections.tm_scale(A1(), O1(), K(9.0)), f"0.9996/sqrt(1-{S_B}**2)"),
    }, digits=3,
)
scalar(
    'gridconvergence',
    {
        "degrees": (lambda: projections.tm_convergence(A1(), O1(), K(9.0)), f"degrees(atan(tan(radians({s_mod('lon1-9+180')}-180))*sin(radians(lat1))))"),
    }, digits=5,
)
scalar(
    'utm',
    {
        "zone": (lambda: projections.utm_zone(A1(), O1()), "CAST(CASE WHEN lat1>=56 AND lat1<64 AND lon1>=3 AND lon1<12 THEN 32 WHEN lat1>=72 AND lat1<84 AND lon1>=0 AND lon1<42 THEN (CASE WHEN lon1<9 THEN 31 WHEN lon1<21 THEN 33 WHEN lon1<33 THEN 35 ELSE 37 END) ELSE least(floor((lon1+180)/6)+1, 60) END AS BIGINT)"),
        "band": (lambda: projections.utm_band(A1()), "substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat1+80)/8)+1 AS BIGINT), 1)"),
    },
)
S_C = "(sin(radians(30))*sin(radians(lat1)) + cos(radians(30))*cos(radians(lat1))*cos(radians(lon1-15)))"
S_E, S_NN = "(cos(radians(lat1))*sin(radians(lon1-15)))", "(cos(radians(30))*sin(radians(lat1)) - sin(radians(30))*cos(radians(lat1))*cos(radians(lon1-15)))"
for proj, f, k in (("gnomonic", projections.gnomonic, f"(CASE WHEN {S_C} > 1e-12 THEN 1/{S_C} END)"), ("azimuthalequidistant", projections.azimuthal_equidistant, f"(acos({S_C})/sin(acos({S_C})))"), ("lambertazimuthal", projections.lambert_azimuthal, f"sqrt(2/(1+{S_C}))")):
    scalar(
        proj,
        {
            "x": (lambda f=f: f(A1(), O1(), K(30.0), K(15.0))[0], f"{k}*{S_E}"),
            "y": (lambda f=f: f(A1(), O1(), K(30.0), K(15.0))[1], f"{k}*{S_NN}"),
        }, digits=5,
    )
scalar(
    'equalarea',
    {
        "cyl_x": (lambda: projections.lambert_cylindrical(A1(), O1())[0], "radians(lon1)"),
        "cyl_y": (lambda: projections.lambert_cylindrical(A1(), O1())[1], "sin(radians(lat1))"),
        "sin_x": (lambda: projections.sinusoidal(A1(), O1())[0], "radians(lon1)*cos(radians(lat1))"),
    },
)
STEP = 1e-4
MERC = lambda: (projections.web_mercator(A1(), O1()), projections.web_mercator(A1() + STEP, O1()), projections.web_mercator(A1(), O1() + STEP))
TIS = lambda: projections.tissot(*MERC()[0], *MERC()[1], *MERC()[2], A1(), STEP)
scalar(
    'tissot',
    {
        "h": (lambda: TIS()[0] * 2 * math.pi, "1/cos(radians(lat1+0.00005))"),
        "k": (lambda: TIS()[1] * 2 * math.pi, "1/cos(radians(lat1))"),
    }, digits=4,
)
scalar(
    'sagitta',
    {
        "km": (lambda: F.pow(geodesy.haversine(A1(), O1(), A1(), O1() + 1), 2) * F.abs(F.tan(F.radians(A1()))) / (8 * geodesy.EARTH_RADIUS_KM), f"({s_hav('lat1', 'lon1', 'lat1', '(lon1+1)')})**2*abs(tan(radians(lat1)))/(8*{R})"),
    },
)

T12 = lambda: codes.tile(A1(), O1(), 12)
S_TX, S_TY = "least(CAST(trunc((lon1+180)/360*4096) AS BIGINT), 4095)", f"least(CAST(trunc({S_MY}*4096) AS BIGINT), 4095)"
scalar(
    'slippytile',
    {
        "x": (lambda: T12()[0], f"CAST({S_TX} AS BIGINT)"),
        "y": (lambda: T12()[1], f"CAST({S_TY} AS BIGINT)"),
        "metres": (lambda: codes.ground_resolution(A1(), 12), "cos(radians(lat1))*2*pi()*6378137/(256*4096)"),
        "south": (lambda: codes.tile_bounds(*T12(), 12)[0], f"degrees(atan(sinh(pi()*(1-2*({S_TY}+1)/4096))))"),
    },
)
scalar(
    'quadkey',
    {
        "key": (lambda: codes.quadkey(*T12(), 12), "concat(" + ", ".join(f"CAST((({S_TX})>>{b})&1 + 2*((({S_TY})>>{b})&1) AS VARCHAR)".replace("CAST(((", "CAST((((").replace("&1 + 2", "&1) + 2") for b in reversed(range(12))) + ")"),
    },
)
@query("quadkey_tiles", fixtures.sql(f"SELECT id, CAST({S_TX} AS BIGINT) AS x, CAST({S_TY} AS BIGINT) AS y, CAST(({S_TX})//2 AS BIGINT) AS parent_x, CAST(({S_TY})*2+1 AS BIGINT) AS child_y FROM places", "places"))
def quadkey_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles back from keys, their parents and their last children; keys are a column of their own first, so each is made once."""
    k = fixtures.places(spark, sf_dir).select("id", codes.quadkey(*T12(), 12).alias("key"))
    k = k.select("id", "key", codes.quadkey_parent(F.col("key")).alias("up"), codes.quadkey_children(F.col("key"))[3].alias("down"))
    x, y = codes.quadkey_tile(F.col("key"), 12)
    return k.select("id", x.alias("x"), y.alias("y"), codes.quadkey_tile(F.col("up"), 11)[0].alias("parent_x"), codes.quadkey_tile(F.col("down"), 13)[1].alias("child_y"))


scalar(
    'viewport',
    {
        "metres": (lambda: codes.metres_per_pixel(A1(), 7.0), "40075016.686*cos(radians(lat1))/(256*128)"),
        "bar": (lambda: codes.metres_per_pixel(A1(), 7.0) * 100, "40075016.686*cos(radians(lat1))/(256*128)*100"),
    },
)


PIXELS = lambda: codes.to_pixels(A1(), O1(), 7.0)
S_PX, S_PY = "(lon1+180)/360*32768", "(1-ln(tan(radians(lat1))+1/cos(radians(lat1)))/pi())/2*32768"
S_PY0, S_PY1 = (f"(1-ln(tan(radians({a}))+1/cos(radians({a})))/pi())/2*256" for a in ("(lat1+id%3+0.1)", "lat1"))
scalar(
    'viewport_pixels',
    {
        "px": (lambda: PIXELS()[0], S_PX),
        "py": (lambda: PIXELS()[1], S_PY),
        "lat_back": (lambda: codes.from_pixels(*PIXELS(), 7.0)[0], "lat1"),
        "lon_back": (lambda: codes.from_pixels(*PIXELS(), 7.0)[1], "lon1"),
        "zoom": (lambda: codes.fitting_zoom(A1(), O1(), A1() + F.col("id") % 3 + 0.1, O1() + F.col("id") % 5 + 0.1, 800, 600), f"CAST(greatest(0, floor(log2(least(800.0/((id%5+0.1)/360*256), 600.0/({S_PY1}-{S_PY0}))))) AS BIGINT)"),
    }, digits=5,
)


@query("geocircle_rim", fixtures.sql(f"WITH k AS (SELECT id, lat1, lon1, (abs(lat1)*10+1)/{R} AS d, i, radians(i*10.0) AS t FROM places, range(36) q(i)), p AS (SELECT *, asin(sin(radians(lat1))*cos(d)+cos(radians(lat1))*sin(d)*cos(t)) AS p2 FROM k), l AS (SELECT *, degrees(radians(lon1)+atan2(sin(t)*sin(d)*cos(radians(lat1)), cos(d)-sin(radians(lat1))*sin(p2)))+540 AS l2 FROM p) SELECT id, i::INT AS i, round(degrees(p2), 6)+0.0 AS lat, round(l2-360*floor(l2/360)-180, 6)+0.0 AS lon FROM l", "places"))
def geocircle_rim(spark: SparkSession, d: str) -> DataFrame:
    """Thirty-six points of the circle round each place."""
    p = fixtures.places(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(35))))
    lat, lon = geodesy.destination(A1(), O1(), F.col("i") * 10.0, F.abs(A1()) * 10 + 1)
    return p.select("id", "i", (F.round(lat, 6) + 0.0).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))


def s_pick(alphabet: str, index: str) -> str:
    return f"substr('{alphabet}', CAST({index} AS BIGINT)+1, 1)"


S_GX, S_GY = "CAST(least(floor((lon1+180)/360*32768), 32767) AS BIGINT)", "CAST(least(floor((lat1+90)/180*32768), 32767) AS BIGINT)"


def s_geohash(gx: str, gy: str) -> str:
    out = []
    for k in range(6):
        bits = [f"((({gx if b % 2 == 0 else gy})>>{14 - b // 2})&1)*{1 << 4 - b % 5}" for b in range(5 * k, 5 * k + 5)]
        out.append(s_pick(codes.GEOHASH_LETTERS, "(" + " + ".join(bits) + ")"))
    return "concat(" + ", ".join(out) + ")"


scalar(
    'geohash',
    {
        "hash": (lambda: codes.geohash(A1(), O1(), 6), s_geohash(S_GX, S_GY)),
    },
)
@query("geohash_bounds", fixtures.sql(f"SELECT id, round(({S_GY}+0.5)*180/32768-90, 6)+0.0 AS lat, round(({S_GX}+0.5)*360/32768-180, 6)+0.0 AS lon, round((({S_GY})//8)*180/4096.0-90, 6)+0.0 AS south5, round((({S_GX})//4+1)*360/8192.0-180, 6)+0.0 AS east5 FROM places", "places"))
def geohash_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and edges back from codes; codes are a column of their own first, so each is made once."""
    h = fixtures.places(spark, sf_dir).select("id", codes.geohash(A1(), O1(), 6).alias("six"), codes.geohash(A1(), O1(), 5).alias("five"))
    (lat, lon), five = codes.middle(codes.geohash_bounds(F.col("six"), 6)), codes.geohash_bounds(F.col("five"), 5)
    return h.select("id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in (("lat", lat), ("lon", lon), ("south5", five[0]), ("east5", five[3]))])


S_STEPS = {"n": (1, 0), "ne": (1, 1), "e": (0, 1), "se": (-1, 1), "s": (-1, 0), "sw": (-1, -1), "w": (0, -1), "nw": (1, -1)}
@query("geohashneighbors", fixtures.sql("SELECT id, " + ", ".join(s_geohash(f"(({S_GX}+{east}+32768)%32768)", f"greatest(least({S_GY}+({north}), 32767), 0)") + f" AS {name}" for name, (north, east) in S_STEPS.items()) + " FROM places", "places"))
def geohashneighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight codes round each place's; the three rows and columns of cells are columns of their own first."""
    rows = [codes.geohash_step(A1(), O1(), 6, k, 0)[0].alias(f"lat{k + 1}") for k in (-1, 0, 1)]
    cols = [codes.geohash_step(A1(), O1(), 6, 0, k)[1].alias(f"lon{k + 1}") for k in (-1, 0, 1)]
    p = fixtures.places(spark, sf_dir).select("id", *rows, *cols)
    return p.select("id", *[codes.geohash(F.col(f"lat{north + 1}"), F.col(f"lon{east + 1}"), 6).alias(name) for name, (north, east) in S_STEPS.items()])


def s_plus() -> str:
    a, b, out = "(least(lat1, 90-1e-9)+90)", "(lon1+180)", []
    for step in codes.PLUS_STEPS:
        i, j = f"floor({a}/{step!r})", f"floor({b}/{step!r})"
        out += [s_pick(codes.PLUS_LETTERS, i), s_pick(codes.PLUS_LETTERS, j)]
        if len(out) == 8:
            out.append("'+'")
        a, b = f"({a}-{i}*{step!r})", f"({b}-{j}*{step!r})"
    return "concat(" + ", ".join(out) + ")"


def s_plus_south() -> str:
    """The sum of the steps' whole multiples, as the code takes them."""
    a, parts = "(least(lat1, 90-1e-9)+90)", []
    for step in codes.PLUS_STEPS:
        parts.append(f"floor({a}/{step!r})*{step!r}")
        a = f"({a}-floor({a}/{step!r})*{step!r})"
    return "-90 + " + " + ".join(parts)


scalar(
    'pluscode',
    {
        "code": (lambda: codes.plus_code(A1(), O1()), s_plus()),
        "south": (lambda: codes.plus_bounds(codes.plus_code(A1(), O1()))[0], s_plus_south()),
        "inside": (lambda: codes.within(A1(), O1(), tuple(b + e for b, e in zip(codes.plus_bounds(codes.plus_code(A1(), O1())), (-1e-9, -1e-9, 1e-9, 1e-9), strict=True))), "CAST(TRUE AS BOOLEAN)"),
    },
)
S_LA, S_LB = "(lon1+180)", "(lat1+90)"
S_LA2, S_LB2 = f"({S_LA}-floor({S_LA}/20)*20)", f"({S_LB}-floor({S_LB}/10)*10)"
S_LA3, S_LB3 = f"({S_LA2}-floor({S_LA2}/2)*2)", f"({S_LB2}-floor({S_LB2}/1)*1)"
scalar(
    'maidenhead',
    {
        "locator": (lambda: codes.locator(A1(), O1(), 3), f"concat({s_pick(codes.LETTERS, f'floor({S_LA}/20)')}, {s_pick(codes.LETTERS, f'floor({S_LB}/10)')}, CAST(CAST(floor({S_LA2}/2) AS BIGINT) AS VARCHAR), CAST(CAST(floor({S_LB2}/1) AS BIGINT) AS VARCHAR), {s_pick(codes.LETTERS, f'floor({S_LA3}/{5.0 / 60.0!r})')}, {s_pick(codes.LETTERS, f'floor({S_LB3}/{2.5 / 60.0!r})')})"),
        "lat": (lambda: codes.middle(codes.locator_bounds(codes.locator(A1(), O1(), 3), 3))[0], f"floor({S_LB}/10)*10 + floor({S_LB2}) + floor({S_LB3}/{2.5 / 60.0!r})*{2.5 / 60.0!r} - 90 + {1.25 / 60.0!r}"),
        "lon": (lambda: codes.middle(codes.locator_bounds(codes.locator(A1(), O1(), 3), 3))[1], f"floor({S_LA}/20)*20 + floor({S_LA2}/2)*2 + floor({S_LA3}/{5.0 / 60.0!r})*{5.0 / 60.0!r} - 180 + {2.5 / 60.0!r}"),
    },
)
IX = lambda: X().cast('long')
IY = lambda: Y().cast('long')
S_MORTON = " + ".join(f"(((CAST(trunc(x) AS BIGINT)>>{b})&1)<<{2 * b}) + (((CAST(trunc(y) AS BIGINT)>>{b})&1)<<{2 * b + 1})" for b in range(10))
scalar(
    'morton',
    {
        "code": (lambda: codes.interleaved(IX(), IY(), 10), f"CAST({S_MORTON} AS BIGINT)"),
        "x_back": (lambda: codes.deinterleaved(codes.interleaved(IX(), IY(), 10), 10)[0], "CAST(trunc(x) AS BIGINT)"),
    }, source='points',
)
scalar(
    'mapsheets',
    {
        "sheet": (lambda: codes.sheet_name(F.floor(X() / 10), F.floor(Y() / 10)), f"concat(CASE WHEN floor(y/10) < 26 THEN {s_pick(codes.LETTERS, 'floor(y/10)')} ELSE concat({s_pick(codes.LETTERS, 'floor(floor(y/10)/26)-1')}, {s_pick(codes.LETTERS, '(CAST(floor(y/10) AS BIGINT)%26)')}) END, lpad(CAST(CAST(floor(x/10)+1 AS BIGINT) AS VARCHAR), 3, '0'))"),
    }, source='points',
)
CUBE = lambda: codes.cube_cell(A1(), O1(), 8)
V = dict(zip("xyz", (f"({u})" for u in U1), strict=True))
S_FACE = f"(CASE WHEN abs({V['x']}) >= abs({V['y']}) AND abs({V['x']}) >= abs({V['z']}) THEN (CASE WHEN {V['x']} > 0 THEN 0 ELSE 3 END) WHEN abs({V['y']}) >= abs({V['z']}) THEN (CASE WHEN {V['y']} > 0 THEN 1 ELSE 4 END) ELSE (CASE WHEN {V['z']} > 0 THEN 2 ELSE 5 END) END)"
S_U = f"(CASE {S_FACE} WHEN 0 THEN {V['y']}/{V['x']} WHEN 1 THEN -{V['x']}/{V['y']} WHEN 2 THEN -{V['x']}/{V['z']} WHEN 3 THEN {V['z']}/{V['x']} WHEN 4 THEN {V['z']}/{V['y']} ELSE {V['y']}/{V['z']} END)"
S_Q = f"(CASE WHEN {S_U} >= 0 THEN sqrt(1+3*greatest({S_U}, 0.0))-1 ELSE 1-sqrt(1-3*least({S_U}, 0.0)) END)"
scalar(
    's2cell',
    {
        "face": (lambda: CUBE()[0], f"CAST({S_FACE} AS BIGINT)"),
        "i": (lambda: CUBE()[1], f"CAST(least(trunc(({S_Q}+1)/2*256), 255) AS BIGINT)"),
    },
)


def s_hilbert(order: int) -> str:
    """The curve's distance level by level: one table for each."""
    top, levels = (1 << order) - 1, ["h0 AS (SELECT id, CAST(trunc(x) AS BIGINT) AS x0, CAST(trunc(y) AS BIGINT) AS y0, CAST(trunc(x) AS BIGINT) AS x, CAST(trunc(y) AS BIGINT) AS y, CAST(0 AS BIGINT) AS d FROM points)"]
    for k, b in enumerate(reversed(range(order))):
        rx, ry = f"((x>>{b})&1)", f"((y>>{b})&1)"
        fx, fy = (f"(CASE WHEN {rx}=1 THEN {top}-{v} ELSE {v} END)" for v in "xy")
        levels.append(f"h{k + 1} AS (SELECT id, x0, y0, CASE WHEN {ry}=0 THEN {fy} ELSE x END AS x, CASE WHEN {ry}=0 THEN {fx} ELSE y END AS y, d + {1 << 2 * b}*xor(3*{rx}, {ry}) AS d FROM h{k})")
    return f"WITH {', '.join(levels)} SELECT id, CAST(d AS BIGINT) AS d, x0 AS x_back, y0 AS y_back FROM h{order}"


@query("hilbert", fixtures.sql(s_hilbert(10), "points"))
def hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance along the curve, and the cell back from it."""
    p = fixtures.points(spark, sf_dir).select("id", codes.hilbert(IX(), IY(), 10).alias("d"))
    x, y = codes.hilbert_cell(F.col("d"), 10)
    return p.select("id", "d", x.alias("x_back"), y.alias("y_back"))


DAY = lambda: (F.col('id') % 365 + 1).cast('double')
S_EB = "(2*pi()*(id%365+1-81)/364)"
S_EOT = f"(9.87*sin(2*{S_EB}) - 7.53*cos({S_EB}) - 1.5*sin({S_EB}))"
S_DEC = "(23.44*sin(radians(360.0*(284+id%365+1)/365)))"
scalar(
    'equationoftime',
    {
        "minutes": (lambda: astronomy.equation_of_time(DAY()), S_EOT),
        "declination": (lambda: astronomy.declination(DAY()), S_DEC),
        "noon_offset": (lambda: astronomy.noon_offset(DAY(), O1(), K(1.0)), f"4*(15-lon1)-{S_EOT}"),
    },
)
WHEN = lambda: F.col('id') * 3571.0 / 86400.0 + 8000.25
S_D = "(id*3571.0/86400.0+8000.25)"
S_G = f"radians({s_mod(f'357.528+0.9856003*{S_D}')})"
S_L = "radians(" + s_mod(f"{s_mod(f'280.46+0.9856474*{S_D}')} + 1.915*sin({S_G}) + 0.02*sin(2*{S_G})") + ")"
S_OB = f"radians(23.439-4e-07*{S_D})"
S_SUN_DEC = f"asin(sin({S_OB})*sin({S_L}))"
S_RA = s_mod(f"degrees(atan2(cos({S_OB})*sin({S_L}), cos({S_L})))")
S_HA = f"radians({s_mod(f'280.46061837+360.98564736629*{S_D}+lon1')} - {S_RA})"
S_ALT = f"degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat1))*sin({S_SUN_DEC}) + cos(radians(lat1))*cos({S_SUN_DEC})*cos({S_HA})))))"
scalar(
    'sunposition',
    {
        "elevation": (lambda: astronomy.sun_elevation(WHEN(), A1(), O1()), S_ALT),
        "declination": (lambda: F.degrees(astronomy.sun_equatorial(WHEN())[1]), f"degrees({S_SUN_DEC})"),
        "azimuth": (lambda: astronomy.sun_azimuth(WHEN(), A1(), O1()), s_mod(f"degrees(atan2(-sin({S_HA}), tan({S_SUN_DEC})*cos(radians(lat1))-sin(radians(lat1))*cos({S_HA})))")),
    }, digits=4,
)
S_MINUTE = f"WITH e AS (SELECT id, m, {S_ALT.replace(S_D, '(id%365+m/1440.0)')} AS high, {s_mod(f'degrees(atan2(-sin({S_HA}), tan({S_SUN_DEC})*cos(radians(lat1))-sin(radians(lat1))*cos({S_HA})))').replace(S_D, '(id%365+m/1440.0)')} AS azimuth FROM places, range(1440) q(m)), w AS (SELECT *, lag(high) OVER w AS before, lead(high) OVER w AS after FROM e WINDOW w AS (PARTITION BY id ORDER BY m)) SELECT id, CAST(arg_min(m, (-round(high, 9), m)) AS BIGINT) AS noon, round(arg_min(azimuth, m) FILTER (WHERE before < 0 AND high >= 0), 4) AS rise, round(arg_max(azimuth, m) FILTER (WHERE high >= 0 AND after < 0), 4) AS set FROM w GROUP BY id"


@query("sunposition_day", fixtures.sql(S_MINUTE, "places"))
def sunposition_day(spark: SparkSession, d: str) -> DataFrame:
    """Noon, sunrise and sunset of a day of 2000 at each place."""
    day = dealt_out(fixtures.places(spark, d)).select("id", astronomy.sun_day((F.col("id") % 365).cast("double"), A1(), O1()).alias("s"))
    return day.select("id", "s.noon", F.round("s.rise", 4).alias("rise"), F.round("s.set", 4).alias("set"))
S_DAYLEN = "(CASE WHEN -tan(radians(lat1))*tan(radians({d})) >= 1 THEN 0.0 WHEN -tan(radians(lat1))*tan(radians({d})) <= -1 THEN 24.0 ELSE degrees(acos(greatest(-1.0, least(1.0, -tan(radians(lat1))*tan(radians({d}))))))*2/15 END)".replace("{d}", S_DEC)
scalar(
    'solarradiation',
    {
        "day_hours": (lambda: astronomy.day_length(DAY(), A1()), S_DAYLEN),
    },
)
COVER = "WITH b AS (SELECT id, CAST(floor(min_x) AS BIGINT) AS x0, CAST(floor(min_y) AS BIGINT) AS y0, CAST(floor(max_x) AS BIGINT) AS x1, CAST(floor(max_y) AS BIGINT) AS y1 FROM boxes), t AS (SELECT b.*, x0+i AS x, y0+j AS y FROM b, range(48) p(i), range(48) q(j) WHERE x0+i <= x1 AND y0+j <= y1), k AS (SELECT id, x, y, max(s) AS s FROM t, range(12) q(s) WHERE (x >> s) << s >= x0 AND (((x >> s)+1) << s)-1 <= x1 AND (y >> s) << s >= y0 AND (((y >> s)+1) << s)-1 <= y1 GROUP BY id, x, y), c AS (SELECT DISTINCT id, s, x >> s AS i, y >> s AS j FROM k) SELECT id, CAST(11-s AS INTEGER) AS level, list_reduce(list_prepend('', list_transform(range(11-s), lambda n: CAST(((i >> (10-s-n)) & 1)+2*((j >> (10-s-n)) & 1) AS VARCHAR))), lambda a, b: a || b) AS key FROM c"


@query("quadkey_cover", fixtures.sql(COVER, "boxes"))
def quadkey_cover(spark: SparkSession, d: str) -> DataFrame:
    """The fewest quadkeys that make up the tiles under each box."""
    box = [F.floor(c).cast("long") for c in ("min_x", "min_y", "max_x", "max_y")]
    return dealt_out(fixtures.boxes(spark, d)).select("id", F.explode(codes.quadkey_cover(*box, 11)).alias("k")).select("id", "k.level", "k.key")


BEAM = f"WITH h AS (SELECT id, radians(lat1) AS p, radians({S_DEC}) AS d, radians(id%50+0.0) AS b, radians(id*7%360+0.0) AS g, radians(m*2/4.0-180) AS w FROM places, range(720) q(m)), u AS (SELECT *, sin(p)*sin(d)+cos(p)*cos(d)*cos(w) AS up FROM h), f AS (SELECT *, -cos(d)*sin(w)*sin(b)*sin(g)+(cos(p)*sin(d)-sin(p)*cos(d)*cos(w))*sin(b)*cos(g)+up*cos(b) AS facing FROM u) SELECT id, round(1361.0*120/1e6*sum(CASE WHEN up > 0 AND facing > 0 THEN facing ELSE 0 END), 5) AS bare, round(1361.0*120/1e6*sum(CASE WHEN up > 0 AND facing > 0 THEN facing*pow(0.7, 1/up) ELSE 0 END), 5) AS beam FROM f GROUP BY id"


@query("solarradiation_beam", fixtures.sql(BEAM, "places"))
def solarradiation_beam(spark: SparkSession, d: str) -> DataFrame:
    """A day's direct light on a slope at each place, above the air and below it."""
    beam = lambda t: astronomy.daily_beam(DAY(), A1(), (F.col("id") % 50).cast("double"), (F.col("id") * 7 % 360).cast("double"), t)
    return dealt_out(fixtures.places(spark, d)).select("id", F.round(beam(None), 5).alias("bare"), F.round(beam(0.7), 5).alias("beam"))



scalar(
    'radiohorizon',
    {
        "km": (lambda: astronomy.radio_horizon_km(F.abs(A1()) + 1), "sqrt(2*(4.0/3)*6371008.8*(abs(lat1)+1))/1000"),
        "fresnel_m": (lambda: astronomy.fresnel_radius(K(3000000000.0), F.abs(A1()) * 100 + 1, K(5000.0)), "sqrt(299792458.0/3.0e9*(abs(lat1)*100+1)*5000/((abs(lat1)*100+1)+5000))"),
    },
)
