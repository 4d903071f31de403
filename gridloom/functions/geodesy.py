"""Geodesy on the sphere and the WGS84 ellipsoid, as column expressions: whole-stage codegen, no Python in tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
EARTH_RADIUS_KM = 6371.0088
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
WGS84_E2 = 1.0 - WGS84_B * WGS84_B / (WGS84_A * WGS84_A)


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


def checked(lat: Column, lon: Column) -> Column:
    """``lat``, or an error where the position is off the globe."""
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), lat).otherwise(F.raise_error(F.lit("a position lies off the globe")).cast("double"))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def normalized(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Latitudes beyond a pole come back on the other side."""
    a = wrap_longitude(lat)
    over = F.abs(a) > 90
    return F.when(a > 90, 180.0 - a).when(a < -90, -180.0 - a).otherwise(a), wrap_longitude(F.when(over, lon + 180.0).otherwise(lon))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance; the argument of the arc sine is held at 1, which an ulp may exceed near the antipode."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * radius)


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    x = F.radians(lon2 - lon1) * F.cos((F.radians(lat1) + F.radians(lat2)) / 2)
    return F.hypot(x, F.radians(lat2 - lat1)) * radius


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def final_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.pmod(initial_bearing(lat2, lon2, lat1, lon1) + 180.0, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, km: Column, radius: float = EARTH_RADIUS_KM) -> tuple[Column, Column]:
    d, t, p = km / radius, F.radians(bearing), F.radians(lat)
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    l2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.pmod(F.degrees(l2) + 540.0, F.lit(360.0)) - 180.0


def antipode(lat: Column, lon: Column) -> tuple[Column, Column]:
    return -lat, F.when(lon <= 0, lon + 180.0).otherwise(lon - 180.0)


def rhumb_parts(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column]:
    d = F.radians(lon2 - lon1)
    short = F.when(F.abs(d) > math.pi, d - F.signum(d) * (2 * math.pi)).otherwise(d)
    north = lambda lat: F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))
    return F.radians(lat2) - F.radians(lat1), short, north(lat2) - north(lat1)


def rhumb_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dphi, dlam, dpsi = rhumb_parts(lat1, lon1, lat2, lon2)
    q = F.when(F.abs(dpsi) > 1e-12, F.try_divide(dphi, dpsi)).otherwise(F.cos(F.radians(lat1)))
    return F.sqrt(dphi * dphi + q * q * dlam * dlam) * EARTH_RADIUS_KM


def rhumb_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    _, dlam, dpsi = rhumb_parts(lat1, lon1, lat2, lon2)
    return F.pmod(F.degrees(F.atan2(dlam, dpsi)) + 360.0, F.lit(360.0))


def cross_track(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """Signed distance of (lat, lon) from the great circle through both waypoints, right positive."""
    d = haversine(lat1, lon1, lat, lon, 1.0)
    turn = F.radians(initial_bearing(lat1, lon1, lat, lon)) - F.radians(initial_bearing(lat1, lon1, lat2, lon2))
    return F.asin(F.sin(d) * F.sin(turn)) * EARTH_RADIUS_KM


def along_track(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """Distance from the first waypoint to the foot of the perpendicular; has no sign."""
    d = haversine(lat1, lon1, lat, lon, 1.0)
    return F.acos(clamp(F.cos(d) / F.cos(cross_track(lat1, lon1, lat2, lon2, lat, lon) / EARTH_RADIUS_KM))) * EARTH_RADIUS_KM


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def from_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(z, F.hypot(x, y))), F.degrees(F.atan2(y, x))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def intermediate(lat1: Column, lon1: Column, lat2: Column, lon2: Column, fraction: Column) -> tuple[Column, Column]:
    """The point at a fraction of the great circle's way."""
    a, b = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    angle = F.acos(clamp(dot(a, b)))
    wa, wb = F.sin((1 - fraction) * angle) / F.sin(angle), F.sin(fraction * angle) / F.sin(angle)
    return from_vector(*(wa * p + wb * q for p, q in zip(a, b, strict=True)))


def prime_vertical(lat: Column) -> Column:
    return WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.pow(F.sin(F.radians(lat)), 2))


def to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    n, p, q = prime_vertical(lat), F.radians(lat), F.radians(lon)
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1.0 - WGS84_E2) + height) * F.sin(p)


def geocentric_latitude(lat: Column) -> Column:
    return F.degrees(F.atan((1.0 - WGS84_E2) * F.tan(F.radians(lat))))


def to_enu(p: tuple[Column, ...], lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """An ECEF point in the east-north-up frame of a reference position."""
    d = tuple(a - b for a, b in zip(p, to_ecef(lat, lon, height), strict=True))
    f, g, zero = F.radians(lat), F.radians(lon), F.lit(0.0)
    return dot(d, (-F.sin(g), F.cos(g), zero)), dot(d, (-F.sin(f) * F.cos(g), -F.sin(f) * F.sin(g), F.cos(f))), dot(d, (F.cos(f) * F.cos(g), F.cos(f) * F.sin(g), F.sin(f)))


def finished_box(lat: Column, lon: Column, dlat: Column, dlon: Column) -> tuple[Column, Column, Column, Column]:
    whole = (lat - dlat <= -90.0) | (lat + dlat >= 90.0) | (dlon >= 180.0)
    west = F.when(lon - dlon < -180.0, lon - dlon + 360.0).otherwise(lon - dlon)
    east = F.when(lon + dlon > 180.0, lon + dlon - 360.0).otherwise(lon + dlon)
    return F.greatest(lat - dlat, F.lit(-90.0)), F.when(whole, -180.0).otherwise(west), F.least(lat + dlat, F.lit(90.0)), F.when(whole, 180.0).otherwise(east)


def radius_box(lat: Column, lon: Column, km: Column) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a box that holds the circle: a filter that reaches the scan's statistics."""
    d = km / EARTH_RADIUS_KM
    ratio = F.sin(d) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-300))
    return finished_box(lat, lon, F.degrees(d) + 1e-12, F.when(ratio >= 1.0, 180.0).otherwise(F.degrees(F.asin(clamp(ratio)))))


def box_contains(box: tuple[Column, ...], lat: Column, lon: Column) -> Column:
    south, west, north, east = box
    return lat.between(south, north) & F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))


def vertex_latitude(lat: Column, bearing: Column) -> Column:
    """Highest latitude of the great circle that leaves ``lat`` at ``bearing`` (Clairaut)."""
    return F.degrees(F.acos(clamp(F.abs(F.sin(F.radians(bearing)) * F.cos(F.radians(lat))))))


def crosses_dateline(lon1: Column, lon2: Column) -> Column:
    return F.abs(lon2 - lon1) > 180.0


def cap_area(km: Column) -> Column:
    """Area of a spherical cap of that radius."""
    return 2 * math.pi * EARTH_RADIUS_KM**2 * (1 - F.cos(km / EARTH_RADIUS_KM))


def triangle_area(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Spherical triangle by L'Huilier's theorem."""
    side = lambda p, q: haversine(*p, *q, 1.0)
    sa, sb, sc = side(b, c), side(a, c), side(a, b)
    s = (sa + sb + sc) / 2
    product = F.tan(s / 2) * F.tan((s - sa) / 2) * F.tan((s - sb) / 2) * F.tan((s - sc) / 2)
    return 4 * F.atan(F.sqrt(F.greatest(product, F.lit(0.0)))) * EARTH_RADIUS_KM**2


def band_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """An edge's share of twice the area of a spherical polygon, per square radius."""
    return F.radians(wrap_longitude(lon2 - lon1)) * (2 + F.sin(F.radians(lat1)) + F.sin(F.radians(lat2)))


def arc_crossing(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column], tolerance_km: float = 1e-3) -> tuple[Column, Column]:
    """Where the arcs a to b and c to d cross, as latitude and longitude; null where they don't, or where they lie on one great circle.

    The planes of two great circles meet in a line; of its two ends at most one lies on both short arcs, which its distances to the ends tell.
    """
    n = cross(cross(unit_vector(*a), unit_vector(*b)), cross(unit_vector(*c), unit_vector(*d)))
    size = F.sqrt(dot(n, n))
    first = from_vector(*(F.try_divide(v, size) for v in n))
    second = (-first[0], F.when(first[1] <= 0, first[1] + 180.0).otherwise(first[1] - 180.0))

    def on(p: tuple[Column, Column], s: tuple[Column, Column], e: tuple[Column, Column]) -> Column:
        return F.abs(haversine(*s, *p) + haversine(*p, *e) - haversine(*s, *e)) <= tolerance_km

    def pick(i: int) -> Column:
        return F.when(size < 1e-15, None).when(on(first, a, b) & on(first, c, d), first[i]).when(on(second, a, b) & on(second, c, d), second[i])

    return pick(0), pick(1)


def short_delta(lon1: Column, lon2: Column) -> Column:
    """Signed change of longitude the short way round, in (-180, 180]."""
    d = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return F.when(d == -180.0, 180.0).otherwise(d)


def arc_box(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of a short arc. It reaches past its ends where it passes the great circle's highest or lowest point, which
    the bearings at both ends tell; the east side may lie beyond 180."""
    start = initial_bearing(lat1, lon1, lat2, lon2)
    end = F.pmod(initial_bearing(lat2, lon2, lat1, lon1) + 180.0, F.lit(360.0))
    peak = F.degrees(F.acos(clamp(F.abs(F.cos(F.radians(lat1)) * F.sin(F.radians(start))))))
    rises = (start > 0) & (start < 90) & (end > 90) & (end < 180) | (start > 270) & (end < 270) & (end > 180)
    falls = (start > 90) & (start < 180) & (end > 0) & (end < 90) | (start < 270) & (start > 180) & (end > 270)
    d = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    north, south = F.greatest(lat1, lat2), F.least(lat1, lat2)
    return F.when(falls, F.least(south, -peak)).otherwise(south), F.least(lon1, lon1 + d), F.when(rises, F.greatest(north, peak)).otherwise(north), F.greatest(lon1, lon1 + d)


def dateline_pieces(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The one or two straight pieces of a segment, as structs (lat1, lon1, lat2, lon2): cut where the short way passes longitude 180."""
    d = short_delta(lon1, lon2)
    piece = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, ("lat1", "lon1", "lat2", "lon2"), strict=True)])
    seam = F.when(d > 0, 180.0).otherwise(-180.0)
    cut = lat1 + F.try_divide(seam - lon1, d) * (lat2 - lat1)
    crosses = (lon1 + d > 180.0) | (lon1 + d < -180.0)
    return F.when(crosses, F.array(piece(lat1, lon1, cut, seam), piece(cut, -seam, lat2, lon2))).otherwise(F.array(piece(lat1, lon1, lat2, lon2)))
