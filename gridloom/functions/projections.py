"""Map projections as column expressions. Positions off a map give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geodesy import EARTH_RADIUS_KM, clamp, wrap_longitude

# Fixed values
MERCATOR_LIMIT = 85.05112877980659
UTM_SCALE = 0.9996
UTM_BANDS = "CDEFGHJKLMNPQRSTUVWXX"


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """On the unit square, y down."""
    p = F.radians(lat)
    y = (1 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2
    return (lon + 180.0) / 360.0, F.when(F.abs(lat) <= MERCATOR_LIMIT, y)


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y)))), x * 360.0 - 180.0


def area_inflation(lat: Column) -> Column:
    return 1.0 / F.pow(F.cos(F.radians(lat)), 2)


def transverse_mercator(lat: Column, lon: Column, lon0: Column, k0: float = UTM_SCALE) -> tuple[Column, Column]:
    p, d = F.radians(lat), F.radians(wrap_longitude(lon - lon0))
    b = F.cos(p) * F.sin(d)
    r = k0 * EARTH_RADIUS_KM * 1000
    return F.when(F.abs(b) < 1 - 1e-12, r * 0.5 * F.log((1 + b) / (1 - b))), r * F.atan2(F.tan(p), F.cos(d))


def tm_scale(lat: Column, lon: Column, lon0: Column, k0: float = UTM_SCALE) -> Column:
    b = F.cos(F.radians(lat)) * F.sin(F.radians(wrap_longitude(lon - lon0)))
    return k0 / F.sqrt(1.0 - b * b)


def tm_convergence(lat: Column, lon: Column, lon0: Column) -> Column:
    return F.degrees(F.atan(F.tan(F.radians(wrap_longitude(lon - lon0))) * F.sin(F.radians(lat))))


def utm_zone(lat: Column, lon: Column) -> Column:
    """With the exceptions of south-western Norway and of Svalbard; longitude 180 is in zone 60."""
    plain = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain).cast("long")


def utm_band(lat: Column) -> Column:
    return F.when(lat.between(-80, 84), F.substring(F.lit(UTM_BANDS), (F.floor((lat + 80) / 8) + 1).cast("int"), F.lit(1)))


def centred(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column, Column]:
    """Cosine of the distance to a map's centre, and the east and north parts."""
    p, q, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    return F.sin(q) * F.sin(p) + F.cos(q) * F.cos(p) * F.cos(d), F.cos(p) * F.sin(d), F.cos(q) * F.sin(p) - F.sin(q) * F.cos(p) * F.cos(d)


def gnomonic(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    c, east, north = centred(lat, lon, lat0, lon0)
    return F.when(c > 1e-12, F.try_divide(east, c)), F.when(c > 1e-12, F.try_divide(north, c))


def azimuthal_equidistant(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    c, east, north = centred(lat, lon, lat0, lon0)
    angle = F.acos(clamp(c))
    k = F.when(angle < 1e-15, 1.0).otherwise(F.try_divide(angle, F.sin(angle)))
    return k * east, k * north


def lambert_cylindrical(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon), F.sin(F.radians(lat))


def sinusoidal(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.cos(F.radians(lat)), F.radians(lat)


def lambert_azimuthal(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    c, east, north = centred(lat, lon, lat0, lon0)
    k = F.when(c > -1 + 1e-12, F.sqrt(F.try_divide(F.lit(2.0), 1 + c)))
    return k * east, k * north


def tissot(x: Column, y: Column, x_north: Column, y_north: Column, x_east: Column, y_east: Column, lat: Column, step: float) -> tuple[Column, Column]:
    """Scale along the meridian and the parallel, from a projection taken at the place and a step north and east."""
    d = math.radians(step)
    return F.hypot(x_north - x, y_north - y) / d, F.hypot(x_east - x, y_east - y) / (d * F.cos(F.radians(lat)))
