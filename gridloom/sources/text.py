"""Geometry as text: WKT and GeoJSON, read and written with columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def number(c: Column, decimals: int | None) -> Column:
    return c.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", c)


def wkt_point(x: Column, y: Column, decimals: int | None = None) -> Column:
    return F.concat(F.lit("POINT ("), number(x, decimals), F.lit(" "), number(y, decimals), F.lit(")"))


def wkt_polygon(ring: Column, decimals: int | None = None) -> Column:
    """The first point is repeated at the end."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, lambda p: F.concat(number(p["x"], decimals), F.lit(" "), number(p["y"], decimals))), ", "), F.lit("))"))


def wkt_line(points: Column, decimals: int | None = None) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat(number(p["x"], decimals), F.lit(" "), number(p["y"], decimals))), ", "), F.lit(")"))


def wkt_kind(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))


def wkt_points(text: Column) -> Column:
    """Points of the first ring or line; null for EMPTY and for text that isn't WKT."""
    body = F.regexp_extract(text, r"^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)", 1)
    return F.when(body != "", F.transform(F.split(body, ","), lambda s: F.struct(F.split(F.trim(s), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(s), r"\s+")[1].cast("double").alias("y"))))


def geojson_point(lat: Column, lon: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def geojson_coordinates(text: Column) -> Column:
    """Latitude and longitude of a GeoJSON point; null where the text isn't one."""
    g = F.from_json(text, "type string, coordinates array<double>")
    return F.when(g["type"] == "Point", F.struct(g["coordinates"][1].alias("lat"), g["coordinates"][0].alias("lon")))


def geojson_line(points: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))


def geojson_polygon(ring: Column, clockwise: Column) -> Column:
    """A polygon of one ring: closed, and counter-clockwise as outer rings are, so a clockwise one is turned round."""
    turned = F.when(clockwise, F.reverse(ring)).otherwise(ring)
    closed = F.concat(turned, F.slice(turned, 1, 1))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def geojson_rings(rings: Column, area: Callable[[Column], Column]) -> Column:
    """A polygon of an outer ring and holes (an array of arrays of points): the first counter-clockwise, the others clockwise, all closed. ``area`` gives a
    ring's signed area."""
    turned = lambda r, i: F.when((area(r) > 0) == (i == 0), r).otherwise(F.reverse(r))
    closed = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(F.transform(rings, turned), closed).alias("coordinates")))


def geojson_parsed_rings(text: Column) -> Column:
    """All rings of a polygon, the outer one first, each with its first point once; null for other kinds, text that isn't GeoJSON, and polygons with a ring that
    isn't closed or has fewer than four positions."""
    rings = F.from_json(F.when(F.get_json_object(text, "$.type") == "Polygon", text), "coordinates array<array<array<double>>>")["coordinates"]
    whole = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return F.when((F.size(rings) > 0) & whole, F.transform(rings, lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), point)))


def geojson_feature(geometry: Column, properties: Column) -> Column:
    """A feature from a geometry's text and a struct of properties."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def geojson_geometry(feature: Column) -> Column:
    """The geometry's text of a feature; null where the text isn't one."""
    return F.when(F.get_json_object(feature, "$.type") == "Feature", F.get_json_object(feature, "$.geometry"))


def geojson_points(text: Column) -> Column:
    """Points of a line, or of a polygon's outer ring with the first point once; null for other kinds, for text that isn't GeoJSON, for lines
    of fewer than two points and for rings that aren't closed or have fewer than four positions."""
    kind = F.get_json_object(text, "$.type")
    line = F.from_json(F.when(kind == "LineString", text), "coordinates array<array<double>>")["coordinates"]
    ring = F.get(F.from_json(F.when(kind == "Polygon", text), "coordinates array<array<array<double>>>")["coordinates"], F.lit(0))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    whole = (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(F.size(line) >= 2, F.transform(line, point)).when(whole, F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), point))
