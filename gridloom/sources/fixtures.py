"""Geometry tables derived from the driver's tables; every column is computed, so scans read two columns and filters push down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(key: str, factor: int, modulus: int, span: float, low: float = 0.0):
    """A deterministic scatter of a key over [low, low + span)."""
    return (F.col(key) * factor % modulus).cast("double") * span / modulus + low


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(id, x, y) on [0, 1000)**2, one per customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), spread("c_custkey", 7919, 100003, 1000).alias("x"), spread("c_custkey", 104729, 99991, 1000).alias("y"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sites(sid, sx, sy) on [0, 1000)**2, one per supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), spread("s_suppkey", 15485863, 100003, 1000).alias("sx"), spread("s_suppkey", 32452843, 99991, 1000).alias("sy"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places(id, lat1, lon1, lat2, lon2): two positions per customer, within 80 degrees of latitude."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        spread("c_custkey", 104729, 99991, 160, -80).alias("lat1"),
        spread("c_custkey", 7919, 100003, 360, -180).alias("lon1"),
        spread("c_custkey", 32452843, 99991, 160, -80).alias("lat2"),
        spread("c_custkey", 15485863, 100003, 360, -180).alias("lon2"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes(id, min_x, min_y, max_x, max_y) with sides of 5 to 45."""
    p = points(spark, sf_dir)
    return p.select("id", F.col("x").alias("min_x"), F.col("y").alias("min_y"), (F.col("x") + 5 + F.col("id") % 41).alias("max_x"), (F.col("y") + 5 + F.col("id") * 7 % 41).alias("max_y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments(id, x1, y1, x2, y2) of up to about 40."""
    p = points(spark, sf_dir)
    return p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("id") % 57 - 28).alias("x2"), (F.col("y") + F.col("id") * 7 % 57 - 28).alias("y2"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans(id, lo, hi) on a line."""
    p = points(spark, sf_dir)
    return p.select("id", F.col("x").alias("lo"), (F.col("x") + F.col("id") % 13 * 0.25).alias("hi"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(r, c, v): 64 columns, one cell per part, whole rows only."""
    p = table(spark, sf_dir, "part")
    cells = p.select(F.floor(F.col("p_partkey") / 64).cast("long").alias("r"), (F.col("p_partkey") % 64).alias("c"), (F.col("p_retailprice") + F.col("p_size")).alias("v"), F.col("p_size").cast("long").alias("k"))
    rows = p.agg(F.floor((F.max("p_partkey") + 1) / 64).cast("long").alias("n"))
    return cells.join(F.broadcast(rows), F.col("r") < F.col("n")).drop("n")


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rings(id, ring): one octagon-like ring per supplier, as an array of points; corners at two alternating distances."""
    s = sites(spark, sf_dir)
    corner = lambda i: F.struct((F.col("sx") + F.cos(i * 0.7853981633974483) * F.when(i % 2 == 0, F.col("sid") % 30 + 10.0).otherwise(F.col("sid") % 20 + 5.0)).alias("x"), (F.col("sy") + F.sin(i * 0.7853981633974483) * F.when(i % 2 == 0, F.col("sid") % 30 + 10.0).otherwise(F.col("sid") % 20 + 5.0)).alias("y"))
    return s.select(F.col("sid").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), corner).alias("ring"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixes(track, seq, t, x, y): one track per user; steps of the event's value in the direction of its id."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    walk = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.radians((F.col("event_id") % 360).cast("double"))
    return e.select(
        F.col("user_id").alias("track"),
        F.row_number().over(w).cast("long").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.sum(F.col("value") * F.cos(turn)).over(walk).alias("x"),
        F.sum(F.col("value") * F.sin(turn)).over(walk).alias("y"),
    )


#: The same tables as DuckDB SQL.
SQL = {
    "points": "SELECT c_custkey AS id, CAST(c_custkey*7919%100003 AS DOUBLE)*1000/100003 AS x, CAST(c_custkey*104729%99991 AS DOUBLE)*1000/99991 AS y FROM customer",
    "sites": "SELECT s_suppkey AS sid, CAST(s_suppkey*15485863%100003 AS DOUBLE)*1000/100003 AS sx, CAST(s_suppkey*32452843%99991 AS DOUBLE)*1000/99991 AS sy FROM supplier",
    "places": "SELECT c_custkey AS id, CAST(c_custkey*104729%99991 AS DOUBLE)*160/99991-80 AS lat1, CAST(c_custkey*7919%100003 AS DOUBLE)*360/100003-180 AS lon1, CAST(c_custkey*32452843%99991 AS DOUBLE)*160/99991-80 AS lat2, CAST(c_custkey*15485863%100003 AS DOUBLE)*360/100003-180 AS lon2 FROM customer",
    "boxes": "SELECT id, x AS min_x, y AS min_y, x+5+id%41 AS max_x, y+5+id*7%41 AS max_y FROM points",
    "segments": "SELECT id, x AS x1, y AS y1, x+id%57-28 AS x2, y+id*7%57-28 AS y2 FROM points",
    "spans": "SELECT id, x AS lo, x+id%13*0.25 AS hi FROM points",
    "cells": "SELECT CAST(p_partkey//64 AS BIGINT) AS r, p_partkey%64 AS c, p_retailprice+p_size AS v, CAST(p_size AS BIGINT) AS k FROM part WHERE p_partkey//64 < (SELECT (max(p_partkey)+1)//64 FROM part)",
    "edges": "SELECT sid AS id, i, sx+cos(i*0.7853981633974483)*(CASE WHEN i%2=0 THEN sid%30+10.0 ELSE sid%20+5.0 END)::DOUBLE AS x1, sy+sin(i*0.7853981633974483)*(CASE WHEN i%2=0 THEN sid%30+10.0 ELSE sid%20+5.0 END)::DOUBLE AS y1, sx+cos(((i+1)%8)*0.7853981633974483)*(CASE WHEN (i+1)%2=0 THEN sid%30+10.0 ELSE sid%20+5.0 END)::DOUBLE AS x2, sy+sin(((i+1)%8)*0.7853981633974483)*(CASE WHEN (i+1)%2=0 THEN sid%30+10.0 ELSE sid%20+5.0 END)::DOUBLE AS y2 FROM sites, range(8) q(i)",
    "fixes": "SELECT user_id AS track, row_number() OVER w AS seq, epoch_us(ts)/1e6 AS t, sum(value*cos(radians(event_id%360))) OVER w AS x, sum(value*sin(radians(event_id%360))) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}
NEEDS = {"boxes": ["points"], "segments": ["points"], "spans": ["points"], "edges": ["sites"]}


def sql(body: str, *names: str) -> str:
    """``body`` with the named tables as common table expressions before it."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def recursive(body: str, *names: str) -> str:
    """The same for a body whose tables may be recursive."""
    return sql(body, *names).replace("WITH ", "WITH RECURSIVE ", 1)
