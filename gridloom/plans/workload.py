"""All registered queries; importing this module fills the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import aggregates, catalog, joins, rasters, routes, scalar, shapes

MODULES = (scalar, joins, aggregates, rasters, shapes, routes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["join_within"](spark, sf_dir)
