"""All queries and SQL of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import extras, landscape, places, rasters, records, ruling, scalars, surface, water

MODULES = [records, scalars, rasters, ruling, water, places, extras, landscape, surface]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return records.p4_profile(spark, d)
