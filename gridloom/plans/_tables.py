"""Table-level preparation that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import clean_name, latest, load


def last_samples(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """``classification_result`` with one row per sample_id (the latest), ``zone`` trimmed and in lower case."""
    df = load(spark, d, "classification_result").select("sample_id", "classified_at", *columns)
    out = latest(df, ["sample_id"], "classified_at", columns).drop("classified_at")
    return out.withColumn("zone", clean_name(F.col("zone"))) if "zone" in columns else out


def cells(spark: SparkSession, d: str, columns: tuple[str, ...] = ("downstream",)) -> DataFrame:
    """``coarse_cells`` with the latest row of each (tile_id, cell)."""
    df = load(spark, d, "coarse_cells").filter("tile_id is not null and cell is not null")
    return latest(df.select("tile_id", "cell", "written_at", *columns), ["tile_id", "cell"], "written_at", list(columns)).drop("written_at")
