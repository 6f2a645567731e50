"""The tables as a grid: events as cells of rows of 100, with climate columns from hashes; in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hashing, scalar
from gridloom.operators import focal
from gridloom.runtime import load

WIDTH = 100
SEEDS = {"h1": 11, "h2": 12, "h3": 13}

#: Climate columns over hash columns u1..u6 in [0, 1) and elev: shared text, as these only give test data its shape.
CLIMATE = {
    "temp": "28 - 0.0065e0 * greatest(elev, 0.0e0) - 22 * u1 + 4 * u5",
    "tseason": "1200 * u2",
    "precip": "3000 * u3 * u4",
    "pcv": "20 + 90 * u4",
    "variant": "2 * u5 - 1",
    "region": "1.4e0 * u6 - 0.7e0",
    "coast": "elev >= 0 AND elev < 250 AND u6 < 0.5e0",
}
SHAPE = {
    "pet": scalar.text("evapotranspiration", temp="temp", tseason="tseason"),
    "growing": scalar.text("growing_season", temp="temp", tseason="tseason"),
}


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell, r, c, elev): one row per event."""
    e = load(spark, d, "events").select("event_id", "value")
    return e.select(F.col("event_id").alias("cell"), F.floor(F.col("event_id") / WIDTH).cast("long").alias("r"), (F.col("event_id") % WIDTH).alias("c"), (F.col("value") * 10 - 200).alias("elev"))


def climate(spark: SparkSession, d: str) -> DataFrame:
    """The cells with climate columns."""
    g = hashing.with_hash(cells(spark, d), **{n: (s, "c", "r") for n, s in SEEDS.items()})
    low = lambda h: F.col(h).bitwiseAND(65535) / 65536
    g = g.select("cell", "r", "c", "elev", *[hashing.unit(h).alias(f"u{i}") for i, h in enumerate(SEEDS, 1)], *[low(h).alias(f"u{i}") for i, h in enumerate(SEEDS, 4)])
    return g.select("cell", "r", "c", "elev", *[F.expr(e).alias(n) for n, e in CLIMATE.items()])


def slopes(g: DataFrame, pixel: float = 3000.0) -> DataFrame:
    """Adds ``slope``: the gradient of ``elev`` per metre."""
    return focal.sobel(g, "elev", pixel)


def derive(g: DataFrame) -> DataFrame:
    """Climate and slope to the full sample record of named variables."""
    d = g.withColumns({k: F.expr(v) for k, v in SHAPE.items()})
    d = d.withColumn("aridity", scalar.col("aridity", precip="precip", pet="pet"))
    d = d.withColumn("treeMoisture", scalar.col("tree_moisture", aridity="aridity", pcv="pcv"))
    d = d.withColumn("bare", scalar.col("bare_threshold", tree_moisture="treeMoisture"))
    d = d.withColumn("bucket", scalar.col("tree_bucket", tree_moisture="treeMoisture", growing="growing"))
    return d.select(
        "cell", "r", "c", "coast", F.col("elev").alias("elevationM"), F.col("temp").alias("temperatureC"), F.col("tseason").alias("temperatureSeasonality"),
        F.col("precip").alias("precipitationMm"), F.col("pcv").alias("precipitationCv"), F.col("treeMoisture").alias("moisture"), "aridity", "treeMoisture",
        scalar.col("tree_coverage", bucket="bucket", slope="slope", bare="bare", tree_moisture="treeMoisture", variant="variant").alias("treeCoverage"), "slope",
        F.col("growing").alias("growingSeasonDays"), (F.col("elev") < 0).alias("ocean"),
        scalar.col("snowy", elev="elev", snow_temp="(temp + 3 * variant)", precip="precip", slope="slope").alias("snowy"),
        scalar.col("bare_slope", slope="slope", bare="bare", tree_moisture="treeMoisture", variant="variant").alias("bareSlope"),
        (F.col("elev") > 2500).alias("mountain"), (F.greatest(F.col("elev"), F.lit(0.0)) < 200).alias("lowland"),
        F.col("variant").alias("variantNoise"), F.col("region").alias("regionNoise"), scalar.col("zone", elev="elev", coast="coast").alias("zone"),
    ).withColumn("sparsity", F.least(F.greatest(1 - F.col("treeCoverage"), F.lit(0.0)), F.lit(1.0)))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return derive(slopes(climate(spark, d)))


# ------------------------------------------------------------------------------------------------ SQL text

_H, _LAST = hashing.sql_hash_ctes("cells", "hh", {n: (str(s), "c", "r") for n, s in SEEDS.items()})
CELLS_SQL = f"cells AS (SELECT event_id AS cell, event_id // {WIDTH} AS r, event_id % {WIDTH} AS c, value * 10 - 200 AS elev FROM events)"
CLIMATE_SQL = f"""{CELLS_SQL}, {_H}, uu AS (SELECT cell, r, c, elev, {', '.join(f'{hashing.sql_unit(h)} AS u{i}' for i, h in enumerate(SEEDS, 1))}, {', '.join(f'({h} & 65535)::DOUBLE / 65536 AS u{i}' for i, h in enumerate(SEEDS, 4))} FROM {_LAST}),
 climate AS (SELECT cell, r, c, elev, {', '.join(f'{e} AS {n}' for n, e in CLIMATE.items())} FROM uu)"""
_NB = "coalesce({a}.elev, g.elev)"
SLOPE_SQL = f"""{CLIMATE_SQL}, side AS (SELECT *, coalesce(lag(elev) OVER a, elev) AS lf, coalesce(lead(elev) OVER a, elev) AS rt FROM climate WINDOW a AS (PARTITION BY r ORDER BY c)),
 rows3 AS (SELECT *, lf + 2 * elev + rt AS s_, rt - lf AS d_ FROM side),
 sloped AS (SELECT * EXCLUDE (lf, rt, s_, d_), sqrt(power(coalesce(lag(d_) OVER b, d_) + 2 * d_ + coalesce(lead(d_) OVER b, d_), 2) + power(coalesce(lead(s_) OVER b, s_) - coalesce(lag(s_) OVER b, s_), 2)) / 8 / 3000 AS slope FROM rows3 WINDOW b AS (PARTITION BY c ORDER BY r))"""
SAMPLE_SQL = f"""{SLOPE_SQL}, s1 AS (SELECT *, greatest(0, temp + 0.5 * tseason / 100) AS te FROM sloped),
 s2 AS (SELECT *, precip / greatest(1, greatest(250, 250 + 25 * te + 0.7 * te * te)) AS aridity, tseason / 100 * 1.414 AS amp FROM s1),
 s3 AS (SELECT *, aridity * (1 - 0.35 * least(greatest(pcv / 100, 0), 1)) AS tm,
   CASE WHEN amp < 0.1 THEN CASE WHEN temp > 5 THEN 365.0 ELSE 0.0 END WHEN (5 - temp) / amp <= -1 THEN 365 WHEN (5 - temp) / amp >= 1 THEN 0 ELSE 365 * (0.5 - asin(least(greatest((5 - temp) / amp, -1), 1)) / pi()) END AS gs FROM s2),
 s4 AS (SELECT *, tm * least(greatest((gs - 60) / 90, 0), 1) AS eff, 0.7 + 0.49 * least(greatest((tm - 0.35) / 0.45, 0), 1) AS bare FROM s3),
 s5 AS (SELECT *, slope >= bare AND NOT (slope < bare + 0.35 AND tm > 0.15 AND variant > 0.3) AS is_bare,
   CASE WHEN eff < 0.2 THEN 0.0 WHEN eff < 0.5 THEN 0.35 WHEN eff < 0.8 THEN 0.62 WHEN eff < 1.3 THEN 0.85 ELSE 1.0 END AS full_cover FROM s4),
 smp AS (SELECT cell, r, c, coast, elev AS "elevationM", temp AS "temperatureC", tseason AS "temperatureSeasonality", precip AS "precipitationMm", pcv AS "precipitationCv", tm AS moisture, aridity, tm AS "treeMoisture",
   CASE WHEN is_bare THEN 0.0 WHEN slope < bare AND slope >= 0.62 THEN least(full_cover, 0.35) ELSE full_cover END AS "treeCoverage", slope, gs AS "growingSeasonDays",
   elev < 0 AS ocean, (temp + 3 * variant < -2 OR (elev > 800 AND temp + 3 * variant < -0.5)) AND precip > 150 AND NOT (slope > 0.78 AND elev <= 1500) AS snowy, is_bare AS "bareSlope", elev > 2500 AS mountain, greatest(elev, 0) < 200 AS lowland,
   variant AS "variantNoise", region AS "regionNoise", CASE WHEN elev < 0 THEN 'ocean' WHEN coast AND elev <= 2500 THEN 'beach' WHEN elev > 2500 THEN 'mountain' ELSE 'lowland' END AS zone,
   1 - (CASE WHEN is_bare THEN 0.0 WHEN slope < bare AND slope >= 0.62 THEN least(full_cover, 0.35) ELSE full_cover END) AS sparsity FROM s5)"""
