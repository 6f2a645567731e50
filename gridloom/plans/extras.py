"""Queries over channel curves, searches and Monte Carlo samples (groups E, G, I, J, A19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import channels, drainage
from gridloom.plans import grid
from gridloom.runtime import cut
from gridloom.sources import montecarlo


def i_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest high cell to a point."""
    return channels.nearest_cell(grid.cells(spark, d), "elev > 4500", 4, 40)


def g_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The cell nearest to its class's mean."""
    g = cut(grid.climate(spark, d)).withColumn("k", F.floor(F.col("elev") / 500))
    return channels.representatives(g, "k", ["temp", "precip"], "cell")


def g_deep(spark: SparkSession, d: str) -> DataFrame:
    """Classes that live in depth."""
    g = grid.cells(spark, d).select((F.col("cell") % 37).alias("k"), F.floor(F.col("elev") / 900).alias("depth")).groupBy("k", "depth").agg(F.count("*").alias("n"))
    return channels.deep_classes(g, "k", "depth", "n", 1.2)


def e_bed_target(spark: SparkSession, d: str) -> DataFrame:
    """Bed under lakes and channels."""
    g = cut(grid.climate(spark, d)).withColumns({
        "surface": F.when(F.col("cell") % 5 != 0, F.col("elev") + 2), "lake": F.when(F.col("cell") % 7 == 0, F.col("pcv") / 10).otherwise(0.0),
        "section": F.greatest(F.col("variant"), F.lit(0.0)), "load": (F.col("region") + 0.7) / 1.4, "slope": F.col("pcv") / 500,
    })
    return channels.bed_target(g, 15.0).select("cell", F.round("bed", 5).alias("bed"))


def e_banks(spark: SparkSession, d: str) -> DataFrame:
    """Softened banks."""
    g = cut(grid.climate(spark, d)).withColumns({"section": (F.col("region") + 0.7) / 2, "cut": F.col("elev") - 30})
    return channels.soften_banks(g, "cut", "elev", "section").select("cell", F.round("cut", 6).alias("cut"))


def j_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Rivers over classes."""
    g = grid.climate(spark, d).withColumns({"wet": F.col("precip") > 1200, "class_index": F.floor(F.col("elev") / 700).cast("int")})
    return channels.river_overlay(g, "wet", 26, 27, [0, 3]).select("cell", "class_index")


def j_segments(spark: SparkSession, d: str) -> DataFrame:
    """J16 (tangents) and J17: sampled channel curves."""
    g = cut(grid.climate(spark, d))
    links = cut(drainage.lowest_links(g, "elev", grid.WIDTH))
    up = drainage.dominant_upstream(links, g.select("cell", F.floor(F.col("precip") / 100).alias("acc")))
    both = cut(links.join(up, "cell", "left"))
    centres = cut(g.select("cell", (F.col("r") + 0.5).alias("row"), (F.col("c") + 0.5).alias("col")))
    t = channels.tangents(centres, both)
    nodes = centres.join(t, "cell").join(links, "cell").join(g.select("cell", (F.col("precip") / 1000).alias("acc"), F.col("elev").alias("surface"), (F.col("precip") / 3000).alias("radius")), "cell")
    return channels.segments(nodes).select("cell", "k", *[F.round(x, 6).alias(x) for x in ("row", "col", "flow", "surface", "radius")])


def a_montecarlo(spark: SparkSession, d: str) -> DataFrame:
    """Zone shares and mean moisture of 50,000 simulated samples."""
    s = montecarlo.simulate(spark, 50_000, 7)
    return s.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("moisture"), 6).alias("moisture"), F.round(F.avg(F.col("snowy").cast("int")), 6).alias("snowy"))


QUERIES = {f.__name__: f for f in (i_nearest, g_representatives, g_deep, e_bed_target, e_banks, j_overlay, j_segments, a_montecarlo)}

SQL = {
    "i_nearest": f"WITH {grid.CELLS_SQL} SELECT r, c, greatest(abs(r - 4), abs(c - 40)) AS rings FROM cells WHERE elev > 4500 ORDER BY rings, r, c LIMIT 1",
    "g_representatives": f"WITH {grid.CLIMATE_SQL}, k AS (SELECT *, floor(elev / 500)::BIGINT AS k FROM climate), m AS (SELECT k, avg(temp) AS mt, avg(precip) AS mp FROM k GROUP BY k) SELECT k, cell FROM (SELECT k.k, cell, row_number() OVER (PARTITION BY k.k ORDER BY (temp - mt) * (temp - mt) + (precip - mp) * (precip - mp), cell) AS p FROM k JOIN m ON m.k = k.k) WHERE p = 1",
    "g_deep": f"WITH {grid.CELLS_SQL}, n AS (SELECT cell % 37 AS k, floor(elev / 900) AS depth, count(*) AS n FROM cells GROUP BY ALL) SELECT k FROM n GROUP BY k HAVING max(n) FILTER (depth <> 0) > 1.2 * coalesce(sum(n) FILTER (depth = 0), 0)",
    "j_overlay": f"WITH {grid.CLIMATE_SQL} SELECT cell, CASE WHEN precip > 1200 AND floor(elev / 700) NOT IN (0, 3) THEN CASE WHEN temp < 0 THEN 27 ELSE 26 END ELSE floor(elev / 700)::INT END AS class_index FROM climate",
    "e_bed_target": f"""WITH {grid.CLIMATE_SQL}, a AS (SELECT cell, elev, CASE WHEN cell % 5 <> 0 THEN elev + 2 END AS surface, CASE WHEN cell % 7 = 0 THEN pcv / 10 ELSE 0 END AS lake, greatest(variant, 0) AS p, least(greatest((region + 0.7) / 1.4, 0), 1) AS l, least(greatest((pcv / 500 - 0.035) / 0.18, 0), 1) AS q FROM climate),
 b AS (SELECT *, q * q * (3 - 2 * q) AS st, p * p * (3 - 2 * p) AS s1 FROM a), e AS (SELECT *, s1 * s1 * (3 - 2 * s1) AS rp, 0.28 + 0.12 * (1 - st) AS ed, 1 + (1.2 + 4.65 * power(l, 0.58) - 1) * (1 - 0.7 * st) AS ce FROM b)
SELECT cell, round(CASE WHEN surface IS NULL THEN NULL WHEN lake >= 0.75 THEN surface - least(8, 2 + lake / 15) * 15 WHEN p > 0 THEN greatest(surface - (ed + (ce - ed) * rp) * 15, elev - (1 + 1.5 * sqrt(l) + 3.5 * rp) * (1 - 0.35 * st) * 15) END, 5) AS bed FROM e""",
    "e_banks": f"""WITH {grid.CLIMATE_SQL}, n AS (SELECT a.cell, any_value(a.elev) AS e, any_value((a.region + 0.7) / 2 / 0.34) AS p, count(*) AS k, sum((b.elev - 30) * CASE WHEN b.r <> a.r AND b.c <> a.c THEN 1 / sqrt(2) ELSE 1 END) / sum(CASE WHEN b.r <> a.r AND b.c <> a.c THEN 1 / sqrt(2) ELSE 1 END) AS m FROM climate a JOIN climate b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.cell <> b.cell GROUP BY a.cell)
SELECT cell, round(CASE WHEN k = 8 AND p > 0 AND p < 1 AND m > e - 30 THEN least(e, e - 30 + (m - e + 30) * 0.13 * 4 * p * (1 - p)) ELSE e - 30 END, 6) AS cut FROM n""",
}
