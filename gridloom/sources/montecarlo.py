"""Monte Carlo climate samples without a random generator: every uniform is a hash of (seed, row, stream).

The result does not depend on partitioning, and any row range can be made again by itself. Draws invert quantile
tables given as (percent, value) points; all of it stays in native columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hashing, scalar
from gridloom.plans.grid import derive

Points = list[tuple[float, float]]
STREAMS = ("elev", "temp", "t_std", "precip", "p_std", "n1", "n2", "variant", "region", "slope")
#: Authored stand-ins for quantile tables that are not public: percent and value.
TABLES: dict[str, Points] = {
    "elev": [(0, -6000.0), (30, -2500.0), (60, -100.0), (70, 50.0), (90, 900.0), (99, 3500.0), (100, 6500.0)],
    "temp": [(0, -25.0), (25, 2.0), (50, 14.0), (75, 24.0), (100, 31.0)],
    "t_std": [(0, 20.0), (50, 500.0), (100, 1900.0)],
    "precip": [(0, 0.0), (25, 300.0), (50, 700.0), (90, 2000.0), (100, 6000.0)],
    "p_std": [(0, 8.0), (50, 55.0), (100, 150.0)],
    "noise": [(0, -0.8), (50, 0.0), (100, 0.8)],
    "slope": [(0, 0.0), (50, 0.1), (90, 0.6), (100, 2.5)],
}


def uniforms(df: DataFrame, seed: int, row: str = "id") -> DataFrame:
    """Adds one uniform column u_<stream> per stream."""
    d = df.withColumns({f"_k_{i}": F.lit(i) for i in range(len(STREAMS))})
    d = hashing.with_hash(d, **{f"_h_{i}": (seed, row, f"_k_{i}") for i in range(len(STREAMS))})
    return d.withColumns({f"u_{s}": hashing.unit(f"_h_{i}") for i, s in enumerate(STREAMS)}).drop(*[f"_{x}_{i}" for i in range(len(STREAMS)) for x in "kh"])


def draw(u: str, points: Points) -> str:
    """Inverse of a cumulative distribution given by its quantiles, as SQL text."""
    return scalar.interp(f"(100 * {u})", points)


def simulate(spark: SparkSession, n: int, seed: int, tables: dict[str, Points] | None = None) -> DataFrame:
    """n sample records (see ``plans.grid.derive``), one per row number."""
    t = tables or TABLES
    d = uniforms(spark.range(n), seed)
    d = d.selectExpr(
        "id", f"{draw('u_elev', t['elev'])} AS elev", f"{draw('u_temp', t['temp'])} AS temp0", f"{draw('u_t_std', t['t_std'])} AS tseason", f"{draw('u_precip', t['precip'])} AS precip0",
        f"{draw('u_p_std', t['p_std'])} AS pcv0", f"{draw('u_n1', t['noise'])} AS n1", f"{draw('u_n2', t['noise'])} AS n2", f"{draw('u_variant', t['noise'])} AS variant", f"{draw('u_region', t['noise'])} AS region", f"{draw('u_slope', t['slope'])} AS slope",
    )
    lapsed = F.least(F.greatest(F.col("temp0") + F.least(scalar.col("lapse_cap", region="region"), F.lit(-0.0065)) * F.greatest("elev", F.lit(0.0)), F.lit(-10.0)), F.lit(40.0))
    d = d.withColumn("lapsed", lapsed).select(
        F.col("id").alias("cell"), (F.col("id") % 1000).alias("c"), F.floor(F.col("id") / 1000).alias("r"), "elev", scalar.col("jitter_temp", temp="lapsed", n1="n1", n2="n2").alias("temp"), "tseason",
        scalar.col("jitter_precip", precip="precip0", n="n1").alias("precip"), (F.col("pcv0") * F.greatest(F.lit(0.0), (185 - 0.04111 * F.col("precip0")) / 185)).alias("pcv"), "variant", "region", "slope", (F.col("n2") > 0.6).alias("coast"),
    )
    return derive(d)
