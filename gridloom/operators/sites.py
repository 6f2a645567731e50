"""Jittered sites and the eligibility of the 32 surface features at them.

One candidate site per cell of a coarse lattice, placed by its hash. A feature's eligibility is a filter over the
join of sites and raster: a rarity roll or a patch of coherent noise, elevation, slope, class tokens, and for arches a
search for an opposing anchor. Each gate is declared once per feature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hashing
from gridloom.functions.hashing import signed64


@dataclass(frozen=True)
class Feature:
    """Gates of one feature. Heights and slopes in blocks; absent gates are None."""

    cell: int
    salt: int
    tokens: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    chance: float | None = None
    noise: tuple[float, float] | None = None
    slope_most: float | None = None
    slope_least: float | None = None
    lowest: float | None = None
    highest: float | None = None
    dry_bed: bool = False
    under_water: bool = False
    span: tuple[int, int] | None = None
    samples: int = 8
    tolerance: float | None = None
    gap: float | None = None


#: Spacing, salts, name parts of the classes, chances, thresholds.
FEATURES: dict[str, Feature] = {
    "arch": Feature(56, 0xA24C7E57, ("mountain", "hills", "badlands", "mesa", "stony", "peaks"), chance=0.5, slope_least=0.4, dry_bed=True, span=(6, 11), samples=10, tolerance=2, gap=3),
    "balanced_rock": Feature(50, 0x424C414C, ("badlands", "mesa"), chance=0.15, slope_most=0.2, dry_bed=True),
    "basalt_column": Feature(44, 0x42415341, ("badlands", "mesa", "mountain", "peaks"), noise=(200.0, 0.3)),
    "beached_iceberg": Feature(72, 0x42454149, ("frozen", "ice_spikes", "tundra"), chance=0.1, slope_most=0.2),
    "blowhole": Feature(56, 0x424C5748, ("beach", "ocean", "stony"), chance=0.15, slope_least=0.6, lowest=0, highest=6),
    "boulder": Feature(28, 0xB0F1DE12, without=("ocean", "beach", "desert", "badlands", "mesa"), chance=0.35, slope_most=0.25, dry_bed=True),
    "cornice": Feature(36, 0x434F524E, ("snow", "peaks", "frozen", "ice", "grove"), chance=0.2, slope_least=0.5, lowest=90),
    "driftwood": Feature(24, 0x44524946, ("beach", "stony"), chance=0.4, slope_most=0.15, lowest=0, highest=3),
    "fallen_log": Feature(48, 0x46414C4C, ("forest", "taiga", "grove", "old_growth", "plains"), chance=0.3, dry_bed=True, span=(4, 8), gap=2),
    "frozen_waterfall": Feature(48, 0x46525A57, ("frozen", "snow", "ice", "tundra", "ice_spikes"), chance=0.2, slope_least=0.5),
    "fumarole": Feature(48, 0x46554D4C, ("badlands", "mesa", "mountain", "peaks"), noise=(250.0, 0.5), lowest=40),
    "giant_arch": Feature(176, 0x61A47C11E5, ("badlands",), endings=("_wasteland_steppe", "dryland"), chance=0.4, dry_bed=True, span=(14, 48), samples=8),
    "glacial_erratic": Feature(64, 0x474C4345, ("tundra", "ice_spikes", "snow", "frozen", "ice"), chance=0.12, slope_most=0.25, dry_bed=True),
    "grandfather_tree": Feature(80, 0x47524E44, ("forest", "old_growth", "taiga", "grove", "plains"), chance=0.3, slope_most=0.2, noise=(300.0, 0.6)),
    "hoodoo_cluster": Feature(40, 0x400D00A1, ("badlands", "mesa"), noise=(180.0, 0.35)),
    "ice_spike": Feature(36, 0x49434553, ("ice_spikes", "frozen", "tundra"), noise=(160.0, 0.3)),
    "lava_tube_skylight": Feature(80, 0x4C565453, ("badlands", "mesa", "mountain", "peaks"), chance=0.06, slope_most=0.3, lowest=25, noise=(300.0, 0.6)),
    "mesas": Feature(60, 0x4D455341, ("badlands", "mesa"), chance=0.3, slope_most=0.15, lowest=6, dry_bed=True),
    "moss_boulder": Feature(32, 0x4D4F5353, ("swamp", "forest", "old_growth", "grove"), chance=0.25, slope_most=0.3),
    "mushroom_rock": Feature(36, 0x4D569601, ("badlands", "mesa"), chance=0.25, slope_most=0.3, dry_bed=True),
    "natural_bridge": Feature(64, 0x4E415442, ("mountain", "hills", "badlands", "mesa", "stony", "peaks"), chance=0.4, slope_least=0.5, dry_bed=True, span=(8, 14), samples=10, tolerance=2.5, gap=4),
    "needle_peak": Feature(52, 0x4E454544, ("mountain", "peaks", "jagged", "stony", "grove"), noise=(250.0, 0.5), lowest=90),
    "oasis_sinkhole": Feature(80, 0x4F415349, ("desert",), chance=0.08, slope_most=0.08, highest=40, dry_bed=True),
    "petrified_dune": Feature(44, 0x50455444, ("badlands", "mesa", "desert"), chance=0.2, dry_bed=True),
    "pressure_ridge": Feature(40, 0x50524553, ("frozen", "ice_spikes"), chance=0.2),
    "reef_spires": Feature(48, 0x52454546, ("ocean",), without=("frozen",), chance=0.2, under_water=True),
    "root_arch": Feature(56, 0x524F4F54, ("swamp", "forest", "old_growth"), chance=0.15, slope_most=0.2, dry_bed=True),
    "sand_dune_crest": Feature(32, 0x53444352, ("desert", "badlands"), chance=0.3, dry_bed=True),
    "sea_arch": Feature(72, 0x5345414C, ("beach", "ocean", "stony"), chance=0.3, slope_least=0.5, dry_bed=True, noise=(150.0, 0.2), span=(5, 10), samples=10, tolerance=1.5, gap=2.5),
    "sea_stack": Feature(48, 0x53454153, ("beach", "ocean", "coast", "frozen_ocean"), noise=(200.0, 0.4)),
    "talus_scree": Feature(24, 0x54414C55, ("mountain", "peaks", "stony", "hills"), chance=0.4, slope_least=0.6),
    "tide_pool": Feature(40, 0x54494450, ("beach", "ocean", "stony"), chance=0.25, slope_most=0.15, lowest=-1, highest=3),
}


def site_grid(df: DataFrame, seed: int, salt: int, cell: int, margin: int = 0) -> DataFrame:
    """Sites (site, x, z) of lattice cells (cx, cz) given as rows: one per cell, jittered by its hash."""
    span = max(1, cell - 2 * margin)
    d = hashing.with_hash(df.select("cx", "cz"), site=(signed64(seed ^ salt), "cx", "cz"))
    part = lambda k: F.shiftrightunsigned("site", k).bitwiseAND(65535) % span
    return d.select("site", (F.col("cx") * cell + margin + part(16)).alias("x"), (F.col("cz") * cell + margin + part(32)).alias("z"))


def lattice(spark, cell: int, box: tuple[int, int, int, int]) -> DataFrame:  # noqa: ANN001
    """Lattice cells that meet the box of blocks (x0, z0, x1, z1), ends included."""
    x0, z0, x1, z1 = box
    a, b, p, q = x0 // cell, x1 // cell, z0 // cell, z1 // cell
    n = b - a + 1
    return spark.range(n * (q - p + 1)).select((F.col("id") % n + a).alias("cx"), (F.floor(F.col("id") / n) + p).alias("cz"))


FEATURE_DDL = (
    "feature string, own long, cell int, tokens array<string>, without array<string>, endings array<string>, chance double, wave double, threshold double, "
    "slope_most double, slope_least double, lowest double, highest double, dry_bed boolean, under_water boolean, span_lo int, span_hi int, ring int, tolerance double, gap double"
)


def feature_table(spark, seed: int, names: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """The features' gates as rows; own: the world seed mixed with the feature's salt."""
    num = lambda v: None if v is None else float(v)
    rows = [
        (n, signed64(seed ^ f.salt), f.cell, list(f.tokens), list(f.without), list(f.endings), num(f.chance), *((num(f.noise[0]), num(f.noise[1])) if f.noise else (None, None)),
         num(f.slope_most), num(f.slope_least), num(f.lowest), num(f.highest), f.dry_bed, f.under_water, *(f.span or (None, None)), f.samples if f.span else None, num(f.tolerance), num(f.gap))
        for n, f in FEATURES.items() if names is None or n in names
    ]
    return spark.createDataFrame(rows, FEATURE_DDL)


def feature_sites(features: DataFrame, box: tuple[int, int, int, int], *, cell: int | None = None) -> DataFrame:
    """Every feature's jittered sites whose lattice cell meets a box of blocks; ``cell`` overrides the spacing."""
    x0, z0, x1, z1 = box
    size = F.lit(cell) if cell else F.col("cell")
    d = features.withColumn("cell", size.cast("int"))
    d = d.withColumn("cx", F.explode(F.sequence(F.floor(F.lit(x0) / F.col("cell")), F.floor(F.lit(x1) / F.col("cell")))))
    d = d.withColumn("cz", F.explode(F.sequence(F.floor(F.lit(z0) / F.col("cell")), F.floor(F.lit(z1) / F.col("cell")))))
    d = hashing.with_hash(d, site=("own", "cx", "cz"))
    part = lambda k: F.shiftrightunsigned("site", k).bitwiseAND(65535) % F.col("cell")
    return d.withColumns({"x": F.col("cx") * F.col("cell") + part(16), "z": F.col("cz") * F.col("cell") + part(32)}).drop("cx", "cz")


def eligible(sites: DataFrame, raster: DataFrame, *, metres: float = 15.0) -> DataFrame:
    """Sites that pass all gates of their feature, every feature in one pass over the raster.

    sites: from ``feature_sites``; raster: (x, z, elev, slope, key, river). The rarity roll and the noise patch come
    before the join; sites off the raster are dropped. Adds elev. A null gate is passed.
    """
    d = hashing.with_hash(sites, _roll=("own", "x", "z")).filter(F.col("chance").isNull() | (hashing.unit("_roll") < F.col("chance"))).drop("_roll")
    d = d.withColumn("_w", F.coalesce("wave", F.lit(1.0)))
    d = hashing.with_value_noise(d, "_patch", "own", "x", "z", wave=F.col("_w")).filter(F.col("wave").isNull() | (F.col("_patch") > F.col("threshold"))).drop("_patch", "_w")
    j = d.join(raster.select("x", "z", "elev", "slope", "key", "river"), ["x", "z"])
    e, s, k = F.col("elev"), F.col("slope"), F.col("key")
    passes = lambda gate, ok: F.col(gate).isNull() | ok
    named = F.exists("tokens", lambda t: F.contains(k, t)) | F.exists("endings", lambda t: F.endswith(k, t)) | (F.size("tokens") + F.size("endings") == 0)
    dry = F.when(F.col("under_water"), e < 0).otherwise(e > F.least(F.coalesce("lowest", F.lit(0.0)), F.lit(0.0)) * metres)
    high = (F.coalesce("lowest", F.lit(0.0)) <= 0) | (e >= F.col("lowest") * metres)
    ok = dry & high & F.coalesce(named & ~F.exists("without", lambda t: F.contains(k, t)), F.lit(False))
    ok = ok & passes("highest", e <= F.col("highest") * metres) & passes("slope_most", s <= F.col("slope_most") * metres) & passes("slope_least", s >= F.col("slope_least") * metres) & (~F.col("dry_bed") | ~F.col("river"))
    return j.filter(ok).drop("slope", "key", "river")


def opposing(sites: DataFrame, raster: DataFrame, *, metres: float = 15.0) -> DataFrame:
    """For eligible sites of features with a span: the best opposing anchor (bx, bz) and the dip between.

    Candidates stand on a hashed ring; their height differs by at most the tolerance, and the middle dips at least
    by the gap. The deepest dip wins, the first on ties. Sites without an anchor are dropped.
    """
    ring = hashing.with_hash(sites.filter("span_lo is not null").withColumn("_0", F.lit(0)), _ring=("site", "_0", "_0")).drop("_0")
    c = ring.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ring") - 1))).withColumn("_7", F.lit(7))
    c = hashing.with_hash(c, _span=("site", "i", "_7")).drop("_7")
    angle = hashing.unit("_ring") * (2 * math.pi) + F.col("i") * (2 * math.pi) / F.col("ring")
    span = F.col("span_lo") + F.floor(hashing.unit("_span") * (F.col("span_hi") - F.col("span_lo")))
    c = c.withColumns({"bx": (F.col("x") + F.floor(F.cos(angle) * span + 0.5)).cast("long"), "bz": (F.col("z") + F.floor(F.sin(angle) * span + 0.5)).cast("long")})
    half = lambda a, b: F.when((F.col(a) + F.col(b)) < 0, F.ceil((F.col(a) + F.col(b)) / 2)).otherwise(F.floor((F.col(a) + F.col(b)) / 2))
    c = c.withColumns({"mx": half("x", "bx"), "mz": half("z", "bz")})
    b = raster.select(F.col("x").alias("bx"), F.col("z").alias("bz"), F.col("elev").alias("eb"))
    m = raster.select(F.col("x").alias("mx"), F.col("z").alias("mz"), F.col("elev").alias("em"))
    j = c.join(b, ["bx", "bz"]).filter(F.col("eb") > 0).filter(F.col("tolerance").isNull() | (F.abs(F.col("eb") - F.col("elev")) <= F.col("tolerance") * metres))
    j = j.join(m, ["mx", "mz"]).withColumn("dip", (F.col("elev") + F.col("eb")) / 2 - F.col("em")).filter(F.col("gap").isNull() | (F.col("dip") >= F.col("gap") * metres))
    best = j.groupBy("feature", "site", "x", "z", "elev").agg(F.max(F.struct(F.col("dip"), (-F.col("i")).alias("first"), F.col("bx"), F.col("bz"))).alias("b"))
    return best.select("feature", "site", "x", "z", "elev", "b.bx", "b.bz", "b.dip")
