"""Queries over the scalar laws (group B) and the hash and value-noise columns (group C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hashing, scalar
from gridloom.plans import grid, scalars_sql

_T = scalar.text
#: query name: output column to law over the climate columns; each law also stands alone in functions.scalar.
GROUPS: dict[str, dict[str, str]] = {
    "b_encoding": {
        "b01": _T("signed_square", v="(elev / 100)"), "b02": _T("signed_sqrt", v="elev"), "b03": _T("normalise", v="elev", w="(region - 0.1)"),
        "b04": _T("denormalise", v="region", mean=3.5, std=2.0), "b04i": _T("standardise", v="elev", mean=100.0, std=25.0), "b05": _T("clamp", v="elev", lo=0.0, hi=800.0),
        "b25": _T("water_mask", profile="variant", load="region", lake="(elev / 100)"), "b26": _T("quantise_elevation", e="(elev * 10)"), "b27": _T("quantise_surface", e="elev"),
        "b28": _T("quantise_centi", t="temp"), "b29": _T("block_height", m="floor(elev)", res=15.0), "b30": _T("scaled_altitude", y="floor(elev)", s=3.0),
        "b30i": _T("world_altitude", y="floor(elev)", s=3.0), "b31": _T("surface_density", h="elev", y="(elev + variant * 20)"), "b32": _T("blocks_to_metres", b="slope_like", res=15.0),
    },
    "b_curves": {
        "b06": _T("smoothstep", t="((variant + 1) / 2)"), "b07": _T("smooth_range", lo=-0.5, hi=0.5, v="variant"), "b08": _T("lerp", a="temp", b="elev", t="variant"),
        "b09": scalar.interp("elev", [(-200.0, 0.0), (0.0, 5.0), (750.0, 6.0), (3000.0, 40.0)]), "b10": scalar.uniform_noise("variant"),
        "b11": _T("hermite", p0="temp", m0="region", p1="variant", m1="slope_like", t="((variant + 1) / 2)"), "b38": _T("lapse_cap", region="region"), "b39": _T("range_compensation", p="variant", scaled="elev", authored=400.0),
    },
    "b_climate": {
        "b13_pet": _T("evapotranspiration", temp="temp", tseason="tseason"), "b14": _T("growing_season", temp="temp", tseason="tseason"), "b20t": _T("jitter_temp", temp="temp", n1="variant", n2="region"),
        "b20p": _T("jitter_precip", precip="precip", n="variant"), "b20s": _T("snow_noise", n1="variant", n2="region"), "b18": _T("zone", elev="elev", coast="coast"),
    },
    "b_water": {
        "b21": _T("river_density", region="region"), "b22": _T("precip_density", precip="precip"), "b23": _T("runoff", elev="elev", temp="temp", precip="precip", pcv="pcv"), "b23_plain": _T("runoff_plain", elev="elev"),
        "b24": _T("channel_radius", flow="(precip / 100)", elev="elev"), "b24_load": _T("channel_load", flow="(precip / 500)"),
    },
    "b_display": {
        "b33": _T("log_display", v="elev"), "b34": _T("lut_index", t="variant"), "b35": _T("blend", c="temp", a="((variant + 1) / 2)", k=255.0), "b36": _T("round3", v="variant"), "b36j": _T("java_round", v="temp"),
        "b37_div": _T("floor_div", a="(c - 50)", n=7), "b37_mod": _T("floor_mod", a="(c - 50)", n=7), "b37_ceil": _T("ceil_div", a="(c - 50)", n=7), "l16": _T("overlay_alpha", mask="c"), "c25": _T("int_roll", u="((variant + 1) / 2)", lo=3, hi=9), "e25": _T("window_weight", x="(c % 16)", size=16),
    },
}
_TEXT = {"b18"}


def _outputs(group: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" if n in _TEXT else f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in group.items()]


def _scalars(group: str):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        return grid.climate(spark, d).withColumn("slope_like", F.col("pcv") / 60).selectExpr("cell", *_outputs(GROUPS[group]))

    query.__name__ = group
    return query


def b_sample(spark: SparkSession, d: str) -> DataFrame:
    """B13 to B18 as one record of 17 variables."""
    s = grid.samples(spark, d)
    nums = ["aridity", "treeMoisture", "treeCoverage", "sparsity", "slope", "growingSeasonDays"]
    return s.select("cell", "zone", "ocean", "snowy", "bareSlope", "mountain", "lowland", *[F.round(n, 6).alias(n) for n in nums])


# fixed values: seeds of the lattice hash, of the three octaves of ice and of the river bed
HASH_SEED = 0x9E3779B97F4A7C15
ICE_COARSE, ICE_DIAGONAL, ICE_DETAIL = 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x1F83D9ABFB41BD6B
BED_SEED = 0x6A09E667F3BCC909


def c_hash(spark: SparkSession, d: str) -> DataFrame:
    """Lattice hash, its unit and signed forms."""
    g = hashing.with_hash(grid.cells(spark, d), h=(hashing.signed64(HASH_SEED), "c", "r"))
    return g.select("cell", F.col("h").cast("string").alias("h"), hashing.unit("h").alias("u"), hashing.signed("h").alias("s"))


def c_value_noise(spark: SparkSession, d: str) -> DataFrame:
    """Value noise at two wavelengths, seeded by a number and by a class column."""
    g = grid.cells(spark, d).withColumn("k", F.col("cell") % 23)
    g = hashing.with_value_noise(g, "plain", 77, "c", "r", wave=12.5)
    g = hashing.with_value_noise(g, "competition", "k", "c", "r", wave=900.0)
    return g.select("cell", F.round("plain", 9).alias("plain"), F.round("competition", 9).alias("competition"))


def c_integer_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise on an integer spacing, ice kinds from three octaves, bed material from hash bytes."""
    g = grid.cells(spark, d).withColumns({"x": F.col("c") - 40, "z": F.col("r") - 3})
    low24 = lambda h: F.shiftrightunsigned(h, 8).bitwiseAND(0xFFFFFF) / F.lit(16777215.0)
    spec = {"coarse": (hashing.signed64(ICE_COARSE), "x", "z", 19), "diagonal": (hashing.signed64(ICE_DIAGONAL), "xz", "zx", 11), "detail": (hashing.signed64(ICE_DETAIL), "x", "z", 5)}
    g = g.withColumns({"xz": F.col("x") + F.col("z"), "zx": F.col("z") - F.col("x")})
    for n, (seed, x, z, step) in spec.items():
        g = g.withColumns({"_x": F.floor(F.col(x) / step), "_z": F.floor(F.col(z) / step)}).withColumns({"_x1": F.col("_x") + 1, "_z1": F.col("_z") + 1})
        g = hashing.with_hash(g, _a=(seed, "_x", "_z"), _b=(seed, "_x1", "_z"), _c=(seed, "_x", "_z1"), _d=(seed, "_x1", "_z1"))
        fx, fz = (F.col(x) - F.col("_x") * step) / step, (F.col(z) - F.col("_z") * step) / step
        g = g.withColumns({"_fx": fx * fx * (3 - 2 * fx), "_fz": fz * fz * (3 - 2 * fz)})
        mix = lambda p, q: low24(F.col(p)) + (low24(F.col(q)) - low24(F.col(p))) * F.col("_fx")
        g = g.withColumn(n, mix("_a", "_b") + (mix("_c", "_d") - mix("_a", "_b")) * F.col("_fz"))
    g = hashing.with_hash(g, bed=(hashing.signed64(BED_SEED), "x", "z"))
    patch = F.col("coarse") * 0.62 + F.col("diagonal") * 0.28 + F.col("detail") * 0.10
    roll = F.col("bed").bitwiseAND(255)
    return g.select(
        "cell", F.round(patch, 9).alias("patch"), F.when(patch < 0.235, "blue").when(patch < 0.365, "packed").otherwise("plain").alias("ice"),
        F.when((F.col("elev") < 720) & (roll < 96), "sand").when(roll < 38, "clay").otherwise("gravel").alias("bed"),
    )


def c_tile_seed(spark: SparkSession, d: str) -> DataFrame:
    """Jitter of flats and tile seeds."""
    g = grid.cells(spark, d)
    return g.select("cell", hashing.flat_jitter(F.col("r"), F.col("c")).alias("jitter"), hashing.tile_seed(F.lit(-123456789012345), F.col("r"), F.col("c") - 50).cast("string").alias("seed"))


QUERIES = {k: _scalars(k) for k in GROUPS} | {f.__name__: f for f in (b_sample, c_hash, c_value_noise, c_integer_noise, c_tile_seed)}


def _noise_sql(name: str, seed: str, x: str, z: str, wave: str, source: str, prefix: str, unit: str = "signed") -> tuple[str, str]:
    """CTEs adding a value-noise column to a source."""
    base = f"{prefix}b AS (SELECT *, floor({x} / {wave})::BIGINT AS x0_, floor({z} / {wave})::BIGINT AS z0_ FROM {source})"
    h, last = hashing.sql_hash_ctes(f"{prefix}b", f"{prefix}h", {"ha_": (seed, "x0_", "z0_"), "hb_": (seed, "x0_ + 1", "z0_"), "hc_": (seed, "x0_", "z0_ + 1"), "hd_": (seed, "x0_ + 1", "z0_ + 1")})
    val = (lambda v: f"({hashing.sql_unit(v)} * 2 - 1)") if unit == "signed" else (lambda v: f"((({v} >> 8) & 16777215)::DOUBLE / 16777215)")
    f = f"{prefix}f AS (SELECT *, {x} / {wave} - x0_ AS fx0_, {z} / {wave} - z0_ AS fz0_ FROM {last}), {prefix}g AS (SELECT *, fx0_ * fx0_ * (3 - 2 * fx0_) AS fx_, fz0_ * fz0_ * (3 - 2 * fz0_) AS fz_ FROM {prefix}f)"
    mix = lambda p, q: f"({val(p)} + ({val(q)} - {val(p)}) * fx_)"
    out = f"{prefix}o AS (SELECT * EXCLUDE (x0_, z0_, ha_, hb_, hc_, hd_, fx0_, fz0_, fx_, fz_), {mix('ha_', 'hb_')} + ({mix('hc_', 'hd_')} - {mix('ha_', 'hb_')}) * fz_ AS {name} FROM {prefix}g)"
    return ", ".join([base, h, f, out]), f"{prefix}o"


def _value_noise_sql() -> str:
    a, la = _noise_sql("plain", "77", "c", "r", "12.5", "src", "n1")
    b, lb = _noise_sql("competition", "k", "c", "r", "900.0", la, "n2")
    return f"WITH {grid.CELLS_SQL}, src AS (SELECT *, cell % 23 AS k FROM cells), {a}, {b} SELECT cell, round(plain, 9) AS plain, round(competition, 9) AS competition FROM {lb}"


def _integer_noise_sql() -> str:
    a, la = _noise_sql("coarse", str(hashing.signed64(ICE_COARSE)), "x", "z", "19.0", "src", "n1", "low")
    b, lb = _noise_sql("diagonal", str(hashing.signed64(ICE_DIAGONAL)), "(x + z)", "(z - x)", "11.0", la, "n2", "low")
    c, lc = _noise_sql("detail", str(hashing.signed64(ICE_DETAIL)), "x", "z", "5.0", lb, "n3", "low")
    h, lh = hashing.sql_hash_ctes(lc, "bd", {"bedh": (str(hashing.signed64(BED_SEED)), "x", "z")})
    return f"""WITH {grid.CELLS_SQL}, src AS (SELECT *, c - 40 AS x, r - 3 AS z FROM cells), {a}, {b}, {c}, {h}, p AS (SELECT *, coarse * 0.62 + diagonal * 0.28 + detail * 0.10 AS patch, bedh & 255 AS roll FROM {lh})
SELECT cell, round(patch, 9) AS patch, CASE WHEN patch < 0.235 THEN 'blue' WHEN patch < 0.365 THEN 'packed' ELSE 'plain' END AS ice, CASE WHEN elev < 720 AND roll < 96 THEN 'sand' WHEN roll < 38 THEN 'clay' ELSE 'gravel' END AS bed FROM p"""


_CH, _CL = hashing.sql_hash_ctes("cells", "k", {"h": (str(hashing.signed64(HASH_SEED)), "c", "r")})
_M32 = "4294967296::HUGEINT"
_M64 = "18446744073709551616::HUGEINT"
SQL = scalars_sql.SQL | {
    "b_sample": f'WITH {grid.SAMPLE_SQL} SELECT cell, zone, ocean, snowy, "bareSlope", mountain, lowland, ' + ", ".join(f'round("{n}", 6) AS "{n}"' for n in ("aridity", "treeMoisture", "treeCoverage", "sparsity", "slope", "growingSeasonDays")) + " FROM smp",
    "c_hash": f"WITH {grid.CELLS_SQL}, {_CH} SELECT cell, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - {_M64} ELSE h END)::VARCHAR AS h, {hashing.sql_unit('h')} AS u, {hashing.sql_unit('h')} * 2 - 1 AS s FROM {_CL}",
    "c_value_noise": _value_noise_sql(),
    "c_integer_noise": _integer_noise_sql(),
    "c_tile_seed": f"""WITH {grid.CELLS_SQL}, a AS (SELECT cell, r, c, (r * {0x27D4EB2D} + c * {0x165667B1}) % {_M32} AS h FROM cells), b AS (SELECT *, xor(h, h >> 15) AS h2 FROM a), e AS (SELECT *, (h2 * {0x2545F491}) % {_M32} AS h3 FROM b), f AS (SELECT *, xor(h3, h3 >> 13) AS h4 FROM e),
 t AS (SELECT *, ((({hashing.sql_unsigned('-123456789012345')} % {_M64} * {0x9E3779B9}::HUGEINT % {_M64} + r) % {_M64})) AS t1 FROM f), u AS (SELECT *, ({hashing.sql_mul('t1', 0x9E3779B9)} + ((c - 50)::HUGEINT + {_M32}) % {_M32}) % {_M64} AS t2 FROM t)
SELECT cell, ((h4 >> 8) % 24)::INTEGER AS jitter, (CASE WHEN t2 >= 9223372036854775808::HUGEINT THEN t2 - {_M64} ELSE t2 END)::VARCHAR AS seed FROM u""",
}
