"""Queries over sites (G15 to G17 and the 32 features), noise fields (C) and map views (G18, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hashing, noise
from gridloom.operators import focal, sites
from gridloom.plans import grid, noise_sql
from gridloom.plans.ruling import CAT
from gridloom.rules import compile as comp
from gridloom.runtime import cut

SEED = 20240611
#: The grid is read as a raster of so many blocks a side per cell of 25 m; class keys follow the cell number.
KEYS = ["loam:badlands", "loam:stony_peaks", "loam:mesa_hills", "loam:old_growth_forest", "loam:frozen_ocean", "loam:stony_beach", "loam:desert", "loam:ice_spikes", "loam:swamp_grove", "loam:snow_taiga", "loam:ocean", "loam:plains_dryland"]


def _raster(spark: SparkSession, d: str) -> DataFrame:
    """(x, z, elev, slope, key, river) over 100 columns of blocks."""
    g = grid.cells(spark, d).select("cell", "r", "c", F.when(F.col("cell") % 3 == 0, F.col("elev") / 12).otherwise(F.col("elev") / 3).alias("elev"))
    g = focal.step_slope(g, "elev", 2)
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("cell") % len(KEYS) + 1).cast("int"))
    return g.select(F.col("c").alias("x"), F.col("r").alias("z"), "elev", (F.col("slope") / 8).alias("slope"), key.alias("key"), (F.col("cell") % 11 == 0).alias("river"))


def g_sites(spark: SparkSession, d: str) -> DataFrame:
    """Jittered sites that meet a box of blocks."""
    f = sites.FEATURES["boulder"]
    s = sites.site_grid(sites.lattice(spark, f.cell, (-500, -400, 800, 900)), SEED, f.salt, f.cell, 5)
    return s.select(F.col("site").cast("string").alias("site"), "x", "z")


def _eligible(spark: SparkSession, d: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(eligible sites, raster); the lattice is four blocks wide, so that a small raster holds many sites."""
    raster = cut(_raster(spark, d))
    m = raster.agg(F.min("x"), F.min("z"), F.max("x"), F.max("z")).first()
    box = (0, 0, -1, -1) if m[0] is None else tuple(m)
    s = sites.feature_sites(sites.feature_table(spark, SEED, names), box, cell=4)
    return sites.eligible(s, raster), raster


def site_features(spark: SparkSession, d: str) -> DataFrame:
    """Eligible sites of every feature, in one pass; arches still without their anchor."""
    return _eligible(spark, d)[0].select("feature", "x", "z", F.round("elev", 6).alias("elev"))


def site_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The opposing anchors of arches, bridges and logs (checked against numpy in the tests)."""
    e, raster = _eligible(spark, d, [n for n, f in sites.FEATURES.items() if f.span])
    return sites.opposing(cut(e), raster).select("feature", "x", "z", "bx", "bz", F.round("dip", 6).alias("dip"))


def c_fields(spark: SparkSession, d: str) -> DataFrame:
    """The named fields in one pass (checked against numpy in the tests)."""
    g = grid.cells(spark, d).withColumns({"x": F.col("c") * 37, "z": F.col("r") * 53})
    names = [*noise.FIELDS, "region_warped"]
    return g.select("cell", noise.field_set(names, "x", "z").alias("f")).select("cell", *[F.round(f"f.{n}", 9).alias(n) for n in names])


def c_normals(spark: SparkSession, d: str) -> DataFrame:
    """A seeded tile of normals for every cell."""
    t = grid.cells(spark, d).select(F.col("r").alias("ty"), F.col("c").alias("tx"))
    t = t.withColumn("seed", hashing.tile_seed(F.lit(99), F.col("ty"), F.col("tx")))
    return noise.normal_tiles(t, 4)


def c_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """A probe's quantile table."""
    g = grid.cells(spark, d).withColumns({"x": F.col("c") * 37, "z": F.col("r") * 53})
    n = g.select(noise.sample_column(noise.FIELDS["variant"], "x", "z").alias("v"))
    return noise.quantile_table(n, "v", 101).select(F.round("pct", 6).alias("pct"), F.round("v", 9).alias("v"))


def g_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Whether a class wins, is eligible or is absent at each cell."""
    s = cut(grid.samples(spark, d))
    m = comp.select(comp.zone_matches(s, CAT), "c", "r", CAT.default_index, CAT.indices())
    can = F.exists("matches", lambda x: (x["class_index"] == 7) & (x["weight"] > 0))
    return m.select("cell", F.when(can & (F.col("class_index") == 7), "WINS").when(can, "ELIGIBLE").otherwise("NONE").alias("status"))


QUERIES = {f.__name__: f for f in (g_sites, site_features, site_anchors, c_fields, c_normals, c_quantiles, g_overlay)}


def _roll(name: str, salt: int, source: str) -> tuple[str, str]:
    return hashing.sql_hash_ctes(source, name, {"rl": (str(sites.signed64(SEED ^ salt)), "x", "z")})


_B = sites.FEATURES["boulder"]
_SH, _SL = hashing.sql_hash_ctes("lat", "sh", {"site": (str(sites.signed64(SEED ^ _B.salt)), "cx", "cz")})
_M64 = "18446744073709551616::HUGEINT"
SQL = {
    "g_sites": f"WITH lat AS (SELECT cx, cz FROM range({-500 // _B.cell}, {800 // _B.cell + 1}) a(cx), range({-400 // _B.cell}, {900 // _B.cell + 1}) b(cz)), {_SH} SELECT (CASE WHEN site >= 9223372036854775808::HUGEINT THEN site - {_M64} ELSE site END)::VARCHAR AS site, (cx * {_B.cell} + 5 + ((site >> 16) & 65535) % {_B.cell - 10})::BIGINT AS x, (cz * {_B.cell} + 5 + ((site >> 32) & 65535) % {_B.cell - 10})::BIGINT AS z FROM {_SL}",
    "g_overlay": f"WITH {grid.SAMPLE_SQL}, mt AS ({comp.rules_union_sql(CAT, 'smp', {*comp.NUMERIC, *comp.FLAGS, 'variantNoise', 'regionNoise'})}), {comp.winners_sql('mt', 'wa')} SELECT smp.cell, CASE WHEN c7.cell IS NOT NULL AND w.class_index = 7 THEN 'WINS' WHEN c7.cell IS NOT NULL THEN 'ELIGIBLE' ELSE 'NONE' END AS status FROM smp LEFT JOIN (SELECT DISTINCT cell FROM mt WHERE class_index = 7) c7 ON c7.cell = smp.cell LEFT JOIN wawin w ON w.cell = smp.cell",
}


def _feature_sql(name: str) -> str:
    """The gates of one feature written out for another engine (features without an anchor search)."""
    f = sites.FEATURES[name]
    p = f"f{list(sites.FEATURES).index(name)}"
    own = str(sites.signed64(SEED ^ f.salt))
    h, last = hashing.sql_hash_ctes("lat", f"{p}s", {"site": (own, "cx", "cz")})
    ctes = [h, f"{p}x AS (SELECT (cx * 4 + ((site >> 16) & 65535) % 4)::BIGINT AS x, (cz * 4 + ((site >> 32) & 65535) % 4)::BIGINT AS z FROM {last})"]
    at = f"{p}x"
    if f.chance is not None:
        r, last = _roll(f"{p}r", f.salt, at)
        ctes += [r, f"{p}y AS (SELECT x, z FROM {last} WHERE {hashing.sql_unit('rl')} < {f.chance})"]
        at = f"{p}y"
    if f.noise is not None:
        from gridloom.plans.scalars import _noise_sql

        n, last = _noise_sql("patch", own, "x", "z", repr(f.noise[0]), at, f"{p}n")
        ctes += [n, f"{p}z AS (SELECT x, z FROM {last} WHERE patch > {f.noise[1]})"]
        at = f"{p}z"
    gates = ["elev < 0" if f.under_water else f"elev > {f.lowest * 15 if f.lowest is not None and f.lowest < 0 else 0}"]
    want = [f"key LIKE '%{t}%'" for t in f.tokens] + [f"key LIKE '%{t}'" for t in f.endings]
    gates += [f"({' OR '.join(want)})"] if want else []
    gates += [f"key NOT LIKE '%{t}%'" for t in f.without]
    gates += [f"elev >= {f.lowest * 15}"] if f.lowest is not None and f.lowest > 0 else []
    gates += [f"elev <= {f.highest * 15}"] if f.highest is not None else []
    gates += [f"slope <= {f.slope_most * 15}"] if f.slope_most is not None else []
    gates += [f"slope >= {f.slope_least * 15}"] if f.slope_least is not None else []
    gates += ["NOT river"] if f.dry_bed else []
    return ", ".join(ctes), f"SELECT '{name}' AS feature, x, z, round(elev, 6) AS elev FROM {at} JOIN ras USING (x, z) WHERE {' AND '.join(gates)}"


_KEYLIST = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_RASTER_SQL = f"""{grid.CELLS_SQL}, ce AS (SELECT cell, r, c, CASE WHEN cell % 3 = 0 THEN elev / 12 ELSE elev / 3 END AS elev FROM cells), cx_ AS (SELECT *, max(r) OVER (PARTITION BY c) AS hr, max(c) OVER (PARTITION BY r) AS hc FROM ce),
 ras AS MATERIALIZED (SELECT k.c AS x, k.r AS z, k.elev, sqrt(power(CASE WHEN least(k.c + 2, hc) > greatest(k.c - 2, 0) THEN (p.elev - q.elev) / (p.c - q.c) ELSE 0 END, 2) + power(CASE WHEN least(k.r + 2, hr) > greatest(k.r - 2, 0) THEN (s.elev - t.elev) / (s.r - t.r) ELSE 0 END, 2)) / 8 AS slope, {_KEYLIST}[k.cell % {len(KEYS)} + 1] AS key, k.cell % 11 = 0 AS river
 FROM cx_ k JOIN ce p ON p.r = k.r AND p.c = least(k.c + 2, hc) JOIN ce q ON q.r = k.r AND q.c = greatest(k.c - 2, 0) JOIN ce s ON s.c = k.c AND s.r = least(k.r + 2, hr) JOIN ce t ON t.c = k.c AND t.r = greatest(k.r - 2, 0))"""
_PARTS = [_feature_sql(n) for n in sites.FEATURES]
SQL["site_features"] = f"WITH {_RASTER_SQL}, lat AS (SELECT cx, cz FROM range(0, (SELECT max(x) // 4 + 1 FROM ras)) a(cx), range(0, (SELECT max(z) // 4 + 1 FROM ras)) b(cz)), {', '.join(c for c, _ in _PARTS)} {' UNION ALL '.join(q for _, q in _PARTS)}"
SQL["h_status"] = f"SELECT status, count(*) AS n FROM ({SQL['g_overlay']}) GROUP BY status"
_NOISE = f"{grid.CELLS_SQL}, np AS (SELECT cell, c * 37 AS x, r * 53 AS z FROM cells), {noise_sql.fields_sql('np', 'nf', noise.FIELDS, 'x', 'z')}"
_WARPED = f"nq AS (SELECT np.cell, x + {noise.WARP} * warp_x AS x, z + {noise.WARP} * warp_z AS z FROM np JOIN nf USING (cell)), {noise_sql.fields_sql('nq', 'nw', {'region': noise.FIELDS['region']}, 'x', 'z')}"
SQL["c_fields"] = f"WITH {_NOISE}, {_WARPED} SELECT nf.cell, {', '.join(f'round(nf.{n}, 9) AS {n}' for n in noise.FIELDS)}, round(nw.region, 9) AS region_warped FROM nf JOIN nw USING (cell)"
SQL["c_quantiles"] = f"WITH {_NOISE}, k AS (SELECT unnest(range(0, 101)) AS k), q AS (SELECT k, (SELECT quantile_cont(variant, [{', '.join(repr(i / 100) for i in range(101))}]) FROM nf)[k + 1] AS v FROM k) SELECT round(k::DOUBLE, 6) AS pct, round(v, 9) AS v FROM q"


def _anchors_sql() -> str:
    """Eligible sites of the features with a span, their candidates on a ring, and the deepest dip between."""
    ctes, sites_ = [], []
    for n, f in sites.FEATURES.items():
        if f.span:
            c, q = _feature_sql(n)
            ctes.append(c.replace("AS z FROM", "AS z, site FROM").replace("(SELECT x, z FROM", "(SELECT x, z, site FROM"))
            num = lambda v: "NULL" if v is None else f"{v * 15!r}"
            sites_.append(q.replace("AS feature, x, z, round(elev, 6) AS elev", f"AS feature, site, x, z, elev, {f.span[0]} AS lo, {f.span[1]} AS hi, {f.samples} AS n, {num(f.tolerance)}::DOUBLE AS tol, {num(f.gap)}::DOUBLE AS gap"))
    ring, last = hashing.sql_hash_ctes("es", "rg", {"ring": ("site", "0", "0")})
    span, last2 = hashing.sql_hash_ctes("ci", "sp", {"spn": ("site", "i", "7")})
    return f"""WITH {_RASTER_SQL}, lat AS (SELECT cx, cz FROM range(0, (SELECT max(x) // 4 + 1 FROM ras)) a(cx), range(0, (SELECT max(z) // 4 + 1 FROM ras)) b(cz)), {', '.join(ctes)}, es AS MATERIALIZED ({' UNION ALL '.join(sites_)}), {ring},
 ci AS (SELECT *, unnest(range(0, n)) AS i FROM {last}), {span}, an AS (SELECT *, {hashing.sql_unit('ring')} * 2 * pi() + i * 2 * pi() / n AS a, lo + floor({hashing.sql_unit('spn')} * (hi - lo)) AS sp_ FROM {last2}),
 b AS (SELECT *, x + floor(cos(a) * sp_ + 0.5)::BIGINT AS bx, z + floor(sin(a) * sp_ + 0.5)::BIGINT AS bz FROM an), m AS (SELECT *, trunc((x + bx) / 2)::BIGINT AS mx, trunc((z + bz) / 2)::BIGINT AS mz FROM b),
 j AS (SELECT m.*, p.elev AS eb, q.elev AS em FROM m JOIN ras p ON p.x = bx AND p.z = bz JOIN ras q ON q.x = mx AND q.z = mz WHERE p.elev > 0 AND (tol IS NULL OR abs(p.elev - m.elev) <= tol)),
 d AS (SELECT *, (elev + eb) / 2 - em AS dip FROM j), w AS (SELECT *, row_number() OVER (PARTITION BY feature, site, x, z ORDER BY dip DESC, i) AS p FROM d WHERE gap IS NULL OR dip >= gap)
SELECT feature, x, z, bx, bz, round(dip, 6) AS dip FROM w WHERE p = 1"""


SQL["site_anchors"] = _anchors_sql()
