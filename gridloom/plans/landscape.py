"""Queries over terrain assemblies, underground places, class tables and whole searches (groups A, C, D, E, F, G, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions.noise import FIELDS, Field
from gridloom.operators import channels, focal, stats, terrain
from gridloom.plans import grid, noise_sql
from gridloom.plans.scalars import _noise_sql
from gridloom.runtime import cut

HUMID, INLAND = [2, 5, 8], [1, 2, 4, 6]


def d_caves(spark: SparkSession, d: str) -> DataFrame:
    """Depth, humidity and inland predicates below the surface."""
    g = grid.cells(spark, d).withColumns({"x": F.col("c") * 16, "z": F.col("r") * 16, "y": F.lit(60) - F.col("cell") % 173, "surface": F.lit(80) + F.col("cell") % 31, "k": F.col("cell") % 10})
    g = g.withColumns({"humid": F.col("k").isin(HUMID), "inland": F.col("k").isin(INLAND)})
    return terrain.caves(g).select("cell", "cave")


def _axes(cell: str) -> dict[str, str]:
    return {a: f"((({cell}) * {17 + 6 * i} + {i * 31}) % 201) / 100.0e0 - 1" for i, a in enumerate(terrain.AXES)}


BOXES = [(k, [(-1 + 0.2 * ((k * 3 + i) % 8), -1 + 0.2 * ((k * 3 + i) % 8) + 0.3 + 0.1 * ((k + i) % 3)) for i in range(6)]) for k in range(12)]


def g_nearest_class(spark: SparkSession, d: str) -> DataFrame:
    """The nearest class in climate space."""
    points = grid.cells(spark, d).selectExpr("cell", *[f"{e} AS {a}" for a, e in _axes("cell").items()])
    table = spark.createDataFrame([(k, *[v for b in box for v in b]) for k, box in BOXES], "class int, " + ", ".join(f"lo_{a} double, hi_{a} double" for a in terrain.AXES))
    return terrain.nearest_class(points, table).select("cell", "class")


def e_strided(spark: SparkSession, d: str) -> DataFrame:
    """A smooth field at every 64th place, read in between (checked against numpy in the tests)."""
    return terrain.strided(grid.cells(spark, d).select("cell", "r", "c"), Field(4711, 1 / 900, 2), 64, "v").select("cell", F.round("v", 8).alias("v"))


def e_detail(spark: SparkSession, d: str) -> DataFrame:
    """Detail noise of a world on slopes and plains."""
    return terrain.add_detail(grid.cells(spark, d), 20240611, 30.0).select("cell", F.round("elev", 6).alias("elev"))


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    """The grid as coarse cells of summed and weighted climate."""
    g = cut(grid.climate(spark, d)).withColumn("w", F.col("cell") % 3 + F.lit(0.5))
    return g.select("r", "c", (F.signum("elev") * F.sqrt(F.abs("elev")) * F.col("w")).alias("elev"), *[(F.col(a) * F.col("w")).alias(b) for a, b in (("temp", "temp"), ("tseason", "t_std"), ("precip", "precip"), ("pcv", "pcv"))], "w")


def f_climate(spark: SparkSession, d: str) -> DataFrame:
    """climate of fine cells, four a side of a coarse one, inside the rim that the regression leaves out."""
    fine = grid.cells(spark, d).select("cell", (F.col("r") * 4 + F.col("cell") % 4).alias("r"), (F.col("c") * 4 + 1).alias("c"), "elev")
    out = terrain.climate(fine, _coarse(spark, d), 4, half=3)
    return out.select("cell", *[F.round(x, 5).alias(x) for x in ("temp", "t_std", "precip", "pcv")], F.round("beta", 8).alias("beta"))


def f_latent(spark: SparkSession, d: str) -> DataFrame:
    """climate of steps of two fine cells from the coarse cell of their centre."""
    fine = grid.cells(spark, d).select("cell", (F.col("r") * 2 + 1).alias("r"), (F.col("c") * 2).alias("c"), "elev")
    out = terrain.latent_climate(fine, _coarse(spark, d), 4, 2, half=3)
    return out.select("cell", *[F.round(x, 5).alias(x) for x in ("temp", "t_std", "precip", "pcv")], F.round("beta", 8).alias("beta"))


def _size(g: DataFrame) -> tuple[int, int]:
    m = g.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return (0, 0) if m.r is None else (m.r + 1, m.c + 1)


def f_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Elevations from a residual and a low band, without the outermost two cells."""
    fine = grid.cells(spark, d).select("r", "c", (F.col("elev") / 400).alias("v"), F.lit(2.0).alias("w"))
    h, w = _size(fine)
    low = fine.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    out = terrain.elevation(fine, low, (h, w), ((h + 1) // 2, (w + 1) // 2), (2, 2, h - 2, w - 2), sigma=2.0, stats=(0.1, 1.5, 2.0, 3.0))
    return out.select("r", "c", F.round("elev", 6).alias("elev"))


def f_upsampled(spark: SparkSession, d: str) -> DataFrame:
    """elevation and a climate plane twice as fine."""
    g = cut(grid.climate(spark, d).select("r", "c", "elev", "temp"))
    return terrain.upsampled(g, ["elev", "temp"], _size(g), 2).select("r", "c", F.round("elev", 6).alias("elev"), F.round("temp", 6).alias("temp"))


MEANS, STDS = [0.5, -0.5, 1.0, 2.0, 0.0, 3.0, 0.25], [2.0, 3.0, 1.5, 4.0, 0.5, 2.5, 0.75]
SCALES = [0.5, 0.25, 2.0, 1.0, 3.0, 0.125]


def f_conditioning(spark: SparkSession, d: str) -> DataFrame:
    """one vector per window of 4 x 4 cells."""
    g = grid.cells(spark, d).withColumn("key", F.floor(F.col("r") / 4) * 25 + F.floor(F.col("c") / 4))
    cells = g.select("key", ((F.col("r") % 4) * 4 + F.col("c") % 4).alias("i"), "elev", (F.col("cell") % 4).cast("double").alias("w"))
    plane = lambda k: F.transform(F.col("x"), lambda e: (e["elev"] / 1000 + k) * e["w"])
    planes = F.array(*[plane(k) for k in range(6)], F.transform(F.col("x"), lambda e: e["w"]))
    windows = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "elev", "w"))).alias("x")).filter(F.size("x") == 16).select("key", planes.alias("planes"))
    v = terrain.conditioning(windows, MEANS, STDS, [0.0, 0.2, 0.4, 0.6, 0.8], SCALES)
    return v.select("key", F.posexplode("vector").alias("i", "v")).select("key", "i", scalar.rounded(F.col("v"), 6).alias("v"))


RASTER = {n: Field(100 + k, 1 / 40, 3) for k, n in enumerate(("elev", "temp", "t_std", "precip", "pcv"))}
EVEN = [-0.6 + 0.3 * k for k in range(5)]
MEASURED = {"elev": [-3000.0, -200.0, 0.0, 400.0, 3000.0], "temp": [-15.0, 5.0, 14.0, 22.0, 35.0], "t_std": [50.0, 200.0, 400.0, 800.0, 1500.0], "precip": [0.0, 200.0, 700.0, 1400.0, 3500.0], "pcv": [5.0, 25.0, 45.0, 80.0, 150.0]}


def a_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """A raster of noise matched to measured distributions."""
    s = terrain.synthetic(grid.cells(spark, d).select("r", "c"), RASTER, {n: EVEN for n in RASTER}, MEASURED, (-8.0, 300.0, 60.0, 1400.0))
    return s.select("r", "c", *[F.round(x, 6).alias(x) for x in ("elev", "temp", "t_std", "precip", "pcv")])


def i_growing(spark: SparkSession, d: str) -> DataFrame:
    """The nearest qualifying cell within a window that grows around a place, else the place itself."""
    return channels.growing_search(grid.cells(spark, d), "elev > 4700", 40, 50, first=8, most=64)


def i_missing(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are in use and not covered by a table."""
    used = grid.cells(spark, d).select((F.col("cell") % 37).alias("key"))
    return stats.uncovered(used, spark.createDataFrame([(k,) for k in range(0, 37, 3)], "key long"), "key")


def h_counters(spark: SparkSession, d: str) -> DataFrame:
    """Calls, total and batch sizes by model, the costliest first."""
    calls = grid.cells(spark, d).select(F.concat(F.lit("model"), F.col("cell") % 5).alias("model"), (F.col("cell") % 97).alias("ms"), (F.col("cell") % 4 + 1).alias("batch"))
    return stats.counters(calls, "model", "ms", "batch")


QUERIES = {f.__name__: f for f in (d_caves, g_nearest_class, e_strided, e_detail, f_climate, f_latent, f_elevation, f_upsampled, f_conditioning, a_synthetic, i_growing, i_missing, h_counters)}


def _caves_sql() -> str:
    source, ctes = "src", []
    for n, (seed, _) in terrain.CAVES.items():
        c, source = _noise_sql(f"n_{n}", str(seed), "x", "z", str(terrain.REGION), source, f"cv{n[:2]}")
        ctes.append(c)
    return f"""WITH {grid.CELLS_SQL}, src AS (SELECT cell, c * 16 AS x, r * 16 AS z, 60 - cell % 173 AS y, 80 + cell % 31 AS s, cell % 10 AS k FROM cells), {', '.join(ctes)}
SELECT cell, CASE WHEN s - y < 24 THEN NULL WHEN y < 0 AND s - y > 100 AND n_deep_dark > 0.25 THEN 'deep_dark' WHEN k IN (2, 5, 8) AND n_lush > 0.10 THEN 'lush' WHEN k IN (1, 2, 4, 6) AND n_dripstone > 0.25 THEN 'dripstone' END AS cave FROM {source}"""


def _nearest_sql() -> str:
    rows = ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for b in box for v in b)})" for k, box in BOXES)
    names = ", ".join(f"lo_{a}, hi_{a}" for a in terrain.AXES)
    d = " + ".join(f"power(greatest(lo_{a} - {a}, {a} - hi_{a}, 0), 2)" for a in terrain.AXES)
    return f"WITH {grid.CELLS_SQL}, p AS (SELECT cell, {', '.join(f'{e} AS {a}' for a, e in _axes('cell').items())} FROM cells), t(k, {names}) AS (VALUES {rows}) SELECT cell, arg_min(k, ({d}, k))::INTEGER AS class FROM p CROSS JOIN t GROUP BY cell"


_COARSE = f"{grid.CLIMATE_SQL}, co AS (SELECT r, c, power(greatest(sign(elev) * sqrt(abs(elev)), 0), 2) AS e, temp AS t, tseason AS ts, precip AS p, pcv AS v FROM climate)"
#: Windowed regression over 7 x 7 coarse cells.
_LAPSE = f"""{_COARSE}, ln AS (SELECT a.r, a.c, any_value(a.t) AS t, any_value(a.e) AS e, any_value(a.ts) AS ts, any_value(a.p) AS p, any_value(a.v) AS v, count(*) AS n, sum((b.e > 0)::INT) AS sw, sum(b.t) FILTER (b.e > 0) AS st, sum(b.e) AS se, sum(b.e * b.e) AS see, sum(b.e * b.t) AS set_ FROM co a JOIN co b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY a.r, a.c),
 lm AS (SELECT *, see / (sw + 1e-6) - power(se / (sw + 1e-6), 2) AS var, set_ / (sw + 1e-6) - se / (sw + 1e-6) * coalesce(st, 0) / (sw + 1e-6) AS cov FROM ln),
 lb AS MATERIALIZED (SELECT r, c, ts, p, v, b AS beta, t - b * e AS base FROM (SELECT *, CASE WHEN n = 49 THEN greatest(-0.012, least(0, CASE WHEN var < 1 OR sw < 0.02 * 49 THEN -0.0065 ELSE cov / (var + 1e-6) END)) END AS b FROM lm))"""
_ROUNDED = "round({base} + {beta} * greatest(elev, 0), 5) AS temp, round({ts}, 5) AS t_std, round({p}, 5) AS precip, round({v}, 5) AS pcv, round({beta}, 8) AS beta"


def _climate_sql() -> str:
    mix = lambda x: f"((q1.{x} * (1 - fx) + q2.{x} * fx) * (1 - fy) + (q3.{x} * (1 - fx) + q4.{x} * fx) * fy)"
    return f"""WITH {_LAPSE}, fi AS (SELECT cell, elev, (r * 4 + cell % 4 + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS y, (c * 4 + 1.5::DOUBLE) / 4 - 0.5::DOUBLE AS x FROM cells), fp AS (SELECT *, floor(y) AS y0, floor(x) AS x0, y - floor(y) AS fy, x - floor(x) AS fx FROM fi),
 mm AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lb)
SELECT cell, {_ROUNDED.format(**{k: mix(k) for k in ('base', 'beta', 'ts', 'p', 'v')})} FROM fp CROSS JOIN mm JOIN lb q1 ON q1.r = greatest(y0, r0) AND q1.c = greatest(x0, c0) JOIN lb q2 ON q2.r = greatest(y0, r0) AND q2.c = least(x0 + 1, c1) JOIN lb q3 ON q3.r = least(y0 + 1, r1) AND q3.c = greatest(x0, c0) JOIN lb q4 ON q4.r = least(y0 + 1, r1) AND q4.c = least(x0 + 1, c1)"""


def _conditioning_sql() -> str:
    norm = lambda k: f"(CASE WHEN w > 1e-6 THEN (elev / 1000 + {k}) * w / w ELSE 0 END - {MEANS[k]}) / {STDS[k]}"
    parts = [f"SELECT key, {16 * k} + i AS i, {norm(k)} * {SCALES[k]} AS v FROM x" for k in (0, 1)]
    parts += [f"SELECT key, {32 + n}, avg({norm(k)}) * {SCALES[2]} FROM x WHERE i IN (5, 6, 9, 10) GROUP BY key" for n, k in enumerate((2, 3, 4, 5))]
    parts += [f"SELECT key, 36 + i, {(1 - MEANS[6]) / STDS[6] * SCALES[3]!r}::DOUBLE FROM x"]
    parts += [f"SELECT DISTINCT key, {52 + k}, {h * SCALES[4]!r}::DOUBLE FROM x" for k, h in enumerate((0.0, 0.2, 0.4, 0.6, 0.8))] + [f"SELECT DISTINCT key, 57, {-0.5 * 12**0.5 * SCALES[5]!r}::DOUBLE FROM x"]
    return f"WITH {grid.CELLS_SQL}, a AS (SELECT r // 4 * 25 + c // 4 AS key, r % 4 * 4 + c % 4 AS i, elev, (cell % 4)::DOUBLE AS w FROM cells), x AS (SELECT * FROM a WHERE key IN (SELECT key FROM a GROUP BY key HAVING count(*) = 16)), u AS ({' UNION ALL '.join(parts)}) SELECT key, i::INTEGER AS i, round(v, 6) AS v FROM u"


def _synthetic_sql() -> str:
    def matched(n: str) -> str:
        knots = list(zip(EVEN, MEASURED[n]))
        parts = [f"WHEN nf.{n} <= {knots[0][0]!r}::DOUBLE THEN {knots[0][1]!r}::DOUBLE"] + [f"WHEN nf.{n} <= {b!r}::DOUBLE THEN {fa!r}::DOUBLE + (nf.{n} - {a!r}::DOUBLE) * {(fb - fa)!r}::DOUBLE / {(b - a)!r}::DOUBLE" for (a, fa), (b, fb) in zip(knots, knots[1:])]
        return f"CASE {' '.join(parts)} ELSE {knots[-1][1]!r}::DOUBLE END AS {n}"

    return f"""WITH {grid.CELLS_SQL}, {noise_sql.fields_sql('cells', 'nf', RASTER, 'c', 'r')}, m AS (SELECT r, c, {', '.join(map(matched, RASTER))} FROM cells JOIN nf USING (cell)),
 t AS (SELECT * REPLACE (greatest(-10, least(40, temp + greatest(-9.8::DOUBLE, least(-4::DOUBLE, -6.5::DOUBLE + 0.0015::DOUBLE * precip)) / 1000 * greatest(elev, 0))) AS temp) FROM m),
 b AS (SELECT *, -8 * temp + 300 AS bl, greatest(60, 8 * temp - 300) AS fl FROM t)
SELECT r, c, round(sign(elev) * sqrt(abs(elev)), 6) AS elev, round(temp, 6) AS temp, round(greatest((t_std - 60) / 1340 * (1400 - fl) + fl + bl, 20), 6) AS t_std, round(precip, 6) AS precip, round(pcv * greatest(0, (185 - 0.04111::DOUBLE * precip) / 185), 6) AS pcv FROM b"""


def _detail_sql() -> str:
    fields = terrain.detail_fields(20240611) | {"fine": Field(FIELDS["temperature"].seed, 1 / 6, 2, 0.6), "coarse": Field(FIELDS["temperature"].seed, 1 / 24, 3)}
    ease = lambda v: f"(({v}) * ({v}) * (3 - 2 * ({v})))"
    one = lambda v: f"least(greatest({v}, 0), 1)"
    return f"""WITH {grid.SLOPE_SQL}, {noise_sql.fields_sql('cells', 'nf', fields, 'c', 'r')}, a AS (SELECT nf.*, elev, least(1, slope * 3000 / 40) AS s FROM nf JOIN sloped USING (cell)),
 b AS (SELECT *, coarse * 100 + fine * 70 AS fbm, CASE WHEN style < 0 THEN -1 ELSE 1 END * (ridged_coarse * 100 + ridged_fine * 70) AS ridge, {ease(one('(abs(style) - 0.15) / 0.55'))} AS t, {ease(one('(plains - 0.05) / 0.5'))} AS g FROM a)
SELECT cell, round(CASE WHEN elev < 0 THEN elev ELSE elev + (CASE WHEN power(s, 2.5) > 1e-4 THEN (fbm + (ridge - fbm) * t) * power(s, 2.5) * (1 + 0.65 * character) ELSE 0 END + swell * 75 * g * (1 - s) * (1 - s)) * {one('elev / 25')} END, 6) AS elev FROM b"""


def _strided_sql() -> str:
    return f"""WITH {grid.CELLS_SQL}, lt AS (SELECT i * 1000000 + j AS cell, i AS lr, j AS lc FROM range(0, (SELECT max(r) // 64 + 2 FROM cells)) a(i), range(0, (SELECT max(c) // 64 + 2 FROM cells)) b(j)), {noise_sql.fields_sql('lt', 'nf', {'v': Field(4711, 1 / 900, 2)}, 'lc * 64', 'lr * 64')},
 g AS (SELECT lr, lc, v FROM lt JOIN nf USING (cell)), p AS (SELECT cell, r // 64 AS y, c // 64 AS x, (r % 64)::DOUBLE / 64 AS fy, (c % 64)::DOUBLE / 64 AS fx FROM cells)
SELECT cell, round((q1.v * (1 - fx) + q2.v * fx) * (1 - fy) + (q3.v * (1 - fx) + q4.v * fx) * fy, 8) AS v FROM p JOIN g q1 ON q1.lr = y AND q1.lc = x JOIN g q2 ON q2.lr = y AND q2.lc = x + 1 JOIN g q3 ON q3.lr = y + 1 AND q3.lc = x JOIN g q4 ON q4.lr = y + 1 AND q4.lc = x + 1"""


def _taps(p: str, src: str, size: str, target: str, extrapolate: bool = False) -> str:
    """CTEs from a grid (r, c, v) of a size (h, w) to ``<p>`` (r, c, v) of another, by four taps."""
    at = lambda x, n: f"(({x} + 0.5::DOUBLE) * s.{n} / g.{n} - 0.5::DOUBLE)" if extrapolate else f"least(greatest(({x} + 0.5::DOUBLE) * s.{n} / g.{n} - 0.5::DOUBLE, 0), s.{n} - 1)"
    return f"""{p}t AS (SELECT a.i AS r, b.j AS c, s.h, s.w, {at('a.i', 'h')} AS y, {at('b.j', 'w')} AS x FROM {size} s, {target} g, range(0, (SELECT h FROM {target})) a(i), range(0, (SELECT w FROM {target})) b(j)),
 {p}u AS (SELECT *, least(greatest(floor(y), 0), h - 2)::BIGINT AS y0, least(greatest(floor(x), 0), w - 2)::BIGINT AS x0 FROM {p}t),
 {p} AS MATERIALIZED (SELECT u.r, u.c, (k.v * (1 - (x - x0)) + l.v * (x - x0)) * (1 - (y - y0)) + (m.v * (1 - (x - x0)) + n.v * (x - x0)) * (y - y0) AS v FROM {p}u u JOIN {src} k ON k.r = y0 AND k.c = x0 JOIN {src} l ON l.r = y0 AND l.c = x0 + 1 JOIN {src} m ON m.r = y0 + 1 AND m.c = x0 JOIN {src} n ON n.r = y0 + 1 AND n.c = x0 + 1)"""


def _elevation_sql() -> str:
    kernel = focal.gaussian_kernel(2.0)
    ker = ", ".join(f"({i - len(kernel) // 2}, {x!r}::DOUBLE)" for i, x in enumerate(kernel))
    return f"""WITH {grid.CELLS_SQL}, fine AS (SELECT r, c, elev / 800 * 1.5 + 0.1 AS v FROM cells), low AS (SELECT r // 2 AS r, c // 2 AS c, avg(elev) / 800 * 3 + 2 AS v FROM cells GROUP BY ALL),
 fs AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM fine), ls AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM low), {_taps('up', 'low', 'ls', 'fs', True)}, fl AS (SELECT r, c, fine.v + up.v AS v FROM fine JOIN up USING (r, c)), {_taps('dn', 'fl', 'fs', 'ls')},
 ker(o, k) AS (VALUES {ker}), b1 AS (SELECT a.r, a.c, sum(b.v * k) AS v FROM dn a CROSS JOIN ker CROSS JOIN ls JOIN dn b ON b.r = a.r AND b.c = least(greatest(a.c + o, 0), w - 1) GROUP BY ALL), b2 AS MATERIALIZED (SELECT a.r, a.c, sum(b.v * k) AS v FROM b1 a CROSS JOIN ker CROSS JOIN ls JOIN b1 b ON b.c = a.c AND b.r = least(greatest(a.r + o, 0), h - 1) GROUP BY ALL),
 {_taps('u2', 'b2', 'ls', 'fs')}, e AS (SELECT r, c, fine.v + u2.v AS v FROM fine JOIN u2 USING (r, c))
SELECT r - 2 AS r, c - 2 AS c, round(sign(v) * v * v, 6) AS elev FROM e, fs WHERE r >= 2 AND c >= 2 AND r < h - 2 AND c < w - 2"""


SQL = {
    "f_elevation": _elevation_sql(),
    "a_synthetic": _synthetic_sql(),
    "e_detail": _detail_sql(),
    "e_strided": _strided_sql(),
    "d_caves": _caves_sql(),
    "g_nearest_class": _nearest_sql(),
    "f_climate": _climate_sql(),
    "f_latent": f"WITH {_LAPSE}, fi AS (SELECT cell, elev, (r * 4 + 3) // 4 AS y, (c * 4 + 1) // 4 AS x FROM cells) SELECT cell, {_ROUNDED.format(base='base', beta='beta', ts='ts', p='p', v='v')} FROM fi LEFT JOIN lb ON lb.r = y AND lb.c = x",
    "f_upsampled": f"""WITH {grid.CLIMATE_SQL}, z AS (SELECT max(r) AS hr, max(c) AS hc FROM climate), t AS (SELECT a.i AS r, b.j AS c, least(greatest((a.i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), hr) AS y, least(greatest((b.j + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), hc) AS x, hr, hc FROM z, range(0, 2 * (SELECT hr + 1 FROM z)) a(i), range(0, 2 * (SELECT hc + 1 FROM z)) b(j)),
 u AS (SELECT *, y - floor(y) AS fy, x - floor(x) AS fx FROM t)
SELECT u.r, u.c, {', '.join(f'round((q1.{v} * (1 - fx) + q2.{v} * fx) * (1 - fy) + (q3.{v} * (1 - fx) + q4.{v} * fx) * fy, 6) AS {v}' for v in ('elev', 'temp'))} FROM u JOIN climate q1 ON q1.r = floor(y) AND q1.c = floor(x) JOIN climate q2 ON q2.r = floor(y) AND q2.c = least(floor(x) + 1, hc) JOIN climate q3 ON q3.r = least(floor(y) + 1, hr) AND q3.c = floor(x) JOIN climate q4 ON q4.r = least(floor(y) + 1, hr) AND q4.c = least(floor(x) + 1, hc)""",
    "f_conditioning": _conditioning_sql(),
    "i_growing": f"""WITH {grid.CELLS_SQL}, w AS (SELECT s FROM range(8, 65, 8) t(s)), q AS (SELECT r, c, s, greatest(abs(r - 40), abs(c - 50)) AS ring FROM cells JOIN w ON r >= 40 - s // 2 AND r < 40 + s // 2 AND c >= 50 - s // 2 AND c < 50 + s // 2 WHERE elev > 4700),
 b AS (SELECT r, c, s AS span FROM q ORDER BY s, ring, r, c LIMIT 1) SELECT r, c, span::INTEGER AS span FROM b UNION ALL SELECT 40, 50, NULL WHERE NOT EXISTS (SELECT 1 FROM b)""",
    "i_missing": f"WITH {grid.CELLS_SQL} SELECT DISTINCT cell % 37 AS key FROM cells WHERE cell % 37 % 3 <> 0",
    "h_counters": f"WITH {grid.CELLS_SQL} SELECT 'model' || (cell % 5) AS model, count(*) AS calls, sum(cell % 97)::BIGINT AS total, sum(cell % 4 + 1)::BIGINT AS items FROM cells GROUP BY 1 ORDER BY total DESC, model",
}
