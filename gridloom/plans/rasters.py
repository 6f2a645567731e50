"""Queries over neighbourhood, resampling and windowed-tensor operators (groups D, E and F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import focal, tensor
from gridloom.plans import grid
from gridloom.runtime import load


def _smooth(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a smoothed elevation shifted so that a part lies below sea level."""
    return focal.box_mean(grid.cells(spark, d), "elev", 2, "m").select("cell", "r", "c", (F.col("m") / 25 - 85).alias("elev"))


_SMOOTH = f"{grid.CELLS_SQL}, sm AS (SELECT a.cell, a.r, a.c, (SELECT avg(b.elev) FROM cells b WHERE b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2) / 25 - 85 AS elev FROM cells a)"


def e_sobel(spark: SparkSession, d: str) -> DataFrame:
    return grid.slopes(grid.cells(spark, d)).select("cell", F.round("slope", 8).alias("slope"))


def e_box(spark: SparkSession, d: str) -> DataFrame:
    g = focal.box_mean(grid.cells(spark, d), "elev", 5, "mean")
    g = focal.box_sums(g, 3, below=F.when(F.col("elev") < 0, 1).otherwise(0))
    return g.select("cell", F.round("mean", 6).alias("mean"), F.col("below").cast("long").alias("below"))


def e_step_slope(spark: SparkSession, d: str) -> DataFrame:
    return focal.step_slope(grid.cells(spark, d), "elev", 2).select("cell", F.round("slope", 6).alias("slope"))


def d_coastline(spark: SparkSession, d: str) -> DataFrame:
    g = _smooth(spark, d).withColumn("slope", F.lit(0.1))
    return focal.coastline(g, "elev", "slope").select("cell", "coastline")


def d_around(spark: SparkSession, d: str) -> DataFrame:
    """All nine cells on land, uniform squares, shores of wet cells."""
    g = _smooth(spark, d).withColumns({"land": F.col("elev") > 0, "k": F.floor(F.col("elev") / 8), "wet": F.col("elev") < 0})
    g = focal.all_around(g, "land", "inland")
    near = focal.neighbours(g, ["k", "wet"], focal.AROUND).groupBy("r", "c").agg(F.min("n_k").alias("lo"), F.max("n_k").alias("hi"), F.count("*").alias("n"), F.min(F.when(F.col("k").isin(1, 3, 4, 6), F.col("n_wet"))).alias("all_wet"))
    g = g.join(near, ["r", "c"], "left")
    return g.select("cell", "inland", ((F.col("n") == 8) & (F.col("lo") == F.col("k")) & (F.col("hi") == F.col("k"))).alias("uniform"), (F.col("wet") & ~F.col("all_wet")).alias("shore"))


def d_range_filter(spark: SparkSession, d: str) -> DataFrame:
    """Several inclusive channel ranges, as a flag."""
    g = grid.climate(spark, d)
    return g.select("cell", (F.col("elev").between(0, 900) & F.col("temp").between(-5, 18) & (F.col("precip") >= 400)).alias("match"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """A grid of four classes with long runs and stray cells."""
    return _smooth(spark, d).withColumns({"k": F.when(F.col("cell") % 29 == 0, F.lit(9).cast("long")).otherwise(F.floor((F.col("elev") + 30) / 22)), "hard": F.col("cell") % 17 == 3})


def e_majority(spark: SparkSession, d: str) -> DataFrame:
    """Isolated cells, beside cells that neither change nor count."""
    out = focal.majority(_classes(spark, d), "k", 1, 5, 2, frozen="hard")
    return out.select("cell", "k")


def e_organic(spark: SparkSession, d: str) -> DataFrame:
    """3x3 and then 5x5 majority among blendable cells."""
    g = _classes(spark, d).withColumn("blend", F.col("cell") % 13 != 5)
    g = focal.majority(g, "k", 1, 6, 3, only="blend")
    return focal.majority(g, "k", 2, 15, 7, only="blend").select("cell", "k")


KERNEL = focal.gaussian_kernel(2.0)


def e_blur(spark: SparkSession, d: str) -> DataFrame:
    """Blurs with repeated edges, and renormalised at them."""
    g = focal.blur(grid.cells(spark, d), "elev", KERNEL, "clamped")
    g = focal.blur(g, "elev", KERNEL, "renormalised", renormalise=True)
    return g.select("cell", F.round("clamped", 6).alias("clamped"), F.round("renormalised", 6).alias("renormalised"))


def _size(g: DataFrame) -> tuple[int, int]:
    """Rows and columns of a grid that starts at (0, 0)."""
    m = g.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return (0, 0) if m.r is None else (m.r + 1, m.c + 1)


def e_resize(spark: SparkSession, d: str) -> DataFrame:
    """The grid 2.5 times as high and 3.3 times as wide, without the outermost cells."""
    g = grid.cells(spark, d)
    h, w = _size(g)
    th, tw = h * 5 // 2, w * 33 // 10
    return focal.resize(g, "elev", (h, w), (th, tw), window=(3, 4, th - 2, tw - 5)).select("r", "c", F.round("elev", 6).alias("elev"))


def e_resize_extrapolated(spark: SparkSession, d: str) -> DataFrame:
    """All of it, its rim following the last difference."""
    g = grid.cells(spark, d)
    h, w = _size(g)
    return focal.resize(g, "elev", (h, w), (h * 5 // 2, w * 33 // 10), extrapolate=True).select("r", "c", F.round("elev", 6).alias("elev"))


def e_nearest(spark: SparkSession, d: str) -> DataFrame:
    g = grid.cells(spark, d)
    h, w = _size(g)
    return focal.nearest(g, "elev", (h, w), (h * 3, w * 5 // 2)).select("r", "c", "elev")


def e_pyramid(spark: SparkSession, d: str) -> DataFrame:
    """A fine residual plus a resized coarse band of half the size, over the whole grid."""
    fine = grid.cells(spark, d).select("r", "c", "elev")
    h, w = _size(fine)
    # the four cells are added in row order, whatever the partitions, so that halves are rounded the same way each time
    four = [F.coalesce(F.sum(F.when((F.col("r") % 2 == i) & (F.col("c") % 2 == j), F.col("elev"))), F.lit(0.0)) for i in (0, 1) for j in (0, 1)]
    mean = F.when(F.count("elev") > 0, sum(four[1:], four[0]) / F.count("elev"))
    low = fine.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg((mean / 3).alias("elev"))
    return focal.pyramid_decode(fine, low, "elev", ((h + 1) // 2, (w + 1) // 2), (h, w)).select("r", "c", scalar.rounded(F.col("elev"), 6).alias("elev"))


def e_lapse(spark: SparkSession, d: str) -> DataFrame:
    """Windowed regression of temperature on elevation, capped by the region."""
    g = grid.climate(spark, d).withColumn("cap", scalar.col("lapse_cap", region="region"))
    return focal.lapse(g, "temp", "elev", half=3, cap="cap").select("cell", F.round("beta", 8).alias("beta"), F.round("baseline", 5).alias("baseline"))


def e_hillshade(spark: SparkSession, d: str) -> DataFrame:
    g = focal.relief(focal.hillshade(grid.cells(spark, d), "elev", 900.0), "elev", 900.0)
    return g.select("cell", F.round("shade", 6).alias("shade"), F.round("relief", 6).alias("relief"))


def e_dilate(spark: SparkSession, d: str) -> DataFrame:
    g = grid.cells(spark, d).withColumn("peak", F.col("elev") > 4600)
    return focal.dilate(g, "peak", 2, "near_peak").select("cell", "near_peak")


def e_steepest(spark: SparkSession, d: str) -> DataFrame:
    """Greatest drop to any neighbour, and among wet ones."""
    g = grid.cells(spark, d).withColumn("wet", F.col("elev") < 900)
    g = focal.steepest(focal.steepest(g, "elev", 240.0, "any"), "elev", 240.0, "wet_only", among="wet")
    return g.select("cell", F.round("any", 8).alias("any_slope"), F.round("wet_only", 8).alias("wet_slope"))


def e_bed(spark: SparkSession, d: str) -> DataFrame:
    """Two passes of weighted smoothing over the cells that have a value."""
    g = grid.cells(spark, d).withColumn("bed", F.when(F.col("elev") < 1500, F.col("elev")))
    for _ in range(2):
        g = focal.smooth_present(g, "bed", 5.0, 1.0, 1.0, "bed2").drop("bed").withColumnRenamed("bed2", "bed")
    return g.select("cell", F.round("bed", 6).alias("bed"))


def e_pad_crop(spark: SparkSession, d: str) -> DataFrame:
    """The grid padded, and all of that but its lowest row."""
    g = grid.cells(spark, d)
    h, w = _size(g)
    return focal.crop(focal.pad(g, (h, w), ["elev"]), 0, 0, h + 1, w + 2).select("r", "c", "elev")


W = tensor.Windows(8, 6, -2)


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).alias("w_i"), (F.col("vec_id") % 20).alias("w_j"), F.col("embedding").cast("array<double>").alias("tile"))


def f_overlap_add(spark: SparkSession, d: str) -> DataFrame:
    """A slice as the sum of all windows over each cell."""
    return tensor.overlap_add(_tiles(spark, d), W, (3, 5, 120, 90)).select("r", "c", F.round("v", 6).alias("v"))


def f_windows(spark: SparkSession, d: str) -> DataFrame:
    """the windows that hold each cell, with the place inside."""
    return tensor.windows_of(grid.cells(spark, d).select("cell", "r", "c"), W).select("cell", "w_i", "w_j", "i", "j")


def f_upstream(spark: SparkSession, d: str) -> DataFrame:
    """Source windows that the windows of all cells, at four times their row, need beyond all stored tiles."""
    gone = tensor.missing_windows(tensor.windows_of(grid.cells(spark, d).select((F.col("r") * 4).alias("r"), "c"), W), _tiles(spark, d))
    return tensor.upstream_windows(gone, W, tensor.Windows(16, 12), margin=1)


QUERIES = {f.__name__: f for f in (e_sobel, e_box, e_step_slope, d_coastline, d_around, d_range_filter, e_majority, e_organic, e_blur, e_resize, e_resize_extrapolated, e_nearest, e_pyramid, e_lapse, e_hillshade, e_dilate, e_steepest, e_bed, e_pad_crop, f_overlap_add, f_windows, f_upstream)}

_OFF = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in focal.AROUND) + ") o(dr, dc)"


def _around(src: str, k: int) -> str:
    return f"SELECT a.r, a.c, o.k, b.* EXCLUDE (r, c) FROM {src} a CROSS JOIN (SELECT row_number() OVER (ORDER BY dr, dc) AS k, dr, dc FROM range(-{k}, {k + 1}) x(dr), range(-{k}, {k + 1}) y(dc)) o JOIN {src} b ON b.r = a.r + o.dr AND b.c = a.c + o.dc"


def _majority_sql(src: str, out: str, k: int, least: int, same: int, take: str) -> str:
    return f"""{out}n AS (SELECT a.cell, a.k AS own, o.i AS ord, b.k AS nk, b.tk FROM (SELECT *, {take} AS tk FROM {src}) a CROSS JOIN (SELECT row_number() OVER (ORDER BY dr, dc) AS i, dr, dc FROM range(-{k}, {k + 1}) x(dr), range(-{k}, {k + 1}) y(dc)) o JOIN (SELECT *, {take} AS tk FROM {src}) b ON b.r = a.r + o.dr AND b.c = a.c + o.dc),
 {out}c AS (SELECT cell, own, nk, count(*) AS n, sum(tk::INT) AS nt, min(ord) AS fo FROM {out}n GROUP BY ALL),
 {out}b AS (SELECT cell, any_value(own) AS own, sum(n) AS cells, arg_max(nk, nt * 100 - fo) AS best, max(nt) AS most, coalesce(max(CASE WHEN nk = own THEN nt END), 0) AS same FROM {out}c GROUP BY cell),
 {out} AS (SELECT s.* REPLACE (CASE WHEN ({take}) AND b.cells = {(2 * k + 1) ** 2} AND b.best <> s.k AND b.most >= {least} AND b.same <= {same} THEN b.best ELSE s.k END AS k) FROM {src} s JOIN {out}b b USING (cell))"""


_CLS = f"{_SMOOTH}, cl AS (SELECT *, CASE WHEN cell % 29 = 0 THEN 9 ELSE floor((elev + 30) / 22)::BIGINT END AS k, cell % 17 = 3 AS hard, cell % 13 <> 5 AS blend FROM sm)"


def _blur_sql() -> str:
    n = len(KERNEL) // 2
    ker = "ker(o, w) AS (VALUES " + ", ".join(f"({i - n}, {x!r}::DOUBLE)" for i, x in enumerate(KERNEL)) + ")"
    return f"""WITH {grid.CELLS_SQL}, {ker}, ext AS (SELECT r, min(c) AS lo, max(c) AS hi FROM cells GROUP BY r), exr AS (SELECT c, min(r) AS lo, max(r) AS hi FROM cells GROUP BY c),
 h1 AS (SELECT a.cell, a.r, a.c, sum(b.elev * w) AS v FROM cells a CROSS JOIN ker JOIN ext ON ext.r = a.r JOIN cells b ON b.r = a.r AND b.c = least(greatest(a.c + o, lo), hi) GROUP BY ALL),
 v1 AS (SELECT a.cell, sum(b.v * w) AS v FROM h1 a CROSS JOIN ker JOIN exr ON exr.c = a.c JOIN h1 b ON b.c = a.c AND b.r = least(greatest(a.r + o, lo), hi) GROUP BY ALL),
 h2 AS (SELECT a.cell, a.r, a.c, sum(b.elev * w) / sum(w) AS v FROM cells a CROSS JOIN ker JOIN cells b ON b.r = a.r AND b.c = a.c + o GROUP BY ALL),
 v2 AS (SELECT a.cell, sum(b.v * w) / sum(w) AS v FROM h2 a CROSS JOIN ker JOIN h2 b ON b.c = a.c AND b.r = a.r + o GROUP BY ALL)
SELECT cell, round(v1.v, 6) AS clamped, round(v2.v, 6) AS renormalised FROM v1 JOIN v2 USING (cell)"""


def _taps(th: str, tw: str, extrapolate: bool) -> str:
    """CTEs from src (r, c, v) and its size z (h, w) to ``out_`` (r, c, v) of the target size, by four taps."""
    at = lambda x, n, t: f"(({x} + 0.5::DOUBLE) * {n} / ({t}) - 0.5::DOUBLE)" if extrapolate else f"least(greatest(({x} + 0.5::DOUBLE) * {n} / ({t}) - 0.5::DOUBLE, 0), {n} - 1)"
    return f"""t AS (SELECT a.i AS r, b.j AS c, h, w, {at('a.i', 'h', th)} AS y, {at('b.j', 'w', tw)} AS x FROM z, range(0, (SELECT {th} FROM z)) a(i), range(0, (SELECT {tw} FROM z)) b(j)),
 u AS (SELECT *, least(greatest(floor(y), 0), h - 2)::BIGINT AS y0, least(greatest(floor(x), 0), w - 2)::BIGINT AS x0 FROM t),
 out_ AS (SELECT u.r, u.c, (p.v * (1 - (x - x0)) + q.v * (x - x0)) * (1 - (y - y0)) + (e.v * (1 - (x - x0)) + f.v * (x - x0)) * (y - y0) AS v FROM u JOIN src p ON p.r = y0 AND p.c = x0 JOIN src q ON q.r = y0 AND q.c = x0 + 1 JOIN src e ON e.r = y0 + 1 AND e.c = x0 JOIN src f ON f.r = y0 + 1 AND f.c = x0 + 1)"""


_SRC = f"{grid.CELLS_SQL}, src AS (SELECT r, c, elev AS v FROM cells), z AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells)"


def _relief_sql() -> str:
    def blurred(name: str, kernel: list[float]) -> str:
        n = len(kernel) // 2
        return f"""k{name}(o, w) AS (VALUES {', '.join(f'({i - n}, {x!r}::DOUBLE)' for i, x in enumerate(kernel))}),
 h{name} AS MATERIALIZED (SELECT a.cell, a.r, a.c, sum(b.elev * w) / sum(w) AS v FROM cells a CROSS JOIN k{name} JOIN cells b ON b.r = a.r AND b.c = a.c + o GROUP BY ALL),
 b{name} AS MATERIALIZED (SELECT a.cell, a.r, a.c, sum(b.v * w) / sum(w) AS v FROM h{name} a CROSS JOIN k{name} JOIN h{name} b ON b.c = a.c AND b.r = a.r + o GROUP BY ALL)"""

    def shade(name: str, source: str, v: str) -> str:
        return f"""g{name} AS (SELECT cell, (coalesce(lead({v}) OVER x, {v}) - coalesce(lag({v}) OVER x, {v})) / 1800 AS dx, (coalesce(lead({v}) OVER y, {v}) - coalesce(lag({v}) OVER y, {v})) / 1800 AS dy FROM {source} WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)),
 s{name} AS (SELECT cell, least(greatest(sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(dy, -dx)), 0), 1) AS s FROM g{name})"""

    return f"""WITH {grid.CELLS_SQL}, {blurred('f', focal.gaussian_kernel(1.0, 7))}, {blurred('w', focal.gaussian_kernel(3.0, 19))}, {shade('0', 'cells', 'elev')}, {shade('1', 'bf', 'v')}, {shade('2', 'bw', 'v')}
SELECT cell, round(s0.s, 6) AS shade, CASE WHEN elev >= 0 THEN round(power(0.75::DOUBLE * s1.s + 0.25::DOUBLE * s2.s, 0.85), 6) END AS relief FROM cells JOIN s0 USING (cell) JOIN s1 USING (cell) JOIN s2 USING (cell)"""


SQL = {
    "e_sobel": f"WITH {grid.SLOPE_SQL} SELECT cell, round(slope, 8) AS slope FROM sloped",
    "e_box": f"WITH {grid.CELLS_SQL} SELECT a.cell, (SELECT round(avg(b.elev), 6) FROM cells b WHERE b.r BETWEEN a.r - 5 AND a.r + 5 AND b.c BETWEEN a.c - 5 AND a.c + 5) AS mean, (SELECT count(*) FILTER (b.elev < 0) FROM cells b WHERE b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3) AS below FROM cells a",
    "e_step_slope": f"""WITH {grid.CELLS_SQL}, x AS (SELECT *, max(r) OVER (PARTITION BY c) AS hr, max(c) OVER (PARTITION BY r) AS hc FROM cells)
SELECT x.cell, round(sqrt(power(CASE WHEN least(x.c + 2, hc) > greatest(x.c - 2, 0) THEN (p.elev - q.elev) / (p.c - q.c) ELSE 0 END, 2) + power(CASE WHEN least(x.r + 2, hr) > greatest(x.r - 2, 0) THEN (s.elev - t.elev) / (s.r - t.r) ELSE 0 END, 2)), 6) AS slope
FROM x JOIN cells p ON p.r = x.r AND p.c = least(x.c + 2, hc) JOIN cells q ON q.r = x.r AND q.c = greatest(x.c - 2, 0) JOIN cells s ON s.c = x.c AND s.r = least(x.r + 2, hr) JOIN cells t ON t.c = x.c AND t.r = greatest(x.r - 2, 0)""",
    "d_coastline": f"""WITH {_SMOOTH}, n AS (SELECT a.cell, any_value(a.elev) AS elev, count(*) FILTER (b.elev < 0) AS w, count(*) FILTER (b.elev < -12) AS dp, count(*) FILTER (b.elev >= 0) AS l, count(*) FILTER (b.elev > 6) AS h FROM sm a JOIN sm b ON b.r BETWEEN a.r - 5 AND a.r + 5 AND b.c BETWEEN a.c - 5 AND a.c + 5 AND b.cell <> a.cell GROUP BY a.cell)
SELECT cell, elev >= 0 AND elev <= 18 AND w >= 8 AND l >= 8 AND h >= 3 AND (dp >= 2 OR w >= 18) AS coastline FROM n""",
    "d_around": f"""WITH {_SMOOTH}, f AS (SELECT *, floor(elev / 8) AS k FROM sm), n AS (SELECT a.cell, count(*) AS n, bool_and(b.elev > 0) AS land, bool_and(b.k = a.k) AS same, bool_and(b.elev < 0) FILTER (abs(b.r - a.r) + abs(b.c - a.c) = 1) AS wet, any_value(a.elev) AS elev FROM f a JOIN f b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell)
SELECT cell, n = 9 AND land AS inland, n = 9 AND same AS uniform, elev < 0 AND NOT wet AS shore FROM n""",
    "d_range_filter": f"WITH {grid.CLIMATE_SQL} SELECT cell, elev >= 0 AND elev <= 900 AND temp >= -5 AND temp <= 18 AND precip >= 400 AS match FROM climate",
    "e_majority": f"WITH {_CLS}, {_majority_sql('cl', 'm1', 1, 5, 2, 'NOT hard')} SELECT cell, k FROM m1",
    "e_organic": f"WITH {_CLS}, {_majority_sql('cl', 'm1', 1, 6, 3, 'blend')}, {_majority_sql('m1', 'm2', 2, 15, 7, 'blend')} SELECT cell, k FROM m2",
    "e_blur": _blur_sql(),
    "e_resize": f"WITH {_SRC}, {_taps('h * 5 // 2', 'w * 33 // 10', False)} SELECT r, c, round(v, 6) AS elev FROM out_, z WHERE r >= 3 AND r < h * 5 // 2 - 2 AND c >= 4 AND c < w * 33 // 10 - 5",
    "e_resize_extrapolated": f"WITH {_SRC}, {_taps('h * 5 // 2', 'w * 33 // 10', True)} SELECT r, c, round(v, 6) AS elev FROM out_",
    "e_nearest": f"WITH {_SRC} SELECT a.i AS r, b.j AS c, v AS elev FROM z, range(0, (SELECT h * 3 FROM z)) a(i), range(0, (SELECT w * 5 // 2 FROM z)) b(j) JOIN src ON src.r = a.i * h // (h * 3) AND src.c = b.j * w // (w * 5 // 2)",
    "e_pyramid": f"WITH {grid.CELLS_SQL}, src AS (SELECT r // 2 AS r, c // 2 AS c, avg(elev) / 3 AS v FROM cells GROUP BY ALL), s0 AS (SELECT max(r) + 1 AS th, max(c) + 1 AS tw FROM cells), z AS (SELECT (th + 1) // 2 AS h, (tw + 1) // 2 AS w, th, tw FROM s0), {_taps('th', 'tw', False).replace('AS c, h, w,', 'AS c, h, w,')} SELECT cells.r, cells.c, round(cells.elev + out_.v, 6) AS elev FROM cells JOIN out_ ON out_.r = cells.r AND out_.c = cells.c",
    "e_hillshade": _relief_sql(),
    "e_lapse": f"""WITH {grid.CLIMATE_SQL}, l AS (SELECT *, (elev > 0)::INT AS w, least(greatest((abs(region) - 0.05) / 0.68, 0), 1) AS q FROM climate),
 n AS (SELECT a.cell, any_value(a.temp) AS t, any_value(a.elev) AS e, any_value(a.q * a.q * (3 - 2 * a.q) * 0.024) AS cap, count(*) AS n, sum(b.w) AS sw, sum(b.temp * b.w) AS st, sum(b.elev * b.w) AS se, sum(b.elev * b.elev * b.w) AS see, sum(b.elev * b.temp * b.w) AS set_ FROM l a JOIN l b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY a.cell),
 m AS (SELECT *, see / (sw + 1e-6) - power(se / (sw + 1e-6), 2) AS var, set_ / (sw + 1e-6) - se / (sw + 1e-6) * st / (sw + 1e-6) AS cov FROM n),
 k AS (SELECT *, CASE WHEN n = 49 THEN greatest(-0.012, least(cap, CASE WHEN var < 1 OR sw < 0.02 * 49 THEN -0.0065 ELSE cov / (var + 1e-6) END)) END AS beta FROM m)
SELECT cell, round(beta, 8) AS beta, round(t - beta * e, 5) AS baseline FROM k""",
    "e_dilate": f"WITH {grid.CELLS_SQL} SELECT a.cell, bool_or(b.elev > 4600) AS near_peak FROM cells a JOIN cells b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.cell",
    "e_steepest": f"""WITH {grid.CELLS_SQL}, n AS (SELECT a.cell, b.elev < 900 AS wet, abs(b.elev - a.elev) / (CASE WHEN o.dr <> 0 AND o.dc <> 0 THEN sqrt(2) ELSE 1 END * 240) AS s FROM cells a CROSS JOIN {_OFF} JOIN cells b ON b.r = a.r + o.dr AND b.c = a.c + o.dc)
SELECT cell, round(max(s), 8) AS any_slope, round(coalesce(max(s) FILTER (wet), 0), 8) AS wet_slope FROM n GROUP BY cell""",
    "e_bed": f"""WITH {grid.CELLS_SQL}, b0 AS (SELECT cell, r, c, CASE WHEN elev < 1500 THEN elev END AS v FROM cells),
 b1 AS (SELECT a.cell, a.r, a.c, CASE WHEN any_value(a.v) IS NOT NULL THEN sum(b.v * CASE WHEN a.cell = b.cell THEN 5 ELSE 1 END) / sum(CASE WHEN b.v IS NOT NULL THEN CASE WHEN a.cell = b.cell THEN 5 ELSE 1 END END) END AS v FROM b0 a JOIN b0 b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell, a.r, a.c),
 b2 AS (SELECT a.cell, CASE WHEN any_value(a.v) IS NOT NULL THEN sum(b.v * CASE WHEN a.cell = b.cell THEN 5 ELSE 1 END) / sum(CASE WHEN b.v IS NOT NULL THEN CASE WHEN a.cell = b.cell THEN 5 ELSE 1 END END) END AS v FROM b1 a JOIN b1 b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell)
SELECT cell, round(v, 6) AS bed FROM b2""",
    "e_pad_crop": f"WITH {_SRC} SELECT a.i AS r, b.j AS c, v AS elev FROM z, range(0, (SELECT h + 1 FROM z)) a(i), range(0, (SELECT w + 2 FROM z)) b(j) JOIN src ON src.r = least(greatest(a.i - 1, 0), h - 1) AND src.c = least(greatest(b.j - 1, 0), w - 1)",
    "f_overlap_add": """WITH t AS (SELECT vec_id // 20 AS w_i, vec_id % 20 AS w_j, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), x AS (SELECT w_i * 6 - 2 + k // 8 AS r, w_j * 6 - 2 + k % 8 AS c, v FROM t)
SELECT r, c, round(sum(v), 6) AS v FROM x WHERE r >= 3 AND r < 120 AND c >= 5 AND c < 90 GROUP BY r, c""",
    "f_windows": f"WITH {grid.CELLS_SQL} SELECT cell, a.w AS w_i, b.w AS w_j, r - (a.w * 6 - 2) AS i, c - (b.w * 6 - 2) AS j FROM cells JOIN range(-2, (SELECT max(r) // 6 + 3 FROM cells)) a(w) ON r >= a.w * 6 - 2 AND r < a.w * 6 + 6 JOIN range(-2, 40) b(w) ON c >= b.w * 6 - 2 AND c < b.w * 6 + 6",
    "f_upstream": f"""WITH {grid.CELLS_SQL}, w AS (SELECT DISTINCT a.w AS w_i, b.w AS w_j FROM cells JOIN range(-2, (SELECT max(r) * 4 // 6 + 3 FROM cells)) a(w) ON r * 4 >= a.w * 6 - 2 AND r * 4 < a.w * 6 + 6 JOIN range(-2, 40) b(w) ON c >= b.w * 6 - 2 AND c < b.w * 6 + 6),
 m AS (SELECT * FROM w ANTI JOIN (SELECT vec_id // 20 AS w_i, vec_id % 20 AS w_j FROM embeddings) USING (w_i, w_j))
SELECT DISTINCT a.u AS w_i, b.u AS w_j FROM m JOIN range(-3, (SELECT max(r) * 4 // 12 + 3 FROM cells)) a(u) ON a.u * 12 <= w_i * 6 + 6 AND a.u * 12 + 15 >= w_i * 6 - 3 JOIN range(-3, 40) b(u) ON b.u * 12 <= w_j * 6 + 6 AND b.u * 12 + 15 >= w_j * 6 - 3""",
}
