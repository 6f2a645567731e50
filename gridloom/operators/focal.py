"""Neighbourhood operators on grids in long form, (r, c, value columns), and resampling between grids.

The grid is cut into square tiles, and each tile is given a rim of the cells around it as wide as the operator
reaches. Separable operators then run as two window passes inside the tile, along rows and along columns: one shuffle
in all, by tile, and no task sees more than its tiles, however tall or wide the grid. Operators over irregular
neighbourhoods send each cell to the cells that see it (offset explode) and aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast

RC = ["r", "c"]
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


#: Cells a side of a tile.
SIDE = 128
TILE = ["_i", "_j"]


def halo(g: DataFrame, side: int, margin: int) -> DataFrame:
    """Each cell once per tile whose core or rim holds it: adds tile_i, tile_j and core."""
    span = lambda x: F.sequence(F.floor((F.col(x) - margin) / side), F.floor((F.col(x) + margin) / side))
    d = g.withColumn("tile_i", F.explode(span("r"))).withColumn("tile_j", F.explode(span("c")))
    return d.withColumn("core", (F.floor(F.col("r") / side) == F.col("tile_i")) & (F.floor(F.col("c") / side) == F.col("tile_j")))


def by_tile(g: DataFrame, margin: int, run: Callable[[DataFrame], DataFrame], side: int = SIDE) -> DataFrame:
    """``run`` over the cells by tiles with a rim of ``margin`` cells; its windows are partitioned by TILE and more."""
    d = halo(g, side, margin).withColumnsRenamed({"tile_i": "_i", "tile_j": "_j", "core": "_core"})
    return run(d.repartition(*TILE)).filter("_core").drop(*TILE, "_core")


def _along(axis: str) -> WindowSpec:
    """All cells of a tile's row or column, in order along the axis."""
    return Window.partitionBy(*TILE, "r" if axis == "c" else "c").orderBy(axis)


def box_sums(g: DataFrame, k: int, **what: Column) -> DataFrame:
    """Adds, per name, the sum of an expression over the (2k+1) square around each cell; the square is cut at edges."""
    row, column = _along("c").rangeBetween(-k, k), _along("r").rangeBetween(-k, k)

    def run(d: DataFrame) -> DataFrame:
        d = d.withColumns({f"_{n}": F.sum(e.cast("double")).over(row) for n, e in what.items()})
        return d.withColumns({n: F.sum(f"_{n}").over(column) for n in what}).drop(*[f"_{n}" for n in what])

    return by_tile(g, k, run)


def box_mean(g: DataFrame, value: str, k: int, name: str = "mean") -> DataFrame:
    """Mean of the present values in the square around each cell."""
    d = box_sums(g, k, _sum=F.col(value), _count=F.col(value).isNotNull().cast("int"))
    return d.withColumn(name, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).drop("_sum", "_count")


def step_slope(g: DataFrame, value: str, k: int, name: str = "slope") -> DataFrame:
    """Central difference over k cells, clamped at the edges and divided by the span that is really there."""

    def run(d: DataFrame) -> DataFrame:
        for axis in ("c", "r"):
            # the furthest present cell within k on either side
            back, ahead = _along(axis).rangeBetween(-k, 0), _along(axis).rangeBetween(0, k)
            rise = F.last(value).over(ahead) - F.first(value).over(back)
            span = F.last(axis).over(ahead) - F.first(axis).over(back)
            d = d.withColumn(f"_s{axis}", F.when(span > 0, rise / span).otherwise(0.0))
        return d.withColumn(name, F.sqrt(F.col("_sc") * F.col("_sc") + F.col("_sr") * F.col("_sr"))).drop("_sc", "_sr")

    return by_tile(g, k, run)


def sobel(g: DataFrame, value: str, pixel: float, name: str = "slope") -> DataFrame:
    """Adds the Sobel gradient over 3x3 cells with repeated edges, per unit of length."""

    def run(d: DataFrame) -> DataFrame:
        across, down, e = _along("c"), _along("r"), F.col(value)
        left, right = F.coalesce(F.lag(e).over(across), e), F.coalesce(F.lead(e).over(across), e)
        d = d.withColumns({"_s": left + 2 * e + right, "_d": right - left})
        near = lambda c, f: F.coalesce(f(c).over(down), F.col(c))
        d = d.withColumns({"_dx": near("_d", F.lag) + 2 * F.col("_d") + near("_d", F.lead), "_dy": near("_s", F.lead) - near("_s", F.lag)})
        return d.withColumn(name, F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / 8 / pixel).drop("_s", "_d", "_dx", "_dy")

    return by_tile(g, 1, run)


def neighbours(g: DataFrame, columns: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """One row per (cell, offset) whose neighbour exists: (r, c, k, and the neighbour's columns prefixed ``n_``)."""
    seen = g.select(*RC, *[F.col(x).alias(f"n_{x}") for x in columns], F.posexplode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])).alias("k", "o"))
    # the row at (r, c) is the k-th neighbour of (r - dr, c - dc)
    return seen.select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "k", *[f"n_{x}" for x in columns])


def coastline(g: DataFrame, elev: str, slope: str) -> DataFrame:
    """Adds ``coastline``: low, gentle land with enough water, land, higher land and deep water within 5 cells."""
    e = F.col(elev)
    d = box_sums(g, 5, water=(e < 0), deep=(e < -12), land=(e >= 0), high=(e > 6))
    own = lambda cond: F.when(cond, 1).otherwise(0)
    water, land, high, deep = F.col("water") - own(e < 0), F.col("land") - own(e >= 0), F.col("high") - own(e > 6), F.col("deep") - own(e < -12)
    ok = (e >= 0) & (e <= 18) & (F.col(slope) <= 0.35) & (water >= 8) & (land >= 8) & (high >= 3) & ((deep >= 2) | (water >= 18))
    return d.withColumn("coastline", F.coalesce(ok, F.lit(False))).drop("water", "deep", "land", "high")


def all_around(g: DataFrame, flag: str, name: str) -> DataFrame:
    """Adds ``name``: the cell and its eight neighbours all exist and hold the flag."""
    d = box_sums(g, 1, _n=F.lit(1), _f=F.col(flag).cast("int"))
    return d.withColumn(name, (F.col("_n") == 9) & (F.col("_f") == 9)).drop("_n", "_f")


def majority(g: DataFrame, cls: str, radius: int, least: int, most_same: int, *, frozen: str | None = None, only: str | None = None) -> DataFrame:
    """Replaces isolated classes by the commonest class around; the grid's rim of ``radius`` cells stays.

    A cell changes if another class has at least ``least`` cells in its square and its own at most ``most_same``.
    ``frozen``: cells with this flag neither change nor count. ``only``: just flagged cells change, and count.
    Ties go to the class met first in row order. The classes come back in the column ``cls``.
    """
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    flag = frozen or only
    base = g.withColumn("_take", F.lit(True) if flag is None else (~F.col(frozen) if frozen else F.col(only)))
    near = neighbours(base, [cls, "_take"], offsets)
    per = near.groupBy("r", "c", F.col(f"n_{cls}").alias("k_cls")).agg(F.count("*").alias("n"), F.sum(F.col("n__take").cast("int")).alias("n_take"), F.min("k").alias("first"))
    best = per.groupBy("r", "c").agg(
        F.max(F.struct(F.col("n_take"), -F.col("first"), F.col("k_cls"))).alias("b"), F.sum("n").alias("cells"), F.map_from_entries(F.collect_list(F.struct("k_cls", "n_take"))).alias("m")
    )
    d = base.join(best, RC, "left")
    same = F.coalesce(F.element_at("m", F.col(cls)), F.lit(0))
    swap = F.col("_take") & (F.col("cells") == len(offsets)) & (F.col("b.k_cls") != F.col(cls)) & (F.col("b.n_take") >= least) & (same <= most_same)
    return d.withColumn(cls, F.when(swap, F.col("b.k_cls")).otherwise(F.col(cls))).drop("_take", "b", "cells", "m")


def gaussian_kernel(sigma: float, size: int | None = None) -> list[float]:
    """Normalised weights; the default size is the largest odd number up to 2 sigma + 1."""
    size = size or (int(2 * sigma) // 2) * 2 + 1
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(w) for x in w]


def _blurred(d: DataFrame, value: str, kernel: list[float], name: str, renormalise: bool) -> DataFrame:
    """``blur`` on tiled cells."""
    k = len(kernel) // 2
    out = d.withColumn(name, F.col(value).cast("double"))
    for axis in ("c", "r"):
        w = _along(axis)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(name).over(whole), F.last(name).over(whole)
        terms, weights = [], []
        for i, x in enumerate(kernel):
            o = i - k
            v = F.col(name) if o == 0 else (F.lag(name, -o).over(w) if o < 0 else F.lead(name, o).over(w))
            terms.append(F.coalesce(v, F.lit(0.0) if renormalise else (first if o < 0 else last)) * x)
            weights.append(F.when(v.isNotNull(), x).otherwise(0.0))
        total = sum(terms[1:], terms[0])
        out = out.withColumn("_b", total / sum(weights[1:], weights[0]) if renormalise else total).drop(name).withColumnRenamed("_b", name)
    return out


def blur(g: DataFrame, value: str, kernel: list[float], name: str, *, renormalise: bool = False) -> DataFrame:
    """Separable weighted mean along rows, then columns.

    Edge cells stand in for what lies beyond them; with ``renormalise`` the weights that fall outside are left out
    instead. The kernel has odd length. Rows without gaps: the window counts cells.
    """
    return by_tile(g, len(kernel) // 2, lambda d: _blurred(d, value, kernel, name, renormalise))


def quads(g: DataFrame, values: list[str], *, repeat: bool = True) -> DataFrame:
    """(r, c, quad): each cell's values with those to the right, below, and right below; a missing one repeats its
    neighbour, or is null without ``repeat``."""
    four = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("r") - a).alias("r"), (F.col("c") - b).alias("c")) for k, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])])
    d = g.select(F.explode(four).alias("_q"), F.struct(*values).alias("_v")).select("_q.*", "_v")
    d = d.groupBy("r", "c").agg(*[F.any_value(F.when(F.col("k") == k, F.col("_v")), True).alias(f"_{k}") for k in range(4)])
    a, b, e, f = (F.col(f"_{k}") for k in range(4))
    if not repeat:
        return d.select("r", "c", F.struct(a.alias("a"), b.alias("b"), e.alias("e"), f.alias("f")).alias("quad"))
    # beyond an edge the nearest row or column is repeated
    own = [F.coalesce(a, e, b, f).alias("a"), F.coalesce(b, f, a, e).alias("b"), F.coalesce(e, a, f, b).alias("e"), F.coalesce(f, b, e, a).alias("f")]
    return d.select("r", "c", F.struct(*own).alias("quad"))


def resize(g: DataFrame, value: str, size: tuple[int, int], target: tuple[int, int], *, window: tuple[int, int, int, int] | None = None, extrapolate: bool = False) -> DataFrame:
    """Bilinear resize with half-pixel centres: (r, c, value) of the target grid, or of its window (r0, c0, r1, c1).

    Samples beyond the outer centres repeat the edge, or follow its last difference with ``extrapolate``. Only the
    window's cells are generated, and each meets one row that holds its four taps; where a tap has no cell the value is
    null.
    """
    (h, w), (th, tw) = size, target
    r0, c0, r1, c1 = window or (0, 0, th, tw)
    cells = g.sparkSession.range(max(r1 - r0, 0) * max(c1 - c0, 0)).select((F.floor(F.col("id") / max(c1 - c0, 1)) + r0).alias("r"), (F.col("id") % max(c1 - c0, 1) + c0).alias("c"))

    def tap(x: str, n: int, tn: int) -> tuple[Column, Column]:
        at = (F.col(x) + 0.5) * n / max(tn, 1) - 0.5
        if not extrapolate or n == 1:
            at = F.least(F.greatest(at, F.lit(0.0)), F.lit(n - 1.0))
        low = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(max(n - 2, 0)))
        return low, at - low

    (rl, rf), (cl, cf) = tap("r", h, th), tap("c", w, tw)
    d = cells.select("r", "c", rl.alias("_r"), cl.alias("_c"), rf.alias("_fr"), cf.alias("_fc"))
    four = quads(g.select("r", "c", F.col(value).cast("double").alias("v")), ["v"], repeat=False).select(F.col("r").alias("_r"), F.col("c").alias("_c"), "quad")
    d = d.join(checked_broadcast(four), ["_r", "_c"], "left")

    def between(p: Column, q: Column, f: Column) -> Column:
        return F.when(f == 0, p).when(f == 1, q).otherwise(p * (1 - f) + q * f)

    # along the row first: the order of the sums decides which way a half is rounded
    a, b, e, f = (F.col("quad")[k]["v"] for k in "abef")
    out = between(between(a, b, F.col("_fc")), between(e, f, F.col("_fc")), F.col("_fr"))
    return d.select("r", "c", out.alias(value))


def nearest(g: DataFrame, value: str, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest upsample by integer index map: (r, c, value) of the target grid."""
    (h, w), (th, tw) = size, target
    cells = g.sparkSession.range(th * tw).select(F.floor(F.col("id") / tw).alias("r"), (F.col("id") % tw).alias("c"))
    cells = cells.withColumns({"sr": F.floor(F.col("r") * h / th), "sc": F.floor(F.col("c") * w / tw)})
    return cells.join(g.select(F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["sr", "sc"]).select("r", "c", value)


def pyramid_decode(residual: DataFrame, low: DataFrame, value: str, low_size: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Residual plus the resized low band."""
    up = resize(low, value, low_size, size).withColumnRenamed(value, "_up")
    return residual.join(up, RC).withColumn(value, F.col(value) + F.col("_up")).drop("_up")


def pyramid_denoise(residual: DataFrame, low: DataFrame, value: str, low_size: tuple[int, int], size: tuple[int, int], sigma: float) -> DataFrame:
    """The low band again from the decoded field: extrapolated decode, downsample, blur."""
    up = resize(low, value, low_size, size, extrapolate=True).withColumnRenamed(value, "_up")
    full = residual.join(up, RC).select(*RC, (F.col(value) + F.col("_up")).alias(value))
    return blur(resize(full, value, size, low_size), value, gaussian_kernel(sigma), "_v").select(*RC, F.col("_v").alias(value))


def lapse(g: DataFrame, temp: str, elev: str, *, half: int = 7, cap: str | None = None, fallback: float = 0.02) -> DataFrame:
    """Adds ``beta`` and ``baseline``: windowed land-weighted regression of temperature on elevation.

    The slope is clamped to [-0.012, cap or 0] and falls back to -0.0065 where the elevation's variance is below 1
    or land covers less than ``fallback`` of the full window. Rim cells whose window is cut get nulls.
    """
    full = (2 * half + 1) ** 2
    e, t = F.col(elev), F.col(temp)
    land = F.when(e > 0, 1.0).otherwise(0.0)
    d = box_sums(g, half, _n=F.lit(1), _w=land, _t=t * land, _e=e * land, _ee=e * e * land, _et=e * t * land)
    den = F.col("_w") + 1e-6
    mt, me, mee, met = (F.col(x) / den for x in ("_t", "_e", "_ee", "_et"))
    var = mee - me * me
    raw = F.when((var < 1.0) | (F.col("_w") < fallback * full), F.lit(-0.0065)).otherwise((met - me * mt) / (var + 1e-6))
    top = F.col(cap) if cap else F.lit(0.0)
    beta = F.when(F.col("_n") == full, F.greatest(F.lit(-0.012), F.least(top, raw)))
    return d.withColumn("beta", beta).withColumn("baseline", t - F.col("beta") * e).drop("_n", "_w", "_t", "_e", "_ee", "_et")


def _shaded(d: DataFrame, elev: str, pixel: float, azimuth: float, altitude: float, name: str) -> DataFrame:
    """``hillshade`` on tiled cells."""
    e = F.col(elev)
    row, column = _along("c"), _along("r")
    dx = (F.coalesce(F.lead(e).over(row), e) - F.coalesce(F.lag(e).over(row), e)) / (2 * pixel)
    dy = (F.coalesce(F.lead(e).over(column), e) - F.coalesce(F.lag(e).over(column), e)) / (2 * pixel)
    az, al = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    d = d.withColumns({"_dx": dx, "_dy": dy})
    slope, aspect = F.atan(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)), F.atan2(F.col("_dy"), -F.col("_dx"))
    shade = math.sin(al) * F.cos(slope) + math.cos(al) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    return d.withColumn(name, F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0))).drop("_dx", "_dy")


def hillshade(g: DataFrame, elev: str, pixel: float, *, azimuth: float = 315.0, altitude: float = 45.0, name: str = "shade") -> DataFrame:
    """Adds the shade of a surface lit from (azimuth, altitude), in [0, 1], from one-cell gradients with repeated edges."""
    return by_tile(g, 1, lambda d: _shaded(d, elev, pixel, azimuth, altitude, name))


def relief(g: DataFrame, elev: str, pixel: float) -> DataFrame:
    """Adds ``relief`` in [0, 1]: shades of a fine and a broad blur mixed 0.75 to 0.25, gamma 0.85; null over ocean."""
    fine, broad = gaussian_kernel(1.0, 7), gaussian_kernel(3.0, 19)

    def run(d: DataFrame) -> DataFrame:
        d = _blurred(_blurred(d, elev, fine, "_fine", True), elev, broad, "_broad", True)
        return _shaded(_shaded(d, "_fine", pixel, 315.0, 45.0, "_s1"), "_broad", pixel, 315.0, 45.0, "_s2")

    mixed = F.pow(0.75 * F.col("_s1") + 0.25 * F.col("_s2"), F.lit(0.85))
    return by_tile(g, len(broad) // 2 + 1, run).withColumn("relief", F.when(F.col(elev) >= 0, mixed)).drop("_fine", "_broad", "_s1", "_s2")


def dilate(g: DataFrame, flag: str, passes: int, name: str) -> DataFrame:
    """Adds ``name``: a flagged cell lies within ``passes`` cells, diagonals included."""
    d = box_sums(g, passes, _n=F.coalesce(F.col(flag), F.lit(False)).cast("int"))
    return d.withColumn(name, F.col("_n") > 0).drop("_n")


def steepest(g: DataFrame, value: str, pixel: float, name: str, *, among: str | None = None) -> DataFrame:
    """Adds the greatest absolute drop per distance to any of eight neighbours (those with the flag ``among``)."""
    cols = [value] + ([among] if among else [])
    near = neighbours(g, cols, AROUND)
    if among:
        near = near.filter(f"n_{among}")
    dist = F.when(F.col("k").isin(0, 2, 5, 7), math.sqrt(2.0)).otherwise(1.0) * max(1.0, pixel)
    up = near.join(g.select(*RC, value), RC).groupBy(*RC).agg(F.max(F.abs(F.col(f"n_{value}") - F.col(value)) / dist).alias(name))
    out = g.join(up, RC, "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def smooth_present(g: DataFrame, value: str, centre: float, side: float, diagonal: float, name: str) -> DataFrame:
    """Weighted mean of a cell and its present neighbours; absent (null) cells stay absent."""
    near = neighbours(g.filter(F.col(value).isNotNull()), [value], AROUND)
    w = F.when(F.col("k").isin(0, 2, 5, 7), diagonal).otherwise(side)
    s = near.groupBy(*RC).agg(F.sum(F.col(f"n_{value}") * w).alias("_s"), F.sum(w).alias("_w"))
    d = g.join(s, RC, "left")
    out = (F.col(value) * centre + F.coalesce("_s", F.lit(0.0))) / (centre + F.coalesce("_w", F.lit(0.0)))
    return d.withColumn(name, F.when(F.col(value).isNotNull(), out)).drop("_s", "_w")


def pad(g: DataFrame, size: tuple[int, int], columns: list[str]) -> DataFrame:
    """The grid with a rim of one repeated cell; the old (0, 0) is the new (1, 1)."""
    h, w = size
    # a cell on a rim stands for the rim beside it too
    places = lambda x, n: F.filter(F.array(F.when(F.col(x) == 0, 0), F.col(x) + 1, F.when(F.col(x) == n - 1, n + 1)), lambda v: v.isNotNull())
    d = g.select(F.explode(places("r", h)).alias("r2"), "c", *columns)
    return d.select(F.col("r2").alias("r"), F.explode(places("c", w)).alias("c2"), *columns).withColumnRenamed("c2", "c")


def crop(g: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The box with exclusive ends, shifted to start at (0, 0)."""
    d = g.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return d.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})
