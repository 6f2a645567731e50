"""Terrain and climate put together from coarse and fine fields, and what lies below the surface.

Coarse fields are read at fractional places through quads: each coarse cell with its three neighbours to the right and
below, made once on the small side, so that a fine cell needs one join and one expression, not four taps to be summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hashing, scalar
from gridloom.functions.noise import FIELDS, Field
from gridloom.operators import focal
from gridloom.runtime import checked_broadcast


def bilinear_at(points: DataFrame, y: str, x: str, g: DataFrame, values: list[str]) -> DataFrame:
    """``points`` with the values of a coarse grid at fractional places, in cells (a cell's own place is its number)."""
    d = points.withColumns({"_r": F.floor(F.col(y)), "_c": F.floor(F.col(x))})
    q = focal.quads(g, values).select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("quad").alias("_quad"))
    d = d.join(checked_broadcast(q), ["_r", "_c"], "left")
    fy, fx = F.col(y) - F.col("_r"), F.col(x) - F.col("_c")
    mix = lambda v: (F.col("_quad")["a"][v] * (1 - fx) + F.col("_quad")["b"][v] * fx) * (1 - fy) + (F.col("_quad")["e"][v] * (1 - fx) + F.col("_quad")["f"][v] * fx) * fy
    return d.withColumns({v: mix(v) for v in values}).drop("_r", "_c", "_quad")


def strided(cells: DataFrame, field: Field, stride: int, name: str) -> DataFrame:
    """Adds a smooth field, worked out at every ``stride``-th place only and read in between."""
    lattice = cells.select(F.floor(F.col("r") / stride).alias("r"), F.floor(F.col("c") / stride).alias("c")).distinct()
    corners = F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a in (0, 1) for b in (0, 1)])
    lattice = lattice.select(F.explode(corners).alias("p")).select("p.*").distinct()
    g = lattice.withColumn(name, field_column(field, F.col("c") * stride, F.col("r") * stride))
    return bilinear_at(cells.withColumns({"_y": F.col("r") / stride, "_w": F.col("c") / stride}), "_y", "_w", g, [name]).drop("_y", "_w")


def field_column(field: Field, x: Column, y: Column) -> Column:
    """A noise field at (x, y)."""
    return F.pandas_udf(lambda a, b: pd.Series(field.at(a.to_numpy(), b.to_numpy())), "double")(x.cast("double"), y.cast("double"))


def detail_fields(seed: int) -> dict[str, Field]:
    """The detail fields of a world (fixed values), each with its own seed from the lattice hash."""
    own = [int(hashing.np_hash(seed, np.array([0x7E22A1]), np.array([k]))[0]) & 0xFFFFFFFF for k in range(1, 7)]
    own = [v - (1 << 32) if v >> 31 else v for v in own]
    return {
        "character": Field(own[0], 1 / 2400, 2), "style": Field(own[1], 1 / 3200, 2), "plains": Field(own[2], 1 / 1400, 2), "swell": Field(own[3], 1 / 170, 2),
        "ridged_coarse": Field(own[4], 1 / 24, 3, kind="ridged"), "ridged_fine": Field(own[5], 1 / 6, 2, 0.6, kind="ridged"),
    }


def field_columns(cells: DataFrame, fields: dict[str, Field], x: str = "c", y: str = "r") -> DataFrame:
    """Adds several fields in one pass over the rows."""

    def call(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in frames:
            yield pd.DataFrame({n: f.at(a.to_numpy(), b.to_numpy()) for n, f in fields.items()})

    call.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    s = F.pandas_udf(call, ", ".join(f"{n} double" for n in fields))(F.col(x).cast("double"), F.col(y).cast("double"))
    return cells.withColumn("_f", s).select(*cells.columns, *[F.col("_f")[n].alias(n) for n in fields])


def add_detail(cells: DataFrame, seed: int, pixel: float, *, native: float = 30.0) -> DataFrame:
    """(cell columns, elev with detail): noise on slopes, blended to ridges or billows by style, swells on plains; faded
    near the sea. cells: (r, c, elev); cells under water stay."""
    k = pixel / native
    fields = detail_fields(seed) | {"fine": Field(FIELDS["temperature"].seed, 1 / 6, 2, 0.6), "coarse": Field(FIELDS["temperature"].seed, 1 / 24, 3)}
    d = field_columns(focal.sobel(cells, "elev", 1.0, "_grad"), fields)
    one = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    ease = lambda v: v * v * (3 - 2 * v)
    steep = F.least(F.lit(1.0), F.col("_grad") / (40.0 * k))
    d = d.withColumns({"_s": steep, "_fbm": (F.col("coarse") * 100 + F.col("fine") * 70) * k, "_ridge": (F.col("ridged_coarse") * 100 + F.col("ridged_fine") * 70) * k})
    d = d.withColumns({"_t": ease(one((F.abs("style") - 0.15) / 0.55)), "_g": ease(one((F.col("plains") - 0.05) / 0.5))})
    ridge = F.when(F.col("style") < 0, -F.col("_ridge")).otherwise(F.col("_ridge"))
    gate = F.pow("_s", F.lit(2.5))
    detail = F.when(gate > 1e-4, (F.col("_fbm") + (ridge - F.col("_fbm")) * F.col("_t")) * gate * (1 + 0.65 * F.col("character"))).otherwise(F.lit(0.0))
    swell = F.col("swell") * 75.0 * k * F.col("_g") * (1 - F.col("_s")) * (1 - F.col("_s"))
    e = F.col("elev")
    return d.select(*[c for c in cells.columns if c != "elev"], F.when(e < 0, e).otherwise(e + (detail + swell) * one(e / 25.0)).alias("elev"))


# ------------------------------------------------------------------------------------------------ assemblies


def decoded(coarse: DataFrame, channels: list[str], weight: str = "w") -> DataFrame:
    """Coarse channels over their summed weight; 0 where there is none."""
    return coarse.select("r", "c", *[F.when(F.col(weight) > 1e-6, F.col(x) / F.col(weight)).otherwise(F.lit(0.0)).alias(x) for x in channels])


CLIMATE = ["temp", "t_std", "precip", "pcv"]


def _baseline(coarse: DataFrame, half: int) -> DataFrame:
    """Coarse climate with the temperature at sea level and the lapse rate of a windowed regression."""
    d = decoded(coarse, ["elev", *CLIMATE]).withColumn("elev", F.pow(F.greatest("elev", F.lit(0.0)), F.lit(2.0)))
    return focal.lapse(d, "temp", "elev", half=half)


def climate(fine: DataFrame, coarse: DataFrame, stride: int, *, half: int = 7) -> DataFrame:
    """``fine`` with temp, t_std, precip, pcv and beta: coarse climate between cell centres, the temperature led along
    the lapse rate to the fine elevation. fine: (r, c, elev) in its own cells, ``stride`` of them a coarse cell."""
    g = _baseline(coarse, half).select("r", "c", "baseline", "beta", *CLIMATE[1:])
    own = fine.withColumns({"_y": (F.col("r") + 0.5) / stride - 0.5, "_w": (F.col("c") + 0.5) / stride - 0.5})
    d = bilinear_at(own, "_y", "_w", g, ["baseline", "beta", *CLIMATE[1:]]).drop("_y", "_w")
    return d.withColumn("temp", F.col("baseline") + F.col("beta") * F.greatest("elev", F.lit(0.0))).drop("baseline")


def latent_climate(fine: DataFrame, coarse: DataFrame, stride: int, step: int, *, half: int = 7) -> DataFrame:
    """The same at the centres of steps of ``step`` fine cells, from the coarse cell that holds the centre. fine: (r, c,
    elev) in steps."""
    g = _baseline(coarse, half).select(F.col("r").alias("_r"), F.col("c").alias("_c"), "baseline", "beta", *CLIMATE[1:])
    at = lambda x: F.floor((F.col(x) * step + step // 2) / stride)
    d = fine.withColumns({"_r": at("r"), "_c": at("c")}).join(checked_broadcast(g), ["_r", "_c"], "left").drop("_r", "_c")
    return d.withColumn("temp", F.col("baseline") + F.col("beta") * F.greatest("elev", F.lit(0.0))).drop("baseline")


def elevation(residual: DataFrame, low: DataFrame, size: tuple[int, int], low_size: tuple[int, int], box: tuple[int, int, int, int], *, sigma: float = 5.0, stats: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0)) -> DataFrame:
    """(r, c, elev) of a box: both bands over their weights and denormalised, the low band denoised, the pyramid decoded,
    the signed root undone. residual and low: (r, c, v, w); stats: mean and deviation of each band."""
    band = lambda d, m, s: decoded(d, ["v"]).withColumn("v", F.col("v") * s + m)
    fine, coarse = band(residual, stats[0], stats[1]), band(low, stats[2], stats[3])
    again = focal.pyramid_denoise(fine, coarse, "v", low_size, size, sigma)
    d = focal.pyramid_decode(fine, again, "v", low_size, size).withColumn("elev", scalar.col("signed_square", v="v"))
    return focal.crop(d.select("r", "c", "elev"), *box)


def upsampled(native: DataFrame, planes: list[str], size: tuple[int, int], scale: int) -> DataFrame:
    """(r, c, planes) of the grid ``scale`` times as fine, between the centres of the native cells."""
    h, w = size
    cells = native.sparkSession.range(h * scale * w * scale).select(F.floor(F.col("id") / (w * scale)).alias("r"), (F.col("id") % (w * scale)).alias("c"))
    at = lambda x, n: F.least(F.greatest((F.col(x) + 0.5) / scale - 0.5, F.lit(0.0)), F.lit(n - 1.0))
    return bilinear_at(cells.withColumns({"_y": at("r", h), "_w": at("c", w)}), "_y", "_w", native.select("r", "c", *planes), planes).drop("_y", "_w")


def conditioning(windows: DataFrame, means: list[float], stds: list[float], histogram: list[float], scales: list[float]) -> DataFrame:
    """(key, vector): the 58 numbers a latent window is conditioned on. windows: (key, planes: seven arrays of 4 x 4, the
    last the weights): both elevation planes, the mean of each climate plane over the inner 2 x 2, the mask, a histogram
    and the noise level, each part scaled."""
    w = F.col("planes")[6]
    plane = lambda k: F.transform(F.arrays_zip(F.col("planes")[k].alias("v"), w.alias("w")), lambda x: (F.when(x["w"] > 1e-6, x["v"] / x["w"]).otherwise(F.lit(0.0)) - means[k]) / stds[k])
    inner = lambda k: sum((F.element_at(plane(k), i) for i in (7, 10, 11)), F.element_at(plane(k), 6)) / 4
    times = lambda a, s: F.transform(a, lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)) * s)
    mask = F.array_repeat(F.lit((1.0 - means[6]) / stds[6]), 16)
    level = F.array(F.lit(-0.5 * 12.0**0.5 * scales[5]))
    hist = F.array(*[F.lit(float(v) * scales[4]) for v in histogram])
    return windows.select("key", F.concat(times(plane(0), scales[0]), times(plane(1), scales[1]), times(F.array(*[inner(k) for k in (2, 3, 4, 5)]), scales[2]), times(mask, scales[3]), hist, level).alias("vector"))


def synthetic(cells: DataFrame, fields: dict[str, Field], noise_tables: dict[str, list[float]], data_tables: dict[str, list[float]], std: tuple[float, float, float, float]) -> DataFrame:
    """(r, c, elev, temp, t_std, precip, pcv): noise fields matched to the distribution of measured climate, then
    corrected for altitude and rain; elevations as signed roots. std: slope and offset of the seasonal baseline and the
    1st and 99th percentile of seasonality."""
    slope, offset, lo, hi = std
    d = field_columns(cells.select("r", "c"), fields)
    d = d.select("r", "c", *[F.expr(scalar.interp(n, list(zip(noise_tables[n], data_tables[n])))).alias(n) for n in ("elev", "temp", "t_std", "precip", "pcv")])
    rate = F.greatest(F.lit(-9.8), F.least(F.lit(-4.0), -6.5 + 0.0015 * F.col("precip"))) / 1000
    temp = F.greatest(F.lit(-10.0), F.least(F.lit(40.0), F.col("temp") + rate * F.greatest("elev", F.lit(0.0))))
    d = d.withColumn("temp", temp).withColumn("_b", slope * F.col("temp") + offset)
    floor = F.greatest(F.lit(lo), -F.col("_b"))
    t_std = F.greatest((F.col("t_std") - lo) / (hi - lo) * (hi - floor) + floor + F.col("_b"), F.lit(20.0))
    return d.select("r", "c", scalar.col("signed_sqrt", v="elev").alias("elev"), "temp", t_std.alias("t_std"), "precip", (F.col("pcv") * F.greatest(F.lit(0.0), (185.0 - 0.04111 * F.col("precip")) / 185.0)).alias("pcv"))


# ------------------------------------------------------------------------------------------------ underground

#: Least depths, size of the noise regions, and per kind seed and threshold of its noise.
CAVE_DEPTH, DEEP_DEPTH, REGION = 24, 100, 256.0
CAVES = {"deep_dark": (55678, 0.25), "lush": (91027, 0.10), "dripstone": (33419, 0.25)}


def caves(places: DataFrame) -> DataFrame:
    """Adds ``cave``: deep_dark, lush, dripstone or null (the surface's class goes on).

    places: (x, z, y, surface height, humid, inland). Nothing above 24 blocks of depth; the deep dark below height 0 and
    more than 100 deep; lush caves under humid, dripstone under inland classes; each where its noise says so.
    """
    d = places
    for n, (seed, _) in CAVES.items():
        d = hashing.with_value_noise(d, f"_cave_{n}", seed, "x", "z", wave=REGION)
    on = {n: F.col(f"_cave_{n}") > t for n, (_, t) in CAVES.items()}
    depth = F.col("surface") - F.col("y")
    kind = (
        F.when(depth < CAVE_DEPTH, None).when((F.col("y") < 0) & (depth > DEEP_DEPTH) & on["deep_dark"], "deep_dark")
        .when(F.col("humid") & on["lush"], "lush").when(F.col("inland") & on["dripstone"], "dripstone")
    )
    return d.withColumn("cave", kind).drop(*[f"_cave_{n}" for n in CAVES])


AXES = ["temperature", "humidity", "continentalness", "erosion", "weirdness", "depth"]


def nearest_class(points: DataFrame, table: DataFrame) -> DataFrame:
    """``points`` with the class whose box in climate space is nearest (squared distance over six axes, ties to the
    first class). points: AXES; table: (class, and lo_ and hi_ of each axis), a table of stated size, broadcast whole."""
    rows = [r.asDict() for r in table.orderBy("class").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("the table of classes is larger than 10,000 rows")
    best = F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("int").alias("k"))
    listed = F.array(*[F.struct(F.lit(r["class"]).cast("int").alias("k"), *[F.lit(float(r[f"{s}_{a}"])).alias(f"{s}_{a}") for a in AXES for s in ("lo", "hi")]) for r in rows])

    def off(x: Column) -> Column:
        gaps = [F.greatest(x[f"lo_{a}"] - F.col(a), F.col(a) - x[f"hi_{a}"], F.lit(0.0)) for a in AXES]
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

    return points.withColumn("class", F.array_min(F.transform(listed, lambda x: F.struct(off(x).alias("d"), x["k"].alias("k"))))["k"] if rows else best["k"])
