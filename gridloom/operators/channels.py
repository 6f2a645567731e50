"""Channels as curves: tangents, sampled segments, bed targets, banks and the river overlay on classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators.focal import AROUND, neighbours


def tangents(centres: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, t_row, t_col): half the way from the dominant inflow to the outflow, one-sided at ends, at most 1.35 long.

    centres: (cell, row, col); links: (cell, up, down), null or not among the centres where there is none.
    """
    at = lambda k: centres.select(F.col("cell").alias(k), F.col("row").alias(f"{k}_row"), F.col("col").alias(f"{k}_col"))
    j = centres.join(links.select("cell", "up", "down"), "cell", "left").join(at("up"), "up", "left").join(at("down"), "down", "left")

    def along(x: str):  # noqa: ANN202
        u, d, own = F.col(f"up_{x}"), F.col(f"down_{x}"), F.col(x)
        return F.when(u.isNotNull() & d.isNotNull(), (d - u) * 0.5).when(d.isNotNull(), d - own).when(u.isNotNull(), own - u).otherwise(0.0)

    t = j.select("cell", along("row").alias("a"), along("col").alias("b"))
    length = F.hypot("a", "b")
    cap = F.when(length > 1.35, 1.35 / length).otherwise(1.0)
    return t.select("cell", (F.col("a") * cap).alias("t_row"), (F.col("b") * cap).alias("t_col"))


def segments(nodes: DataFrame, step: float = 0.2) -> DataFrame:
    """Sampled points of every channel segment: (cell, k, row, col, flow, surface, radius).

    nodes: (cell, down, row, col, t_row, t_col, acc, surface, radius). A node without an outflow among the nodes gives
    its own point. The curve is a cubic through both ends with their tangents; the level never rises downstream.
    """
    names = ["row", "col", "t_row", "t_col", "acc", "surface", "radius"]
    d = nodes.join(nodes.select(F.col("cell").alias("down"), *[F.col(n).alias(f"d_{n}") for n in names]), "down", "left")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("d_row") - F.col("row"), F.col("d_col") - F.col("col")) / step).cast("int"))
    d = d.withColumn("n", F.when(F.col("d_row").isNull(), 0).otherwise(n))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0))
    curve = lambda x: F.when(F.col("n") == 0, F.col(x)).otherwise(scalar.col("hermite", p0=x, m0=f"t_{x}", p1=f"d_{x}", m1=f"d_t_{x}", t="t"))
    mix = lambda a, b: F.when(F.col("n") == 0, F.col(a)).otherwise(F.col(a) + (b - F.col(a)) * F.col("t"))
    return d.select("cell", "k", curve("row").alias("row"), curve("col").alias("col"), mix("acc", F.col("d_acc")).alias("flow"), mix("surface", F.least("surface", "d_surface")).alias("surface"), mix("radius", F.col("d_radius")).alias("radius"))


def bed_target(cells: DataFrame, metres: float) -> DataFrame:
    """Adds ``bed``: the floor under lakes and channels, with a limit on how deep a channel may cut.

    cells: (elev, surface or null, lake, section, load, slope). Cells without a water surface, lake or channel: null.
    """
    unit = lambda x: x * x * (3 - 2 * x)
    one = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    load, steep = one(F.col("load")), unit(one((F.col("slope") - 0.035) / 0.18))
    centre = 1.0 + (0.20 + 4.65 * F.pow(load, F.lit(0.58))) * (1 - 0.70 * steep)
    edge = 0.28 + 0.12 * (1 - steep)
    d = cells.withColumns({"_c": centre, "_e": edge, "_p": unit(unit(F.col("section"))), "_cut": (1.0 + 1.5 * F.sqrt(load)) * (1 - 0.35 * steep), "_more": 3.5 * (1 - 0.35 * steep)})
    channel = F.greatest(F.col("surface") - (F.col("_e") + (F.col("_c") - F.col("_e")) * F.col("_p")) * metres, F.col("elev") - (F.col("_cut") + F.col("_more") * F.col("_p")) * metres)
    lake = F.col("surface") - F.least(F.lit(8.0), 2.0 + F.col("lake") / max(1.0, metres)) * metres
    bed = F.when(F.col("surface").isNull(), None).when(F.col("lake") >= 0.75, lake).when(F.col("section") > 0, channel)
    return d.withColumn("bed", bed).drop("_c", "_e", "_p", "_cut", "_more")


def soften_banks(g: DataFrame, adjusted: str, natural: str, section: str, passes: int = 1) -> DataFrame:
    """Lifts the over-cut rim of channels toward the distance-weighted mean around, never above the natural ground.

    Inner cells only, with a section strictly inside (0, 0.34); the rest stays.
    """
    out = g
    for _ in range(passes):
        near = neighbours(out.select("r", "c", adjusted), [adjusted], AROUND)
        w = F.when(F.col("k").isin(0, 2, 5, 7), 1 / 2**0.5).otherwise(1.0)
        m = near.groupBy("r", "c").agg((F.sum(F.col(f"n_{adjusted}") * w) / F.sum(w)).alias("_m"), F.count("*").alias("_n"))
        d = out.join(m, ["r", "c"], "left")
        p = F.col(section) / 0.34
        lifted = F.least(F.col(natural), F.col(adjusted) + (F.col("_m") - F.col(adjusted)) * 0.13 * 4 * p * (1 - p))
        inner = (F.col("_n") == 8) & (p > 0) & (p < 1) & (F.col("_m") > F.col(adjusted))
        out = d.withColumn(adjusted, F.when(inner, lifted).otherwise(F.col(adjusted))).drop("_m", "_n")
    return out


def river_overlay(cells: DataFrame, wet: str, river: int, frozen: int, protected: list[int], cls: str = "class_index") -> DataFrame:
    """Wet cells become rivers, frozen below zero, unless their class is ocean or shore."""
    swap = F.col(wet) & ~F.col(cls).isin(protected)
    return cells.withColumn(cls, F.when(swap, F.when(F.col("temp") < 0, frozen).otherwise(river)).otherwise(F.col(cls)))


def nearest_cell(cells: DataFrame, ok: str, r: int, c: int) -> DataFrame:
    """One row (r, c, rings): the qualifying cell in the nearest square ring, then by row, then by column; none, no row.

    A running minimum per task, so nothing is sorted.
    """
    dr, dc = F.col("r") - r, F.col("c") - c
    best = cells.filter(ok).agg(F.min(F.struct(F.greatest(F.abs(dr), F.abs(dc)).alias("rings"), F.col("r"), F.col("c"))).alias("m"))
    return best.filter("m is not null").select("m.r", "m.c", "m.rings")


def growing_search(cells: DataFrame, ok: str, r: int, c: int, *, first: int, most: int, step: int = 8) -> DataFrame:
    """One row (r, c, span): the qualifying cell nearest to a place (by square rings, then row, then column) inside the
    smallest window around it that has one; without any up to ``most``, the place itself and a null span.

    One pass over the widest window: each cell knows the smallest window that holds it.
    """
    dr, dc = F.col("r") - r, F.col("c") - c
    # a window of size s runs from -s/2 to s/2, its end left out
    half = F.greatest(F.when(dr >= 0, dr + 1).otherwise(-dr), F.when(dc >= 0, dc + 1).otherwise(-dc))
    size = F.greatest(F.lit(first), F.lit(first) + F.ceil((half * 2 - first) / step) * step)
    inside = cells.filter((F.col("r") >= r - most // 2) & (F.col("r") < r + most // 2) & (F.col("c") >= c - most // 2) & (F.col("c") < c + most // 2)).filter(ok)
    best = inside.agg(F.min(F.struct(size.cast("int").alias("span"), F.greatest(F.abs(dr), F.abs(dc)).alias("ring"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))).alias("m"))
    return best.select(F.coalesce("m.r", F.lit(r)).cast("long").alias("r"), F.coalesce("m.c", F.lit(c)).cast("long").alias("c"), F.col("m.span").alias("span"))


def representatives(samples: DataFrame, cls: str, axes: list[str], key: str) -> DataFrame:
    """(class, key): per class the sample nearest to its mean over the axes, ties to the lowest key."""
    mean = samples.groupBy(cls).agg(*[F.avg(a).alias(f"_{a}") for a in axes])
    d = samples.join(mean, cls)
    dist = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"_{axes[0]}")) * (F.col(axes[0]) - F.col(f"_{axes[0]}")))
    return d.groupBy(cls).agg(F.min(F.struct(dist.alias("d"), F.col(key).alias("k"))).alias("m")).select(cls, F.col("m.k").alias(key))


def deep_classes(counts: DataFrame, cls: str, depth: str, n: str, ratio: float = 8.0) -> DataFrame:
    """(class): classes whose fullest depth holds more than ``ratio`` times their surface (depth 0) count."""
    d = counts.groupBy(cls).agg(F.max(F.when(F.col(depth) != 0, F.col(n))).alias("most"), F.coalesce(F.sum(F.when(F.col(depth) == 0, F.col(n))), F.lit(0)).alias("top"))
    return d.filter(F.col("most") > ratio * F.col("top")).select(cls)
