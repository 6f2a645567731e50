"""Whole drainage queries: from elevations and runoff to filled surface, links, flow, lakes, channels and compact tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hashing, scalar
from gridloom.operators import channels, drainage, filling, flats
from gridloom.operators.focal import AROUND, neighbours
from gridloom.runtime import cut


def drain(cells: DataFrame, width: int, load: str, *, inflow: DataFrame | None = None, sea: float = 0.0) -> DataFrame:
    """(cell, r, c, elev, filled, down, acc): the filled surface, where each cell drains to, and what drains through it.

    cells: (cell = r * width + c, r, c, elev and the column ``load``). inflow: (cell, inflow) that enters from outside.
    """
    surface = filling.fill(cells, sea=sea)
    own = cut(cells.select("cell", "r", "c", "elev", F.col(load).cast("double").alias("load")).join(surface, ["r", "c"]))
    links = cut(flats.route(own, width, sea=sea))
    loads = own.select("cell", "load")
    if inflow is not None:
        loads = loads.join(inflow, "cell", "left").select("cell", (F.col("load") + F.coalesce("inflow", F.lit(0.0))).alias("load"))
    acc = drainage.accumulate(links, loads, "load", width)
    return own.drop("load").join(links, "cell").join(acc, "cell")


def network(cells: DataFrame, width: int, load: str, *, inflow: DataFrame | None = None, sea: float = 0.0) -> DataFrame:
    """``drain`` with the visible network and the lakes: adds visible, source, body, lake, water level and channel radius.

    cells: as for ``drain``, with (density, precip) for the threshold of visible flow.
    """
    d = cut(drain(cells, width, load, inflow=inflow, sea=sea))
    seen = drainage.visible(d.join(cells.select("cell", "density", "precip"), "cell")).drop("density", "precip")
    seen = cut(seen)
    links = d.select("cell", "down")
    first = drainage.sources(seen, links).withColumn("source", F.lit(True))
    water = cut(drainage.bodies(seen, links, width))
    lake = drainage.lakes(seen, water)
    out = seen.join(first, "cell", "left").join(water.select("cell", "body"), "cell", "left").join(lake.select("cell", "lake", "surface"), "cell", "left")
    radius = F.when(F.col("visible"), scalar.col("channel_radius", flow="acc", elev="elev"))
    return out.select("cell", "r", "c", "elev", "filled", "down", "acc", "visible", F.coalesce("source", F.lit(False)).alias("source"), "body", F.coalesce("lake", F.lit(0.0)).alias("lake"), "surface", radius.alias("radius"))


def coarse_tiles(cells: DataFrame, side: int, *, sea: float = 0.0) -> DataFrame:
    """(tile_i, tile_j, cell, downstream, accumulation): each super-tile flooded by itself and its cells counted along
    the links; cell is the place within the tile. Tiles fit a task."""
    d = cells.withColumns({"tile_i": F.floor(F.col("r") / side), "tile_j": F.floor(F.col("c") / side)})
    f = cut(drainage.flood_tiles(d, ["tile_i", "tile_j"]))
    place = lambda r, c: (F.col(r) - F.col("tile_i") * side) * side + F.col(c) - F.col("tile_j") * side
    # the tiles are scopes of their own: one number per tile stands for both of its coordinates
    links = f.select("tile_i", "tile_j", (F.col("tile_i") * (1 << 31) + F.col("tile_j")).alias("s"), place("r", "c").alias("v"), F.when(F.col("down_r") >= 0, place("down_r", "down_c")).alias("p"), F.lit(1.0).alias("one"))
    acc = drainage.hierarchy.accumulate(links, "one")
    return links.join(acc, ["s", "v"]).select("tile_i", "tile_j", F.col("v").alias("cell"), F.coalesce("p", F.lit(-1)).alias("downstream"), F.col("acc").cast("float").alias("accumulation"))


def routes_inward(links: DataFrame, depth: DataFrame, required: int, steps: int) -> DataFrame:
    """(cell, inward): whether following the links for at most ``steps`` (rounded up to a power of two) steps comes to a
    cell at least ``required`` cells away from the edge. depth: (cell, depth)."""
    state = cut(links.join(depth, "cell").select("cell", F.col("down").alias("next"), F.col("depth").alias("best")))
    for _ in range(max(steps - 1, 0).bit_length() + 1):
        ahead = state.select(F.col("cell").alias("next"), F.col("next").alias("next2"), F.col("best").alias("best2"))
        state = cut(state.join(ahead, "next", "left").select("cell", F.col("next2").alias("next"), F.greatest("best", "best2").alias("best")))
    return state.select("cell", (F.col("best") >= required).alias("inward"))


def injection_cells(crossings: DataFrame, candidates: DataFrame, radius: int) -> DataFrame:
    """(crossing, cell): where flow that crosses an edge at a position enters: the lowest candidate within ``radius``
    along that edge that routes inward, ties to the first position; no row without one.

    crossings: (crossing, side, position); candidates: (side, position, cell, elev, inward). Both are put into buckets
    of one radius, so each crossing meets three buckets of its own edge.
    """
    size = max(radius, 1)
    near = crossings.withColumn("_b", F.explode(F.sequence(F.floor((F.col("position") - radius) / size), F.floor((F.col("position") + radius) / size)))).withColumnRenamed("position", "_at")
    own = candidates.filter("inward").withColumn("_b", F.floor(F.col("position") / size))
    j = near.join(own, ["side", "_b"]).filter(F.abs(F.col("position") - F.col("_at")) <= radius)
    return j.groupBy("crossing").agg(F.min(F.struct("elev", "position", "cell")).alias("m")).select("crossing", F.col("m.cell").alias("cell"))


def meander(centres: DataFrame, links: DataFrame, cells: DataFrame, width: int, seed: int, pixel: float, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """(cell, row, col): channel centres moved sideways by coherent noise, less where it is steep or much flows, at most
    0.48 cells from the middle.

    The direction is that of the smoothed centres, whatever has been moved already, so the order of cells is free.
    centres: (cell, row, col); links: (cell, down) among them; cells: (cell, acc, slope).
    """
    ahead = centres.select(F.col("cell").alias("down"), F.col("row").alias("_dr"), F.col("col").alias("_dc"))
    d = centres.join(links.select("cell", "down"), "cell", "left").join(ahead, "down", "left").join(cells.select("cell", "acc", "slope"), "cell")
    d = d.withColumns({"_wr": F.col("row") + origin[0], "_wc": F.col("col") + origin[1]})
    d = hashing.with_value_noise(d, "_n", seed, "_wr", "_wc", wave=10.0)
    gentle = 1 - scalar.col("smooth_range", lo=0.0008, hi=0.018, v="slope")
    amplitude = 0.34 * gentle * (0.45 + 0.55 * (1 - F.least(F.greatest(F.col("acc") / 8.0, F.lit(0.0)), F.lit(1.0))))
    dr, dc = F.col("_dr") - F.col("row"), F.col("_dc") - F.col("col")
    length = F.hypot(dr, dc)
    shift = F.when(length > 0, F.col("_n") * amplitude / length).otherwise(F.lit(0.0))
    middle = {"row": F.floor(F.col("cell") / width) + 0.5, "col": F.col("cell") % width + 0.5}
    near = lambda x, mid: F.least(F.greatest(x, mid - 0.48), mid + 0.48)
    return d.select("cell", near(F.coalesce(F.col("row") - dc * shift, F.col("row")), middle["row"]).alias("row"), near(F.coalesce(F.col("col") + dr * shift, F.col("col")), middle["col"]).alias("col"))


def canonical_tile(cells: DataFrame, width: int, box: tuple[int, int, int, int], pixel: float, *, river: int, frozen: int, protected: list[int]) -> DataFrame:
    """(r, c, elev, mask, surface, class) of a box as compact integers, from samples with a halo around it.

    cells: (cell, r, c, elev, load, density, precip, temp, class_index). Drains the whole input, stamps its channels,
    lowers the ground under water, overlays rivers on the classes, cuts out the box (ends exclusive) and quantises.
    """
    n = cut(network(cells, width, "load"))
    v = n.filter("visible")
    points = v.select((F.col("r") + 0.5).alias("row"), (F.col("c") + 0.5).alias("col"), F.col("filled").alias("surface"), "radius", scalar.col("channel_load", flow="acc").alias("load"))
    stamps = drainage.stamp(points).select("r", "c", "section", F.col("surface").alias("_level"), "load")
    g = n.join(stamps, ["r", "c"], "left").join(cells.select("cell", "temp", "class_index"), "cell")
    near = neighbours(n.select("r", "c", "elev"), ["elev"], AROUND).join(n.select("r", "c", "elev"), ["r", "c"])
    dist = F.when(F.col("k").isin(0, 2, 5, 7), math.sqrt(2.0)).otherwise(1.0) * max(1.0, pixel)
    slope = near.groupBy("r", "c").agg(F.max(F.abs(F.col("n_elev") - F.col("elev")) / dist).alias("slope"))
    g = g.join(slope, ["r", "c"], "left").select("cell", "r", "c", "elev", "temp", "class_index", "lake", F.coalesce("surface", "_level").alias("surface"), F.coalesce("section", F.lit(0.0)).alias("section"), F.coalesce("load", F.lit(0.0)).alias("load"), F.coalesce("slope", F.lit(0.0)).alias("slope"))
    b = channels.bed_target(g, pixel).withColumn("ground", F.coalesce(F.least("bed", "elev"), "elev"))
    b = channels.soften_banks(b, "ground", "elev", "section")
    b = b.withColumn("wet", F.col("surface").isNotNull() & ((F.col("section") > 0) | (F.col("lake") > 0)))
    b = channels.river_overlay(b, "wet", river, frozen, protected)
    r0, c0, r1, c1 = box
    b = b.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    q = lambda law, **a: scalar.col(law, **a)
    return b.select(
        (F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), q("quantise_elevation", e="ground").cast("short").alias("elev"),
        q("water_mask", profile="section", load="load", lake="lake").cast("short").alias("mask"),
        F.when(F.col("wet"), q("quantise_elevation", e="surface")).otherwise(F.lit(-32768)).cast("short").alias("surface"), F.col("class_index").cast("short").alias("class"),
    )
