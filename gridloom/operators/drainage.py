"""Drainage on grids: links, accumulation, water bodies and channels.

Links are (cell, down) rows over a dense cell number r * width + c; what follows chains of them is tree contraction
by square blocks of the grid. The exact priority flood orders all cells of a tile globally, so it runs inside one
tile (bounded by its side) with a heap; tiles can be given a rim. ``filling`` fills a grid of any size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import hierarchy
from gridloom.operators.focal import AROUND, halo, neighbours


def flood(elev: np.ndarray, sea: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filled, downstream index or -1, order of visit) of one tile by priority flood.

    Seeds are the border and cells at or below the sea; the lowest (fill, index) is taken next and its unvisited
    neighbours drain to it, in scan order. NaN marks a place without a cell, and the cells beside it are border.
    """
    h, w = elev.shape
    filled, down, order = elev.astype(float).copy(), np.full(h * w, -1), []
    flat = filled.ravel()
    seen = np.isnan(flat)
    beyond = np.pad(seen.reshape(h, w), 1, constant_values=True)
    rim = np.logical_or.reduce([beyond[1 + a : h + 1 + a, 1 + b : w + 1 + b] for a, b in AROUND])
    seeds = np.flatnonzero((rim.ravel() | (flat <= sea)) & ~seen)
    seen[seeds] = True
    heap = [(flat[i], int(i)) for i in seeds]
    heapq.heapify(heap)
    while heap:
        level, i = heapq.heappop(heap)
        order.append(i)
        r, c = divmod(i, w)
        for dr, dc in AROUND:
            a, b = r + dr, c + dc
            if 0 <= a < h and 0 <= b < w and not seen[j := a * w + b]:
                seen[j] = True
                down[j] = i
                flat[j] = max(flat[j], level)
                heapq.heappush(heap, (flat[j], j))
    return flat.reshape(h, w), down, np.array(order)


def flood_with_rim(cells: DataFrame, side: int, margin: int, elev: str = "elev") -> DataFrame:
    """(tile_i, tile_j, r, c, filled, down_r, down_c): square tiles flooded with a rim of ``margin`` cells around them,
    of which the rim is then cut off, so that a tile's edge is no outlet unless the way out is longer than the rim."""
    d = halo(cells.select("r", "c", elev), side, margin)
    out = flood_tiles(d, ["tile_i", "tile_j"], elev)
    return out.filter((F.floor(F.col("r") / side) == F.col("tile_i")) & (F.floor(F.col("c") / side) == F.col("tile_j")))


def flood_tiles(cells: DataFrame, tile: list[str], elev: str = "elev") -> DataFrame:
    """(tile, r, c, filled, down_r, down_c) of every tile; a tile's cells fit one task, and may end short of the rectangle."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["r", "c"])
        r0, c0 = d["r"].min(), d["c"].min()
        h, w = int(d["r"].max() - r0 + 1), int(d["c"].max() - c0 + 1)
        at = ((d["r"] - r0) * w + d["c"] - c0).to_numpy()
        if len(np.unique(at)) != len(at):
            raise ValueError("a tile has a cell twice")
        level = np.full(h * w, np.nan)
        level[at] = d[elev].to_numpy()
        filled, down, _ = flood(level.reshape(h, w))
        filled, down = filled.ravel()[at], down[at]
        out = d[[*tile, "r", "c"]].copy()
        out["filled"] = filled
        out["down_r"] = np.where(down >= 0, down // w + r0, -1)
        out["down_c"] = np.where(down >= 0, down % w + c0, -1)
        return out

    types = dict(cells.dtypes)
    ddl = ", ".join(f"`{k}` {types[k]}" for k in tile) + ", r long, c long, filled double, down_r long, down_c long"
    return cells.groupBy(*tile).applyInPandas(run, ddl)


def lowest_links(cells: DataFrame, elev: str, width: int) -> DataFrame:
    """(cell, down): the lowest strictly lower of eight neighbours, ties to the first in scan order; else null."""
    near = neighbours(cells.select("r", "c", elev), [elev], AROUND)
    own = cells.select("r", "c", F.col(elev).alias("own"))
    best = near.join(own, ["r", "c"]).filter(F.col(f"n_{elev}") < F.col("own")).groupBy("r", "c").agg(F.min(F.struct(F.col(f"n_{elev}").alias("v"), F.col("k"))).alias("m"))
    steps = [a * width + b for a, b in AROUND]
    step = F.lit(None).cast("long")
    for k, s in enumerate(steps):
        step = F.when(F.col("k") == k, F.lit(s)).otherwise(step)
    linked = best.select("r", "c", F.col("m.k").alias("k")).select("r", "c", (F.col("r") * width + F.col("c") + step).alias("down"))
    return cells.select("r", "c").join(linked, ["r", "c"], "left").select((F.col("r") * width + F.col("c")).alias("cell"), "down")


#: Cells a side of the blocks in which chains of links are followed in memory.
BLOCK = 128


def _forest(links: DataFrame, *extra: str) -> DataFrame:
    return links.select(F.lit(0).cast("long").alias("s"), F.col("cell").alias("v"), F.col("down").alias("p"), *extra)


def square_blocks(width: int, side: int = BLOCK) -> hierarchy.Block:
    """Cells by squares of the grid, so that most links stay inside their block."""
    across = -(-width // side)
    return lambda x: F.floor(x / (width * side)) * across + F.floor((x % width) / side)


def depths(links: DataFrame, width: int) -> DataFrame:
    """(cell, root, depth): outlet and number of steps; roots first in any order by depth."""
    return hierarchy.resolve(_forest(links), block=square_blocks(width)).select(F.col("v").alias("cell"), "root", "depth")


def accumulate(links: DataFrame, load: DataFrame, value: str, width: int) -> DataFrame:
    """(cell, acc): each cell's load plus that of every cell that drains through it."""
    f = _forest(links.join(load.select("cell", F.col(value).alias("_load")), "cell", "left"), "_load")
    return hierarchy.accumulate(f, "_load", block=square_blocks(width)).select(F.col("v").alias("cell"), "acc")


def visible(cells: DataFrame) -> DataFrame:
    """Adds ``visible``: cells on land whose accumulation passes the flow threshold over density and rain.

    cells: (cell, elev, acc, density, precip).
    """
    bar = 0.16 / (F.col("density") * scalar.col("precip_density", precip="precip"))
    return cells.withColumn("visible", (F.col("elev") > 0) & (F.col("acc") >= bar))


def sources(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell): visible cells that no visible cell drains to."""
    v = cells.filter("visible").select("cell")
    fed = links.join(v, "cell", "left_semi").select(F.col("down").alias("cell"))
    return v.join(fed, "cell", "left_anti")


def bodies(cells: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(cell, body, throughflow, depth): standing water grouped by following links inside one filled level.

    cells: (cell, elev, filled, acc). A body is named by the submerged cell that leaves it.
    """
    wet = cells.filter("elev > 0 and filled > elev").select("cell", "filled", "elev", "acc")
    inside = wet.select("cell", "filled").join(links, "cell").join(wet.select(F.col("cell").alias("down"), F.col("filled").alias("f2")), "down", "left").select("cell", F.when(F.col("f2") == F.col("filled"), F.col("down")).alias("down"))
    body = depths(inside, width).select("cell", F.col("root").alias("body"))
    d = wet.join(body, "cell")
    per = d.groupBy("body").agg(F.max("acc").alias("throughflow"), F.max(F.col("filled") - F.col("elev")).alias("depth"))
    return d.select("cell", "body").join(per, "body")


def lakes(cells: DataFrame, water: DataFrame) -> DataFrame:
    """(cell, lake, load, surface): lake depth after the body's flow gate."""
    gate = F.least(F.greatest(F.col("throughflow") / 0.18, F.lit(0.0)), F.lit(1.0))
    d = cells.join(water, "cell").withColumn("d", F.col("filled") - F.col("elev")).filter("d >= 0.75").withColumn("gate", gate)
    return d.filter((F.col("gate") > 0.05) | (F.col("depth") >= 3.0)).select("cell", (F.col("d") * (0.35 + 0.65 * F.col("gate"))).alias("lake"), F.col("gate").alias("load"), F.col("filled").alias("surface"))


def dominant_upstream(links: DataFrame, acc: DataFrame) -> DataFrame:
    """(cell, up): the inflow with the greatest accumulation, ties to the lowest cell."""
    d = links.filter("down is not null").join(acc, "cell")
    return d.groupBy(F.col("down").alias("cell")).agg((-F.max(F.struct("acc", -F.col("cell"))).getField("col2")).alias("up"))


def smooth_centres(channels: DataFrame, width: int, passes: int = 3) -> DataFrame:
    """(cell, row, col): channel centres drawn toward their neighbours along the links, each at most 0.48 cells away.

    channels: (cell, down, up) with down and up among the channels or null. Three chained joins on the links.
    """
    at = channels.select("cell", "down", "up", (F.floor(F.col("cell") / width) + 0.5).alias("row"), (F.col("cell") % width + 0.5).alias("col"))
    for _ in range(passes):
        p = at.select("cell", "row", "col")
        u, d = p.select(F.col("cell").alias("up"), F.col("row").alias("ur"), F.col("col").alias("uc")), p.select(F.col("cell").alias("down"), F.col("row").alias("dr"), F.col("col").alias("dc"))
        j = at.join(u, "up", "left").join(d, "down", "left")
        both = F.col("ur").isNotNull() & F.col("dr").isNotNull()
        pull = lambda x, a, b: F.when(both, F.col(x) * 0.38 + F.col(a) * 0.31 + F.col(b) * 0.31).otherwise(F.col(x))
        near = lambda x, mid: F.least(F.greatest(x, mid - 0.48), mid + 0.48)
        at = j.select("cell", "down", "up", near(pull("row", "ur", "dr"), F.floor(F.col("cell") / width) + 0.5).alias("row"), near(pull("col", "uc", "dc"), F.col("cell") % width + 0.5).alias("col"))
    return at.select("cell", "row", "col")


def stamp(points: DataFrame) -> DataFrame:
    """(r, c, section, surface, load): discs around channel points, strongest section per cell, ties to the lower
    surface. points: (row, col, surface, radius, load)."""
    box = lambda x: F.sequence(F.floor(F.col(x) - F.col("radius") - 0.75).cast("long"), F.ceil(F.col(x) + F.col("radius") + 0.75).cast("long"))
    d = points.withColumn("r", F.explode(box("row"))).withColumn("c", F.explode(box("col")))
    dist = F.hypot(F.col("r") + 0.5 - F.col("row"), F.col("c") + 0.5 - F.col("col"))
    x = F.least(F.greatest(1 - dist / F.greatest(F.lit(0.55), F.col("radius") + 0.35), F.lit(0.0)), F.lit(1.0))
    d = d.filter(dist <= F.col("radius") + 0.5).withColumn("x", x).filter("x > 0").withColumn("section", F.col("x") * F.col("x") * (3 - 2 * F.col("x")))
    return d.groupBy("r", "c").agg(F.max(F.struct(F.col("section"), (-F.col("surface")).alias("s"))).alias("m"), F.max("load").alias("load")).select("r", "c", F.col("m.section").alias("section"), (-F.col("m.s")).alias("surface"), "load")


def boundary_inflow(coarse: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """(cell, inflow): accumulation that enters a box from coarse cells outside it whose link lands inside.

    coarse: (cell, r, c, down, acc). One self join on the link; cells of the box itself are left out.
    """
    r0, c0, r1, c1 = box
    inside = (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    land = coarse.filter(inside).select(F.col("cell").alias("down"))
    return coarse.filter(~inside).join(land, "down", "left_semi").groupBy(F.col("down").alias("cell")).agg(F.sum("acc").alias("inflow"))
