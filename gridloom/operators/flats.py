"""Water across flats: distances inside level stretches of a filled surface, and links that lead out of them.

A flat is a stretch of land cells at one level. Two distances are measured inside it: from its spill edges (cells with
a lower neighbour) and from where higher ground drains in. Each tile measures by itself with its rim's distances as
given, and passes repeat until no tile changes: as many as a way crosses tiles, not as many as it has cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hashing
from gridloom.operators.drainage import lowest_links
from gridloom.operators.focal import AROUND, halo, neighbours
from gridloom.runtime import cut

SIDE = 128
#: Weight of a step in the potential (fixed value); the jitter stays below it.
STEP = 24
STATE_DDL = "r long, c long, f double, spill double, inflow double, changed boolean"


def _planes(d: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Index of each row's place, and columns as planes with one more empty line around."""
    r, c = (d["r"] - d["r"].min() + 1).to_numpy(), (d["c"] - d["c"].min() + 1).to_numpy()
    shape = (int(r.max()) + 2, int(c.max()) + 2)
    at = r * shape[1] + c
    out = {}
    for n in names:
        p = np.full(shape, np.nan)
        p.ravel()[at] = d[n].to_numpy(float)
        out[n] = p
    return at, out


def _moved(p: np.ndarray, a: int, b: int) -> np.ndarray:
    """The plane in which each place holds its neighbour at (a, b)."""
    return np.roll(p, (-a, -b), (0, 1))


def _measure(level: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Steps between equal levels until nothing changes; places without a level take no part."""
    same = [(a, b, _moved(level, a, b) == level) for a, b in AROUND]
    while True:
        best = dist
        for a, b, ok in same:
            best = np.minimum(best, np.where(ok, _moved(dist, a, b) + 1, np.inf))
        if np.array_equal(best, dist):
            return dist
        dist = best


def _first(d: pd.DataFrame, sea: float) -> pd.DataFrame:
    at, p = _planes(d, ["f", "e"])
    f, land = p["f"], p["e"] > sea
    near = [_moved(f, a, b) for a, b in AROUND]
    flat = land & np.logical_or.reduce([x == f for x in near])
    level = np.where(flat, f, np.nan)
    core = d["core"].to_numpy(bool)
    inner = np.zeros(f.size, bool)
    inner[at[core]] = True
    inner = inner.reshape(f.shape)
    level = np.where(inner, level, np.nan)  # what the rim is, its own tile says
    spill = _measure(level, np.where(flat & inner & np.logical_or.reduce([x < f for x in near]), 0.0, np.inf))
    inflow = _measure(level, np.where(flat & inner & np.logical_or.reduce([x > f for x in near]), 0.0, np.inf))
    out = pd.DataFrame({"r": d["r"], "c": d["c"], "f": d["f"], "spill": spill.ravel()[at], "inflow": inflow.ravel()[at], "changed": True})
    return out[core & flat.ravel()[at]]


def _again(d: pd.DataFrame) -> pd.DataFrame:
    at, p = _planes(d, ["f", "spill", "inflow"])
    held = [np.where(np.isnan(p[n]), np.inf, p[n]) for n in ("spill", "inflow")]
    now = [_measure(p["f"], x) for x in held]
    out = d[["r", "c", "f"]].copy()
    out["spill"], out["inflow"] = now[0].ravel()[at], now[1].ravel()[at]
    out["changed"] = (now[0] != held[0]).ravel()[at] | (now[1] != held[1]).ravel()[at]
    return out[d["core"].to_numpy(bool)]


def flat_distances(cells: DataFrame, elev: str = "elev", filled: str = "filled", *, sea: float = 0.0, side: int = SIDE) -> DataFrame:
    """(r, c, filled, spill, inflow) of the flat cells of a surface: land cells with a neighbour at their own level.

    Distances are steps inside the flat; null where the flat has no such edge.
    """
    tile = ["tile_i", "tile_j"]
    d = halo(cells.select("r", "c", F.col(elev).cast("double").alias("e"), F.col(filled).cast("double").alias("f")), side, 1)
    state = cut(d.groupBy(*tile).applyInPandas(lambda x: _first(x, sea), STATE_DDL))
    while True:
        state = cut(halo(state.drop("changed"), side, 1).groupBy(*tile).applyInPandas(_again, STATE_DDL))
        if not state.filter("changed").limit(1).count():
            break
    end = lambda x: F.when(F.col(x) < float("inf"), F.col(x).cast("long")).alias(x)
    return state.select("r", "c", F.col("f").alias("filled"), end("spill"), end("inflow"))


def potentials(flat: DataFrame) -> DataFrame:
    """Adds ``potential``: falls towards the spill edge, and among equals away from where water comes in; null without a spill edge."""
    p = STEP * (3 * F.col("spill") - F.coalesce("inflow", F.lit(0))) + hashing.flat_jitter(F.col("r"), F.col("c"))
    return flat.withColumn("potential", p)


def ranked(flat: DataFrame, width: int) -> DataFrame:
    """(cell, filled, potential, place): the flat cells of each level in order of potential, then of number."""
    from pyspark.sql import Window

    d = potentials(flat).filter("potential is not null").select((F.col("r") * width + F.col("c")).alias("cell"), "filled", "potential")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("filled").orderBy("potential", "cell")) - 1)


def route(cells: DataFrame, width: int, elev: str = "elev", filled: str = "filled", *, sea: float = 0.0, side: int = SIDE) -> DataFrame:
    """(cell, down) over a filled surface: the lowest strictly lower neighbour, inside flats the neighbour of the least
    (potential, cell) below its own, and null at outlets and in flats that spill nowhere. Links never form circles."""
    lower = lowest_links(cells.select("r", "c", F.col(filled).alias("_f")), "_f", width)
    flat = cut(potentials(flat_distances(cells, elev, filled, sea=sea, side=side)).filter("potential is not null").withColumn("cell", F.col("r") * width + F.col("c")))
    near = neighbours(flat, ["filled", "potential", "cell"], AROUND).join(flat, ["r", "c"])
    ahead = near.filter((F.col("n_filled") == F.col("filled")) & (F.struct("n_potential", "n_cell") < F.struct("potential", "cell")))
    best = ahead.groupBy("cell").agg(F.min(F.struct("n_potential", "n_cell")).alias("m")).select("cell", F.col("m.n_cell").alias("side"))
    return lower.join(best, "cell", "left").select("cell", F.coalesce("down", "side").alias("down"))
