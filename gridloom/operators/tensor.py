"""Unbounded tensors of overlapping windows: window arithmetic, overlap-add slices and staged computation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` every ``stride`` cells from ``offset``, the same on both axes."""

    size: int
    stride: int
    offset: int = 0

    def __post_init__(self) -> None:
        if self.size <= 0 or self.stride <= 0:
            raise ValueError("a window has a positive size and stride")

    def start(self, w: Column) -> Column:
        return w * self.stride + self.offset

    def lowest(self, p: Column) -> Column:
        """Index of the first window that holds cell p."""
        return F.ceil((p - self.offset - self.size + 1) / self.stride)

    def highest(self, p: Column) -> Column:
        """Index of the last window that holds cell p."""
        return F.floor((p - self.offset) / self.stride)

    def over(self, start: int, end: int) -> tuple[int, int]:
        """First and last window that meet [start, end)."""
        if end <= start:
            raise ValueError("an empty or inverted slice")
        return -((self.offset + self.size - 1 - start) // self.stride), (end - 1 - self.offset) // self.stride


def windows_of(cells: DataFrame, w: Windows) -> DataFrame:
    """One row per (cell, window that holds it): adds w_i, w_j and the place (i, j) inside the window."""
    both = cells.withColumn("w_i", F.explode(F.sequence(w.lowest(F.col("r")), w.highest(F.col("r"))))).withColumn("w_j", F.explode(F.sequence(w.lowest(F.col("c")), w.highest(F.col("c")))))
    return both.withColumns({"i": F.col("r") - w.start(F.col("w_i")), "j": F.col("c") - w.start(F.col("w_j"))})


def overlap_add(tiles: DataFrame, w: Windows, box: tuple[int, int, int, int] | None = None, value: str = "tile") -> DataFrame:
    """(r, c, v): the sum over all windows that cover each cell; tiles are (w_i, w_j, row-major array).

    Tiles outside the box are pruned by window index before they are unpacked. A missing tile adds nothing.
    """
    t = tiles
    if box:
        r0, c0, r1, c1 = box
        (a, b), (p, q) = w.over(r0, r1), w.over(c0, c1)
        t = t.filter(F.col("w_i").between(a, b) & F.col("w_j").between(p, q))
    cells = t.select("w_i", "w_j", F.posexplode(value).alias("k", "v"))
    cells = cells.select((w.start(F.col("w_i")) + F.floor(F.col("k") / w.size)).alias("r"), (w.start(F.col("w_j")) + F.col("k") % w.size).alias("c"), "v")
    if box:
        cells = cells.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    return cells.groupBy("r", "c").agg(F.sum("v").alias("v"))


def missing_windows(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct windows asked for and not yet held."""
    return wanted.select("w_i", "w_j").distinct().join(held.select("w_i", "w_j"), ["w_i", "w_j"], "left_anti")


def upstream_windows(needed: DataFrame, own: Windows, source: Windows, margin: int = 0) -> DataFrame:
    """Distinct source windows that the needed windows read, each by its own exact range."""
    lo = lambda x: own.start(F.col(x)) - margin
    hi = lambda x: own.start(F.col(x)) + own.size - 1 + margin
    d = needed.select(F.explode(F.sequence(source.lowest(lo("w_i")), source.highest(hi("w_i")))).alias("u_i"), "w_j")
    return d.select(F.col("u_i").alias("w_i"), F.explode(F.sequence(source.lowest(lo("w_j")), source.highest(hi("w_j")))).alias("u")).select("w_i", F.col("u").alias("w_j")).distinct()


def compute(inputs: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Calls a function once per window on all its input cells."""
    return inputs.groupBy("w_i", "w_j").applyInPandas(function, schema)


def compute_batched(windows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int) -> DataFrame:
    """Calls a function on batches of exactly ``batch`` windows (rows); a short batch repeats its last row, and
    what comes back for the repeats is dropped. The function returns one row per row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                n = len(part)
                if n < batch:
                    part = pd.concat([part, *[part.iloc[[-1]]] * (batch - n)], ignore_index=True)
                out = function(part)
                if len(out) != batch:
                    raise ValueError("a batch function returns one row per window")
                yield out.iloc[:n]

    return windows.mapInPandas(run, schema)


def karras_schedule(steps: int, low: float = 0.002, high: float = 80.0, rho: float = 7.0) -> list[float]:
    """Decreasing noise levels, evenly spaced in their 1/rho-th power."""
    a, b = high ** (1 / rho), low ** (1 / rho)
    return [(a + k / max(steps - 1, 1) * (b - a)) ** rho for k in range(steps)]
