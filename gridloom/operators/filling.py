"""Filling closed depressions of a grid of any size, exactly.

The filled level of a cell is the lowest level at which water leaves it for the rim or the sea: the least, over all
ways out, of the highest ground on the way. A tile is flooded by itself from its border cells and outlets, and what
matters of it to others is a small graph: between which of its border cells, and at which level, water passes. These
graphs are joined with the steps between tiles and reduced again, group of tiles by group of tiles, each to its own
border (a merge tree keeps one edge per border cell). From the topmost group the levels go back down, and every tile
is flooded once more with the levels of its border known. No task ever sees more than a tile or a group's borders.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.focal import AROUND, box_sums, neighbours
from gridloom.runtime import cut

#: Cells a side of a tile, and tiles (or groups) a side of a group.
SIDE, GROUP = 128, 8
#: The node that stands for the rim and the sea; a cell's node is r * ROW + c.
OUT, ROW = -1, 1 << 31
GRAPH_DDL = "gi long, gj long, a long, b long, w double"


def spread(elev: np.ndarray, seeds: np.ndarray, level: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filled level, label) of every cell of a tile, flooded from seeds (flat indices, their levels and labels).

    The lowest open cell is taken next and hands its label on. NaN marks places without a cell.
    """
    h, w = elev.shape
    flat = elev.ravel().astype(float)
    out, mark = np.full(h * w, np.inf), np.full(h * w, -2, np.int64)
    wide = w + 2
    # a rim of closed places saves the tests for the tile's edge
    closed = np.ones((h + 2, wide), bool)
    closed[1:-1, 1:-1] = np.isnan(elev)
    closed = closed.ravel().tolist()
    ground = np.pad(elev.astype(float), 1).ravel().tolist()
    got, name = [np.inf] * len(ground), [-2] * len(ground)
    place = (seeds // w + 1) * wide + seeds % w + 1
    heap = sorted(zip(level.tolist(), [0] * len(place), place.tolist(), label.tolist()))  # seeds before what floods at their level
    steps = [a * wide + b for a, b in AROUND]
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        at, _, i, k = pop(heap)
        if closed[i]:
            continue
        closed[i] = True
        got[i], name[i] = at, k
        for s in steps:
            j = i + s
            if not closed[j]:
                push(heap, (at if at > ground[j] else ground[j], 1, j, k))
    inner = (np.arange(h)[:, None] + 1) * wide + np.arange(w)[None, :] + 1
    out, mark = np.array(got)[inner].ravel(), np.array(name, np.int64)[inner].ravel()
    return np.where(np.isnan(flat), np.nan, out).reshape(h, w), mark.reshape(h, w)


def _tile(d: pd.DataFrame) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(first row, first column, index of each row's cell, elevations, outlets) of a tile's cells."""
    r0, c0 = int(d["r"].min()), int(d["c"].min())
    h, w = int(d["r"].max()) - r0 + 1, int(d["c"].max()) - c0 + 1
    at = ((d["r"] - r0) * w + d["c"] - c0).to_numpy()
    elev, rim = np.full(h * w, np.nan), np.zeros(h * w, bool)
    elev[at] = d["e"].to_numpy(float)
    rim[at] = d["rim"].to_numpy(bool)
    return r0, c0, at, elev.reshape(h, w), rim


def _border(r: np.ndarray, c: np.ndarray, side: int) -> np.ndarray:
    return (r % side == 0) | (r % side == side - 1) | (c % side == 0) | (c % side == side - 1)


def tile_graph(d: pd.DataFrame, side: int) -> pd.DataFrame:
    """Passages (a, b, w) between a tile's border cells and the outside, through the tile."""
    r0, c0, at, elev, rim = _tile(d)
    h, w = elev.shape
    flat = elev.ravel()
    here = np.flatnonzero(~np.isnan(flat))
    r, c = here // w + r0, here % w + c0
    node = np.where(rim[here], OUT, r * ROW + c)
    seed = rim[here] | _border(r, c, side)
    level, label = spread(elev, here[seed], flat[here[seed]], node[seed])
    parts = []
    for a, b in AROUND[4:]:
        x, y = (slice(None, h - a), slice(a, None)), (slice(max(-b, 0), w - max(b, 0)), slice(max(b, 0), w + min(b, 0)))
        p, q = label[x[0], y[0]], label[x[1], y[1]]
        over = np.maximum(level[x[0], y[0]], level[x[1], y[1]])
        ok = (p != q) & (p > -2) & (q > -2)
        parts.append((np.minimum(p, q)[ok], np.maximum(p, q)[ok], over[ok]))
    # border cells that are outlets themselves take part under their own name too
    own = np.flatnonzero(rim[here] & _border(r, c, side))
    lo = np.concatenate([p[0] for p in parts] + [np.full(len(own), OUT)])
    hi = np.concatenate([p[1] for p in parts] + [r[own] * ROW + c[own]])
    over = np.concatenate([p[2] for p in parts] + [flat[here[own]]])
    g = pd.DataFrame({"a": lo, "b": hi, "w": over}).groupby(["a", "b"], as_index=False)["w"].min()
    g.insert(0, "gj", c0 // side)
    g.insert(0, "gi", r0 // side)
    return g


def reduce_graph(d: pd.DataFrame, side: int) -> pd.DataFrame:
    """The passages of a group between its own border cells and the outside only: a merge tree over them.

    Edges are taken in order of level; each set of joined nodes goes by one node that is kept, so sets of which both
    have one give an edge, and the rest leaves no trace. Levels between kept nodes stay as they were.
    """
    d = d.sort_values(["w", "a", "b"], kind="stable")
    names, ends = np.unique(d[["a", "b"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2).tolist()
    kept = (names == OUT) | _border(names // ROW, names % ROW, side)
    parent, held = list(range(len(names))), [i if k else -1 for i, k in enumerate(kept.tolist())]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = []
    for (a, b), w in zip(ends, d["w"].tolist()):
        a, b = find(a), find(b)
        if a == b:
            continue
        if held[a] >= 0 and held[b] >= 0:
            rows.append((held[a], held[b], w))
        parent[a] = b
        held[b] = held[a] if held[b] < 0 else held[b]
    e = np.array(rows, float).reshape(-1, 3)
    a, b = names[e[:, 0].astype(int)], names[e[:, 1].astype(int)]
    return pd.DataFrame({"gi": d["gi"].iloc[0], "gj": d["gj"].iloc[0], "a": np.minimum(a, b), "b": np.maximum(a, b), "w": e[:, 2]})


def _reduced(side: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda d: reduce_graph(d, side)


def solve_graph(d: pd.DataFrame) -> pd.DataFrame:
    """(node, level): the level at which each node of a graph reaches the outside."""
    names, ends = np.unique(d[["a", "b"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    both = np.concatenate([ends, ends[:, ::-1]])
    w = np.concatenate([d["w"].to_numpy(), d["w"].to_numpy()])
    o = np.argsort(both[:, 0], kind="stable")
    to, w = both[o, 1].tolist(), w[o].tolist()
    first = np.searchsorted(both[o, 0], np.arange(len(names) + 1)).tolist()
    level = [np.inf] * len(names)
    done = [False] * len(names)
    heap = [(-np.inf, 0)] if len(names) and names[0] == OUT else []
    while heap:
        at, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i], level[i] = True, at
        for k in range(first[i], first[i + 1]):
            if not done[to[k]]:
                heapq.heappush(heap, (at if at > w[k] else w[k], to[k]))
    return pd.DataFrame({"node": names, "level": np.array(level)}).iloc[int(len(names) > 0 and names[0] == OUT) :]


def fill(cells: DataFrame, elev: str = "elev", *, sea: float = 0.0, side: int = SIDE, group: int = GROUP) -> DataFrame:
    """(r, c, filled): the least surface with fill = max(elev, lowest fill around), grown from rim and sea.

    cells: (r, c >= 0, elev not null), each place once. The rim is where one of the eight neighbours is missing.
    """
    e = F.col(elev).cast("double")
    own = box_sums(cells.select("r", "c", e.alias("e")), 1, _n=F.lit(1))
    own = cut(own.select("r", "c", "e", ((F.col("_n") < 9) | (F.col("e") <= sea)).alias("rim")))
    tile = lambda x, s: F.floor(F.col(x) / s)
    graph = cut(own.groupBy(tile("r", side).alias("gi"), tile("c", side).alias("gj")).applyInPandas(lambda d: tile_graph(d, side), GRAPH_DDL))
    edge = own.filter(((F.col("r") % side).isin(0, side - 1)) | ((F.col("c") % side).isin(0, side - 1))).select("r", "c", "e")
    node = lambda r, c: F.col(r) * F.lit(ROW) + F.col(c)
    near = neighbours(edge.withColumns({"a": node("r", "c"), "ti": tile("r", side), "tj": tile("c", side)}), ["e", "a", "ti", "tj"], AROUND).join(edge, ["r", "c"])
    steps = near.filter((node("r", "c") < F.col("n_a")) & ((F.col("n_ti") != tile("r", side)) | (F.col("n_tj") != tile("c", side))))
    steps = cut(steps.select(node("r", "c").alias("a"), F.col("n_a").alias("b"), F.greatest("e", "n_e").alias("w")))
    box = own.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    if box.r is None:
        return own.select("r", "c", F.col("e").alias("filled"))
    row, col = (lambda x: F.shiftright(x, 31)), (lambda x: F.col(x).bitwiseAND(ROW - 1))
    levels = []  # (cells a side of a group, its graph)
    size, count = side, max(box.r, box.c) // side + 1
    while count > 1:
        size, count = size * group, -(-count // group)
        at = lambda x, f, s=size: F.floor(f(x) / s)
        inner = (at("a", row) == at("b", row)) & (at("a", col) == at("b", col))
        new = steps.filter(inner).select(at("a", row).alias("gi"), at("a", col).alias("gj"), "a", "b", "w")
        steps = steps.filter(~inner)
        graph = cut(graph.select(F.floor(F.col("gi") / group).alias("gi"), F.floor(F.col("gj") / group).alias("gj"), "a", "b", "w").unionByName(new))
        levels.append((size, graph))
        if count > 1:
            graph = cut(graph.groupBy("gi", "gj").applyInPandas(_reduced(size), GRAPH_DDL))
    known = None
    for size, g in reversed(levels):
        if known is not None:
            g = g.unionByName(known.select(F.floor(row("node") / size).alias("gi"), F.floor(col("node") / size).alias("gj"), F.lit(OUT).cast("long").alias("a"), F.col("node").alias("b"), F.col("level").alias("w")))
        known = cut(g.groupBy("gi", "gj").applyInPandas(solve_graph, "node long, level double"))

    def finish(d: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame({"r": [], "c": [], "filled": []})
        r0, c0, at, e, rim = _tile(d)
        w = e.shape[1]
        flat = e.ravel()
        seed = np.flatnonzero(rim)
        edge = ((border["node"] // ROW - r0) * w + border["node"] % ROW - c0).to_numpy(np.int64) if len(border) else np.zeros(0, np.int64)
        level, _ = spread(e, np.r_[seed, edge], np.r_[flat[seed], border["level"].to_numpy(float)], np.zeros(len(seed) + len(edge), np.int64))
        return pd.DataFrame({"r": d["r"], "c": d["c"], "filled": level.ravel()[at]})

    if known is None:
        known = own.sparkSession.createDataFrame([], "node long, level double")
    tiles = own.groupBy(tile("r", side).alias("ti"), tile("c", side).alias("tj"))
    borders = known.groupBy(F.floor(row("node") / side).alias("ti"), F.floor(col("node") / side).alias("tj"))
    return tiles.cogroup(borders).applyInPandas(lambda d, b: finish(d, b), "r long, c long, filled double")
