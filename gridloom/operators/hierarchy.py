"""Parent-child rows to full hierarchies by tree contraction.

Contraction alternates two moves: leaves are raked onto their parent, and unary nodes whose rank beats both
neighbours' are spliced out of their chain (an independent set, so no two adjacent nodes go in one round). Every
removed node keeps a record (node, parent at that time, distance). Reading the records in reverse gives each node's
root, depth, path, sums of what drains through it; what never ends in a root is a core of circles, and splicing
shrinks each circle to one node that points at itself, named by the least key seen on the way.

The moves are first made inside blocks of neighbouring keys (one shuffle, arrays in memory, blocks of bounded size),
which resolves scopes that fit a block at once. Of a scope that spans blocks, only the last node of each block's
trees is left; these go through the same moves as joins, round by round, and through one task when at most
``base_rows`` of them are left (a parameter; with 0 every move is a join).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast, cut, hub_join

#: Keys of a block, as a power of two, where the caller names no other blocks.
BLOCK_BITS = 17
#: Rows of whole blocks that are contracted together.
CHUNK = 400_000
#: Open nodes up to which the joins are finished in one task.
BASE_ROWS = 100_000
MAX_ROUNDS = 200
#: Entries of the path arrays in one batch.
PATH_ENTRIES = 4_000_000

NODE_DDL = "s long, v long, p long, b long, pb long, len long, low long"
MEMBER_DDL = "s long, v long, top long, dist long, low long, out long, out_len long, circle long"

Block = Callable[[Column], Column]


def _contract(par: np.ndarray, length: np.ndarray, low: np.ndarray, load: np.ndarray | None = None, carry: np.ndarray | None = None) -> tuple:
    """Contract and expand in memory. par: index of the parent, or -1 if it lies outside the given nodes.

    low: the least key of a node and of what its link passes over. Returns, per node, the index of the last node
    inside (whose parent lies outside, or the circle's node), the distance to it, the least key on the way to it, the
    circle's least key, whether it ends in a circle, and with ``load`` the sum of the loads of the node and all nodes
    below it; ``carry`` is what a node's link already holds of nodes that it passes over.
    """
    n = len(par)
    par, length, low = par.copy(), length.copy(), low.copy()
    circle = np.full(n, -1, np.int64)
    on_circle = np.zeros(n, bool)
    total = None if load is None else load.astype(float).copy()
    carry = np.zeros(n) if carry is None else carry.copy()
    alive = par >= 0
    loop = par == np.arange(n)
    circle[loop], on_circle[loop] = low[loop], True
    alive &= ~loop
    records: list[tuple] = []
    rng = np.random.default_rng(7)
    child = np.full(n, -1)
    while alive.any():
        live = np.flatnonzero(alive)
        kids = np.bincount(par[live], minlength=n)
        child[par[live]] = live
        h = rng.permutation(n)
        leaf = live[kids[live] == 0]
        unary = live[kids[live] == 1]
        spliced = unary[(h[unary] > h[par[unary]]) & (h[unary] > h[child[unary]])]
        kid = child[spliced]
        before = None
        if total is not None:
            before = total[spliced] + carry[kid]
            carry[kid] += total[spliced] + carry[spliced]
        length[kid] += length[spliced]
        low[kid] = np.minimum(low[kid], low[spliced])
        par[kid] = par[spliced]
        if total is not None:  # after the splices: a leaf's link may just have been led over its parent
            total += np.bincount(par[leaf], total[leaf] + carry[leaf], n)
        gone = np.concatenate([leaf, spliced])
        records.append((gone, par[gone].copy(), length[gone].copy(), spliced, kid, before))
        alive[gone] = False
        own = live[(par[live] == live) & alive[live]]
        circle[own], on_circle[own] = low[own], True
        alive[own] = False
    top, dist, least = np.arange(n), np.zeros(n, np.int64), low.copy()
    for gone, up, far, spliced, kid, before in reversed(records):
        top[gone] = top[up]
        dist[gone] = dist[up] + far
        least[gone] = np.minimum(low[gone], least[up])
        circle[gone] = circle[up]
        on_circle[gone] = on_circle[up]
        if total is not None:
            total[spliced] = before + total[kid]
    return top, dist, least, circle, on_circle, total


def _parents(s: np.ndarray, v: np.ndarray, p: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each row's parent among the rows, which are in order of (s, v), or -1."""
    names = np.unique(v)
    code = np.cumsum(np.r_[True, s[1:] != s[:-1]]) * len(names) if len(s) else np.zeros(0, np.int64)
    key = code + np.searchsorted(names, v)
    at = np.minimum(np.searchsorted(names, p), max(len(names) - 1, 0))
    hit = known & (names[at] == p)
    want = code + at
    i = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
    return np.where(hit & (key[i] == want), i, -1)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole blocks as arrays; nulls of integer columns read as 0, with the parent's presence in ``known``."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        out = {n: t.column(n).fill_null(0).to_numpy() for n in t.column_names}
        out["known"] = t.column("p").is_valid().to_numpy()
        o = np.lexsort((out["v"], out["s"]))
        return {n: a[o] for n, a in out.items()}

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= chunk:
            t = pa.Table.from_batches(held)
            s, k = t.column("s").to_numpy(), t.column("b").to_numpy()
            edge = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1]))
            if len(edge):
                yield arrays(t.slice(0, int(edge[-1]) + 1))
                rest = t.slice(int(edge[-1]) + 1)
                held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield arrays(pa.Table.from_batches(held))


def _within(d: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent among the rows or -1, whether the parent must lie in another block)."""
    par = _parents(d["s"], d["v"], d["p"], d["known"])
    return par, (par < 0) & d["known"] & (d["pb"] != d["b"])


def _nullable(a: np.ndarray, ok: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64), mask=~ok)


def _members(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for d in _chunks(batches, chunk):
        par, beyond = _within(d)
        top, dist, least, circle, round_, total = _contract(par, d["len"], d["low"], d.get("load"))
        out = beyond[top] & ~round_
        cols = [pa.array(d["s"]), pa.array(d["v"]), pa.array(d["v"][top]), pa.array(dist), pa.array(least), _nullable(d["p"][top], out), pa.array(d["len"][top]), _nullable(circle, round_)]
        names = ["s", "v", "top", "dist", "low", "out", "out_len", "circle"]
        if total is not None:
            cols, names = [*cols, pa.array(total, mask=round_)], [*names, "acc"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _nodes(links: DataFrame, block: Block | None, *extra: Column) -> DataFrame:
    """The rows of the links by blocks: each block whole in one task, in order of blocks."""
    of = block or (lambda x: F.shiftright(x, BLOCK_BITS).cast("long"))
    d = links.select("s", "v", "p", of(F.col("v")).cast("long").alias("b"), F.coalesce(of(F.col("p")).cast("long"), F.lit(0).cast("long")).alias("pb"), F.lit(1).cast("long").alias("len"), F.col("v").alias("low"), *extra)
    return d.repartition("s", "b").sortWithinPartitions("s", "b")


def _blocks(links: DataFrame, block: Block | None, chunk: int, load: str | None = None) -> DataFrame:
    extra = [] if load is None else [F.coalesce(F.col(load).cast("double"), F.lit(0.0)).alias("load")]
    return cut(_nodes(links, block, *extra).mapInArrow(lambda it: _members(it, chunk), MEMBER_DDL + (", acc double" if extra else "")))


def _beyond(members: DataFrame) -> DataFrame:
    """The last nodes of trees that go on in another block, with where their parent leads: (s, v, p, len, low, root,
    depth); p is the next such node, or null where the way ends, at the given root and depth."""
    tops = members.filter("out is not null and v = top").select("s", "v", F.col("out"), "out_len", F.col("low").alias("own_low"))
    at = checked_broadcast(tops.select("s", F.col("out").alias("v")).distinct())
    there = members.join(at, ["s", "v"], "left_semi").select("s", F.col("v").alias("out"), F.col("top").alias("t"), F.col("dist").alias("d"), F.col("low").alias("l"), F.col("out").alias("o"), F.col("circle").alias("c"))
    j = hub_join(tops, there, ["s", "out"])
    goes = F.col("o").isNotNull()
    root = F.when(F.col("t").isNull(), F.col("v")).when(F.col("c").isNotNull(), F.col("c")).when(~goes, F.col("t"))
    depth = F.when(F.col("t").isNull(), F.lit(0)).when(F.col("c").isNotNull(), F.lit(-1)).when(~goes, F.col("out_len") + F.col("d"))
    return j.select("s", "v", F.when(goes, F.col("t")).alias("p"), (F.col("out_len") + F.coalesce("d", F.lit(0))).alias("len"), F.least("own_low", "l").alias("low"), root.alias("root"), depth.cast("long").alias("depth"), "out")


def _base_case(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    d = {n: t.column(n).to_numpy() for n in t.column_names}
    o = np.lexsort((d["v"], d["s"]))
    d = {n: a[o] for n, a in d.items()}
    par = _parents(d["s"], d["v"], d["p"], np.ones(len(o), bool))
    top, dist, _, circle, round_, _ = _contract(par, d["len"], d["low"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(d["s"]), pa.array(d["v"]), _nullable(d["p"][top], ~round_), pa.array(dist + d["len"][top]), _nullable(circle, round_)], names=["s", "v", "p", "len", "circle"]
    )


def _rounds(nodes: DataFrame, base_rows: int) -> DataFrame:
    """(s, v, root, depth) of nodes (s, v, p, len, low, root, depth) whose ends are known, by joins."""
    pieces = [nodes.filter("p is null").select("s", "v", "root", "depth")]
    opened = nodes.filter("p is not null").select("s", "v", "p", "len", "low")
    records: list[tuple[DataFrame, int]] = []
    for k in range(MAX_ROUNDS):
        pieces.append(opened.filter("p = v").select("s", "v", F.col("low").alias("root"), F.lit(-1).cast("long").alias("depth")))
        opened = opened.filter("p <> v")
        n = opened.count()
        if n <= base_rows:
            break
        kids = opened.groupBy("s", F.col("p").alias("v")).agg(F.count("*").alias("kids"), F.min("v").alias("child"))
        rank = lambda c: F.xxhash64("s", c, F.lit(k))  # noqa: B023, E731
        state = opened.join(kids.hint("merge"), ["s", "v"], "left").withColumn(
            "spliced", F.coalesce((F.col("kids") == 1) & (rank("v") > rank("p")) & (rank("v") > rank("child")), F.lit(False))
        )
        # a spliced node has one child, so this join meets no hub on its right; hubs on the left are served apart
        over = state.filter("spliced").select("s", F.col("v").alias("p"), F.col("p").alias("p2"), F.col("len").alias("len2"), F.col("low").alias("low2"))
        moved = cut(
            hub_join(state, over, ["s", "p"], rows=n).select(
                "s", "v", F.coalesce("p2", "p").alias("p"), (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len"),
                F.least("low", "low2").alias("low"), (F.col("kids").isNull() | F.col("spliced")).alias("gone"),
            )
        )
        records.append((moved.filter("gone").select("s", "v", "p", "len"), n))
        opened = moved.filter(~F.col("gone")).drop("gone")
    else:
        raise RuntimeError("the contraction did not end")
    if base_rows:
        base = cut(opened.select("s", "v", "p", "len", "low").coalesce(1).mapInArrow(_base_case, "s long, v long, p long, len long, circle long"))
        pieces.append(base.filter("circle is not null").select("s", "v", F.col("circle").alias("root"), F.lit(-1).cast("long").alias("depth")))
        records.append((base.filter("circle is null").select("s", "v", "p", "len"), n))
    for rec, n in reversed(records):
        known = pieces[0]
        for piece in pieces[1:]:
            known = known.unionByName(piece)
        at = known.select("s", F.col("v").alias("p"), "root", F.col("depth").alias("at"))
        # each record is written once; what has been written before is only read
        pieces.append(cut(hub_join(rec, at, ["s", "p"], rows=n).select("s", "v", "root", F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") + F.col("len")).alias("depth"))))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def _answers(members: DataFrame, base_rows: int) -> DataFrame:
    """(s, v, root, depth) of every member."""
    here = members.filter("out is null").select("s", "v", F.coalesce("circle", "top").alias("root"), F.when(F.col("circle").isNotNull(), F.lit(-1)).otherwise(F.col("dist")).cast("long").alias("depth"))
    if not members.filter("out is not null").limit(1).count():
        return here
    ends = _rounds(cut(_beyond(members)), base_rows).select("s", F.col("v").alias("top"), "root", F.col("depth").alias("at"))
    far = members.filter("out is not null").join(ends, ["s", "top"]).select("s", "v", "root", F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") + F.col("dist")).alias("depth"))
    return here.unionByName(far)


def resolve(links: DataFrame, *, block: Block | None = None, base_rows: int = BASE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Root and depth of every node of ``links`` (s long, v long, p long: parent of v in the same scope s).

    (s, v) must be unique and not null. A node whose p is null or not a node of s is a root: itself as root,
    depth 0. A node that reaches no root gets the least key on the circle it ends in, and depth -1; a node that
    is its own parent is a circle of one. An empty table gives an empty result. ``block`` gives the block of a key
    (blocks must fit a task; by default keys that agree but for their last 17 bits). Returns (s, v, root, depth).
    """
    return _answers(_blocks(links, block, chunk), base_rows)


def _segments(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Members with the way to the last node inside the block as an array, itself first; null for circles."""
    for d in _chunks(batches, chunk):
        par, beyond = _within(d)
        top, dist, _, circle, round_, _ = _contract(par, d["len"], d["low"])
        out = beyond[top] & ~round_
        size = np.where(round_, 0, dist + 1)
        # batches of bounded size, each filled by following all its nodes upwards together
        edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // PATH_ENTRIES)) + 1, len(size)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            off = np.r_[0, np.cumsum(size[a:b])]
            flat = np.empty(off[-1], np.int64)
            at, left, to = np.arange(a, b), size[a:b].copy(), off[:-1].copy()
            go = left > 0
            at, left, to = at[go], left[go], to[go]
            while len(at):
                flat[to] = d["v"][at]
                left -= 1
                go = left > 0
                at, left, to = par[at[go]], left[go], to[go] + 1
            way = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=pa.array(round_[a:b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["s"][a:b]), pa.array(d["v"][a:b]), pa.array(d["v"][top][a:b]), pa.array(dist[a:b]), _nullable(d["p"][top][a:b], out[a:b]), _nullable(circle[a:b], round_[a:b]), way],
                names=["s", "v", "top", "dist", "out", "circle", "way"],
            )


def paths(links: DataFrame, *, block: Block | None = None, base_rows: int = BASE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(s, v, root, depth, path): each node's path (itself first, its root last) as an array, from the contraction.

    A node in or above a circle gets a null path. The result's size is the sum of all depths, which is what was asked
    for. Inside a block the recorded distances say where each node of a path stands. Where a tree goes on in another
    block, the paths of the nodes it goes on at (and only theirs) are put together by doubling and appended.
    """
    members = _blocks(links, block, chunk)
    ways = _nodes(links, block).mapInArrow(lambda it: _segments(it, chunk), "s long, v long, top long, dist long, out long, circle long, way array<long>")
    if not members.filter("out is not null").limit(1).count():
        depth = F.when(F.col("circle").isNotNull(), F.lit(-1)).otherwise(F.col("dist")).cast("long")
        return ways.select("s", "v", F.coalesce("circle", "top").alias("root"), depth.alias("depth"), F.col("way").alias("path"))
    answers = cut(_answers(members, base_rows))
    places = members.filter("out is not null and v = top").select("s", F.col("out").alias("v")).distinct().join(answers.filter("depth >= 0"), ["s", "v"]).select("s", "v")
    step = cut(ways.join(checked_broadcast(places), ["s", "v"]).select("s", "v", F.col("out").alias("next"), F.col("way").alias("path")))
    for _ in range(MAX_ROUNDS):
        if not step.filter("next is not null").limit(1).count():
            break
        # a parent that is no node ends the way
        ahead = step.select("s", F.col("v").alias("next"), F.col("next").alias("next2"), F.col("path").alias("path2"))
        more = hub_join(step.filter("next is not null"), ahead, ["s", "next"]).select("s", "v", F.col("next2").alias("next"), F.concat("path", F.coalesce("path2", F.array().cast("array<long>"))).alias("path"))
        step = cut(step.filter("next is null").unionByName(more))
    tails = step.select("s", F.col("v").alias("out"), F.col("path").alias("tail"))
    j = hub_join(ways, tails, ["s", "out"]).select("s", "v", F.concat("way", F.coalesce("tail", F.array().cast("array<long>"))).alias("path"))
    return answers.join(j, ["s", "v"]).select("s", "v", "root", "depth", F.when(F.col("depth") >= 0, F.col("path")).alias("path"))


def descendants(pathed: DataFrame) -> DataFrame:
    """(s, ancestor, v, distance) for every node and every node above it, from the paths."""
    return pathed.filter("path is not null").select("s", "v", F.posexplode("path").alias("distance", "ancestor")).filter("distance > 0").select("s", "ancestor", "v", "distance")


def _base_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    known = t.column("p").is_valid().to_numpy()
    d = {n: t.column(n).fill_null(0).to_numpy() for n in ("s", "v", "p", "load", "carry")}
    o = np.lexsort((d["v"], d["s"]))
    d, known = {n: a[o] for n, a in d.items()}, known[o]
    par = _parents(d["s"], d["v"], d["p"], known)
    total = _contract(par, np.ones(len(o), np.int64), d["v"], d["load"], d["carry"])[-1]
    yield pa.RecordBatch.from_arrays([pa.array(d["s"]), pa.array(d["v"]), pa.array(total)], names=["s", "v", "acc"])


def _sum_rounds(nodes: DataFrame, base_rows: int) -> DataFrame:
    """(s, v, acc): the load of each node (s, v, p or null, load) and of all nodes below it, by joins.

    A raked leaf hands its sum to its parent and is done. A spliced node leaves what it has gathered so far on the
    link of its only child, and gets the child's own sum when the records are read in reverse.
    """
    opened = nodes.select("s", "v", "p", "load", F.lit(0.0).alias("carry"))
    pieces: list[DataFrame] = []
    records: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        n = opened.filter("p is not null").count()
        if n <= base_rows:
            break
        kids = opened.filter("p is not null").groupBy("s", F.col("p").alias("v")).agg(F.count("*").alias("kids"), F.min("v").alias("child"))
        rank = lambda c: F.xxhash64("s", c, F.lit(k))  # noqa: B023, E731
        free = (F.col("kids") == 1) & F.col("p").isNotNull() & (rank("v") > rank("p")) & (rank("v") > rank("child"))
        state = opened.join(kids.hint("merge"), ["s", "v"], "left").withColumn("spliced", F.coalesce(free, F.lit(False)))
        over = state.filter("spliced").select("s", F.col("v").alias("p"), F.col("p").alias("p2"), (F.col("load") + F.col("carry")).alias("both"), F.col("load").alias("load2"))
        moved = cut(hub_join(state.filter(~F.col("spliced")), over, ["s", "p"], rows=n))
        records.append(moved.filter("p2 is not null").select("s", F.col("p").alias("v"), F.col("v").alias("child"), (F.col("load2") + F.col("carry")).alias("before")))
        now = moved.select("s", "v", F.coalesce("p2", "p").alias("p"), "load", (F.col("carry") + F.coalesce("both", F.lit(0.0))).alias("carry"), "kids")
        leaf = F.col("kids").isNull() & F.col("p").isNotNull()
        given = now.filter(leaf).groupBy("s", F.col("p").alias("v")).agg(F.sum(F.col("load") + F.col("carry")).alias("more"))
        pieces.append(now.filter(leaf).select("s", "v", F.col("load").alias("acc")))
        opened = cut(now.filter(~leaf).drop("kids").join(given.hint("merge"), ["s", "v"], "left").select("s", "v", "p", (F.col("load") + F.coalesce("more", F.lit(0.0))).alias("load"), "carry"))
    else:
        raise RuntimeError("the contraction did not end")
    pieces.append(cut(opened.coalesce(1).mapInArrow(_base_sums, "s long, v long, acc double")) if base_rows else opened.select("s", "v", F.col("load").alias("acc")))
    for rec in reversed(records):
        known = pieces[0]
        for piece in pieces[1:]:
            known = known.unionByName(piece)
        pieces.append(cut(rec.join(known.withColumnRenamed("v", "child"), ["s", "child"]).select("s", "v", (F.col("before") + F.col("acc")).alias("acc"))))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def accumulate(links: DataFrame, load: str, *, block: Block | None = None, base_rows: int = BASE_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(s, v, acc): the load of each node of ``links`` (s, v, p, and the column ``load``) and of all nodes below it.

    Null loads count as 0. Nodes in or above circles have no row. Sums are taken while leaves are raked. Of a scope
    that spans blocks, one sum per tree and block is carried on to where the tree enters the next block; with these
    as additional loads each block is then summed once more.
    """
    first = _blocks(links, block, chunk, load)
    if not first.filter("out is not null").limit(1).count():
        return first.filter("acc is not null").select("s", "v", "acc")
    on = cut(_beyond(first))
    ends = cut(_rounds(on, base_rows)).select("s", F.col("v").alias("top"), "depth")
    trees = on.join(first.filter("out is not null and v = top").select("s", "v", F.col("acc").alias("load")), ["s", "v"])
    sums = _sum_rounds(trees.select("s", "v", "p", "load"), base_rows)
    enters = on.select("s", "v", "out").join(sums, ["s", "v"]).groupBy("s", F.col("out").alias("v")).agg(F.sum("acc").alias("more"))
    again = links.select("s", "v", "p", F.col(load).alias("_own")).join(enters, ["s", "v"], "left").select("s", "v", "p", (F.coalesce(F.col("_own").cast("double"), F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("load"))
    both = _blocks(again, block, chunk, "load").filter("acc is not null")
    lost = ends.filter("depth < 0").select("s", "top")
    return both.join(lost, ["s", "top"], "left_anti").select("s", "v", "acc")
