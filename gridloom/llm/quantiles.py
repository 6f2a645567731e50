"""Percentiles of very large numeric columns, by deterministic buffer collapsing.

A state is a set of sorted buffers. Raw values fill buffers of equal size and weight one; when FAN buffers of a
level have come together they collapse into one of the next level, which keeps the values at evenly spaced
positions of their weighted merge and carries their summed weight. One collapse moves a rank by at most half its
spacing, and the tree keeps the number of collapses over any value at the logarithm of the count, so the rank
error stays below levels / (2 * size) of the count; each state carries its own exact bound. States of tasks,
days, worlds or probes are merged in the same way, without going back to the values.

Results do not depend on how the input is partitioned: rows are put into buckets by the hash of their own id, each
bucket becomes states by itself, and states are merged bucket by bucket along a fixed tree, in an order that follows
from their content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast

SIZE, FAN = 512, 8
#: Rows of a bucket, which a task gathers before it folds them, and buckets whose states are merged at a time.
BUCKET_ROWS, TREE = 1 << 18, 256

STATE_DDL = "by string, key string, metric string, level int, weight double, err double, vals array<double>"
_TYPES = [("by", pa.string()), ("key", pa.string()), ("metric", pa.string()), ("level", pa.int32()), ("weight", pa.float64()), ("err", pa.float64()), ("vals", pa.list_(pa.float64()))]


class State:
    """The buffers of one group: raw values not yet in a full buffer, and full buffers by level."""

    def __init__(self, size: int = SIZE) -> None:
        self.size = size
        self.raw: list[np.ndarray] = []
        self.n_raw = 0
        self.levels: dict[int, list[tuple[float, float, np.ndarray]]] = {}

    def add(self, values: np.ndarray) -> None:
        """Raw values, weight one."""
        self.raw.append(values)
        self.n_raw += len(values)
        if self.n_raw >= self.size:
            v = np.concatenate(self.raw)
            full = len(v) // self.size * self.size
            for part in v[:full].reshape(-1, self.size):
                self.put(0, 1.0, 0.0, np.sort(part))
            self.raw = [v[full:]]
            self.n_raw = len(v) - full

    def put(self, level: int, weight: float, err: float, values: np.ndarray) -> None:
        """A sorted buffer of weighted values."""
        held = self.levels.setdefault(level, [])
        held.append((weight, err, values))
        if len(held) >= FAN:
            self.levels[level] = []
            self.put(level + 1, *collapse(held, self.size))

    def buffers(self) -> Iterator[tuple[int, float, float, np.ndarray]]:
        if self.n_raw:
            yield 0, 1.0, 0.0, np.sort(np.concatenate(self.raw))
        for level, held in sorted(self.levels.items()):
            for w, e, v in held:
                yield level, w, e, v


def merged(buffers: list[tuple[float, float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All values in order with their cumulated weights."""
    v = np.concatenate([b[2] for b in buffers])
    w = np.repeat([b[0] for b in buffers], [len(b[2]) for b in buffers])
    o = np.argsort(v, kind="stable")
    return v[o], np.cumsum(w[o])


def collapse(buffers: list[tuple[float, float, np.ndarray]], size: int) -> tuple[float, float, np.ndarray]:
    """(weight, error bound, values) of the buffer of ``size`` values at evenly spaced positions of the merge."""
    v, cum = merged(buffers)
    step = cum[-1] / size
    at = np.searchsorted(cum, (np.arange(size) + 0.5) * step, "left")
    weights = [b[0] for b in buffers]
    return step, sum(b[1] for b in buffers) + step / 2 + max(weights) - min(weights), v[np.minimum(at, len(v) - 1)]


def read(buffers: list[tuple[float, float, np.ndarray]], fractions: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(count, error bound in ranks, values at the fractions); exact with linear interpolation if all weights are one."""
    v, cum = merged(buffers)
    n = cum[-1]
    err = sum(b[1] for b in buffers)
    if all(b[0] == 1.0 for b in buffers):
        return n, err, np.quantile(v, fractions)
    mid = cum - np.diff(cum, prepend=0.0) / 2
    return n, err + max(b[0] for b in buffers) / 2, np.interp(fractions * n, mid, v)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _TYPES)], names=[n for n, _ in _TYPES])


def _fold_groups(by: str, metric: str, codes: np.ndarray, names: np.ndarray, values: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """States of a chunk: small groups as raw buffers (cut from one array), large ones folded."""
    ok = (codes >= 0) & ~np.isnan(values)
    codes, values = codes[ok], values[ok]
    if not len(codes):
        return
    o = np.lexsort((values, codes))
    codes, values = codes[o], values[o]
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    count = np.diff(np.r_[start, len(codes)])
    small = count < size
    if small.any():
        keep = np.repeat(small, count)
        n = int(small.sum())
        vals = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count[small])], pa.int32()), pa.array(values[keep]))
        key = pa.array(names[codes[start[small]]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([by] * n), key, pa.array([metric] * n), pa.array(np.zeros(n), pa.int32()), pa.array(np.ones(n)), pa.array(np.zeros(n)), vals], names=[t[0] for t in _TYPES])
    rows = []
    for s, c in zip(start[~small], count[~small]):
        state = State(size)
        # every FANth value goes to the same buffer, so leaf buffers of a sorted chunk are alike
        state.add(np.concatenate([values[s : s + c][k::FAN] for k in range(FAN)]))
        rows += [(by, names[codes[s]], metric, *b) for b in state.buffers()]
    if rows:
        yield _batch(rows)


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Number of buckets for so many rows: a power of two, whatever the cluster."""
    return 1 << max(0, (max(rows, 1) - 1) // bucket_rows).bit_length()


def sketch(df: DataFrame, groups: dict[str, str | Column], metrics: list[str], *, row: list[str], buckets: int = 1, size: int = SIZE, absent: float | None = None) -> DataFrame:
    """States (STATE_DDL and the column ``part``, the bucket) of every metric per group.

    groups: name of a grouping to its key, a column or an expression (any type, shown as text). row: columns that tell
    rows apart; their hash gives the bucket. Rows with a null key are left out of that grouping; null, NaN and
    ``absent`` values do not count. One shuffle, by bucket, so a group with a third of all rows is spread evenly.
    """
    used = {c for c in groups.values() if isinstance(c, str)} | set(metrics)
    kept = df.select(*(sorted(used) if all(isinstance(c, str) for c in groups.values()) else df.columns), F.pmod(F.xxhash64(*row), F.lit(buckets)).cast("int").alias("_part"))
    kept = kept.repartition("_part").sortWithinPartitions("_part")
    need = kept.select("_part", *[(F.col(c) if isinstance(c, str) else c).cast("string").alias(f"g{i}") for i, c in enumerate(groups.values())], *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])

    names_of = list(groups)  # the expressions themselves stay on the driver

    def states(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for i, by in enumerate(names_of):
            d = t.column(f"g{i}").combine_chunks()
            d = d.dictionary_encode() if not pa.types.is_dictionary(d.type) else d
            d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
            codes = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            names = np.asarray(d.dictionary.to_pylist(), dtype=object)
            for j, m in enumerate(metrics):
                v = t.column(f"m{j}").to_numpy().astype(float)
                if absent is not None:
                    v = np.where(v == absent, np.nan, v)
                yield from _fold_groups(by, m, codes, names, v, size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                for b in states(pa.Table.from_batches(held).combine_chunks()):
                    yield b.append_column("part", pa.array(np.full(b.num_rows, now, np.int32)))

        for b in batches:
            part = b.column("_part").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                if part[a] != now:
                    yield from flush()
                    held, now = [], int(part[a])
                held.append(b.slice(a, z - a))
        yield from flush()

    return need.mapInArrow(fold, STATE_DDL + ", part int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, float, float, np.ndarray]]]]:
    """Buffers of each run of equal (by, key, metric)."""
    now, held = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("by", "key", "metric", "level", "weight", "err")]
        lists = b.column("vals")
        flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for i, (by, key, metric, level, weight, err) in enumerate(zip(*cols)):
            if (by, key, metric) != now:
                if held:
                    yield now, held
                now, held = (by, key, metric), []
            held.append((level, weight, err, flat[off[i] : off[i + 1]]))
            if len(held) >= 64 * FAN:
                held = list(_folded(held).buffers())
    if held:
        yield now, held


def _folded(held: list[tuple[int, float, float, np.ndarray]], size: int = SIZE) -> State:
    state = State(size)
    for level, weight, err, v in held:
        if level == 0 and weight == 1.0 and err == 0.0:
            state.add(v)
        else:
            state.put(level, weight, err, v)
    return state


def combine(states: DataFrame, buckets: int = 1) -> DataFrame:
    """States merged to few buffers per (by, key, metric), whole in one partition and in order; columns beside
    STATE_DDL's (days, probes) are dropped.

    With more than TREE buckets (column ``part``), the states of so many buckets are merged first, level by level, so
    a group that is in all of them never comes together in one task. The order of merging follows from the content.
    """
    names = [n for n, _ in _TYPES]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group, held in _groups(batches):
            rows += [(*group, *b) for b in _folded(held).buffers()]
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of one part at a time; the part goes on with the merged states
        for part, run in _by_part(batches):
            for b in merge(iter(run)):
                yield b.append_column("part", pa.array(np.full(b.num_rows, part, np.int32)))

    keys = ["by", "key", "metric"]
    content = ["level", "weight", F.xxhash64("vals")]
    s = states
    while buckets > TREE:
        buckets = -(-buckets // TREE)
        s = s.select(*names, F.floor(F.col("part") / TREE).cast("int").alias("part"))
        s = s.repartition(*keys, "part").sortWithinPartitions("part", *keys, *content).mapInArrow(merge_parts, STATE_DDL + ", part int")
    return s.select(*names).repartition(*keys).sortWithinPartitions(*keys, *content).mapInArrow(merge, STATE_DDL)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal ``part``, cut also between groups of keys once they are long."""
    now, held = None, []
    for b in batches:
        part = b.column("part").to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        for a, z in zip(edges[:-1], edges[1:]):
            if a == z:
                continue
            if held and part[a] != now:
                yield now, held
                held = []
            now = int(part[a])
            held.append(b.slice(a, z - a))
    if held:
        yield now, held


def percentiles(states: DataFrame, fractions: list[float], buckets: int = 1) -> DataFrame:
    """(by, key, metric, n, rank_error, fraction columns q<percent>) from states; merges them first.

    rank_error is the proven bound as a share of n; 0 where all values were kept, and the values then agree
    with linear interpolation between order statistics.
    """
    cols = [_name(f) for f in fractions]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.array(fractions)
        rows = []
        for group, held in _groups(batches):
            n, err, q = read([b[1:] for b in held], f)
            rows.append((*group, n, err / n, *q.tolist()))
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in c[:3]], *[pa.array(x, pa.float64()) for x in c[3:]]], names=["by", "key", "metric", "n", "rank_error", *cols])

    ddl = "by string, key string, metric string, n double, rank_error double, " + ", ".join(f"{c} double" for c in cols)
    # combine leaves each group whole and sorted in one partition
    return combine(states, buckets).mapInArrow(finish, ddl).withColumn("n", F.round("n").cast("long"))


def _name(f: float) -> str:
    return f"q{100 * f:g}".replace(".", "_")


def within_bounds(values: DataFrame, found: DataFrame, fractions: list[float]) -> DataFrame:
    """(by, key, metric, n, within): whether every reported percentile lies within its own bound of its exact rank.

    values: (by, key, metric, value), one row per value and grouping; found: from ``percentiles``. Two ranks more are
    granted, as values between two ranks are read in between. Counts only, folded before the shuffle.
    """
    keys = ["by", "key", "metric"]
    j = values.join(checked_broadcast(found.select(*keys, "rank_error", *[_name(f) for f in fractions])), keys)
    sides = [c for f in fractions for c in (F.count_if(F.col("value") < F.col(_name(f))).alias(f"a_{_name(f)}"), F.count_if(F.col("value") <= F.col(_name(f))).alias(f"b_{_name(f)}"))]
    g = j.groupBy(*keys).agg(F.count("*").alias("n"), F.max("rank_error").alias("e"), *sides)
    slack = F.col("e") * F.col("n") + 2
    ok = F.lit(True)
    for f in fractions:
        ok = ok & (F.col(f"a_{_name(f)}") <= f * F.col("n") + slack) & (F.col(f"b_{_name(f)}") >= f * F.col("n") - slack)
    return g.select(*keys, "n", ok.alias("within"))


def table_states(tables: DataFrame, *, family: str = "family", samples: str = "samples", pcts: str = "quantile_pcts", vals: str = "quantile_vals", lo: str | None = None, hi: str | None = None, size: int = SIZE) -> DataFrame:
    """States from measured quantile tables: each stands for ``samples`` values spread along its quantile curve.

    Entries with a null or NaN on either side are left out, the rest sorted by percent; percents of which none
    exceeds 1 are on a 0..1 scale, unless the least and greatest value (columns ``lo`` and ``hi``, if given) show that
    the last entry is the low end of a percent scale. A table without usable entries has no state; one without a positive count
    counts as its number of entries. The table's widest gap adds to the error bound.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, n, p, v, low, high in zip(*[b.column(c).to_pylist() for c in ("family", "samples", "pcts", "vals", "lo", "hi")]):
                pairs = sorted((x, y) for x, y in zip(p or [], v or []) if x is not None and y is not None and x == x and y == y)
                if not pairs or name is None:
                    continue
                x, y = np.array(pairs).T
                cut_off = low is not None and high is not None and abs(y[-1] - low) < abs(y[-1] - high)
                if x[-1] <= 1.0 and not cut_off:
                    x = x * 100
                n = float(n) if n and n > 0 else float(len(x))
                points = np.interp((np.arange(size) + 0.5) * 100 / size, x, np.maximum.accumulate(y))
                gap = max(np.diff(np.r_[0.0, x, 100.0])) / 100
                level = max(0, int(np.floor(np.log(max(n / size, 1.0)) / np.log(FAN)))) + 1
                rows.append(("family", name, "value", level, n / size, n * gap / 2, points))
            yield _batch(rows)

    need = tables.select(F.col(family).alias("family"), F.col(samples).cast("double").alias("samples"), F.col(pcts).cast("array<double>").alias("pcts"), F.col(vals).cast("array<double>").alias("vals"), *[(F.col(c).cast("double") if c else F.lit(None).cast("double")).alias(n) for c, n in ((lo, "lo"), (hi, "hi"))])
    return need.mapInArrow(turn, STATE_DDL)
