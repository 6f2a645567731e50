"""Items that appear together, by stripes.

A stripe is an item's associative array of the neighbours it met and how often (itself included, which counts the
item). Each task folds its records into stripes, whole batches at a time, and flushes them when they reach a bounded
number of entries, so records become compact arrays before any shuffle. The shuffle sends stripes, not pairs; arrays
of one item are merged by key while they stream past. An item that meets very many others has its stripe cut by
neighbour into parts of bounded width, so not even the whole vocabulary must fit one task. The likelihood ratio then
tells pairs above chance from noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast, cut

#: Entries of all associative arrays of one task, after which it flushes them, and pairs made at a time.
FLUSH_ENTRIES, PAIRS = 500_000, 2_000_000
#: Entries of a merged stripe from which it is cut into parts.
WIDE = 65_536
#: A neighbour that no item has: the number of records of a group is kept under it.
RECORDS = -1

STRIPE_DDL = "grp string, item long, near array<long>, times array<long>"


def _reduce(g: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal (g, a, b) summed, in order."""
    if not len(g):
        return g, a, b, n
    o = np.lexsort((b, a, g))
    g, a, b, n = g[o], a[o], b[o], n[o]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return g[first], a[first], b[first], np.add.reduceat(n, first)


def _rows(names: list[str], g: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Entries in order of (g, a, b) as one stripe per (g, a)."""
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1])]) if len(g) else np.zeros(0, np.int64)
    off = pa.array(np.r_[start, len(g)].astype(np.int32))
    group = pa.DictionaryArray.from_arrays(pa.array(g[start].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([group, pa.array(a[start], pa.int64()), pa.ListArray.from_arrays(off, pa.array(b, pa.int64())), pa.ListArray.from_arrays(off, pa.array(n, pa.int64()))], names=["grp", "item", "near", "times"])


class _Fold:
    """Entries of the associative arrays of a task; groups by number, with their names."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.names: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.entries = 0

    def add(self, g: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        """Adds entries; whether it is time to flush."""
        self.parts.append(_reduce(g, a, b, n))
        self.entries += len(self.parts[-1][0])
        if self.entries < self.most:
            return False
        self.parts = [_reduce(*(np.concatenate(x) for x in zip(*self.parts)))]
        self.entries = len(self.parts[0][0])
        return 2 * self.entries >= self.most

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield _rows(list(self.names), *_reduce(*(np.concatenate(x) for x in zip(*self.parts))))
        self.parts, self.entries = [], 0


def _stripes(batches: Iterator[pa.RecordBatch], most: int = FLUSH_ENTRIES, pairs: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """Records (grp, items sorted and distinct) to stripes."""
    fold = _Fold(most)
    for batch in batches:
        lists = batch.column("items")
        items, off = lists.flatten().to_numpy(), np.asarray(lists.value_lengths()).astype(np.int64)
        off = np.r_[0, np.cumsum(off)]
        seen = batch.column("grp").dictionary_encode()
        code = np.asarray([fold.names.setdefault(x, len(fold.names)) for x in seen.dictionary.to_pylist()], np.int64)
        group = code[seen.indices.to_numpy()]
        none = np.full(len(group), RECORDS, np.int64)
        fold.add(group, none, none, np.ones(len(group), np.int64))
        # place p of a record meets the places from p to the record's end; a bounded number of pairs at a time
        size = np.diff(off)
        end, of = np.repeat(off[1:], size), np.repeat(group, size)
        met = end - np.arange(len(items))
        upto = np.r_[0, np.cumsum(met)]
        at = 0
        while at < len(items):
            to = max(int(np.searchsorted(upto, upto[at] + pairs, "right")) - 1, at + 1)
            left = np.repeat(np.arange(at, to), met[at:to])
            right = left + np.arange(len(left)) - np.repeat(upto[at:to] - upto[at], met[at:to])
            if fold.add(of[left], items[left], items[right], np.ones(len(left), np.int64)):
                yield from fold.flush()
            at = to
        if len(fold.names) >= most:  # only between batches, as a batch goes by the numbers of its groups
            yield from fold.flush()
            fold.names = {}
    yield from fold.flush()


def _merge(batches: Iterator[pa.RecordBatch], most: int = FLUSH_ENTRIES) -> Iterator[pa.RecordBatch]:
    """Stripes in order of (grp, item, part) to one stripe per run."""
    held: list[pa.RecordBatch] = []
    entries = 0

    def put(t: pa.Table) -> pa.RecordBatch:
        seen = t.column("grp").combine_chunks().dictionary_encode()
        seen = seen.combine_chunks() if isinstance(seen, pa.ChunkedArray) else seen
        near, times = t.column("near").combine_chunks(), t.column("times").combine_chunks()
        size = np.asarray(near.value_lengths()).astype(np.int64)
        g, a = (np.repeat(x, size) for x in (seen.indices.to_numpy().astype(np.int64), t.column("item").to_numpy()))
        return _rows(seen.dictionary.to_pylist(), *_reduce(g, a, near.flatten().to_numpy(), times.flatten().to_numpy()))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b.select(["grp", "item", "near", "times"]))
        entries += int(np.asarray(b.column("near").value_lengths()).sum())
        if entries >= most:
            t = pa.Table.from_batches(held)
            last = (t.column("grp")[-1].as_py(), t.column("item")[-1].as_py())
            k = t.num_rows - 1
            item, grp = t.column("item").to_numpy(), t.column("grp")
            while k > 0 and item[k - 1] == last[1] and grp[k - 1].as_py() == last[0]:
                k -= 1
            if k:
                yield put(t.slice(0, k))
                t = t.slice(k)
            rest = put(t) if t.num_rows > 1 else t.combine_chunks().to_batches()[0]
            held, entries = [rest], 0
    if held:
        yield put(pa.Table.from_batches(held))


def stripes(records: DataFrame, group: str, items: str, *, wide: int = WIDE) -> DataFrame:
    """(grp, item, near, times): one merged stripe per item, in parts where it is wide; see ``cooccurrence``."""
    cells = records.select(F.col(group).cast("string").alias("grp"), F.col(items).alias("items")).filter("grp is not null and items is not null")
    cells = cells.select("grp", F.sort_array(F.array_distinct(F.filter(F.col("items").cast("array<long>"), lambda x: x.isNotNull()))).alias("items"))
    made = cut(cells.mapInArrow(_stripes, STRIPE_DDL))
    width = made.groupBy("grp", "item").agg(F.sum(F.size("near")).alias("w")).agg(F.max("w")).first()[0] or 0
    parts = math.ceil(width / wide)
    if parts > 1:
        # a part holds the neighbours of one hash remainder; a stripe of one entry stays as it is
        pick = lambda k: F.filter(F.arrays_zip("near", "times"), lambda e: F.pmod(F.xxhash64(e["near"]), F.lit(parts)) == k)
        made = made.select("grp", "item", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "near", "times").withColumn("e", pick(F.col("part"))).filter(F.size("e") > 0)
        made = made.select("grp", "item", "part", F.col("e.near").alias("near"), F.col("e.times").alias("times"))
        keys = ["grp", "item", "part"]
    else:
        keys = ["grp", "item"]
    return made.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge, STRIPE_DDL)


def cooccurrence(records: DataFrame, group: str, items: str, *, least: float = 0.0, wide: int = WIDE) -> DataFrame:
    """Counts of every pair of items that occur together, with lift and log-likelihood ratio, per group.

    records: a column ``group`` (any type, shown as text) and an array column ``items`` of whole numbers; null arrays
    and null groups are left out, repeated and null elements count once or not at all, an empty array counts as a
    record. Items must not be negative. Returns (grp, item_a < item_b, both, n_a, n_b, records, lift, llr) of the
    pairs whose llr is at least ``least``; llr is 0 at chance, and above 2.71, 3.84 or 10.83 at levels of 10, 5 or
    0.1 percent.
    """
    # written once: what follows reads the merged stripes three times
    merged = cut(stripes(records, group, items, wide=wide))
    entries = merged.select("grp", "item", F.explode(F.arrays_zip("near", "times")).alias("e")).select("grp", "item", "e.near", "e.times")
    alone = entries.filter("item = near").select("grp", "item", F.col("times").alias("n"))
    items_ = checked_broadcast(cut(alone.filter("item >= 0")))
    total = checked_broadcast(alone.filter(f"item = {RECORDS}").select("grp", F.col("n").alias("n")))
    pairs = entries.filter("item <> near").select("grp", F.col("item").alias("item_a"), F.col("near").alias("item_b"), F.col("times").alias("x"))
    out = (
        pairs.join(items_.select("grp", F.col("item").alias("item_a"), F.col("n").alias("a")), ["grp", "item_a"])
        .join(items_.select("grp", F.col("item").alias("item_b"), F.col("n").alias("b")), ["grp", "item_b"])
        .join(total, ["grp"])
    )
    h = lambda k: F.when(k > 0, k * F.ln(k)).otherwise(F.lit(0.0))
    x, a, b, n = (F.col(c).cast("double") for c in ("x", "a", "b", "n"))
    matrix = h(x) + h(a - x) + h(b - x) + h(n - a - b + x)
    llr = F.greatest(F.lit(2.0) * (matrix + h(n) - h(a) - h(n - a) - h(b) - h(n - b)), F.lit(0.0))
    out = out.select("grp", "item_a", "item_b", F.col("x").alias("both"), F.col("a").alias("n_a"), F.col("b").alias("n_b"), F.col("n").alias("records"), (x * n / (a * b)).alias("lift"), llr.alias("llr"))
    return out.filter(F.col("llr") >= least) if least else out
