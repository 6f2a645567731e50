"""Diagnostics over classified samples: shares, diversity, co-occurrence, ranges, pass rates, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast, cut


def shares(df: DataFrame, zone: str, cls: str) -> DataFrame:
    """(zone, class, n, share): count and share of each class within each zone, and overall where zone is null.

    One pass of grouping sets; the totals come from the aggregated rows. A null zone in the data is shown as ''.
    """
    d = df.select(F.coalesce(F.col(zone), F.lit("")).alias("zone"), F.col(cls).alias("class_index"))
    g = d.groupingSets([["zone", "class_index"], ["class_index"]], "zone", "class_index").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("zone"))
    return g.withColumn("share", F.col("n") / total)


def diversity(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Per group: Shannon entropy, effective number of classes, concentration (sum of squared shares), class count."""
    s, sn, ss = F.sum(n), F.sum(F.col(n) * F.ln(n)), F.sum(F.col(n).cast("double") * F.col(n))
    d = counts.filter(F.col(n) > 0).groupBy(*by).agg(s.alias("_s"), sn.alias("_e"), ss.alias("_q"), F.count("*").alias("classes"))
    h = F.ln("_s") - F.col("_e") / F.col("_s")
    return d.select(*by, h.alias("entropy"), F.exp(h).alias("effective"), (F.col("_q") / F.col("_s") / F.col("_s")).alias("concentration"), "classes")


def collisions(df: DataFrame, cands: str, extra: list[str] | None = None) -> DataFrame:
    """(class_a < class_b, n): in how many cells both are eligible. Pairs are made inside a cell's own short array
    of distinct candidates and folded before the shuffle."""
    c = F.sort_array(F.array_distinct(F.transform(F.col(cands), lambda m: m["class_index"])))
    d = df.select(*(extra or []), c.alias("c")).filter(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("class_a"), b.alias("class_b")))))
    return d.select(*(extra or []), F.explode(pairs).alias("p")).groupBy(*(extra or []), "p.class_a", "p.class_b").agg(F.count("*").alias("n"))


def runners_up(df: DataFrame, cands: str, key: str, k: int = 3) -> DataFrame:
    """(key, place, class): the first k distinct classes of each row by their best weight, ties to the first rule."""
    best = F.array_sort(
        F.transform(F.array_distinct(F.transform(F.col(cands), lambda m: m["class_index"])), lambda c: F.struct((-F.array_max(F.transform(F.filter(F.col(cands), lambda m: m["class_index"] == c), lambda m: m["weight"]))).alias("w"), F.array_min(F.transform(F.filter(F.col(cands), lambda m: m["class_index"] == c), lambda m: m["ord"])).alias("o"), c.alias("class_index")))
    )
    return df.select(key, F.posexplode(F.slice(best, 1, k)).alias("place", "m")).select(key, "place", F.col("m.class_index").alias("class_index"))


#: Values around a percentile that are kept per so many values: the accuracy of the first, approximate pass.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, by: list[str], variables: list[str], cuts: list[float], *, accuracy: int = ACCURACY) -> DataFrame:
    """(by, variable, cut, value): exact percentiles with linear interpolation, without gathering a column's values.

    A first pass of mergeable sketches gives a bracket around each percentile that holds about 8/``accuracy`` of the
    values (all values of groups no larger than ``accuracy``); a second counts what lies below each bracket and the distinct values inside it, of which those at the
    wanted ranks are read. Null and NaN values do not count; a group without values has no row. Null keys are a group.
    """
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("v")) for v in variables])
    long = df.select(*by, F.explode(each).alias("_x")).select(*by, "_x.variable", "_x.v").filter("v is not null and not isnan(v)")
    keys = [*by, "variable"]
    d = 4.0 / accuracy  # the sketch is off by at most 1/accuracy, so the wanted rank and the next lie inside
    ends = F.array(*[F.lit(x) for f in cuts for x in (max(f - d, 0.0), min(f + d, 1.0))])
    first = long.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", ends, accuracy).alias("q"))
    near = lambda i, f: F.struct(F.lit(f).alias("cut"), F.when((F.col("n") <= accuracy) | F.lit(f <= d), F.col("least")).otherwise(F.col("q")[2 * i]).alias("lo"), F.when((F.col("n") <= accuracy) | F.lit(f >= 1 - d), F.col("most")).otherwise(F.col("q")[2 * i + 1]).alias("hi"))
    brackets = cut(first.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", F.array(*[near(i, f) for i, f in enumerate(cuts)]).alias("b")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    j = long.join(checked_broadcast(brackets), same).select(*keys, "v", "n", "b")
    below = j.groupBy(*keys).agg(F.max("n").alias("n"), *[F.count_if(F.col("v") < F.col("b")[i]["lo"]).alias(f"_{i}") for i in range(len(cuts))])
    below = below.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(f).alias("cut"), F.col(f"_{i}").alias("below")) for i, f in enumerate(cuts)])).alias("x")).select(*keys, "n", "x.*")
    inside = F.filter("b", lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"]))
    held = j.select(*keys, "v", F.explode(F.transform(inside, lambda x: x["cut"])).alias("cut")).groupBy(*keys, "cut", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*keys, "cut").orderBy("v"))
    held = held.withColumn("upto", upto).select(*[F.col(k).alias(f"_{k}") for k in [*keys, "cut"]], "v", "upto")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "cut"]])
    at = F.col("cut") * (F.col("n") - 1)
    low = F.floor(at)
    r = held.join(checked_broadcast(below), same).groupBy(*keys, "cut", "n").agg(F.min(F.when(F.col("below") + F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("below") + F.col("upto") > F.least(low + 1, F.col("n") - 1), F.col("v"))).alias("z"))
    return r.select(*keys, "cut", (F.col("a") + (F.col("z") - F.col("a")) * (at - low)).alias("value"))


def ranges(df: DataFrame, by: list[str], variables: list[str], flags: list[str], cuts: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Exact percentiles of each variable and shares of each flag per group; NaN values do not count."""
    q = exact_percentiles(df, by, variables, list(cuts)).groupBy(*by).agg(
        *[F.max(F.when((F.col("variable") == v) & (F.col("cut") == c), F.col("value"))).alias(f"{v}_p{round(100 * c):d}") for v in variables for c in cuts]
    )
    n = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("int")).alias(f"{f}_share") for f in flags])
    q = q.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in q.columns if c not in by])
    j = n.join(q, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]), "left")
    return j.select(*by, "n", *[c for c in q.columns if c not in [f"_{k}" for k in by]], *[f"{f}_share" for f in flags])


def pass_rates(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(name, rate): the share of rows that hold each named condition, all in one aggregate."""
    names = list(conditions)
    row = df.agg(*[F.avg(conditions[n].cast("int")).alias(f"c{i}") for i, n in enumerate(names)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("rate")) for i, n in enumerate(names)])).alias("x")).select("x.*")


def extremes(df: DataFrame, channels: list[str]) -> DataFrame:
    """(channel, lo, hi) without NaN and null values; 0 where nothing is left."""
    row = df.agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"{n}{i}") for i, c in enumerate(channels) for n, f in (("lo", F.min), ("hi", F.max))])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), zero(f"lo{i}").alias("lo"), zero(f"hi{i}").alias("hi")) for i, c in enumerate(channels)])).alias("x")).select("x.*")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, distinct, checksum): independent of order and partitioning."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.countDistinct(*columns).alias("distinct_rows"), F.bit_xor(h).alias("checksum"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their place; partial limits run before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def uncovered(used: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key): the distinct keys in use that the table does not have."""
    return used.select(key).filter(F.col(key).isNotNull()).distinct().join(table.select(key).distinct(), key, "left_anti")


def counters(calls: DataFrame, model: str, cost: str, batch: str) -> DataFrame:
    """(model, calls, total, items): calls, summed cost and summed batch sizes by model, the costliest first, ties by name."""
    d = calls.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("calls"), F.sum(cost).alias("total"), F.sum(batch).alias("items"))
    return d.orderBy(F.desc("total"), "model")


def statuses(cells: DataFrame, status: str) -> DataFrame:
    """(status, n): how many cells have each status."""
    return cells.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
