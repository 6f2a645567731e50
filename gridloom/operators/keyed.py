"""Per-key results where a few keys hold most records.

Every result here is algebraic (counts, sums, means from sums), so it is left to the engine's two-phase hash
aggregate: each task folds its rows into one bounded hash table per key set, spills it sorted if it grows, and
only the partial states are shuffled. A key that holds a third of all rows thus reaches the final task as one
compact state per map task, whatever its row count, and no salting is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(c: str, absent: float = -9999.0) -> Column:
    """A measured value, with NaN and the absent-value mark as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (x != absent), x)


def profile_by_key(df: DataFrame, keys: list[str], means: list[str]) -> DataFrame:
    """Rows, and for each of ``means`` its mean and number of present values, per key.

    Null keys form a group of their own. Null, NaN and -9999 values do not count. An empty table gives no rows.
    """
    aggs = [F.count("*").alias("samples")]
    for m in means:
        aggs += [F.avg(present(m)).alias(f"mean_{m}"), F.count(present(m)).alias(f"n_{m}")]
    return df.groupBy(*keys).agg(*aggs)


def heavy_keys(df: DataFrame, keys: list[str], part: int) -> DataFrame:
    """Keys that hold at least 1/``part`` of the rows, with their counts.

    The total is a scalar subquery over the same per-key counts, so the input is read once.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("samples"))
    total = counts.agg(F.sum("samples").alias("total"))
    return counts.filter(F.col("samples") * part >= total.scalar())
