"""Session-level helpers shared by the operators: reading, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side counts as small enough to be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of one join key from which it counts as a hub.
HUB_ROWS = 1_000_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the workers once per application, where they may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"  # read by the driver's own file server only
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; columns are pruned by whoever selects them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least as many partitions as the session has cores, for work that is heavy per row.

    A small file is one partition whatever its rows cost. Larger inputs have enough splits and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own; on a single machine without one, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there, so later steps survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than one row beyond the limit."""
    return df.limit(limit + 1).count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if its row count is proven to be within ``limit``; else as it is."""
    return F.broadcast(df) if bounded_rows(df, limit) else df


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], *, hub: int = HUB_ROWS, rows: int | None = None) -> DataFrame:
    """Left join on ``keys`` where a few keys may hold most of the left rows; the right side is unique on the keys.

    Keys with more than ``hub`` left rows are counted first (a partial aggregate). Their rows stay where they are and
    meet the matching right rows as a broadcast, of which there are at most the left rows over ``hub``; all others go
    through an ordinary join. Rows with a null key match nothing and stay. ``rows``: how many left rows there are at most,
    if that is known; no more than ``hub`` of them hold no hub. The ordinary join is a merge of both sides: in loops of
    many joins, small sides that are broadcast each time would pile up in the driver.
    """
    right_ = right.hint("merge")
    if rows is not None and rows <= hub:
        return left.join(right_, keys, "left")
    heavy = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hub).select(*keys)
    if not bounded_rows(heavy, 0) and bounded_rows(heavy, BROADCAST_ROWS):
        heavy = cut(heavy)
        few = left.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys, "left")
        return left.join(F.broadcast(heavy), keys, "left_anti").join(right_, keys, "left").unionByName(few)
    return left.join(right_, keys, "left")


def clean_name(col, *, lower: bool = True):
    """Trimmed (and lower-case) spelling of a descriptive string column."""
    out = F.trim(col)
    return F.lower(out) if lower else out


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order``; equal ``order`` is settled by the values.

    Nulls in ``order`` sort first, so a row without it is used only if there is no other. It is a partial
    aggregate before the shuffle, so a key that holds a third of all rows sends one row per task.
    """
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [order, *values]])
