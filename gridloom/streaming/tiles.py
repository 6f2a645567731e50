"""Canonical tiles written while they come in: each micro-batch in one commit, tiles that are held already left alone."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources import stores


def write_new_tiles(tiles: DataFrame, path: str) -> None:
    """Writes those tiles of a batch that the store does not hold; a tile's key stands in its directory, so looking it
    up reads no cells. Rows of a cell that comes twice in a batch count once."""
    keys = stores.KEYS[1:]
    new = tiles.dropDuplicates([*keys, "r", "c"])
    spark = tiles.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        held = spark.read.parquet(path).filter(f"version = {stores.VERSION}").select(*keys).distinct()
        new = new.join(held, keys, "left_anti")
    stores.write_tiles(new, path, mode="overwrite")


def tile_sink(tiles: DataFrame, path: str, checkpoint: str | Path, *, once: bool = False) -> StreamingQuery:
    """A running query that writes a stream of tiles (see ``stores.write_tiles``) beside everything else; with ``once``
    it ends when what is there has been written. After a failure the batch at hand is written again, to the same end."""
    w = tiles.writeStream.foreachBatch(lambda b, _: write_new_tiles(b, path)).option("checkpointLocation", str(checkpoint))
    return (w.trigger(availableNow=True) if once else w).start()
