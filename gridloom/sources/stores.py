"""Tile, catalog and table stores: versioned, partitioned, written in one commit (group A)."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
KEYS = ["version", "seed", "scale", "tile_i", "tile_j"]
TILE_DDL = "r int, c int, elev short, mask short, surface short, class short"


def write_tiles(tiles: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Canonical tiles (seed, scale, tile_i, tile_j, r, c, elev, mask, surface, class), one directory per tile.

    Only the partitions that are written are replaced; a tile's rows are clustered so a tile is one file.
    """
    d = tiles.withColumn("version", F.lit(VERSION))
    d.repartition(*KEYS).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_tiles(spark: SparkSession, path: str, seed: int, scale: int, box: tuple[int, int, int, int], side: int) -> DataFrame:
    """Cells of a box (r0, c0, r1, c1; ends exclusive) in grid coordinates; other tiles' directories are pruned."""
    r0, c0, r1, c1 = box
    d = spark.read.parquet(path).filter((F.col("version") == VERSION) & (F.col("seed") == seed) & (F.col("scale") == scale) & F.col("tile_i").between(r0 // side, (r1 - 1) // side) & F.col("tile_j").between(c0 // side, (c1 - 1) // side))
    d = d.withColumns({"r": F.col("tile_i") * side + F.col("r"), "c": F.col("tile_j") * side + F.col("c")})
    return d.filter((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))


def write_drainage(cells: DataFrame, path: str) -> None:
    """Coarse drainage tiles (seed, scale, tile_i, tile_j, cell, downstream int, accumulation float)."""
    cells.withColumn("version", F.lit(VERSION)).repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_drainage(spark: SparkSession, path: str, seed: int, scale: int, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
    """(tile_i, tile_j, cell, downstream, accumulation) of one world's coarse drainage tiles, all or those named; the
    directories of others are pruned. Tiles of another version are a miss."""
    d = spark.read.parquet(path).filter((F.col("version") == VERSION) & (F.col("seed") == seed) & (F.col("scale") == scale))
    if tiles is not None:
        hit = F.lit(False)
        for i, j in tiles:
            hit = hit | ((F.col("tile_i") == i) & (F.col("tile_j") == j))
        d = d.filter(hit)
    return d.select("tile_i", "tile_j", "cell", "downstream", "accumulation")


MAGIC = b"GLTL"


def encode_tile(elev: np.ndarray, cls: np.ndarray, mask: np.ndarray, surface: np.ndarray, seed: int, scale: int) -> bytes:
    """A tile as big-endian bytes: header, i16 elevation, i16 class, u8 mask, i16 surface."""
    h, w = elev.shape
    return MAGIC + struct.pack(">iqiii", VERSION, seed, scale, h, w) + b"".join(a.astype(t).tobytes() for a, t in ((elev, ">i2"), (cls, ">i2"), (mask, "u1"), (surface, ">i2")))


def decode_tile(data: bytes, seed: int, scale: int) -> dict[str, np.ndarray] | None:
    """The planes of a tile, or None if any check fails (magic, version, key, length): a damaged tile is a miss."""
    head = 4 + struct.calcsize(">iqiii")
    if len(data) < head or data[:4] != MAGIC:
        return None
    version, s, k, h, w = struct.unpack(">iqiii", data[4:head])
    if (version, s, k) != (VERSION, seed, scale) or h <= 0 or w <= 0 or len(data) != head + 7 * h * w:
        return None
    at, out = head, {}
    for name, t in (("elev", ">i2"), ("class", ">i2"), ("mask", "u1"), ("surface", ">i2")):
        n = h * w * np.dtype(t).itemsize
        out[name] = np.frombuffer(data[at : at + n], t).reshape(h, w)
        at += n
    return out


def read_binary_tiles(spark: SparkSession, path: str, seed: int, scale: int) -> DataFrame:
    """(path, r, c, elev, class, mask, surface) of all readable binary tiles under a folder, in parallel."""
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                t = decode_tile(data, seed, scale)
                if t is None:
                    continue
                h, w = t["elev"].shape
                k = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array([p] * (h * w)), pa.array(k // w, pa.int32()), pa.array(k % w, pa.int32()), *[pa.array(t[n].ravel().astype(np.int16)) for n in ("elev", "class", "mask", "surface")]], names=["path", "r", "c", "elev", "class", "mask", "surface"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, r int, c int, elev short, class short, mask short, surface short")


FAMILY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("octaves", T.IntegerType()), T.StructField("gain", T.DoubleType()), T.StructField("samples", T.LongType()),
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("stddev", T.DoubleType()), T.StructField("quantiles", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(name, pct, v, lo, hi): quantile tables from one JSON file per family."""
    d = spark.read.schema(FAMILY_SCHEMA).option("multiLine", True).json(path)
    return d.select("name", F.explode("quantiles").alias("q"), F.col("min").alias("lo"), F.col("max").alias("hi")).select("name", F.col("q")[0].alias("pct"), F.col("q")[1].alias("v"), "lo", "hi")


def check_climate_tables(tables: DataFrame) -> DataFrame:
    """(channel, ok): quantile tables (channel, pct, v) whose elevation median is at most 0 and magnitudes below 20000."""
    mid = F.max(F.when(F.col("pct") == 50, F.col("v")))
    return tables.groupBy("channel").agg((((F.col("channel") != "elevation") | (mid <= 0)) & (F.max(F.abs("v")) <= 20000)).alias("ok"))


def nested_window(g: DataFrame, value: str, decimals: int = 2) -> DataFrame:
    """One row: the window's values as a JSON list of rows, rounded half up."""
    k = 10**decimals
    rows = g.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", (F.floor(F.col(value) * k + 0.5) / k).alias("v")))).alias("x"))
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", F.transform("x", lambda e: e["v"]).alias("v")))), lambda e: e["v"])).alias("json"))


def model_config(path: str) -> dict:
    """Model settings with their checks: positive sizes and equally long statistics."""
    with open(path, encoding="utf-8") as f:
        c = json.load(f)
    if len(c.get("means", [])) != len(c.get("stds", [])) or any(s <= 0 for s in c.get("stds", [])):
        raise ValueError("means and standard deviations do not match")
    return c


def first_existing(paths: list[str]) -> str | None:
    return next((p for p in paths if os.path.exists(p)), None)


def png(rgba: np.ndarray) -> bytes:
    """A picture (height, width, 4 bytes) as PNG."""
    h, w, _ = rgba.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def _window(d: pd.DataFrame) -> tuple[np.ndarray, tuple[int, int]]:
    r, c = d["r"] - d["r"].min(), d["c"] - d["c"].min()
    shape = (int(r.max()) + 1, int(c.max()) + 1)
    return (r * shape[1] + c).to_numpy(), shape


def pictures(cells: DataFrame, by: list[str], red: str, green: str, blue: str, alpha: str) -> DataFrame:
    """(by, height, width, png) of each window of cells (by, r, c and four channels of 0 to 255); gaps are clear.

    A window is a screenful, so its cells fit a task.
    """

    def draw(d: pd.DataFrame) -> pd.DataFrame:
        at, (h, w) = _window(d)
        p = np.zeros((h * w, 4), np.uint8)
        p[at] = d[[red, green, blue, alpha]].clip(0, 255).to_numpy().astype(np.uint8)
        return pd.DataFrame({**{k: [d[k].iloc[0]] for k in by}, "height": [h], "width": [w], "png": [png(p.reshape(h, w, 4))]})

    types = dict(cells.dtypes)
    return cells.groupBy(*by).applyInPandas(draw, ", ".join(f"`{k}` {types[k]}" for k in by) + ", height int, width int, png binary")


def raw_details(cells: DataFrame, by: list[str], temperature: bool = False) -> DataFrame:
    """(by, height, width, layout, data) of each window: little-endian i16 elevation, temperature if wanted, class and
    water surface, then the u8 mask, one plane after the other. Gaps read as 0."""
    planes = [("elev", "<i2"), *([("temp", "<i2")] if temperature else []), ("class", "<i2"), ("surface", "<i2"), ("mask", "u1")]

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        at, (h, w) = _window(d)
        out = b""
        for n, t in planes:
            p = np.zeros(h * w, t)
            p[at] = d[n].fillna(0).to_numpy().astype(t)
            out += p.tobytes()
        return pd.DataFrame({**{k: [d[k].iloc[0]] for k in by}, "height": [h], "width": [w], "layout": [",".join(f"{n}:{t}" for n, t in planes)], "data": [out]})

    types = dict(cells.dtypes)
    return cells.groupBy(*by).applyInPandas(pack, ", ".join(f"`{k}` {types[k]}" for k in by) + ", height int, width int, layout string, data binary")


def captured(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows kept under a path; built and written there in one commit where there are none yet."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_NAMED: dict[tuple[str, str], DataFrame] = {}


def registered(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a name in this session: built and kept at the first call, the same one afterwards; also as a view."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _NAMED:
        _NAMED[key] = build().persist()
        _NAMED[key].createOrReplaceTempView(name)
    return _NAMED[key]
