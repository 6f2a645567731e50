"""Filling fixed-capacity sequences with texts of varying length, by cost-balanced packing.

A text costs a linear share per token and, where attention stays inside each text, a quadratic one. Texts go in
descending order to the cheapest sequence that still has room, which balances cost over sequences while small
texts fill what is left. Only texts longer than a sequence are split, into full sequences and a rest. Lengths
are counted once in parallel and written; pieces are then dealt at random to shards of bounded size, and each
shard is packed by itself, so no step gathers more than a shard and only each shard's last sequences stay partly
empty.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import cut

#: File of a public byte-level tokenizer, at the same place on every machine, and its split pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Cost of a text of n tokens: n + QUADRATIC * n * n (attention against the rest, at a model width of 4096).
QUADRATIC = 1 / (6 * 4096)
SHARD_TOKENS, SHARD_PIECES = 8_000_000, 100_000

_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):  # noqa: ANN201
    """The tokenizer of a rank file, kept per worker."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def assign(sizes: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each piece. sizes: in descending order, none above the capacity.

    Two heaps: sequences by cost, and those too full for the piece at hand by room. Sizes only fall, so a full
    sequence comes back as soon as one fits; each is moved at most once per piece it takes.
    """
    opened = math.ceil(sizes.sum() / capacity) if len(sizes) else 0
    room = [capacity] * opened
    cheap = [(0.0, k) for k in range(opened)]
    full: list[tuple[int, float, int]] = []
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        while full and -full[0][0] >= s:
            _, cost, k = heapq.heappop(full)
            heapq.heappush(cheap, (cost, k))
        while cheap and room[cheap[0][1]] < s:
            cost, k = heapq.heappop(cheap)
            heapq.heappush(full, (-room[k], cost, k))
        if cheap:
            cost, k = heapq.heappop(cheap)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        out[i] = k
        room[k] -= s
        heapq.heappush(cheap, (cost + s + quadratic * s * s, k))
    return out


def pack(docs: DataFrame, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN, quadratic: float = QUADRATIC) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens): where every text goes.

    A text longer than the capacity gives pieces of the full capacity and a rest; any other is whole. Null and
    empty texts are placed with 0 tokens. Repeated rows are placed each. An empty table gives no rows.
    """
    sizes = cut(count_tokens(docs, doc_id, text, tokenizer=tokenizer, pattern=pattern))
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    pieces = (
        sizes.withColumn("row", F.monotonically_increasing_id())  # stable: the lengths have been written
        .select("doc_id", "row", F.col("n_tokens").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
        .select("doc_id", "row", "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.least(F.col("total") - F.col("piece_no") * capacity, F.lit(capacity)).alias("n_tokens"))
    )
    total, count = pieces.agg(F.sum("n_tokens"), F.count("*")).first()
    shards = max(1, math.ceil((total or 0) / SHARD_TOKENS), math.ceil(count / SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece_no"), F.lit(shards)).cast("long"))

    def place(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["n_tokens", "doc_id", "piece_no", "row"], ascending=[False, True, True, True], kind="stable")
        d["container_id"] = d["shard"] * (1 << 32) + assign(d["n_tokens"].to_numpy(), capacity, quadratic)
        return d[["container_id", "doc_id", "piece_no", "start_token", "n_tokens"]]

    return dealt.groupBy("shard").applyInPandas(place, "container_id long, doc_id long, piece_no long, start_token long, n_tokens long")


def placed(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, copies, sound): how many rows of a document were placed, and whether their pieces are in order, without
    gaps, full but for the last, and lie in containers that keep to the capacity."""
    packed = cut(packed)
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).filter(F.col("t") > capacity).select("container_id", F.lit(True).alias("over"))
    d = packed.join(over, "container_id", "left")
    places = d.groupBy("doc_id", "piece_no").agg(F.count("*").alias("n"), F.min("start_token").alias("a"), F.max("start_token").alias("b"), F.max("n_tokens").alias("most"), F.max(F.coalesce("over", F.lit(False))).alias("over"))
    fine = (F.col("a") == F.col("piece_no") * capacity) & (F.col("b") == F.col("a")) & (F.col("most") <= capacity) & ~F.col("over")
    g = places.groupBy("doc_id").agg(F.max("n").alias("copies"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.min(fine).alias("fine"), F.sum(F.col("most")).alias("tokens"))
    return g.select("doc_id", "copies", (F.col("fine") & (F.col("pieces") == F.col("last") + 1) & (F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)))).alias("sound"))


def usage(packed: DataFrame, *, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> DataFrame:
    """Per container: its pieces, tokens, unused tokens and cost."""
    n = F.col("n_tokens")
    return packed.groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum(n).alias("tokens"), (F.lit(capacity) - F.sum(n)).alias("unused"), F.sum(n + quadratic * n * n).alias("cost"))
