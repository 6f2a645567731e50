"""64-bit lattice hash and value noise as native columns.

The mixer multiplies modulo 2^64. Under ANSI arithmetic a wrapping product is an error, so it is put together from
16-bit limbs. Each round is its own projection: an intermediate value is computed once and all rounds stay in
whole-stage code.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: lattice and mixing multipliers
LATTICE_X, LATTICE_Z = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def signed64(v: int) -> int:
    """The low 64 bits of a number as a signed long."""
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def wrapping_product(v: Column, k: int) -> Column:
    """v * k modulo 2^64, as a signed long."""
    a = [F.shiftrightunsigned(v, 16 * i).bitwiseAND(65535) for i in range(4)]
    b = [k >> 16 * i & 65535 for i in range(4)]
    carry, limbs = None, []
    for i in range(4):
        s = None
        for j in range(i + 1):
            t = a[j] * F.lit(b[i - j]).cast("long")
            s = t if s is None else s + t
        s = s if carry is None else s + carry
        limbs.append(s.bitwiseAND(65535))
        carry = F.shiftrightunsigned(s, 16)
    out = limbs[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[i], 16 * i))
    return out


def with_hash(df: DataFrame, **spec: tuple[int | str, str, str]) -> DataFrame:
    """Adds one long column per name: the hash of (seed, x, z); seed a number or column, x and z integer columns."""
    names = list(spec)

    def stage(d: DataFrame, f) -> DataFrame:  # noqa: ANN001
        return d.withColumns({n: f(F.col(n)) for n in names})

    start = {}
    for n, (seed, x, z) in spec.items():
        s = F.lit(seed).cast("long") if isinstance(seed, int) else F.col(seed).cast("long")
        start[n] = s.bitwiseXOR(wrapping_product(F.col(x).cast("long"), LATTICE_X)).bitwiseXOR(wrapping_product(F.col(z).cast("long"), LATTICE_Z))
    d = df.withColumns(start)
    for shift, k in ((30, MIX_A), (27, MIX_B)):
        d = stage(d, lambda v, s=shift: v.bitwiseXOR(F.shiftrightunsigned(v, s)))
        d = stage(d, lambda v, m=k: wrapping_product(v, m))
    # The partition number is never negative, so this adds nothing; but no filter is pushed through a projection that
    # reads it, which would put all rounds together into one expression of thousands of terms. Filter before hashing.
    still = F.when(F.spark_partition_id() < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return stage(d, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)).bitwiseXOR(still))


def unit(h: str | Column) -> Column:
    """Top 24 bits of a hash as a value in [0, 1)."""
    return F.shiftrightunsigned(F.col(h) if isinstance(h, str) else h, 40) / F.lit(16777216.0)


def signed(h: str | Column) -> Column:
    """Top 24 bits of a hash as a value in [-1, 1)."""
    return unit(h) * 2 - 1


def with_value_noise(df: DataFrame, name: str, seed: int | str, x: str, z: str, *, wave: float | Column = 1.0) -> DataFrame:
    """Adds ``name``: bilinear, smoothstep-eased noise of the signed lattice hash at (x / wave, z / wave)."""
    d = df.withColumns({"_x": F.floor(F.col(x) / wave), "_z": F.floor(F.col(z) / wave)}).withColumns({"_x1": F.col("_x") + 1, "_z1": F.col("_z") + 1})
    d = with_hash(d, _a=(seed, "_x", "_z"), _b=(seed, "_x1", "_z"), _c=(seed, "_x", "_z1"), _d=(seed, "_x1", "_z1"))
    fx, fz = F.col(x) / wave - F.col("_x"), F.col(z) / wave - F.col("_z")
    d = d.withColumns({"_fx": fx * fx * (3 - 2 * fx), "_fz": fz * fz * (3 - 2 * fz)})
    mix = lambda p, q: signed(p) + (signed(q) - signed(p)) * F.col("_fx")
    north, south = mix("_a", "_b"), mix("_c", "_d")
    return d.withColumn(name, north + (south - north) * F.col("_fz")).drop("_x", "_z", "_x1", "_z1", "_a", "_b", "_c", "_d", "_fx", "_fz")


def tile_seed(base: Column, ty: Column, tx: Column) -> Column:
    """64-bit seed of a tile: (base * k + ty) * k + tx modulo 2^64."""
    k = 0x9E3779B9
    add = lambda a, b: _wrapping_sum(a, b)
    return add(wrapping_product(add(wrapping_product(base.cast("long"), k), ty.cast("long").bitwiseAND(0xFFFFFFFF)), k), tx.cast("long").bitwiseAND(0xFFFFFFFF))


def _wrapping_sum(a: Column, b: Column) -> Column:
    lo = a.bitwiseAND(0xFFFFFFFF) + b.bitwiseAND(0xFFFFFFFF)
    hi = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(lo, 32)
    return F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(0xFFFFFFFF))


def flat_jitter(r: Column, c: Column, steps: int = 24) -> Column:
    """Per-cell jitter of flats: 32-bit wrapping mix, remainder of an unsigned 24-bit value."""
    low = 0xFFFFFFFF
    h = (r.cast("long") * 0x27D4EB2D + c.cast("long") * 0x165667B1).bitwiseAND(low)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 15))
    h = ((F.shiftrightunsigned(h, 16) * 0x2545F491).bitwiseAND(65535) * 65536 + h.bitwiseAND(65535) * 0x2545F491).bitwiseAND(low)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    return (F.shiftrightunsigned(h, 8) % steps).cast("int")


# ------------------------------------------------------------------------ numpy twins, for Arrow functions and tests


def np_hash(seed: np.ndarray | int, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.asarray(seed, np.int64).astype(np.uint64) ^ (np.asarray(x, np.int64).astype(np.uint64) * np.uint64(LATTICE_X)) ^ (np.asarray(z, np.int64).astype(np.uint64) * np.uint64(LATTICE_Z))
        for shift, k in ((30, MIX_A), (27, MIX_B)):
            v = (v ^ (v >> np.uint64(shift))) * np.uint64(k)
        return v ^ (v >> np.uint64(31))


def np_signed(seed: np.ndarray | int, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (np_hash(seed, x, z) >> np.uint64(40)).astype(float) / 16777216.0 * 2 - 1


def np_value_noise(seed: np.ndarray | int, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    x0, z0 = np.floor(x), np.floor(z)
    fx, fz = x - x0, z - z0
    fx, fz = fx * fx * (3 - 2 * fx), fz * fz * (3 - 2 * fz)
    a, b, c, d = (np_signed(seed, x0 + i, z0 + j) for j in (0, 1) for i in (0, 1))
    north, south = a + (b - a) * fx, c + (d - c) * fx
    return north + (south - north) * fz


# ---------------------------------------------------------------------------------------------- SQL text, 128-bit


def sql_mul(v: str, k: int) -> str:
    """v * k modulo 2^64 for an unsigned 128-bit v below 2^64 (other engines' SQL)."""
    return f"((({v} & 4294967295::HUGEINT) * {k}::HUGEINT + ((({v} >> 32) * {k}::HUGEINT) % 4294967296::HUGEINT) * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT)"


def sql_unsigned(v: str) -> str:
    return f"(CASE WHEN ({v}) < 0 THEN ({v})::HUGEINT + 18446744073709551616::HUGEINT ELSE ({v})::HUGEINT END)"


def sql_hash_ctes(source: str, prefix: str, spec: Mapping[str, tuple[str, str, str]]) -> tuple[str, str]:
    """(CTEs, name of the last one): ``source`` with one unsigned hash column per name, round by round."""
    stages = [(source, ", ".join(f"xor(xor({sql_unsigned(s)}, {sql_mul(sql_unsigned(x), LATTICE_X)}), {sql_mul(sql_unsigned(z), LATTICE_Z)}) AS {n}" for n, (s, x, z) in spec.items()), "*")]
    rounds = [lambda v, s=30: f"xor({v}, {v} >> {s})", lambda v: sql_mul(v, MIX_A), lambda v: f"xor({v}, {v} >> 27)", lambda v: sql_mul(v, MIX_B), lambda v: f"xor({v}, {v} >> 31)"]
    ctes, last = [], source
    first = f"{prefix}0 AS (SELECT *, {stages[0][1]} FROM {source})"
    ctes.append(first)
    last = f"{prefix}0"
    for i, f in enumerate(rounds, 1):
        ctes.append(f"{prefix}{i} AS (SELECT * REPLACE ({', '.join(f'{f(n)} AS {n}' for n in spec)}) FROM {last})")
        last = f"{prefix}{i}"
    return ", ".join(ctes), last


def sql_unit(h: str) -> str:
    return f"(({h} >> 40)::DOUBLE / 16777216)"
