"""Gradient noise fields in SQL: one row per place and octave, summed by field."""

from __future__ import annotations

from gridloom.functions import noise
from gridloom.functions.noise import Field

_M = "4294967296::HUGEINT"


def _octaves(fields: dict[str, Field]) -> str:
    rows = []
    for n, f in fields.items():
        amp, freq = 1 / sum(abs(f.gain) ** k for k in range(f.octaves)), f.frequency
        for k in range(f.octaves):
            rows.append(f"('{n}', '{f.kind}', {(f.seed + k) & 0xFFFFFFFF}::BIGINT, {freq!r}::DOUBLE, {amp!r}::DOUBLE)")
            amp, freq = amp * f.gain, freq * f.lacunarity
    return ", ".join(rows)


def fields_sql(source: str, prefix: str, fields: dict[str, Field], x: str, y: str, key: str = "cell") -> str:
    """CTEs from ``source`` to ``<prefix>`` (key and a column per field) at the places (x, y)."""
    p = prefix
    low = lambda v: f"((({v}) % {_M} + {_M}) % {_M})"

    def corner(name: str, i: int, j: int) -> str:
        h = f"((xor(xor(seed::HUGEINT, {'xa' if i == 0 else 'xb'}), {'ya' if j == 0 else 'yb'}) * {noise.HASH}) % {_M})"
        return f"{h} AS h{name}"

    def grad(name: str, i: int, j: int) -> str:
        k = f"((xor(h{name}, h{name} >> 15) & 254) >> 1)::INT"
        angle = f"radians(CASE WHEN {k} < 120 THEN 7.5::DOUBLE + 15 * ({k} % 24) ELSE 22.5::DOUBLE + 45 * ({k} - 120) END)"
        return f"(dx - {i}) * sin({angle}) + (dy - {j}) * cos({angle}) AS g{name}"

    corners = (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 1, 1))
    n = "(ga + u * (gb - ga) + v * (gc + u * (gd - gc) - ga - u * (gb - ga))) * " + repr(noise.SCALE)
    pivot = ", ".join(f"sum(CASE WHEN fld = '{f}' THEN w END) AS {f}" for f in fields)
    return f"""{p}o(fld, kind, seed, freq, amp) AS (VALUES {_octaves(fields)}),
 {p}1 AS (SELECT s.{key}, fld, kind, seed, amp, ({x})::DOUBLE * freq AS px, ({y})::DOUBLE * freq AS py FROM {source} s CROSS JOIN {p}o),
 {p}2 AS (SELECT *, floor(px) AS x0, floor(py) AS y0, px - floor(px) AS dx, py - floor(py) AS dy FROM {p}1),
 {p}3 AS (SELECT *, dx * dx * dx * (dx * (dx * 6 - 15) + 10) AS u, dy * dy * dy * (dy * (dy * 6 - 15) + 10) AS v, {low(f'x0::HUGEINT * {noise.PRIME_X}')} AS xa, {low(f'(x0::HUGEINT + 1) * {noise.PRIME_X}')} AS xb, {low(f'y0::HUGEINT * {noise.PRIME_Y}')} AS ya, {low(f'(y0::HUGEINT + 1) * {noise.PRIME_Y}')} AS yb FROM {p}2),
 {p}4 AS (SELECT *, {', '.join(corner(*c) for c in corners)} FROM {p}3), {p}5 AS (SELECT *, {', '.join(grad(*c) for c in corners)} FROM {p}4),
 {p}6 AS (SELECT {key}, fld, amp * CASE kind WHEN 'ridged' THEN 1 - 2 * abs({n}) ELSE {n} END AS w FROM {p}5),
 {p} AS MATERIALIZED (SELECT {key}, {pivot} FROM {p}6 GROUP BY {key})"""
