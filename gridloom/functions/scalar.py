"""Scalar laws of terrain, climate and water as column expressions.

Each law is one SQL expression over named arguments, so it compiles into the surrounding whole-stage code and
reads the same wherever SQL is spoken. ``col`` gives the Spark column, ``text`` the expression as text. Arguments
are doubles; a null argument gives null unless the law says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = "({0}) * ({0}) * (3 - 2 * ({0}))"


def _clamp01(x: str) -> str:
    return f"least(greatest({x}, 0.0e0), 1.0e0)"


def _trunc(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN ceil({x}) ELSE floor({x}) END)"


def _range(lo: str, hi: str, x: str) -> str:
    t = f"(({x}) - {lo}) / ({hi} - {lo})"
    return f"(CASE WHEN ({x}) <= {lo} THEN 0.0e0 WHEN ({x}) >= {hi} THEN 1.0e0 ELSE {_STEP.format(t)} END)"


def _sat(x: str, lo: int, hi: int) -> str:
    return f"least(greatest(floor({x}), {lo}), {hi})"


_LOAD = _range("0.16e0", "3.24e0", "{flow}")
_RADIUS = f"(0.26e0 + 0.34e0 * power(greatest(1.0e0, {{flow}} / 0.16e0), 0.34e0) + 0.90e0 * power(greatest(0.0e0, {{flow}}), 0.28e0)) * (1 - 0.48e0 * {_range('650.0e0', '2600.0e0', '{elev}')} * (1 - {_LOAD}))"
_PET = "greatest(250.0e0, 250.0e0 + 25.0e0 * greatest(0.0e0, {temp} + 0.005e0 * {tseason}) + 0.7e0 * greatest(0.0e0, {temp} + 0.005e0 * {tseason}) * greatest(0.0e0, {temp} + 0.005e0 * {tseason}))"
_AMP = "({tseason} * 0.01414e0)"
_GROW = f"(CASE WHEN {_AMP} < 0.1e0 THEN (CASE WHEN {{temp}} > 5 THEN 365.0e0 ELSE 0.0e0 END) WHEN (5 - {{temp}}) <= -{_AMP} THEN 365.0e0 WHEN (5 - {{temp}}) >= {_AMP} THEN 0.0e0 ELSE 365.0e0 * (0.5e0 - asin(greatest(-1.0e0, least(1.0e0, (5 - {{temp}}) / {_AMP}))) / pi()) END)"
_COVER = "CASE WHEN {x} >= 1.3e0 THEN 4 WHEN {x} >= 0.8e0 THEN 3 WHEN {x} >= 0.5e0 THEN 2 WHEN {x} >= 0.2e0 THEN 1 ELSE 0 END"

#: name: (arguments, expression). Constants are fixed values.
LAWS: dict[str, tuple[tuple[str, ...], str]] = {
    "signed_square": (("v",), "sign({v}) * {v} * {v}"),
    "signed_sqrt": (("v",), "sign({v}) * sqrt(abs({v}))"),
    "normalise": (("v", "w"), "CASE WHEN {w} > 0.000001e0 THEN {v} / {w} ELSE 0.0e0 END"),
    "denormalise": (("v", "mean", "std"), "{v} * {std} + {mean}"),
    "standardise": (("v", "mean", "std"), "CASE WHEN {std} <> 0 THEN ({v} - {mean}) / {std} END"),
    "clamp": (("v", "lo", "hi"), "CASE WHEN NOT isnan({v}) THEN least(greatest({v}, {lo}), {hi}) END"),
    "clamp01": (("v",), _clamp01("{v}")),
    "smoothstep": (("t",), _STEP.format("{t}")),
    "smooth_range": (("lo", "hi", "v"), _range("{lo}", "{hi}", "{v}")),
    "lerp": (("a", "b", "t"), "{a} + ({b} - {a}) * {t}"),
    "hermite": (("p0", "m0", "p1", "m1", "t"), "(2 * {t} * {t} * {t} - 3 * {t} * {t} + 1) * {p0} + ({t} * {t} * {t} - 2 * {t} * {t} + {t}) * {m0} + (3 * {t} * {t} - 2 * {t} * {t} * {t}) * {p1} + ({t} * {t} * {t} - {t} * {t}) * {m1}"),
    "evapotranspiration": (("temp", "tseason"), _PET),
    "aridity": (("precip", "pet"), "{precip} / greatest(1.0e0, {pet})"),
    "tree_moisture": (("aridity", "pcv"), f"{{aridity}} * (1 - 0.35e0 * {_clamp01('{pcv} / 100')})"),
    "growing_season": (("temp", "tseason"), _GROW),
    "bare_threshold": (("tree_moisture",), f"0.7e0 + 0.49e0 * {_clamp01('({tree_moisture} - 0.35e0) / 0.45e0')}"),
    "tree_bucket": (("tree_moisture", "growing"), _COVER.replace("{x}", f"({{tree_moisture}} * {_clamp01('({growing} - 60) / 90')})")),
    "tree_coverage": (
        ("bucket", "slope", "bare", "tree_moisture", "variant"),
        "CASE WHEN {slope} >= {bare} AND NOT ({slope} < {bare} + 0.35e0 AND {tree_moisture} > 0.15e0 AND {variant} > 0.3e0) THEN 0.0e0 "
        "WHEN {slope} >= {bare} THEN (CASE {bucket} WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.62e0 WHEN 3 THEN 0.85e0 ELSE 1.0e0 END) "
        "WHEN {slope} >= 0.62e0 THEN (CASE {bucket} WHEN 0 THEN 0.0e0 ELSE 0.35e0 END) "
        "ELSE (CASE {bucket} WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.62e0 WHEN 3 THEN 0.85e0 ELSE 1.0e0 END) END",
    ),
    "bare_slope": (("slope", "bare", "tree_moisture", "variant"), "{slope} >= {bare} AND NOT ({slope} < {bare} + 0.35e0 AND {tree_moisture} > 0.15e0 AND {variant} > 0.3e0)"),
    "snowy": (("elev", "snow_temp", "precip", "slope"), "({snow_temp} < -2 OR ({elev} > 800 AND {snow_temp} < -0.5e0)) AND {precip} > 150 AND NOT ({slope} > 0.78e0 AND {elev} <= 1500)"),
    "zone": (("elev", "coast"), "CASE WHEN {elev} < 0 THEN 'ocean' WHEN {coast} AND {elev} <= 2500 THEN 'beach' WHEN {elev} > 2500 THEN 'mountain' ELSE 'lowland' END"),
    "jitter_temp": (("temp", "n1", "n2"), "{temp} + 0.4e0 * {n1} + 0.2e0 * {n2}"),
    "jitter_precip": (("precip", "n"), "greatest(0.0e0, {precip}) * (1 + 0.2e0 * {n})"),
    "snow_noise": (("n1", "n2"), "3 * {n1} + 2 * {n2}"),
    "river_density": (("region",), f"0.12e0 + 0.88e0 * {_STEP.format(_clamp01('({region} + 1) * 0.5e0'))}"),
    "precip_density": (("precip",), f"CASE WHEN {{precip}} <= 0 THEN 0.12e0 WHEN {{precip}} < 700 THEN 0.12e0 + 0.28e0 * {_STEP.format('({precip} / 700.0e0)')} WHEN {{precip}} < 1200 THEN 0.4e0 + 0.6e0 * {_STEP.format('(({precip} - 700) / 500.0e0)')} ELSE 1.0e0 END"),
    "runoff": (("elev", "temp", "precip", "pcv"), f"greatest(0.035e0, greatest({{precip}}, 0.0e0) / 1000 * (0.18e0 + 0.28e0 * {_clamp01('(greatest({precip}, 0.0e0) - 350) / 1650')} + 0.10e0 * {_clamp01('greatest({elev}, 0.0e0) / 3000')} + CASE WHEN {{temp}} < 2 THEN 0.08e0 ELSE 0.0e0 END) * (1 + 0.18e0 * {_clamp01('greatest({pcv}, 0.0e0) / 120')}))"),
    "runoff_plain": (("elev",), f"0.35e0 + 0.45e0 * {_clamp01('greatest({elev}, 0.0e0) / 2500')}"),
    "channel_load": (("flow",), _LOAD),
    "channel_radius": (("flow", "elev"), f"least(16.0e0, greatest(0.26e0 + 0.38e0 * sqrt({_LOAD}), {_RADIUS}) * (1.75e0 + 0.50e0 * sqrt({_LOAD})))"),
    "water_mask": (("profile", "load", "lake"), f"CASE WHEN greatest({_clamp01('{profile}')} * (0.55e0 + 0.45e0 * {_clamp01('{load}')}), {_clamp01('{lake} / 24')}) <= 0 THEN 0 ELSE greatest(1, least(255, floor(greatest({_clamp01('{profile}')} * (0.55e0 + 0.45e0 * {_clamp01('{load}')}), {_clamp01('{lake} / 24')}) * 255 + 0.5e0))) END"),
    "quantise_elevation": (("e",), _sat("{e}", -32768, 32767)),
    "quantise_surface": (("e",), f"CASE WHEN NOT isnan({{e}}) THEN {_sat('{e}', -32767, 32767)} END"),
    "quantise_centi": (("t",), _sat("{t} * 100 + 0.5e0", -32768, 32767)),
    "block_height": (("m", "res"), f"CASE WHEN {{m}} >= 0 THEN {_trunc('{m} / {res}')} + 63 ELSE {_trunc('sqrt(10.0e0) - sqrt(abs({m}) + 10)')} + 62 END"),
    "scaled_altitude": (("y", "s"), "63 + floor(({y} - 63) / {s})"),
    "world_altitude": (("y", "s"), "CASE WHEN {y} > 63 THEN 63 + ({y} - 63) * {s} ELSE {y} END"),
    "surface_density": (("h", "y"), "greatest(-1.0e0, least(1.0e0, ({h} - {y} - 0.5e0) / 16))"),
    "blocks_to_metres": (("b", "res"), "{b} * {res}"),
    "log_display": (("v",), "ln(1 + greatest({v}, 0.0e0))"),
    "lut_index": (("t",), f"floor({_clamp01('{t}')} * 255 + 0.5e0)"),
    "blend": (("c", "a", "k"), "{c} * (1 - {a}) + {k} * {a}"),
    "round3": (("v",), "floor({v} * 1000 + 0.5e0) / 1000"),
    "java_round": (("v",), "floor({v} + 0.5e0)"),
    "floor_div": (("a", "n"), "floor({a} / {n})"),
    "floor_mod": (("a", "n"), "{a} - floor({a} / {n}) * {n}"),
    "ceil_div": (("a", "n"), "-floor(-({a}) / {n})"),
    "lapse_cap": (("region",), f"0.024e0 * {_STEP.format(_clamp01('(abs({region}) - 0.05e0) / 0.68e0'))}"),
    "range_compensation": (("p", "scaled", "authored"), "CASE WHEN {authored} <> 0 THEN least(1.0e0, {p} * {scaled} / {authored}) END"),
    "selection_key": (("u", "weight"), "CASE WHEN {weight} <> 0 THEN ln({u}) / {weight} END"),
    "overlay_alpha": (("mask",), "0.28e0 + 0.42e0 * {mask} / 255"),
    "int_roll": (("u", "lo", "hi"), f"CASE WHEN {{hi}} <= {{lo}} THEN {{lo}} ELSE {{lo}} + least({_trunc('{u} * ({hi} - {lo} + 1)')}, {{hi}} - {{lo}}) END"),
    "window_weight": (("x", "size"), "1 - 0.999999e0 * abs({x} - ({size} - 1) / 2.0e0) / (({size} - 1) / 2.0e0)"),
}


def text(law: str, **args: str | float) -> str:
    """The law as SQL text over the given expressions."""
    names, body = LAWS[law]
    if set(names) != set(args):
        raise TypeError(f"{law} takes {', '.join(names)}")
    out = body
    for n in names:
        v = args[n]
        out = out.replace("{" + n + "}", f"({_double(v)})" if isinstance(v, float) else f"({v})" if not str(v).replace("_", "").isalnum() else str(v))
    return f"({out})"


def _double(v: float) -> str:
    """A number as a double literal with all its digits."""
    r = repr(float(v))
    return r if "e" in r else f"{r}e0"


def col(law: str, **args: str | float) -> Column:
    """The law as a Spark column over the given expressions."""
    return F.expr(text(law, **args))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines round doubles: scaled, then half away from zero. ``F.round`` takes the shortest
    decimal text instead, so the two part where scaling lands on a half. Values too large for a fraction stay."""
    scaled = x * float(10**digits)
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    up = F.when(size - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(size < 2.0**52, F.signum(scaled) * (whole + up) / float(10**digits)).otherwise(x)


def interp(x: str, points: list[tuple[float, float]]) -> str:
    """Piecewise linear interpolation through fixed points, constant outside them; a value on a knot takes its own."""
    p = sorted(points)
    parts = [f"WHEN {x} <= {_double(p[0][0])} THEN {_double(p[0][1])}"]
    for (a, fa), (b, fb) in zip(p, p[1:]):
        if b > a:
            parts.append(f"WHEN {x} <= {_double(b)} THEN {_double(fa)} + ({x} - {_double(a)}) * {_double((fb - fa) / (b - a))}")
    return f"(CASE {' '.join(parts)} ELSE {_double(p[-1][1])} END)"


#: Cumulative distribution of the competition noise over [-1, 1] at 33 even steps (fixed values).
NOISE_CDF = [
    0.000000, 0.002161, 0.008784, 0.019927, 0.035609, 0.055724, 0.080132, 0.108747, 0.141309, 0.177474, 0.216943,
    0.259346, 0.304313, 0.351328, 0.399982, 0.449803, 0.500061, 0.550323, 0.600022, 0.648588, 0.695640, 0.740613,
    0.783037, 0.822494, 0.858638, 0.891144, 0.919765, 0.944205, 0.964329, 0.980018, 0.991182, 0.997837, 1.000000,
]


def uniform_noise(noise: str) -> str:
    """A noise value in about [-1, 1] as a uniform value in the open unit interval."""
    steps = [(k / 16 - 1, v) for k, v in enumerate(NOISE_CDF)]
    return f"least(greatest({interp(noise, steps)}, 0.000001e0), 0.999999e0)"
