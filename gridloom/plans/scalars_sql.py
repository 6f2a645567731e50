"""SQL twins of the scalar laws, each written out from its definition and apart from the expressions that Spark runs."""

from __future__ import annotations

from gridloom.functions.scalar import NOISE_CDF
from gridloom.plans import grid

_ONE = "least(greatest({0}, 0::DOUBLE), 1::DOUBLE)".format
_EASED = "list_transform([{0}], lambda q: q * q * (3 - 2 * q))[1]".format
_CDF = "[" + ", ".join(f"{v!r}::DOUBLE" for v in NOISE_CDF) + "]"
_U = "((variant + 1) / 2)"


def _range(lo: float, hi: float, x: str) -> str:
    return _EASED(_ONE(f"({x} - {lo!r}::DOUBLE) / ({hi!r}::DOUBLE - {lo!r}::DOUBLE)"))


_LOAD = lambda flow: _range(0.16, 3.24, flow)
_LAWS: dict[str, dict[str, str]] = {
    "b_encoding": {
        "b01": "CASE WHEN elev < 0 THEN -power(elev / 100, 2) ELSE power(elev / 100, 2) END", "b02": "CASE WHEN elev < 0 THEN -sqrt(-elev) ELSE sqrt(elev) END",
        "b03": "CASE WHEN region - 0.1 > 1e-6 THEN elev / (region - 0.1) ELSE 0 END", "b04": "3.5 + 2 * region", "b04i": "(elev - 100) / 25",
        "b05": "CASE WHEN elev < 0 THEN 0 WHEN elev > 800 THEN 800 ELSE elev END",
        "b25": f"list_transform([greatest({_ONE('variant')} * (0.55 + 0.45 * {_ONE('region')}), {_ONE('elev / 100 / 24')})], lambda m: CASE WHEN m <= 0 THEN 0 ELSE least(greatest(floor(m * 255 + 0.5), 1), 255) END)[1]",
        "b26": "least(greatest(floor(elev * 10), -32768), 32767)", "b27": "least(greatest(floor(elev), -32767), 32767)", "b28": "least(greatest(floor(temp * 100 + 0.5), -32768), 32767)",
        "b29": "CASE WHEN floor(elev) >= 0 THEN trunc(floor(elev) / 15) + 63 ELSE trunc(sqrt(10::DOUBLE) - sqrt(abs(floor(elev)) + 10)) + 62 END",
        "b30": "63 + floor((floor(elev) - 63) / 3)", "b30i": "CASE WHEN floor(elev) <= 63 THEN floor(elev) ELSE 63 + 3 * (floor(elev) - 63) END",
        "b31": "least(greatest((elev - (elev + variant * 20) - 0.5) / 16, -1), 1)", "b32": "15 * slope_like",
    },
    "b_curves": {
        "b06": _EASED(_U), "b07": _range(-0.5, 0.5, "variant"), "b08": "(1 - variant) * temp + variant * elev",
        "b09": "CASE WHEN elev <= -200 THEN 0 WHEN elev <= 0 THEN 5 * (elev + 200) / 200 WHEN elev <= 750 THEN 5 + elev / 750 WHEN elev <= 3000 THEN 6 + 34 * (elev - 750) / 2250 ELSE 40 END",
        "b10": f"list_transform([least(floor((variant + 1) * 16), 31)::INT], lambda i: least(greatest({_CDF}[i + 1] + ({_CDF}[i + 2] - {_CDF}[i + 1]) * ((variant + 1) * 16 - i), 1e-6), 1 - 1e-6))[1]",
        "b11": f"temp + {_U} * (region + {_U} * ((3 * (variant - temp) - 2 * region - slope_like) + {_U} * (2 * (temp - variant) + region + slope_like)))",
        "b38": f"0.024 * {_EASED(_ONE('(abs(region) - 0.05) / 0.68'))}", "b39": "least(variant * elev / 400, 1)",
    },
    "b_climate": {
        "b13_pet": "list_transform([greatest(temp + tseason / 200, 0)], lambda t: greatest(250 + 25 * t + 0.7 * t * t, 250))[1]",
        "b14": "list_transform([tseason / 100 * 1.414], lambda a: CASE WHEN a < 0.1 AND temp > 5 THEN 365 WHEN a < 0.1 THEN 0 WHEN 5 - temp <= -a THEN 365 WHEN 5 - temp >= a THEN 0 ELSE 365 * acos((5 - temp) / a) / pi() END)[1]",
        "b20t": "temp + (2 * variant + region) / 5", "b20p": "CASE WHEN precip > 0 THEN precip + precip * variant / 5 ELSE 0 END", "b20s": "3 * variant + 2 * region",
        "b18": "CASE WHEN elev < 0 THEN 'ocean' WHEN elev > 2500 THEN 'mountain' WHEN coast THEN 'beach' ELSE 'lowland' END",
    },
    "b_water": {
        "b21": f"0.12 + 0.88 * {_EASED(_ONE('(region + 1) / 2'))}",
        "b22": f"CASE WHEN precip <= 0 THEN 0.12 WHEN precip < 700 THEN 0.12 + 0.28 * {_EASED('precip / 700')} WHEN precip < 1200 THEN 0.4 + 0.6 * {_EASED('(precip - 700) / 500')} ELSE 1 END",
        "b23": f"greatest(greatest(precip, 0) / 1000 * (0.18 + 0.28 * {_ONE('(greatest(precip, 0) - 350) / 1650')} + {_ONE('elev / 3000')} / 10 + CASE WHEN temp < 2 THEN 0.08 ELSE 0 END) * (1 + 0.18 * {_ONE('pcv / 120')}), 0.035)",
        "b23_plain": f"0.35 + 0.45 * {_ONE('elev / 2500')}",
        "b24": f"list_transform([{_LOAD('precip / 100')}], lambda l: least(greatest(0.26 + 0.38 * sqrt(l), (0.26 + 0.34 * power(greatest(precip / 16, 1), 0.34) + 0.9 * power(greatest(precip / 100, 0), 0.28)) * (1 - 0.48 * {_range(650.0, 2600.0, 'elev')} * (1 - l))) * (1.75 + sqrt(l) / 2), 16))[1]",
        "b24_load": _LOAD("precip / 500"),
    },
    "b_display": {
        "b33": "ln(greatest(elev, 0) + 1)", "b34": f"floor({_ONE('variant')} * 255 + 0.5)", "b35": f"temp + (255 - temp) * {_U}", "b36": "floor(variant * 1000 + 0.5) / 1000", "b36j": "floor(temp + 0.5)",
        "b37_div": "((c - 50) - (((c - 50) % 7) + 7) % 7) / 7", "b37_mod": "(((c - 50) % 7) + 7) % 7", "b37_ceil": "ceil((c - 50) / 7)", "l16": "(71.4 + 0.42 * c) / 255", "c25": f"3 + least(floor({_U} * 7), 6)", "e25": "1 - 0.999999 * abs(c % 16 - 7.5) / 7.5",
    },
}
_TEXT = {"b18"}
SQL = {g: f"WITH {grid.CLIMATE_SQL}, z AS (SELECT *, pcv / 60 AS slope_like FROM climate) SELECT cell, " + ", ".join(f"{e} AS {n}" if n in _TEXT else f"round(({e})::DOUBLE, 6) AS {n}" for n, e in laws.items()) + " FROM z" for g, laws in _LAWS.items()}
