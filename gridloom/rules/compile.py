"""One condition tree, two back ends: Spark columns for running, SQL text for checking elsewhere.

Rules become one array expression per zone that yields the matching rules of a cell without a join or a shuffle.
Where a zone has more rules than ARRAY_RULES, each row tests only those of its one-degree temperature bucket; the
matches are the same. Selection among the matches is one array expression too: the noise of every class is needed at
the corners of a lattice far coarser than the grid, so the corners' hashes are worked out once per lattice cell.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hashing, scalar
from gridloom.rules.catalog import FLAGS, NOISE, NUMERIC, Catalog, Condition, Rule
from gridloom.runtime import checked_broadcast, cut

ARRAY_RULES = 100
WAVE = 900.0
MATCH_DDL = "array<struct<ord:int,class_index:int,weight:double,override:boolean>>"


def predicate(c: Condition, columns: set[str], *, noise: bool = False) -> Column:
    """A condition as a column; never null. NaN and absent numbers fail, a missing threshold reads as 0, an unknown
    flag reads as false, no operator and unknown variables fail. In the noise part the flag is not looked at."""
    if c.flag is not None and not noise:
        held = F.coalesce(F.col(c.variable), F.lit(False)) if c.variable in FLAGS and c.variable in columns else F.lit(False)
        return held == F.lit(c.flag)
    if c.variable not in (*NUMERIC, *NOISE) or c.variable not in columns or c.op is None:
        return F.lit(False)
    x, v, v2 = F.col(c.variable), float(c.value or 0.0), float(c.value2 or 0.0)
    test = {"eq": x == v, "gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v, "between": (x >= v) & (x <= v2)}[c.op]
    return F.coalesce(~F.isnan(x) & test, F.lit(False))


def rule_predicate(r: Rule, columns: set[str]) -> Column:
    """All climate, then all noise conditions; no conditions match everything."""
    parts = [predicate(c, columns) for c in r.conditions] + [predicate(c, columns, noise=True) for c in r.noise]
    return reduce(and_, parts) if parts else F.lit(True)


def predicate_sql(c: Condition, columns: set[str], *, noise: bool = False) -> str:
    if c.flag is not None and not noise:
        held = f'coalesce("{c.variable}", FALSE)' if c.variable in FLAGS and c.variable in columns else "FALSE"
        return f"({held} = {str(c.flag).upper()})"
    if c.variable not in (*NUMERIC, *NOISE) or c.variable not in columns or c.op is None:
        return "FALSE"
    x, v, v2 = f'"{c.variable}"', float(c.value or 0.0), float(c.value2 or 0.0)
    test = {"eq": f"{x} = {v}", "gt": f"{x} > {v}", "gte": f"{x} >= {v}", "lt": f"{x} < {v}", "lte": f"{x} <= {v}", "between": f"{x} >= {v} AND {x} <= {v2}"}[c.op]
    return f"coalesce(NOT isnan({x}) AND {test}, FALSE)"


def rule_sql(r: Rule, columns: set[str]) -> str:
    parts = [predicate_sql(c, columns) for c in r.conditions] + [predicate_sql(c, columns, noise=True) for c in r.noise]
    return " AND ".join(parts) or "TRUE"


def matches(catalog: Catalog, zone: str, columns: set[str]) -> Column:
    """Array of the zone's matching rules, in catalog order."""
    items = [F.when(rule_predicate(r, columns), F.struct(F.lit(n).alias("ord"), F.lit(c.index).alias("class_index"), F.lit(float(r.weight)).alias("weight"), F.lit(r.override).alias("override"))) for n, c, r in catalog.rules(zone)]
    if not items:
        return F.array().cast(MATCH_DDL)
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(MATCH_DDL)


def zone_matches(df: DataFrame, catalog: Catalog, zone: str = "zone", name: str = "matches") -> DataFrame:
    """Adds the matching rules of each row's own zone; rows of an unknown zone match nothing."""
    cols = set(df.columns)
    zones = sorted({r.zone for _, _, r in catalog.rules()})
    if any(len(catalog.rules(z)) > ARRAY_RULES for z in zones):
        return bucket_matches(df, catalog, zone, name)
    out = F.array().cast(MATCH_DDL)
    for z in zones:
        out = F.when(F.col(zone) == z, matches(catalog, z, cols)).otherwise(out)
    return df.withColumn(name, out)


BUCKETS = range(-60, 60)


def temperature_span(r: Rule) -> tuple[float, float]:
    """The temperatures a rule can match at."""
    lo, hi = -math.inf, math.inf
    for c in r.conditions:
        if c.variable == "temperatureC" and c.flag is None and c.op:
            v, v2 = float(c.value or 0.0), float(c.value2 or 0.0)
            lo = max(lo, v) if c.op in ("gt", "gte", "eq", "between") else lo
            hi = min(hi, v2 if c.op == "between" else v) if c.op in ("lt", "lte", "eq", "between") else hi
    return lo, hi


def bucket_matches(df: DataFrame, catalog: Catalog, zone: str = "zone", name: str = "matches") -> DataFrame:
    """As ``zone_matches``, with each row testing only the rules of its zone and one-degree temperature bucket.

    The rules' own predicates are grouped by (zone, bucket) while the plan is built; a row without a temperature
    falls into the last bucket, whose rules' predicates then fail on it as they should.
    """
    cols = set(df.columns)
    t = F.coalesce(F.when(~F.isnan("temperatureC"), F.floor("temperatureC")), F.lit(BUCKETS[-1]))
    bucket = F.least(F.greatest(t, F.lit(BUCKETS[0])), F.lit(BUCKETS[-1])).cast("int")
    groups: dict[tuple, list] = {}
    for n, c, r in catalog.rules():
        lo, hi = temperature_span(r)
        span = tuple(b for b in BUCKETS if (b + 1 >= lo or b == BUCKETS[-1]) and (b <= hi or b == BUCKETS[0]))
        groups.setdefault((r.zone, span), []).append((n, c, r))
    out = F.array().cast(MATCH_DDL)
    for (z, span), rules in groups.items():
        if not span:
            continue
        items = F.array(*[F.when(rule_predicate(r, cols), F.struct(F.lit(n).alias("ord"), F.lit(c.index).alias("class_index"), F.lit(float(r.weight)).alias("weight"), F.lit(r.override).alias("override"))) for n, c, r in rules])
        here = (F.col(zone) == z) & F.col("_bucket").between(span[0], span[-1])
        out = F.concat(out, F.when(here, F.filter(items, lambda x: x.isNotNull()).cast(MATCH_DDL)).otherwise(F.array().cast(MATCH_DDL)))
    return df.withColumn("_bucket", bucket).withColumn(name, F.array_sort(out)).drop("_bucket")


def with_corners(df: DataFrame, classes: list[int], x: str, z: str, name: str = "_corners") -> DataFrame:
    """Adds the signed hashes of every class at the four corners of the row's lattice cell, by class, and the place in it.

    One row per lattice cell of WAVE x WAVE positions and few classes: broadcast if so many are few, else joined.
    """
    d = df.withColumns({"_x0": F.floor(F.col(x).cast("double") / WAVE), "_z0": F.floor(F.col(z).cast("double") / WAVE)})
    cells = d.select("_x0", "_z0").distinct().filter("_x0 is not null and _z0 is not null")
    each = cells.withColumn("_k", F.explode(F.array(*[F.lit(k).cast("long") for k in classes]))).withColumns({"_x1": F.col("_x0") + 1, "_z1": F.col("_z0") + 1})
    each = hashing.with_hash(each, _a=("_k", "_x0", "_z0"), _b=("_k", "_x1", "_z0"), _c=("_k", "_x0", "_z1"), _d=("_k", "_x1", "_z1"))
    corner = F.struct(*[hashing.signed(h).alias(h[1]) for h in ("_a", "_b", "_c", "_d")])
    table = each.groupBy("_x0", "_z0").agg(F.map_from_entries(F.collect_list(F.struct("_k", corner))).alias("_at"))
    d = d.join(checked_broadcast(cut(table)), ["_x0", "_z0"], "left")
    fx, fz = F.col(x).cast("double") / WAVE - F.col("_x0"), F.col(z).cast("double") / WAVE - F.col("_z0")
    eased = lambda t: t * t * (3 - 2 * t)
    return d.withColumn(name, F.struct(F.col("_at").alias("at"), eased(fx).alias("fx"), eased(fz).alias("fz"))).drop("_x0", "_z0", "_at")


def winner(cands: Column, corners: Column) -> Column:
    """The class that wins among a row's matches; null without a match.

    The greatest ln(u) / weight wins, u uniform from the class's own noise field, with
    overrides before all others and ties to the first rule.
    """
    cdf = F.array(*[F.lit(v) for v in scalar.NOISE_CDF])

    def key(m: Column) -> Column:
        # bound one by one through single-element arrays, so that no term is worked out twice
        one = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
        bilinear = lambda q: one(q["a"] + (q["b"] - q["a"]) * corners["fx"], lambda north: north + (q["c"] + (q["d"] - q["c"]) * corners["fx"] - north) * corners["fz"])
        noise = one(corners["at"][m["class_index"].cast("long")], bilinear)
        low = lambda t: F.least(F.floor(t), F.lit(31)).cast("int")
        u = one((noise + 1) * 16, lambda t: F.element_at(cdf, low(t) + 1) + (F.element_at(cdf, low(t) + 2) - F.element_at(cdf, low(t) + 1)) * (t - low(t)))
        return F.when(m["weight"] > 0, F.ln(F.least(F.greatest(u, F.lit(1e-6)), F.lit(1 - 1e-6))) / m["weight"]).otherwise(F.lit(float("-inf")))

    ranked = F.transform(cands, lambda m: F.struct(m["override"].alias("o"), key(m).alias("k"), (-m["ord"]).alias("n"), m["class_index"].alias("c")))
    return F.array_max(ranked)["c"].cast("long")  # the matches are named once, as their own expression may be put in here


def select(df: DataFrame, x: str, z: str, default: int | str, classes: list[int], *, cands: str = "matches", name: str = "class_index", corners: str | None = None) -> DataFrame:
    """Adds the selected class of each row; rows without a match get the default (a number or a column).

    classes: all classes that can match. corners: the column of ``with_corners``, if it is there already.
    """
    rest = F.lit(default) if isinstance(default, int) else F.col(default)
    d = df if corners else with_corners(df, classes, x, z)
    d = d.withColumn(name, F.coalesce(winner(F.col(cands), F.col(corners or "_corners")), rest.cast("long")))
    return d if corners else d.drop("_corners")


def classify(df: DataFrame, catalog: Catalog, x: str = "c", z: str = "r") -> DataFrame:
    """Adds ``class_index``: the zone's winner, and on bare slopes outside ocean and mountain the winner of the
    bare-slope rules, if any matches."""
    classes = catalog.indices()
    d = with_corners(zone_matches(df, catalog), classes, x, z)
    d = select(d, x, z, catalog.default_index, classes, name="first_index", corners="_corners")
    steep = F.col("bareSlope") & ~F.col("ocean") & ~F.col("mountain")
    d = d.withColumn("bare", F.when(steep, matches(catalog, "bareSlope", set(df.columns))).otherwise(F.array().cast(MATCH_DDL)))
    return select(d, x, z, "first_index", classes, cands="bare", corners="_corners").drop("_corners")


# ---------------------------------------------------------------------------------------- SQL text of the same


def rules_union_sql(catalog: Catalog, source: str, columns: set[str], zone: str | None = None) -> str:
    """One row per (cell, matching rule)."""
    parts = []
    for n, c, r in catalog.rules(zone):
        parts.append(f"SELECT cell, c, r, {n} AS ord, {c.index} AS class_index, {float(r.weight)}::DOUBLE AS weight, {str(r.override).upper()} AS ovr FROM {source} WHERE {'TRUE' if zone else f'zone = {chr(39)}{r.zone}{chr(39)}'} AND {rule_sql(r, columns)}")
    return " UNION ALL ".join(parts)


def winners_sql(source: str, prefix: str) -> str:
    """CTEs from matches (cell, c, r, ord, class_index, weight, ovr) to ``<prefix>win`` (cell, class_index)."""
    base = f"{prefix}b AS (SELECT *, floor(c / {WAVE})::BIGINT AS x0, floor(r / {WAVE})::BIGINT AS z0 FROM {source})"
    h, last = hashing.sql_hash_ctes(f"{prefix}b", f"{prefix}h", {"ha": ("class_index", "x0", "z0"), "hb": ("class_index", "x0 + 1", "z0"), "hc": ("class_index", "x0", "z0 + 1"), "hd": ("class_index", "x0 + 1", "z0 + 1")})
    s = lambda v: f"({hashing.sql_unit(v)} * 2 - 1)"
    cdf = "[" + ", ".join(f"{v}::DOUBLE" for v in scalar.NOISE_CDF) + "]"
    return f"""{base}, {h}, {prefix}f AS (SELECT *, c / {WAVE} - x0 AS px, r / {WAVE} - z0 AS pz FROM {last}), {prefix}g AS (SELECT *, px * px * (3 - 2 * px) AS fx, pz * pz * (3 - 2 * pz) AS fz FROM {prefix}f),
 {prefix}n AS (SELECT *, {s('ha')} + ({s('hb')} - {s('ha')}) * fx + ({s('hc')} + ({s('hd')} - {s('hc')}) * fx - {s('ha')} - ({s('hb')} - {s('ha')}) * fx) * fz AS noise FROM {prefix}g),
 {prefix}u AS (SELECT *, (noise + 1) * 16 AS sc, least(floor((noise + 1) * 16), 31)::INT AS lo FROM {prefix}n),
 {prefix}k AS (SELECT *, ln(least(greatest({cdf}[lo + 1] + ({cdf}[lo + 2] - {cdf}[lo + 1]) * (sc - lo), 1e-6), 1 - 1e-6)) / weight AS key FROM {prefix}u),
 {prefix}win AS (SELECT cell, class_index FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ovr DESC, key DESC, ord) AS rn FROM {prefix}k) WHERE rn = 1)"""
