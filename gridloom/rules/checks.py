"""Static checks, inversion, repair and fitting of rule sets, as relational plans over the condition table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.stats import exact_percentiles
from gridloom.rules.catalog import DISCRETE, HARD_BOUNDS, Catalog, Condition, Rule
from gridloom.runtime import checked_broadcast, cut

EPS = 1e-6
RULE = ["class_index", "class_key", "rule", "zone"]
BIG = 1e300


def lows(c: DataFrame) -> DataFrame:
    """Adds ``lo`` and ``hi``: the closed interval a numeric condition allows; flags and missing operators get none."""
    v, v2 = F.coalesce("value", F.lit(0.0)), F.coalesce("value2", F.lit(0.0))
    lo = F.when(F.col("op").isin("eq", "gt", "gte", "between"), v).when(F.col("op").isin("lt", "lte"), -BIG)
    hi = F.when(F.col("op").isin("eq", "lt", "lte"), v).when(F.col("op") == "between", v2).when(F.col("op").isin("gt", "gte"), BIG)
    return c.withColumns({"lo": F.when(F.col("flag").isNull(), lo), "hi": F.when(F.col("flag").isNull(), hi)})


def intervals(c: DataFrame, part: str = "climate") -> DataFrame:
    """Per rule and variable: the intersection of its conditions' intervals, and how many there are."""
    d = lows(c).filter((F.col("part") == part) & F.col("lo").isNotNull())
    return d.groupBy(*RULE, "variable").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count("*").alias("conditions"), F.min("op").alias("op"), F.min(F.coalesce("value", F.lit(0.0))).alias("value"))


def admits(x: Column, op: Column, v: Column, v2: Column) -> Column:
    """Whether a discrete value satisfies a condition, within a small tolerance."""
    return (
        F.when(op == "eq", F.abs(x - v) <= EPS).when(op == "gt", x > v + EPS).when(op == "gte", x >= v - EPS)
        .when(op == "lt", x < v - EPS).when(op == "lte", x <= v + EPS).when(op == "between", (x >= v - EPS) & (x <= v2 + EPS)).otherwise(False)
    )


def _discrete(c: DataFrame) -> DataFrame:
    """Conditions on bucketed variables, one row per value the variable can take."""
    values = F.create_map(*[y for k, vs in DISCRETE.items() for y in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    d = c.filter(F.col("variable").isin(*DISCRETE) & (F.col("part") == "climate") & F.col("flag").isNull())
    return d.select("*", F.explode(F.element_at(values, F.col("variable"))).alias("x"))


def dead_discrete(c: DataFrame) -> DataFrame:
    """Rules whose conditions on a bucketed variable admit none of its values together: (rule, variable, conditions)."""
    d = _discrete(c).withColumn("ok", admits(F.col("x"), F.col("op"), F.coalesce("value", F.lit(0.0)), F.coalesce("value2", F.lit(0.0))))
    per = d.groupBy(*RULE, "variable", "x").agg(F.min("ok").alias("ok"), F.count("*").alias("conditions"))
    return per.groupBy(*RULE, "variable").agg(F.max("ok").alias("ok"), F.max("conditions").alias("conditions")).filter(~F.col("ok")).drop("ok")


def over_ceiling(c: DataFrame, families: DataFrame) -> DataFrame:
    """Noise conditions outside the measured range of their field; families: (variable, lo, hi)."""
    d = lows(c).filter((F.col("part") == "noise") & F.col("op").isNotNull()).join(families.select("variable", F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi")), "variable")
    tol = F.when(F.col("op") == "eq", EPS).otherwise(0.0)
    dead = (F.col("lo") > F.col("f_hi") + tol) | (F.col("hi") < F.col("f_lo") - tol)
    return d.filter(dead).select(*RULE, "variable", "no", "f_lo", "f_hi")


def against_bounds(c: DataFrame) -> DataFrame:
    """Rules that leave (dead) or merely repeat (redundant) a variable's hard bounds: (rule, variable, severity)."""
    lo = F.create_map(*[x for k, (a, _) in HARD_BOUNDS.items() for x in (F.lit(k), F.lit(-BIG if a is None else a))])
    hi = F.create_map(*[x for k, (_, b) in HARD_BOUNDS.items() for x in (F.lit(k), F.lit(BIG if b is None else b))])
    d = intervals(c).filter(F.col("variable").isin(*HARD_BOUNDS)).withColumns({"b_lo": F.element_at(lo, F.col("variable")), "b_hi": F.element_at(hi, F.col("variable"))})
    dead = F.greatest("lo", "b_lo") > F.least("hi", "b_hi") + EPS
    again = (F.col("conditions") == 1) & ((F.col("op").isin("gt", "gte") & (F.col("b_lo") > -BIG) & (F.col("value") <= F.col("b_lo"))) | (F.col("op").isin("lt", "lte") & (F.col("b_hi") < BIG) & (F.col("value") >= F.col("b_hi"))))
    return d.withColumn("severity", F.when(dead, "dead").when(again, "redundant")).filter("severity is not null").select(*RULE, "variable", "severity")


def aliased(c: DataFrame) -> DataFrame:
    """Rules that use both names of the one moisture variable."""
    d = c.filter((F.col("part") == "climate") & F.col("variable").isin("moisture", "treeMoisture"))
    return d.groupBy(*RULE).agg(F.countDistinct("variable").alias("n")).filter("n = 2").drop("n")


def envelopes(c: DataFrame, rules: DataFrame) -> DataFrame:
    """Per class, zone and variable: the union of its rules' intervals, skipping contradictory rules; open (null)
    where any rule leaves the variable free. Adds the class's weight range and rule count in the zone."""
    iv = intervals(c)
    bad = iv.filter("lo > hi").select("rule").distinct()
    live = rules.join(bad, "rule", "left_anti").filter("weight > 0")
    per = live.groupBy("class_index", "zone").agg(F.count("*").alias("rules"), F.min("weight").alias("weight_lo"), F.max("weight").alias("weight_hi"))
    got = iv.join(live.select("rule"), "rule").groupBy("class_index", "zone", "variable").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("bounding"))
    d = got.join(per, ["class_index", "zone"])
    open_ = F.col("bounding") < F.col("rules")
    return d.select("class_index", "zone", "variable", F.when(~open_ & (F.col("lo") > -BIG), F.col("lo")).alias("lo"), F.when(~open_ & (F.col("hi") < BIG), F.col("hi")).alias("hi"), "rules", "weight_lo", "weight_hi")


def moisture_families(env: DataFrame) -> DataFrame:
    """Precipitation and temperature hints from moisture bounds, inverting the monotone chain.

    Moisture is at most aridity and at least 0.65 of it, and aridity is precipitation over an evaporative demand of
    250 at least; so a lower moisture bound asks for that much precipitation at any temperature (reduced by the
    noise factor 1.2).
    """
    m = env.filter(F.col("variable").isin("moisture", "treeMoisture", "aridity") & F.col("lo").isNotNull() & (F.col("lo") > 0))
    return m.groupBy("class_index", "zone").agg((F.max("lo") * 250.0 / 1.2).alias("precipitation_least"), F.max(F.when(F.col("variable") != "aridity", F.col("lo"))).alias("aridity_least"))


def snap_discrete(c: DataFrame) -> DataFrame:
    """A window of 0.01 around the nearest possible value, for single dead conditions on a bucketed variable."""
    dead = dead_discrete(c).filter("conditions = 1").select("rule", "variable")
    d = _discrete(c).join(dead, ["rule", "variable"])
    mid = F.when(F.col("op") == "between", (F.col("value") + F.col("value2")) / 2).otherwise(F.coalesce("value", F.lit(0.0)))
    near = F.min_by(F.col("x"), F.struct(F.abs(F.col("x") - mid), F.col("x")))
    return d.groupBy(*RULE, "variable", "no").agg(near.alias("x")).select(*RULE, "variable", "no", (F.col("x") - 0.01).alias("value"), (F.col("x") + 0.01).alias("value2"))


def apply_patches(c: DataFrame, patches: DataFrame) -> DataFrame:
    """The condition table with new thresholds where a patch names the condition: (rule, part, no, value, value2)."""
    p = patches.select("rule", "part", "no", F.col("value").alias("_v"), F.col("value2").alias("_v2"), F.lit(True).alias("_p"))
    d = c.join(p, ["rule", "part", "no"], "left")
    return d.select(*[F.coalesce(f"_{'v' if x == 'value' else 'v2'}", x).alias(x) if x in ("value", "value2") else F.when(F.col("_p") & F.col("_v2").isNotNull(), F.lit("between")).otherwise(F.col("op")).alias("op") if x == "op" else F.col(x) for x in c.columns])


def widened(samples: DataFrame, variable: str, rest: Column, target: float, side: str) -> DataFrame:
    """The threshold at which ``rest`` and ``variable`` on one side of it hold for a share ``target`` of all rows.

    An order statistic of the variable among the rows that hold ``rest``; no bisection. side: 'above' or 'below'.
    Null if ``rest`` itself holds for less.
    """
    d = samples.agg(F.count("*").alias("n"), F.sum(rest.cast("int")).alias("k"))
    ranked = samples.filter(rest & ~F.isnan(variable)).select(F.col(variable).alias("v"))
    share = d.select(F.when(F.col("k") >= target * F.col("n"), target * F.col("n") / F.col("k")).alias("q"), "k", "n").first()
    if share is None or share.q is None:
        return samples.sparkSession.createDataFrame([(None, share.k, share.n)], "threshold double, held long, n long")
    q = 1 - share.q if side == "above" else share.q
    return exact_percentiles(ranked, [], ["v"], [q]).select(F.col("value").alias("threshold"), F.lit(share.k).cast("long").alias("held"), F.lit(share.n).cast("long").alias("n"))


def with_conditions(rule: Rule, changed: list[Condition]) -> Rule:
    """The rule with the changed conditions in place of those on the same variable and operator."""
    new = {(c.variable, c.op): c for c in changed}
    return replace(rule, conditions=tuple(new.get((c.variable, c.op), c) if c.flag is None else c for c in rule.conditions))


def widen_greedily(samples: DataFrame, rule: Rule, target: float, most: int = 2) -> tuple[list[Condition], float]:
    """(widened conditions, joint rate): the tightest one or two conditions of a rule moved until it holds for ``target``.

    Conditions are taken by their own pass rate, the rarest first, with the others as they are by then. A threshold moves
    to the order statistic of the variable among the rows that hold the others (an exact percentile, no search); a
    between widens on both sides alike in rank around its middle. Flags and equalities are left, as is a condition
    whose others hold nowhere. The rate may stay below the target.
    """
    from gridloom.rules.compile import predicate, rule_predicate

    columns = set(samples.columns)
    own = list(rule.conditions)
    held = samples.agg(F.count("*").alias("n"), *[F.count_if(predicate(c, columns)).alias(f"c{i}") for i, c in enumerate(own)]).first()
    joint = lambda: samples.agg(F.count_if(rule_predicate(replace(rule, conditions=tuple(own), noise=()), columns))).first()[0] / max(held.n, 1)
    changed: list[Condition] = []
    for i in sorted(range(len(own)), key=lambda i: (held[f"c{i}"], i)):
        c = own[i]
        if len(changed) >= most or joint() >= target:
            break
        if c.flag is not None or c.op in ("eq", None) or c.variable not in columns:
            continue
        rest = rule_predicate(replace(rule, conditions=tuple(x for k, x in enumerate(own) if k != i), noise=()), columns)
        values = samples.filter(rest & F.col(c.variable).isNotNull() & ~F.isnan(c.variable)).select(F.col(c.variable).cast("double").alias("v"))
        n = values.count()
        if not n:
            continue
        share = min(target * held.n / n, 1.0)
        if c.op == "between":
            at = values.agg(F.count_if(F.col("v") < (c.value + c.value2) / 2)).first()[0] / n
            lo = min(max(at - share / 2, 0.0), 1.0 - share)
            cuts = sorted({lo, lo + share})
        else:
            cuts = [1 - share] if c.op in ("gt", "gte") else [share]
        q = [r.value for r in exact_percentiles(values, [], ["v"], cuts).orderBy("cut").collect()]
        low, high = q[0], q[-1]
        new = {"between": lambda: replace(c, value=min(low, c.value), value2=max(high, c.value2)), "gt": lambda: replace(c, value=min(low, c.value) - EPS), "gte": lambda: replace(c, value=min(low, c.value)),
               "lt": lambda: replace(c, value=max(high, c.value) + EPS), "lte": lambda: replace(c, value=max(high, c.value))}[c.op]()
        own[i] = new
        changed.append(new)
    return changed, joint()


#: What a gated class's weight is multiplied with, and where it ends (fixed values).
BOOST, CAP = 1.5, 8.0


def assign_provinces(catalog: Catalog, province: dict[str, str], bands: dict[str, Condition], *, replace_gates: set[str] = frozenset(), weights: dict[str, float] | None = None) -> Catalog:
    """The catalog with classes bound to provinces of the region field: a rule without a noise gate gets its province's
    band, one with a gate keeps it unless the class is in ``replace_gates``. Classes that changed weigh more, or
    what ``weights`` says."""
    out = []
    for c in catalog.classes:
        band = bands.get(province.get(c.key, ""))
        rules = tuple(replace(r, noise=(band,)) if band and (not r.noise or c.key in replace_gates) else r for r in c.rules)
        if band and rules != c.rules:
            own = (weights or {}).get(c.key)
            rules = tuple(replace(r, weight=own if own is not None else round(min(r.weight * BOOST, CAP), 3)) for r in rules)
        out.append(replace(c, rules=rules))
    return replace(catalog, classes=tuple(out))


def caveats(c: DataFrame, opaque: list[str], most: int = 10) -> DataFrame:
    """(class, zone, caveats, truncated): what a class's envelope in a zone cannot show, each once, in the order met and at
    most ``most``: conditions on opaque variables and all noise gates."""
    text = F.when(F.col("flag").isNotNull(), F.concat("variable", F.lit(" == "), F.col("flag").cast("string"))).otherwise(F.concat_ws(" ", "variable", "op", F.col("value").cast("string"), F.col("value2").cast("string")))
    d = c.filter((F.col("part") == "noise") | F.col("variable").isin(opaque)).withColumn("t", text)
    first = d.groupBy("class_index", "zone", "t").agg(F.min(F.struct("rule", F.col("part") == "noise", "no")).alias("at"))
    # one entry per distinct condition of a class, which a catalog bounds
    g = first.groupBy("class_index", "zone").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]).alias("all"))
    return g.select("class_index", "zone", F.slice("all", 1, most).alias("caveats"), (F.size("all") > most).alias("truncated"))


def violations(samples: DataFrame, matches: str, env: DataFrame, channels: list[str], *, zone: str = "zone") -> DataFrame:
    """(class, zone, eligible, outside, and out_<channel>): of the rows where a class can win in its zone, how many lie
    outside the envelope that was derived for it, by channel and at all. env: from ``envelopes``."""
    wide = env.groupBy("class_index", "zone").agg(*[F.max(F.when(F.col("variable") == v, F.struct("lo", "hi"))).alias(f"_{v}") for v in channels])
    d = samples.select(F.col(zone).alias("zone"), *channels, F.explode(F.array_distinct(F.transform(matches, lambda m: m["class_index"]))).alias("class_index"))
    j = d.join(checked_broadcast(wide), ["zone", "class_index"], "left")
    off = {v: F.coalesce((F.col(v) < F.col(f"_{v}")["lo"]) | (F.col(v) > F.col(f"_{v}")["hi"]), F.col(v) < F.col(f"_{v}")["lo"], F.col(v) > F.col(f"_{v}")["hi"], F.lit(False)) for v in channels}
    any_off = F.lit(False)
    for x in off.values():
        any_off = any_off | x
    return j.groupBy("class_index", "zone").agg(F.count("*").alias("eligible"), F.count_if(any_off).alias("outside"), *[F.count_if(x).alias(f"out_{v}") for v, x in off.items()])


def remap(samples: DataFrame, variable: str, rates: list[float]) -> DataFrame:
    """(rate, threshold): for each rate, the value that the variable exceeds that often."""
    found = exact_percentiles(samples, [], [variable], [1 - r for r in rates])
    rate = F.create_map(*[F.lit(x) for r in rates for x in (1 - r, r)])
    return found.select(rate[F.col("cut")].alias("rate"), F.col("value").alias("threshold"))


def unstack(c: DataFrame, rates: DataFrame, keep: int = 1) -> DataFrame:
    """Noise gates to keep per rule: the ``keep`` with the highest pass rate; rates: (rule, no, rate)."""
    d = c.filter("part = 'noise'").join(rates, ["rule", "no"])
    return d.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("rate"), "no"))).withColumn("kept", F.col("place") <= keep).select(*RULE, "no", "variable", "rate", "kept")


def dominant_gate(c: DataFrame) -> DataFrame:
    """Per class: the first noise variable of its heaviest noise-gated rule, ties to the first rule."""
    d = c.filter("part = 'noise'")
    return d.withColumn("p", F.row_number().over(Window.partitionBy("class_index").orderBy(F.desc("weight"), "rule", "no"))).filter("p = 1").select("class_index", "class_key", "variable", "weight")


def expand_taxonomy(cells: DataFrame, temp: DataFrame, veg: DataFrame) -> DataFrame:
    """Rules from a table of (class, zone, temp band, vegetation band) and the two band tables (name, lo, hi)."""
    t = temp.select(F.col("name").alias("temp_band"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    v = veg.select(F.col("name").alias("veg_band"), F.col("lo").alias("v_lo"), F.col("hi").alias("v_hi"))
    d = cells.join(checked_broadcast(t), "temp_band").join(checked_broadcast(v), "veg_band")
    cond = lambda var, a, b: F.struct(F.lit(var).alias("variable"), F.lit("between").alias("op"), F.col(a).alias("value"), F.col(b).alias("value2"))
    return d.select("class_index", "zone", F.array(cond("temperatureC", "t_lo", "t_hi"), cond("treeCoverage", "v_lo", "v_hi")).alias("conditions"))


def fit_weights(cells: DataFrame, cands: str, shares: dict[int, float], classes: list[int], *, x: str, z: str, rounds: int = 12, damping: float = 0.5, lo: float = 0.02, hi: float = 10.0) -> dict[int, float]:
    """Weights per class that bring the classes' winning shares near the wanted ones.

    Eligibility is computed once and written; each round only ranks again and multiplies each weight by the damped
    ratio of wanted to measured share, within [lo, hi]. The driver sees one count per class and round.
    """
    from gridloom.rules.compile import MATCH_DDL, winner, with_corners

    own = cells.select(F.col(x).cast("double").alias("x"), F.col(z).cast("double").alias("z"), F.col(cands).alias("m")).filter(F.size("m") > 0)
    held = cut(with_corners(own, classes, "x", "z"))
    total = held.count()
    weights = {k: 1.0 for k in shares}
    for _ in range(rounds if total else 0):
        table = F.create_map(*[y for k, w in weights.items() for y in (F.lit(k), F.lit(w))])
        again = F.transform("m", lambda m: F.struct(m["ord"].alias("ord"), m["class_index"].alias("class_index"), F.coalesce(table[m["class_index"]], m["weight"]).alias("weight"), m["override"].alias("override"))).cast(MATCH_DDL)
        got = {r.k: r.n for r in held.select(again.alias("m"), "_corners").select(winner(F.col("m"), F.col("_corners")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
        for k, want in shares.items():
            have = max(got.get(k, 0) / total, 1e-6)
            weights[k] = min(hi, max(lo, weights[k] * (want / have) ** damping))
    return weights
