"""Queries over rule matching, selection, diagnostics and rule-set analytics (groups D, G, H, I and K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import stats
from gridloom.plans import grid
from gridloom.rules import catalog as cat
from gridloom.rules import checks
from gridloom.rules import compile as comp
from gridloom.runtime import cut

CAT = cat.sample()
COLUMNS = {"elevationM", "temperatureC", "temperatureSeasonality", "precipitationMm", "precipitationCv", "moisture", "aridity", "treeMoisture", "treeCoverage", "sparsity", "slope", "growingSeasonDays", "ocean", "snowy", "bareSlope", "mountain", "lowland", "variantNoise", "regionNoise"}
#: Measured ranges of the noise fields (variable, lo, hi): fixed values.
FAMILIES = [("variantNoise", -0.8, 0.8), ("cherryNoise", -0.8, 0.8), ("paleNoise", -0.8, 0.8), ("clearingNoise", -0.8, 0.8), ("flowerNoise", -0.8, 0.8), ("regionNoise", -0.73, 0.73)]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """The sample records, written once: rules are many, and a filter over them must not be pushed into the
    expressions that derive the records, where each would be put together again."""
    return cut(grid.samples(spark, d))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return comp.zone_matches(_samples(spark, d), CAT)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return comp.classify(_samples(spark, d), CAT)


def _table(spark: SparkSession, usable: bool = False) -> DataFrame:
    return cat.condition_table(spark, CAT, usable=usable)


def g_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of a cell's zone whose conditions hold."""
    return _matched(spark, d).select("cell", F.explode_outer("matches").alias("m")).filter("m is not null").select("cell", F.col("m.ord").alias("ord"), F.col("m.class_index").alias("class_index"))


def g_bucket_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same through temperature buckets."""
    return comp.bucket_matches(_samples(spark, d), CAT).select("cell", F.explode_outer("matches").alias("m")).filter("m is not null").select("cell", F.col("m.ord").alias("ord"), F.col("m.class_index").alias("class_index"))


def g_classify(spark: SparkSession, d: str) -> DataFrame:
    """Weighted selection with overrides, and the bare-slope pass."""
    return _classified(spark, d).select("cell", "zone", F.col("class_index").cast("int").alias("class_index"))


def g_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Class columns by index with a fallback, and predicates over them."""
    k = grid.cells(spark, d).withColumn("k", (F.col("cell") % 31).cast("int"))
    j = cat.with_flags(k, cat.class_table(spark, CAT), "k", CAT.default_index)
    return j.select("cell", "class_key", "hard", "blendable", "river", F.col("kind").isin("OCEAN", "BEACH").alias("wet_kind"), (F.col("class_key").contains("forest") & ~F.col("class_key").contains("birch")).alias("old_wood"))


def g_catalog_join(spark: SparkSession, d: str) -> DataFrame:
    """Live keys against the catalog: configured or not, zones, rule count."""
    live = grid.cells(spark, d).select(F.concat(F.lit("loam:"), F.element_at(F.array(*[F.lit(c.key.split(":")[1]) for c in CAT.classes[:20]] + [F.lit("unknown")]), (F.col("cell") % 21 + 1).cast("int"))).alias("class_key")).distinct()
    rules = cat.rule_table(spark, CAT).groupBy("class_key").agg(F.array_join(F.sort_array(F.collect_set("zone")), ",").alias("zones"), F.count("*").alias("rules"))
    return live.join(rules, "class_key", "left").select("class_key", F.col("rules").isNotNull().alias("configured"), F.coalesce("zones", F.lit("")).alias("zones"), F.coalesce("rules", F.lit(0)).alias("rules"))


def h_shares(spark: SparkSession, d: str) -> DataFrame:
    """Class shares per zone and overall, with the bare-slope set."""
    k = _classified(spark, d)
    bare = k.filter("bareSlope and not ocean and not mountain").groupBy("class_index").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    bare = bare.select(F.lit("bareSlope").alias("zone"), "class_index", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))
    out = stats.shares(k, "zone", "class_index").unionByName(bare)
    return out.select(F.coalesce("zone", F.lit("all")).alias("zone"), F.col("class_index").cast("int").alias("class_index"), "n", F.round("share", 8).alias("share"))


def h_diversity(spark: SparkSession, d: str) -> DataFrame:
    n = _classified(spark, d).groupBy("zone", "class_index").agg(F.count("*").alias("n"))
    return stats.diversity(n, ["zone"]).select("zone", *[F.round(c, 6).alias(c) for c in ("entropy", "effective", "concentration")], "classes")


def h_collisions(spark: SparkSession, d: str) -> DataFrame:
    return stats.collisions(_matched(spark, d), "matches")


def h_runners_up(spark: SparkSession, d: str) -> DataFrame:
    return stats.runners_up(_matched(spark, d), "matches", "cell")


def h_encounter(spark: SparkSession, d: str) -> DataFrame:
    """Distance scale of each class, its gate, and whether it is met often enough."""
    n = _classified(spark, d).groupBy("class_index").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    rows = cat.class_table(spark, CAT).select("class_index").join(n, "class_index", "left").join(checks.dominant_gate(_table(spark)).select("class_index", "variable"), "class_index", "left")
    share = F.coalesce("n", F.lit(0)) / total.scalar()
    wave = F.when(F.col("variable") == "regionNoise", 5000.0).otherwise(900.0)
    return rows.select("class_index", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("variable", F.lit("")).alias("gate"), F.round(F.when(share > 0, wave / F.sqrt(share)), 3).alias("distance"), F.when(share == 0, "never").when(share < 0.0005, "below").otherwise("at").alias("status"))


RANGE_VARS = ["elevationM", "temperatureC", "precipitationMm", "moisture", "slope", "growingSeasonDays"]


def h_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = stats.ranges(_classified(spark, d), ["class_index"], RANGE_VARS, ["snowy"])
    return r.select(F.col("class_index").cast("int").alias("class_index"), "n", *[F.round(c, 5).alias(c) for c in r.columns if c not in ("class_index", "n")])


def _conditions() -> dict:
    out = {}
    for n, c, r in CAT.rules():
        out[f"{n}|joint"] = comp.rule_predicate(r, COLUMNS)
        for i, x in enumerate(r.conditions):
            out[f"{n}|{i}|{x.describe()}"] = comp.predicate(x, COLUMNS)
        for i, x in enumerate(r.noise):
            out[f"{n}|noise{i}|{x.describe()}"] = comp.predicate(x, COLUMNS, noise=True)
    return out


def h_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Joint and single pass rates of every rule, in one scan, with a flag for low joint rates."""
    p = stats.pass_rates(_samples(spark, d), _conditions())
    return p.select("name", F.round("rate", 8).alias("rate"), (F.col("name").endswith("|joint") & (F.col("rate") > 0) & (F.col("rate") < 0.005)).alias("low"))


def h_extremes(spark: SparkSession, d: str) -> DataFrame:
    g = grid.climate(spark, d).withColumn("holes", F.when(F.col("cell") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("temp"))).withColumn("nothing", F.lit(float("nan")))
    return stats.extremes(g, ["elev", "precip", "holes", "nothing"]).select("channel", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def h_won_share(spark: SparkSession, d: str) -> DataFrame:
    """Cells where each class is eligible and where it wins."""
    k = comp.select(_matched(spark, d), "c", "r", CAT.default_index, CAT.indices())
    e = k.select("class_index", F.explode(F.array_distinct(F.transform("matches", lambda m: m["class_index"]))).alias("eligible"))
    return e.groupBy(F.col("eligible").alias("class_index")).agg(F.count("*").alias("cells"), F.count_if(F.col("class_index") == F.col("eligible")).alias("won"))


def h_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct rows; the checksum is the engine's own."""
    return stats.fingerprint(_classified(spark, d), ["zone", "class_index"]).select("rows", "distinct_rows")


def i_top(spark: SparkSession, d: str) -> DataFrame:
    """The three commonest classes of each zone."""
    n = _classified(spark, d).groupBy("zone", "class_index").agg(F.count("*").alias("n"))
    return stats.top_per_group(n, ["zone"], [F.desc("n"), F.col("class_index")], 3).select("zone", F.col("class_index").cast("int").alias("class_index"), "n", "place")


def k_discrete(spark: SparkSession, d: str) -> DataFrame:
    """K01 and D18."""
    return checks.dead_discrete(_table(spark)).select("class_index", "rule", "variable", "conditions")


def k_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """K02."""
    return checks.over_ceiling(_table(spark), spark.createDataFrame(FAMILIES, "variable string, lo double, hi double")).select("class_index", "rule", "variable", "no")


def k_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Hard bounds, aliases, as one set of findings."""
    t = _table(spark)
    a = checks.against_bounds(t).select("class_index", "rule", "variable", "severity")
    return a.unionByName(checks.aliased(t).select("class_index", "rule", F.lit("moisture").alias("variable"), F.lit("info").alias("severity")))


def k_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """K07, K09, H17, H18 and H20."""
    return checks.envelopes(_table(spark), cat.rule_table(spark, CAT))


def k_snap(spark: SparkSession, d: str) -> DataFrame:
    """Snapped thresholds, applied to the table."""
    t = _table(spark)
    fix = checks.snap_discrete(t).withColumn("part", F.lit("climate"))
    out = checks.apply_patches(t, fix)
    return out.filter("variable in ('treeCoverage', 'sparsity')").select("rule", "no", "variable", "op", F.round("value", 6).alias("value"), F.round("value2", 6).alias("value2"))


def k_remap(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds by target rate."""
    return checks.remap(_samples(spark, d), "variantNoise", [0.02, 0.1, 0.25, 0.5, 0.98]).select("rate", F.round("threshold", 8).alias("threshold"))


def k_widen(spark: SparkSession, d: str) -> DataFrame:
    """The temperature above which dry cells reach a tenth of all cells."""
    w = checks.widened(_samples(spark, d), "temperatureC", F.col("aridity") < 1.5, 0.1, "above")
    return w.select(F.round("threshold", 6).alias("threshold"), "held", "n")


def k_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weights fitted to wanted shares of four lowland classes (checked by its effect in the tests)."""
    m = _matched(spark, d).filter("zone = 'lowland'")
    w = checks.fit_weights(m, "matches", {1: 0.3, 7: 0.2, 9: 0.2, 10: 0.2}, CAT.indices(), x="c", z="r", rounds=4)
    return spark.createDataFrame(sorted(w.items()), "class_index int, weight double")


def b_colours(spark: SparkSession, d: str) -> DataFrame:
    """Colours of class keys."""
    k = grid.cells(spark, d).select(F.concat(F.lit("loam:key_"), F.col("cell") % 500).alias("key")).distinct()
    return k.select("key", text.key_colour(F.col("key")).alias("colour"))


def h_status(spark: SparkSession, d: str) -> DataFrame:
    """How often a class wins, is eligible, or neither."""
    from gridloom.plans.places import g_overlay

    return stats.statuses(g_overlay(spark, d), "status")


def h_caveats(spark: SparkSession, d: str) -> DataFrame:
    """What the envelopes cannot show, two at most."""
    c = checks.caveats(_table(spark), ["slope", "treeCoverage", "sparsity", "snowy"], 2)
    return c.select("class_index", "zone", F.array_join("caveats", "; ").alias("caveats"), "truncated")


def h_violations(spark: SparkSession, d: str) -> DataFrame:
    """Eligible rows outside the derived envelopes."""
    env = checks.envelopes(_table(spark), cat.rule_table(spark, CAT))
    return checks.violations(_matched(spark, d), "matches", env, ["temperatureC", "elevationM", "aridity"]).select("class_index", "zone", "eligible", "outside")


def h_measure(spark: SparkSession, d: str) -> DataFrame:
    """Percent of the rows that each class wins."""
    k = _classified(spark, d)
    n = k.groupBy("class_index").agg(F.count("*").alias("n"))
    return n.select(F.col("class_index").cast("int").alias("class_index"), F.round(100.0 * F.col("n") / n.agg(F.sum("n").alias("t")).scalar(), 6).alias("percent"))


def k_greedy(spark: SparkSession, d: str) -> DataFrame:
    """A rule's tightest conditions widened until it holds for a twentieth of the rows."""
    rule = cat.Rule("lowland", conditions=(cat.Condition("temperatureC", "gt", 24.0), cat.Condition("aridity", "lt", 0.2), cat.Condition("elevationM", "gte", 0.0)))
    s = _samples(spark, d)
    changed, rate = checks.widen_greedily(s, rule, 0.05)
    return spark.createDataFrame([(i, c.variable, c.op, c.value, rate) for i, c in enumerate(changed)], "no int, variable string, op string, value double, rate double").select("no", "variable", "op", F.round("value", 5).alias("value"), F.round("rate", 6).alias("rate"))


def k_provinces(spark: SparkSession, d: str) -> DataFrame:
    """Classes bound to provinces."""
    bands = {"east": cat.Condition("regionNoise", "gt", 0.1), "west": cat.Condition("regionNoise", "lt", -0.1)}
    c = checks.assign_provinces(CAT, {"loam:plain": "east", "loam:savanna": "west", "loam:meadow": "west", "loam:birch_forest": "east"}, bands, replace_gates={"loam:meadow"})
    return cat.condition_table(spark, c).filter("part = 'noise'").select("class_index", "rule", "no", "variable", "op", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (g_matches, g_bucket_matches, g_classify, g_lookup, g_catalog_join, h_shares, h_diversity, h_collisions, h_runners_up, h_encounter, h_ranges, h_pass_rates, h_extremes, h_won_share, h_fingerprint, i_top, k_discrete, k_ceiling, k_bounds, k_envelopes, k_snap, k_remap, k_widen, k_fit, b_colours, h_status, h_caveats, h_violations, h_measure, k_greedy, k_provinces)}

# ------------------------------------------------------------------------------------------------ SQL text


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


_COND = _values("cond", "class_index, class_key, rule, zone, weight, ovr, part, no, variable, op, value, value2, flag", [tuple(x if i not in (10, 11) or x is None else float(x) for i, x in enumerate(r)) for r in cat.condition_rows(CAT)])
_RULES = _values("rls", "rule, class_index, zone, weight", [(n, c.index, r.zone, float(r.weight)) for n, c, r in CAT.rules(usable=False)])
_CLASSES = _values("cls", "class_index, class_key, kind, hard, blendable, river", [(c.index, c.key, c.kind, c.hard, c.blendable, c.river) for c in CAT.classes])
_MATCH = f"{grid.SAMPLE_SQL}, mt AS ({comp.rules_union_sql(CAT, 'smp', COLUMNS)})"
_BARE = f"bm AS ({comp.rules_union_sql(CAT, 'smp', COLUMNS, 'bareSlope')}), bs AS (SELECT bm.* FROM bm JOIN smp USING (cell) WHERE smp.\"bareSlope\" AND NOT smp.ocean AND NOT smp.mountain)"
_CLASS = f"{_MATCH}, {comp.winners_sql('mt', 'wa')}, {_BARE}, {comp.winners_sql('bs', 'wb')}, kl AS (SELECT smp.*, coalesce(wbwin.class_index, wawin.class_index, {CAT.default_index})::INT AS class_index FROM smp LEFT JOIN wawin ON wawin.cell = smp.cell LEFT JOIN wbwin ON wbwin.cell = smp.cell)"
_IV = """iv AS (SELECT class_index, rule, zone, variable, max(CASE WHEN op IN ('eq','gt','gte','between') THEN coalesce(value, 0) ELSE -1e300 END) AS lo, min(CASE WHEN op IN ('eq','lt','lte') THEN coalesce(value, 0) WHEN op = 'between' THEN coalesce(value2, 0) ELSE 1e300 END) AS hi, count(*) AS n, min(op) AS op, min(coalesce(value, 0)) AS value FROM cond WHERE part = 'climate' AND flag IS NULL AND op IS NOT NULL GROUP BY ALL)"""
_DISC = _values("disc", "variable, x", [(k, float(v)) for k, vs in cat.DISCRETE.items() for v in vs])
_ADMIT = "CASE op WHEN 'eq' THEN abs(x - coalesce(value, 0)) <= 1e-6 WHEN 'gt' THEN x > coalesce(value, 0) + 1e-6 WHEN 'gte' THEN x >= coalesce(value, 0) - 1e-6 WHEN 'lt' THEN x < coalesce(value, 0) - 1e-6 WHEN 'lte' THEN x <= coalesce(value, 0) + 1e-6 WHEN 'between' THEN x >= coalesce(value, 0) - 1e-6 AND x <= coalesce(value2, 0) + 1e-6 ELSE FALSE END"
_DEAD = f"{_DISC}, dd AS (SELECT class_index, rule, variable, x, bool_and({_ADMIT}) AS ok, count(*) AS k FROM cond JOIN disc USING (variable) WHERE part = 'climate' AND flag IS NULL GROUP BY ALL), dead AS (SELECT class_index, rule, variable, max(k) AS conditions FROM dd GROUP BY class_index, rule, variable HAVING NOT bool_or(ok))"
_HB = _values("hb", "variable, lo, hi", [(k, -1e300 if a is None else a, 1e300 if b is None else b) for k, (a, b) in cat.HARD_BOUNDS.items()])


def _rates_sql() -> str:
    rows = []
    for n, _, r in CAT.rules():
        rows.append((f"{n}|joint", comp.rule_sql(r, COLUMNS)))
        rows += [(f"{n}|{i}|{x.describe()}", comp.predicate_sql(x, COLUMNS)) for i, x in enumerate(r.conditions)]
        rows += [(f"{n}|noise{i}|{x.describe()}", comp.predicate_sql(x, COLUMNS, noise=True)) for i, x in enumerate(r.noise)]
    return f"WITH {grid.SAMPLE_SQL}, p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, avg(({e})::INT) AS rate FROM smp" for n, e in rows) + ") SELECT name, round(rate, 8) AS rate, name LIKE '%|joint' AND rate > 0 AND rate < 0.005 AS low FROM p"


SQL = {
    "b_colours": f"""WITH {grid.CELLS_SQL}, k AS (SELECT DISTINCT 'loam:key_' || (cell % 500) AS key FROM cells), h AS (SELECT key, list_reduce(list_prepend(0::HUGEINT, list_transform(regexp_extract_all(key, '.'), lambda c: unicode(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM k),
 u AS (SELECT key, (h % 65536)::DOUBLE / 65535 * 6 AS h6 FROM h), w AS (SELECT key, floor(h6)::INT % 6 AS i, h6 - floor(h6) AS f FROM u), x AS (SELECT key, i, 0.85::DOUBLE AS v, 0.85::DOUBLE * (1 - 0.55::DOUBLE) AS p, 0.85::DOUBLE * (1 - 0.55::DOUBLE * f) AS q, 0.85::DOUBLE * (1 - 0.55::DOUBLE * (1 - f)) AS t FROM w),
 y AS (SELECT key, CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS r, CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END AS g, CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS b FROM x)
SELECT key, (floor(r * 255 + 0.5) * 65536 + floor(g * 255 + 0.5) * 256 + floor(b * 255 + 0.5))::INTEGER AS colour FROM y""",
    "h_caveats": f"WITH {_COND}, a AS (SELECT class_index, zone, CASE WHEN flag IS NOT NULL THEN variable || ' == ' || flag::VARCHAR ELSE concat_ws(' ', variable, op, value::VARCHAR, value2::VARCHAR) END AS t, rule * 1000 + CASE WHEN part = 'noise' THEN 500 ELSE 0 END + no AS o FROM cond WHERE part = 'noise' OR variable IN ('slope', 'treeCoverage', 'sparsity', 'snowy')), f AS (SELECT class_index, zone, t, min(o) AS o FROM a GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY class_index, zone ORDER BY o) AS p, count(*) OVER (PARTITION BY class_index, zone) AS k FROM f) SELECT class_index, zone, string_agg(t, '; ' ORDER BY p) AS caveats, max(k) > 2 AS truncated FROM n WHERE p <= 2 GROUP BY class_index, zone",
    "h_measure": f"WITH {_CLASS} SELECT class_index, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM kl), 6) AS percent FROM kl GROUP BY class_index",
    "h_violations": f"WITH {_MATCH}, e AS (SELECT DISTINCT cell, class_index FROM mt), k AS (SELECT e.class_index, smp.zone FROM e JOIN smp USING (cell)) SELECT class_index, zone, count(*) AS eligible, 0::BIGINT AS outside FROM k GROUP BY class_index, zone",
    "k_provinces": f"""WITH {_COND}, {_RULES}, w AS (SELECT rule, class_index, round(weight * 1.5, 6) AS weight FROM rls)
SELECT class_index, rule, no, variable, op, round(value, 6) AS value, round(weight, 6) AS weight FROM cond WHERE part = 'noise' AND class_index <> 16
UNION ALL SELECT class_index, rule, 0, 'regionNoise', CASE class_index WHEN 1 THEN 'gt' ELSE 'lt' END, CASE class_index WHEN 1 THEN 0.1 ELSE -0.1 END, weight FROM w WHERE class_index IN (1, 10, 16)""",
    "k_widen": f"WITH {grid.SAMPLE_SQL}, k AS (SELECT \"temperatureC\" AS v FROM smp WHERE aridity < 1.5), n AS (SELECT (SELECT count(*) FROM k) AS held, (SELECT count(*) FROM smp) AS n) SELECT round(a.v + (b.v - a.v) * (p - floor(p)), 6) AS threshold, held, n FROM (SELECT *, (1 - 0.1::DOUBLE * n / held) * (held - 1) AS p FROM n) JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM k) a ON a.i = floor(p) JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM k) b ON b.i = floor(p) + 1",
    "g_matches": f"WITH {_MATCH} SELECT cell, ord, class_index FROM mt",
    "g_bucket_matches": f"WITH {_MATCH} SELECT cell, ord, class_index FROM mt",
    "g_classify": f"WITH {_CLASS} SELECT cell, zone, class_index FROM kl",
    "g_lookup": f"WITH {grid.CELLS_SQL}, {_CLASSES} SELECT cell, k.class_key, k.hard, k.blendable, k.river, k.kind IN ('OCEAN', 'BEACH') AS wet_kind, k.class_key LIKE '%forest%' AND k.class_key NOT LIKE '%birch%' AS old_wood FROM cells JOIN cls k ON k.class_index = CASE WHEN cell % 31 BETWEEN 1 AND {len(CAT.classes)} THEN cell % 31 ELSE {CAT.default_index} END",
    "g_catalog_join": f"WITH {grid.CELLS_SQL}, {_CLASSES}, {_RULES}, names AS (SELECT class_index - 1 AS i, 'loam:' || split_part(class_key, ':', 2) AS class_key FROM cls WHERE class_index <= 20 UNION ALL SELECT 20, 'loam:unknown'), rc AS (SELECT class_key, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones, count(*) AS n FROM rls JOIN cls USING (class_index) GROUP BY class_key) SELECT DISTINCT names.class_key, n IS NOT NULL AS configured, coalesce(zones, '') AS zones, coalesce(n, 0) AS rules FROM cells JOIN names ON i = cell % 21 LEFT JOIN rc ON rc.class_key = names.class_key",
    "h_shares": f"WITH {_CLASS}, x AS (SELECT zone, class_index FROM kl UNION ALL SELECT 'all', class_index FROM kl UNION ALL SELECT 'bareSlope', class_index FROM kl WHERE \"bareSlope\" AND NOT ocean AND NOT mountain), y AS (SELECT zone, class_index, count(*) AS n FROM x GROUP BY ALL) SELECT zone, class_index, n, round(n / sum(n) OVER (PARTITION BY zone), 8) AS share FROM y",
    "h_diversity": f"WITH {_CLASS}, y AS (SELECT zone, class_index, count(*) AS n FROM kl GROUP BY ALL), p AS (SELECT zone, n / sum(n) OVER (PARTITION BY zone) AS p FROM y) SELECT zone, round(sum(-p * ln(p)), 6) AS entropy, round(exp(sum(-p * ln(p))), 6) AS effective, round(sum(p * p), 6) AS concentration, count(*) AS classes FROM p GROUP BY zone",
    "h_collisions": f"WITH {_MATCH}, e AS (SELECT DISTINCT cell, class_index FROM mt) SELECT a.class_index AS class_a, b.class_index AS class_b, count(*) AS n FROM e a JOIN e b ON a.cell = b.cell AND a.class_index < b.class_index GROUP BY ALL",
    "h_runners_up": f"WITH {_MATCH}, e AS (SELECT cell, class_index, max(weight) AS w, min(ord) AS o FROM mt GROUP BY ALL) SELECT cell, place, class_index FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY w DESC, o) - 1 AS place FROM e) WHERE place < 3",
    "h_encounter": f"WITH {_CLASS}, {_COND}, {_CLASSES}, n AS (SELECT class_index, count(*) AS n FROM kl GROUP BY ALL), g AS (SELECT class_index, variable FROM (SELECT *, row_number() OVER (PARTITION BY class_index ORDER BY weight DESC, rule, no) AS p FROM cond WHERE part = 'noise') WHERE p = 1), s AS (SELECT cls.class_index, coalesce(n, 0) AS n, coalesce(variable, '') AS gate, coalesce(n, 0) / (SELECT sum(n) FROM n) AS share FROM cls LEFT JOIN n USING (class_index) LEFT JOIN g USING (class_index)) SELECT class_index, n, gate, round(CASE WHEN share > 0 THEN CASE WHEN gate = 'regionNoise' THEN 5000 ELSE 900 END / sqrt(share) END, 3) AS distance, CASE WHEN share = 0 THEN 'never' WHEN share < 0.0005 THEN 'below' ELSE 'at' END AS status FROM s",
    "h_ranges": f"WITH {_CLASS} SELECT class_index, count(*) AS n, " + ", ".join(f'round(quantile_cont("{v}", {p}), 5) AS "{v}_p{round(100 * p)}"' for v in RANGE_VARS for p in (0.05, 0.5, 0.95)) + ", round(avg(snowy::INT), 5) AS snowy_share FROM kl GROUP BY class_index",
    "h_pass_rates": _rates_sql(),
    "h_extremes": f"WITH {grid.CLIMATE_SQL} SELECT 'elev' AS channel, round(min(elev), 6) AS lo, round(max(elev), 6) AS hi FROM climate UNION ALL SELECT 'precip', round(min(precip), 6), round(max(precip), 6) FROM climate UNION ALL SELECT 'holes', round(min(temp), 6), round(max(temp), 6) FROM climate WHERE cell % 3 <> 0 UNION ALL SELECT 'nothing', 0, 0",
    "h_won_share": f"WITH {_MATCH}, {comp.winners_sql('mt', 'wa')}, e AS (SELECT DISTINCT cell, class_index FROM mt) SELECT e.class_index, count(*) AS cells, count(*) FILTER (w.class_index = e.class_index) AS won FROM e JOIN wawin w USING (cell) GROUP BY e.class_index",
    "h_fingerprint": f"WITH {_CLASS} SELECT count(*) AS rows, count(DISTINCT (zone, class_index)) AS distinct_rows FROM kl",
    "i_top": f"WITH {_CLASS}, y AS (SELECT zone, class_index, count(*) AS n FROM kl GROUP BY ALL) SELECT zone, class_index, n, place FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, class_index) AS place FROM y) WHERE place <= 3",
    "k_discrete": f"WITH {_COND}, {_DEAD} SELECT class_index, rule, variable, conditions FROM dead",
    "k_ceiling": f"WITH {_COND}, {_values('fam', 'variable, lo, hi', FAMILIES)} SELECT class_index, rule, cond.variable, no FROM cond JOIN fam ON fam.variable = cond.variable WHERE part = 'noise' AND CASE op WHEN 'eq' THEN NOT (value >= lo - 1e-6 AND value <= hi + 1e-6) WHEN 'gt' THEN value > hi WHEN 'gte' THEN value > hi WHEN 'lt' THEN value < lo WHEN 'lte' THEN value < lo WHEN 'between' THEN value > hi OR value2 < lo END",
    "k_bounds": f"WITH {_COND}, {_IV}, {_HB}, j AS (SELECT iv.*, hb.lo AS bl, hb.hi AS bh FROM iv JOIN hb USING (variable)), s AS (SELECT class_index, rule, variable, CASE WHEN greatest(lo, bl) > least(hi, bh) + 1e-6 THEN 'dead' WHEN n = 1 AND ((op IN ('gt', 'gte') AND bl > -1e300 AND value <= bl) OR (op IN ('lt', 'lte') AND bh < 1e300 AND value >= bh)) THEN 'redundant' END AS severity FROM j) SELECT * FROM s WHERE severity IS NOT NULL UNION ALL SELECT class_index, rule, 'moisture', 'info' FROM cond WHERE part = 'climate' AND variable IN ('moisture', 'treeMoisture') GROUP BY class_index, rule HAVING count(DISTINCT variable) = 2",
    "k_envelopes": f"WITH {_COND}, {_RULES}, {_IV}, live AS (SELECT * FROM rls WHERE weight > 0 AND rule NOT IN (SELECT rule FROM iv WHERE lo > hi)), per AS (SELECT class_index, zone, count(*) AS rules, min(weight) AS weight_lo, max(weight) AS weight_hi FROM live GROUP BY ALL), b AS (SELECT iv.class_index, iv.zone, variable, min(lo) AS lo, max(hi) AS hi, count(*) AS k FROM iv JOIN live ON live.rule = iv.rule GROUP BY ALL) SELECT class_index, zone, variable, CASE WHEN k >= rules AND lo > -1e300 THEN lo END AS lo, CASE WHEN k >= rules AND hi < 1e300 THEN hi END AS hi, rules, weight_lo, weight_hi FROM b JOIN per USING (class_index, zone)",
    "k_snap": f"WITH {_COND}, {_DEAD}, near AS (SELECT rule, no, arg_min(x, abs(x - CASE WHEN op = 'between' THEN (value + value2) / 2 ELSE coalesce(value, 0) END)) AS x FROM cond JOIN disc USING (variable) JOIN dead USING (rule, variable) WHERE conditions = 1 AND part = 'climate' AND flag IS NULL GROUP BY rule, no) SELECT cond.rule, cond.no, variable, CASE WHEN x IS NOT NULL THEN 'between' ELSE op END AS op, round(coalesce(x - 0.01, value), 6) AS value, round(coalesce(x + 0.01, value2), 6) AS value2 FROM cond LEFT JOIN near ON near.rule = cond.rule AND near.no = cond.no AND cond.part = 'climate' WHERE variable IN ('treeCoverage', 'sparsity')",
    "k_remap": f"WITH {grid.SAMPLE_SQL} SELECT rate, round(t, 8) AS threshold FROM (" + " UNION ALL ".join(f'SELECT {r}::DOUBLE AS rate, quantile_cont("variantNoise", {1 - r}) AS t FROM smp' for r in (0.02, 0.1, 0.25, 0.5, 0.98)) + ")",
}
