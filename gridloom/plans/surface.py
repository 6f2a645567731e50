"""Queries over the query surface, stores, callbacks and catalog editing (groups A, B41, C05, F08 to F09, G08, I, K, L)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import api
from gridloom.functions import hashing
from gridloom.operators import tensor
from gridloom.plans import grid, rasters, ruling
from gridloom.plans.ruling import CAT
from gridloom.plans.scalars import SQL as SCALARS
from gridloom.rules import catalog as cat
from gridloom.rules import checks
from gridloom.rules import compile as comp
from gridloom.runtime import checkpoint_dir, cut
from gridloom.sources import stores


def a_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A catalog written and read again, its usable conditions as a table."""
    c = cat.from_json(cat.to_json(CAT), CAT.loaded)
    return cat.condition_table(spark, c, usable=True).select("class_index", "rule", "part", "no", "variable", "op", "value", "value2", "flag")


def b_describe(spark: SparkSession, d: str) -> DataFrame:
    """Conditions in words."""
    rows = [(n, part, i, x.describe()) for n, _, r in CAT.rules(usable=False) for part, cs in (("climate", r.conditions), ("noise", r.noise)) for i, x in enumerate(cs)]
    return spark.createDataFrame(rows, "rule int, part string, no int, words string")


def c_vector_noise(spark: SparkSession, d: str) -> DataFrame:
    """Value noise by arrays."""
    plain = F.pandas_udf(lambda x, z: pd.Series(hashing.np_value_noise(77, x.to_numpy() / 12.5, z.to_numpy() / 12.5)), "double")
    own = F.pandas_udf(lambda k, x, z: pd.Series(hashing.np_value_noise(k.to_numpy(), x.to_numpy() / 900.0, z.to_numpy() / 900.0)), "double")
    g = grid.cells(spark, d)
    return g.select("cell", F.round(plain(F.col("c").cast("double"), F.col("r").cast("double")), 9).alias("plain"), F.round(own(F.col("cell") % 23, F.col("c").cast("double"), F.col("r").cast("double")), 9).alias("competition"))


def f_compute(spark: SparkSession, d: str) -> DataFrame:
    """A function called once per window on all its cells."""
    cells = tensor.windows_of(grid.cells(spark, d).select("r", "c", "elev"), rasters.W)

    def measure(w: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w_i": [w["w_i"].iloc[0]], "w_j": [w["w_j"].iloc[0]], "n": [len(w)], "relief": [w["elev"].max() - w["elev"].min()]})

    return tensor.compute(cells, measure, "w_i long, w_j long, n long, relief double").withColumn("relief", F.round("relief", 6))


def f_batched(spark: SparkSession, d: str) -> DataFrame:
    """A function called on batches of windows of one size."""

    def total(part: pd.DataFrame) -> pd.DataFrame:
        assert len(part) == 7
        return pd.DataFrame({"w_i": part["w_i"], "w_j": part["w_j"], "total": [float(sum(t)) for t in part["tile"]]})

    return tensor.compute_batched(rasters._tiles(spark, d), total, "w_i long, w_j long, total double", 7).withColumn("total", F.round("total", 5))


def _store(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


def a_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Canonical tiles written, and a box of them gathered."""
    g = grid.cells(spark, d).select(F.lit(5).cast("long").alias("seed"), F.lit(2).alias("scale"), F.floor(F.col("r") / 25).cast("int").alias("tile_i"), F.floor(F.col("c") / 25).cast("int").alias("tile_j"), (F.col("r") % 25).cast("int").alias("r"), (F.col("c") % 25).cast("int").alias("c"),
                                    F.floor("elev").cast("short").alias("elev"), (F.col("cell") % 256).cast("short").alias("mask"), (F.col("cell") % 999).cast("short").alias("surface"), (F.col("cell") % 26).cast("short").alias("class"))
    path = _store(spark)
    stores.write_tiles(g, path)
    return api.region(spark, path, 5, 2, (3, 10, 61, 80), 25).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "elev", "mask", "surface", "class")


def a_drainage(spark: SparkSession, d: str) -> DataFrame:
    """Coarse drainage tiles written, and two of them read."""
    g = grid.cells(spark, d).select(F.lit(7).cast("long").alias("seed"), F.lit(1).alias("scale"), F.floor(F.col("r") / 50).cast("int").alias("tile_i"), F.floor(F.col("c") / 50).cast("int").alias("tile_j"), ((F.col("r") % 50) * 50 + F.col("c") % 50).cast("int").alias("cell"), (F.col("cell") % 77 - 1).cast("int").alias("downstream"), F.col("elev").cast("float").alias("accumulation"))
    path = _store(spark)
    stores.write_drainage(g, path)
    return stores.read_drainage(spark, path, 7, 1, [(0, 1), (1, 0)]).select("tile_i", "tile_j", "cell", "downstream", F.round(F.col("accumulation").cast("double"), 3).alias("accumulation"))


def k_moisture(spark: SparkSession, d: str) -> DataFrame:
    """Rain hints from moisture bounds."""
    m = checks.moisture_families(checks.envelopes(cat.condition_table(spark, CAT), cat.rule_table(spark, CAT)))
    return m.select("class_index", "zone", F.round("precipitation_least", 6).alias("precipitation_least"), "aridity_least")


def k_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Rules from a table of bands."""
    cells = grid.cells(spark, d).select((F.col("cell") % 40).cast("int").alias("class_index"), F.lit("lowland").alias("zone"), F.element_at(F.array(*map(F.lit, ("cold", "mild", "hot"))), (F.col("cell") % 3 + 1).cast("int")).alias("temp_band"), F.element_at(F.array(*map(F.lit, ("bare", "woods"))), (F.col("cell") % 2 + 1).cast("int")).alias("veg_band")).distinct()
    t = spark.createDataFrame([("cold", -30.0, 5.0), ("mild", 5.0, 18.0), ("hot", 18.0, 45.0)], "name string, lo double, hi double")
    v = spark.createDataFrame([("bare", 0.0, 0.4), ("woods", 0.6, 1.0)], "name string, lo double, hi double")
    return checks.expand_taxonomy(cells, t, v).select("class_index", "zone", F.posexplode("conditions").alias("no", "x")).select("class_index", "zone", "no", "x.variable", "x.op", "x.value", "x.value2")


def k_unstack(spark: SparkSession, d: str) -> DataFrame:
    """Which noise gates of a rule stay."""
    t = cat.condition_table(spark, CAT)
    rates = t.filter("part = 'noise'").select("rule", "no", ((F.col("rule") * 7 + F.col("no") * 3) % 10 / 10).alias("rate"))
    return checks.unstack(t, rates).select("rule", "no", "variable", "kept")


NEW = cat.Class(9, "loam:new_desert", "LOWLAND", (cat.Rule("lowland", 2.5, conditions=(cat.Condition("treeCoverage", "between", 0.1, 0.2), cat.Condition("slope", "lt", -1.0))),), color=0x123456)


def i_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A class put in by index, and which classes have what they need."""
    return cat.class_table(spark, CAT.with_class(NEW)).select("class_index", "class_key", "color", "available")


def l_preview(spark: SparkSession, d: str) -> DataFrame:
    """What would be found with a class put in."""
    return api.preview(spark, CAT, NEW).select("variable", "severity")


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("cell") % 4 * F.lit(0.5)
    return cut(grid.climate(spark, d)).select("cell", "r", "c", w.alias("w"), *[(x * w).alias(n) for n, x in (("elev", F.col("elev") / 100), ("p5", F.col("elev") / 200), ("temp", F.col("temp")), ("t_std", F.col("tseason")), ("precip", F.col("precip")), ("precip_cv", F.col("pcv")))])


def l_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest value of each coarse channel."""
    return api.coarse_stats(_coarse(spark, d)).select("channel", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def l_channel(spark: SparkSession, d: str) -> DataFrame:
    """The elevations of the coarse map."""
    return api.coarse_channel(_coarse(spark, d), "elev").select("r", "c", F.round("v", 6).alias("v"))


def l_detail(spark: SparkSession, d: str) -> DataFrame:
    """The elevation view with the water overlay."""
    g = grid.cells(spark, d).withColumns({"mask": (F.col("cell") % 256).cast("int"), "temp": F.lit(0.0), "class": F.lit(1)})
    return api.detail(g, "elevation", 30.0).select("r", "c", F.round("v", 6).alias("v"), F.round("water", 6).alias("water"))


def l_probe(spark: SparkSession, d: str) -> DataFrame:
    """The best status of a class over the four probes of a place."""
    s = cut(grid.samples(spark, d)).withColumn("place", F.floor(F.col("cell") / 4))
    return api.spawn_status(s, CAT, 7, ["place"])


QUERIES = {f.__name__: f for f in (a_catalog, b_describe, c_vector_noise, f_compute, f_batched, a_tiles, a_drainage, k_moisture, k_taxonomy, k_unstack, i_upsert, l_preview, l_coarse, l_channel, l_detail, l_probe)}

_CHANNELS = {"elev": "sign(elev / 100) * power(elev / 100, 2)", "p5": "sign(elev / 200) * power(elev / 200, 2)", "temp": "temp", "t_std": "tseason", "precip": "precip", "precip_cv": "pcv"}
_PLAIN = {"elev": "elev / 100", "p5": "elev / 200", "temp": "temp", "t_std": "tseason", "precip": "precip", "precip_cv": "pcv"}
SQL = {
    "a_catalog": f"WITH {ruling._COND} SELECT class_index, rule, part, no, variable, op, value, value2, flag FROM cond WHERE weight > 0",
    "b_describe": f"WITH {ruling._COND} SELECT rule, part, no, variable || ' ' || CASE WHEN flag IS NOT NULL THEN '== ' || flag::VARCHAR WHEN op = 'between' THEN op || ' ' || value::VARCHAR || ' ' || value2::VARCHAR ELSE coalesce(op, 'None') || ' ' || coalesce(value::VARCHAR, 'None') END AS words FROM cond",
    "c_vector_noise": SCALARS["c_value_noise"],
    "f_compute": f"WITH {grid.CELLS_SQL} SELECT a.w AS w_i, b.w AS w_j, count(*) AS n, round(max(elev) - min(elev), 6) AS relief FROM cells JOIN range(-2, (SELECT max(r) // 6 + 3 FROM cells)) a(w) ON r >= a.w * 6 - 2 AND r < a.w * 6 + 6 JOIN range(-2, 40) b(w) ON c >= b.w * 6 - 2 AND c < b.w * 6 + 6 GROUP BY a.w, b.w",
    "f_batched": "SELECT vec_id // 20 AS w_i, vec_id % 20 AS w_j, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings",
    "a_tiles": f"WITH {grid.CELLS_SQL} SELECT r, c, floor(elev)::SMALLINT AS elev, (cell % 256)::SMALLINT AS mask, (cell % 999)::SMALLINT AS surface, (cell % 26)::SMALLINT AS class FROM cells WHERE r >= 3 AND r < 61 AND c >= 10 AND c < 80",
    "a_drainage": f"WITH {grid.CELLS_SQL}, t AS (SELECT (r // 50)::INTEGER AS tile_i, (c // 50)::INTEGER AS tile_j, (r % 50 * 50 + c % 50)::INTEGER AS cell, (cell % 77 - 1)::INTEGER AS downstream, round(elev::FLOAT::DOUBLE, 3) AS accumulation FROM cells) SELECT * FROM t WHERE (tile_i = 0 AND tile_j = 1) OR (tile_i = 1 AND tile_j = 0)",
    "k_moisture": f"WITH e AS ({ruling.SQL['k_envelopes']}) SELECT class_index, zone, round(max(lo) * 250 / 1.2, 6) AS precipitation_least, max(lo) FILTER (variable <> 'aridity') AS aridity_least FROM e WHERE variable IN ('moisture', 'treeMoisture', 'aridity') AND lo > 0 GROUP BY class_index, zone",
    "k_taxonomy": f"""WITH {grid.CELLS_SQL}, k AS (SELECT DISTINCT (cell % 40)::INTEGER AS class_index, cell % 3 AS t, cell % 2 AS v FROM cells)
SELECT class_index, 'lowland' AS zone, 0 AS no, 'temperatureC' AS variable, 'between' AS op, ([-30.0, 5.0, 18.0]::DOUBLE[])[t + 1] AS value, ([5.0, 18.0, 45.0]::DOUBLE[])[t + 1] AS value2 FROM k UNION ALL SELECT class_index, 'lowland', 1, 'treeCoverage', 'between', ([0.0, 0.6]::DOUBLE[])[v + 1], ([0.4, 1.0]::DOUBLE[])[v + 1] FROM k""",
    "k_unstack": f"WITH {ruling._COND} SELECT rule, no, variable, row_number() OVER (PARTITION BY rule ORDER BY (rule * 7 + no * 3) % 10 DESC, no) = 1 AS kept FROM cond WHERE part = 'noise'",
    "i_upsert": ruling._values("x", "class_index, class_key, color, available", [(c.index, c.key, c.color, not c.needs or c.needs <= {"loam", "cobalt"}) for c in CAT.classes if c.index != 9] + [(9, "loam:new_desert", 0x123456, True)]).join(["WITH ", " SELECT * FROM x"]),
    "l_preview": "SELECT 'treeCoverage' AS variable, 'dead' AS severity UNION ALL SELECT 'slope', 'dead'",
    "l_coarse": f"WITH {grid.CLIMATE_SQL}, k AS (SELECT *, cell % 4 AS w FROM climate) " + " UNION ALL ".join(f"SELECT '{n}' AS channel, round(min(CASE WHEN w > 0 THEN {e} ELSE 0 END), 6) AS lo, round(max(CASE WHEN w > 0 THEN {e} ELSE 0 END), 6) AS hi FROM k" for n, e in _PLAIN.items()),
    "l_channel": f"WITH {grid.CELLS_SQL} SELECT r, c, round(CASE WHEN cell % 4 > 0 THEN {_CHANNELS['elev']} ELSE 0 END, 6) AS v FROM cells",
    "l_detail": f"WITH {grid.CELLS_SQL} SELECT r, c, round(elev, 6) AS v, CASE WHEN cell % 256 > 0 THEN round(0.28::DOUBLE + 0.42::DOUBLE * (cell % 256) / 255, 6) END AS water FROM cells",
    "l_probe": f"WITH {grid.SAMPLE_SQL}, mt AS ({comp.rules_union_sql(CAT, 'smp', ruling.COLUMNS)}), {comp.winners_sql('mt', 'wa')}, e AS (SELECT DISTINCT cell FROM mt WHERE class_index = 7), s AS (SELECT smp.cell // 4 AS place, CASE WHEN e.cell IS NULL THEN 0 WHEN w.class_index = 7 THEN 2 ELSE 1 END AS l FROM smp LEFT JOIN e ON e.cell = smp.cell LEFT JOIN wawin w ON w.cell = smp.cell) SELECT place, ['NONE', 'ELIGIBLE', 'WINS'][max(l) + 1] AS status FROM s GROUP BY place",
}
