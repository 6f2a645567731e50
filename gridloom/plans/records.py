"""Queries of the general record operators (problems 1, 3, 4, 6), with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import drift, hierarchy, keyed, shred
from gridloom.plans._tables import cells, last_samples
from gridloom.plans.records_sql import P6
from gridloom.runtime import latest, load

FILE_KEYS = ["pack_id", "file_name"]
CLIMATE = ["elevationM", "temperatureC", "precipitationMm", "moisture", "aridity", "treeCoverage", "slope"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dimension_files").select("file_id", "pack_id", "file_name", "pack_format", "received_at", "body")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    versions = drift.readable_versions(_files(spark, d), FILE_KEYS, "pack_format", "received_at")
    return drift.changes(versions, FILE_KEYS, "pack_format")


def _unified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return drift.unify(_files(spark, d).drop("received_at"), ["file_id", "pack_id", "file_name", "pack_format"])


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """One table over all files; settings beyond the widest table are in ``other``, as JSON text."""
    return _unified(spark, d)[0].withColumn("other", F.to_json("other"))


def p1_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d)[1]


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path-type statistics by file name."""
    versions = drift.readable_versions(_files(spark, d), FILE_KEYS, "pack_format", "received_at")
    return drift.path_statistics(versions, ["file_name"], "pack_format")


def p1_shifts(spark: SparkSession, d: str) -> DataFrame:
    """How many paths each version retypes, loses and gains against the one before."""
    versions = drift.readable_versions(_files(spark, d), FILE_KEYS, "pack_format", "received_at")
    return drift.shifts(versions, FILE_KEYS, "pack_format").select(*FILE_KEYS, "pack_format", *[F.size(x).alias(x) for x in ("retyped", "gone", "come")])


def _links(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    p = F.when(F.col("downstream") >= 0, F.col("downstream").cast("long"))  # a negative one is an outlet
    return c.select(F.col("tile_id").alias("s"), F.col("cell").cast("long").alias("v"), p.alias("p"))


def _resolved(r: DataFrame) -> DataFrame:
    return r.select(F.col("s").alias("tile_id"), F.col("v").cast("int").alias("cell"), F.col("root").cast("int").alias("root_cell"), F.col("depth").cast("int").alias("depth"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(hierarchy.resolve(_links(spark, d)))


def p3_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same with blocks of 64 keys and every move between blocks as a join, none in one task."""
    return _resolved(hierarchy.resolve(_links(spark, d), block=lambda x: F.shiftright(x, 6), base_rows=0))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_links(spark, d))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select(F.col("s").alias("tile_id"), F.col("v").cast("int").alias("cell"), F.col("root").cast("int").alias("root_cell"), F.col("depth").cast("int").alias("depth"), F.col("path").cast("array<int>").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_paths(spark, d)).select(F.col("s").alias("tile_id"), F.col("ancestor").cast("int").alias("cell"), F.col("v").cast("int").alias("upstream_cell"), F.col("distance").alias("steps"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = last_samples(spark, d, ["zone", "biome_index"]).filter("zone is not null and biome_index is not null")
    return keyed.heavy_keys(s, ["zone", "biome_index"], 50).select("zone", "biome_index")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    s = last_samples(spark, d, ["zone", "biome_index", "candidate_counts"])
    c = load(spark, d, "climate_samples").select("sample_id", "sampled_at", *CLIMATE)
    joined = s.join(latest(c, ["sample_id"], "sampled_at", CLIMATE), "sample_id", "left")
    out = keyed.profile_by_key(joined, ["zone", "biome_index"], ["candidate_counts", *CLIMATE])
    return out.select("zone", "biome_index", "samples", *[F.round(f"mean_{m}", 4).alias(f"mean_{m}") for m in ["candidate_counts", *CLIMATE]], *[f"n_{m}" for m in CLIMATE])


def _classes(spark: SparkSession, d: str) -> DataFrame:
    own = [n for n, _, _ in shred.CLASS_FIELDS]
    values = ["requiredMods", "rules", "pack_id", *own]
    typed = latest(load(spark, d, "biome_catalog").select("record_id", "loaded_at", *values), ["record_id"], "loaded_at", values).drop("loaded_at")
    raw = latest(load(spark, d, "catalog_raw").select("record_id", "received_at", "body", "pack_id"), ["record_id"], "received_at", ["body", "pack_id"])
    parsed = raw.select("record_id", "pack_id", "body").mapInArrow(shred.parse_bodies, shred.CLASS_DDL)
    # the typed table has no unknown fields
    cond = lambda c: F.when(c.isNotNull(), F.struct(*[c[n].alias(n) for n in ("variable", "op", "value", "value2", "bool")], F.lit(None).cast("string").alias("extra")))
    rule = lambda r: F.when(r.isNotNull(), F.struct(r["zone"].alias("zone"), r["rarity"].cast("double").alias("rarity"), r["override"].alias("override"), F.transform(r["conditions"], cond).alias("conditions"), F.transform(r["noiseConditions"], cond).alias("noiseConditions"), r["requiredMods"].alias("requiredMods"), F.lit(None).cast("string").alias("extra")))
    typed = typed.withColumns({"rules": F.transform("rules", rule), "extra": F.lit(None).cast("string")})
    return typed.select("record_id", *[F.col(n).cast(parsed.schema[n].dataType.simpleString()).alias(n) for n in ["pack_id", *own, "extra", "requiredMods", "rules"]]).unionByName(parsed)


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("record_id", "requiredMods", "rules")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).mapInArrow(shred.item_rows, shred.ITEM_DDL)


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per class; unknown fields are in ``p6_extras``."""
    return _classes(spark, d).drop("requiredMods", "rules", "extra")


def p6_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).mapInArrow(shred.condition_rows, shred.CONDITION_DDL)


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).mapInArrow(shred.rule_rows, shred.RULE_ROW_DDL).withColumn("rarity", F.round("rarity", 4))


def p6_mods(spark: SparkSession, d: str) -> DataFrame:
    """Mods that a class (rule_no -1) or a rule requires."""
    return p6_found(spark, d).filter("list_name = 'requiredMods'").select("record_id", "rule_no", "item_no", F.col("item").alias("mod"))


def p6_extras(spark: SparkSession, d: str) -> DataFrame:
    """Fields that the schema does not know, with the place of their owner."""
    return _extras(spark, d).drop("value")


def p6_extra_values(spark: SparkSession, d: str) -> DataFrame:
    """The same with the values as JSON text."""
    return _extras(spark, d)


def _extras(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("record_id", "extra", "rules").mapInArrow(shred.extra_rows, shred.EXTRA_DDL)


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).mapInArrow(shred.level_rows, shred.LEVEL_DDL)


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p1_failed_casts, p1_paths, p1_shifts, p3_found, p3_joined, p3_paths, p3_descendants, p4_found, p4_profile, p6_found, p6_classes, p6_conditions, p6_rules, p6_mods, p6_extras, p6_extra_values, p6_levels)}

_LAST = """last AS (SELECT sample_id, lower(trim(zone)) AS zone, biome_index, candidate_counts, candidates FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY classified_at DESC, zone DESC NULLS LAST, biome_index DESC NULLS LAST) AS r FROM classification_result) WHERE r = 1)"""
_V = "CASE WHEN NOT isnan({0}::DOUBLE) AND {0} <> -9999 THEN {0}::DOUBLE END"

_TREE = """WITH RECURSIVE c AS (SELECT tile_id, cell, downstream FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, cell ORDER BY written_at DESC, downstream DESC NULLS LAST) r FROM coarse_cells) WHERE r = 1),
 l AS (SELECT a.tile_id, a.cell, b.cell AS p FROM c a LEFT JOIN c b ON a.tile_id = b.tile_id AND a.downstream = b.cell),
 t AS (SELECT tile_id, cell, cell AS root_cell, 0 AS depth, [cell] AS path FROM l WHERE p IS NULL
       UNION ALL SELECT l.tile_id, l.cell, t.root_cell, t.depth + 1, list_prepend(l.cell, t.path) FROM t JOIN l ON l.tile_id = t.tile_id AND l.p = t.cell),
 k AS (SELECT l.* FROM l ANTI JOIN t ON l.tile_id = t.tile_id AND l.cell = t.cell),
 w AS (SELECT tile_id, cell, p AS z FROM k UNION SELECT w.tile_id, w.cell, k.p FROM w JOIN k ON k.tile_id = w.tile_id AND k.cell = w.z),
 ring AS (SELECT tile_id, cell FROM w WHERE cell = z)
"""

#: Readable bodies with every path outside lists, then one body per version; its kinds are spelt as here.
_BODIES = """WITH b AS (SELECT file_id, pack_id, file_name, pack_format, received_at, ltrim(body, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS j FROM dimension_files),
 ok AS (SELECT * FROM b WHERE json_valid(j) AND json_type(j) = 'OBJECT'),
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, file_name, pack_format ORDER BY received_at DESC NULLS LAST, file_id DESC) AS r FROM ok) WHERE r = 1),
 t AS (SELECT v.pack_id, v.file_name, v.pack_format, replace(replace(substring(x.fullkey, 3), '"', ''), '\\', '') AS path, CASE WHEN x.type = 'OBJECT' THEN 'object' WHEN x.type = 'ARRAY' THEN 'list' WHEN x.type = 'VARCHAR' THEN 'string' WHEN x.type = 'BOOLEAN' THEN 'boolean' WHEN x.type = 'NULL' THEN 'null' ELSE 'number' END AS kind
   FROM v, json_tree(v.j) x WHERE x.fullkey <> '$' AND x.fullkey NOT LIKE '%[%')
"""

SQL = {
    "p1_paths": _BODIES + "SELECT file_name, path, kind, count(*) AS files, min(pack_format) AS first, max(pack_format) AS last FROM t GROUP BY file_name, path, kind",
    "p1_shifts": _BODIES + """, s AS (SELECT pack_id, file_name, pack_format, lag(pack_format) OVER (PARTITION BY pack_id, file_name ORDER BY pack_format) AS before FROM v),
 p AS (SELECT * FROM s WHERE before IS NOT NULL),
 d AS (SELECT p.*, n.path AS np, n.kind AS nk FROM p LEFT JOIN t n ON n.pack_id = p.pack_id AND n.file_name = p.file_name AND n.pack_format = p.pack_format),
 o AS (SELECT p.*, n.path AS op, n.kind AS ok FROM p LEFT JOIN t n ON n.pack_id = p.pack_id AND n.file_name = p.file_name AND n.pack_format = p.before),
 r AS (SELECT pack_id, file_name, pack_format, count(*) FILTER (WHERE nk IS NOT NULL AND nk <> ok AND nk <> 'null' AND ok <> 'null') AS retyped, count(*) FILTER (WHERE op IS NOT NULL AND nk IS NULL AND ok <> 'object') AS gone FROM (SELECT o.*, d.nk FROM o LEFT JOIN d ON d.pack_id = o.pack_id AND d.file_name = o.file_name AND d.pack_format = o.pack_format AND d.np = o.op) GROUP BY ALL),
 c AS (SELECT pack_id, file_name, pack_format, count(*) FILTER (WHERE np IS NOT NULL AND ok IS NULL AND nk <> 'object') AS come FROM (SELECT d.*, o.ok FROM d LEFT JOIN o ON o.pack_id = d.pack_id AND o.file_name = d.file_name AND o.pack_format = d.pack_format AND o.op = d.np) GROUP BY ALL)
SELECT pack_id, file_name, pack_format, retyped::INTEGER AS retyped, gone::INTEGER AS gone, come::INTEGER AS come FROM r JOIN c USING (pack_id, file_name, pack_format)""",
    "p3_paths": _TREE + "SELECT tile_id, cell, root_cell, depth, path FROM t UNION ALL SELECT w.tile_id, w.cell, min(w.z), -1, NULL FROM w JOIN ring ON ring.tile_id = w.tile_id AND ring.cell = w.z GROUP BY w.tile_id, w.cell",
    "p3_descendants": _TREE + ", u AS (SELECT tile_id, cell AS upstream_cell, unnest(path) AS cell, generate_subscripts(path, 1) - 1 AS steps FROM t) SELECT tile_id, cell, upstream_cell, steps::INTEGER AS steps FROM u WHERE steps > 0",
    "p3_found": _TREE + "SELECT tile_id, cell, root_cell, depth FROM t UNION ALL SELECT w.tile_id, w.cell, min(w.z), -1 FROM w JOIN ring ON ring.tile_id = w.tile_id AND ring.cell = w.z GROUP BY w.tile_id, w.cell",
    "p4_found": f"""WITH {_LAST}, k AS (SELECT zone, biome_index, count(*) n FROM last WHERE zone IS NOT NULL AND biome_index IS NOT NULL GROUP BY ALL)
SELECT zone, biome_index FROM k WHERE n * 50 >= (SELECT sum(n) FROM k)""",
    "p4_profile": f"""WITH {_LAST}, clim AS (SELECT DISTINCT ON (sample_id) * FROM climate_samples ORDER BY sample_id, sampled_at DESC)
SELECT zone, biome_index, count(*) AS samples, round(avg(candidate_counts::DOUBLE), 4) AS mean_candidate_counts,
{', '.join(f'round(avg({_V.format(m)}), 4) AS mean_{m}' for m in CLIMATE)}, {', '.join(f'count({_V.format(m)}) AS n_{m}' for m in CLIMATE)}
FROM last LEFT JOIN clim USING (sample_id) GROUP BY zone, biome_index""",
}
SQL["p3_joined"] = SQL["p3_found"]
SQL |= P6
