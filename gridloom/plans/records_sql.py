"""Longer SQL twins of the record queries."""

from __future__ import annotations


def _as_list(v: str) -> str:
    """The list that a JSON value stands for."""
    return f"""CASE json_type({v}) WHEN 'ARRAY' THEN json_extract({v}, '$[*]') WHEN 'OBJECT' THEN CASE WHEN len(json_keys({v})) = 0 THEN []::JSON[] WHEN len(list_filter(json_keys({v}), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0 THEN list_transform(list_sort(list_transform(json_keys({v}), lambda k: k::INTEGER)), lambda i: json_extract({v}, '$."' || i || '"')) ELSE [{v}] END WHEN 'NULL' THEN []::JSON[] ELSE [{v}] END"""


def _unpacked(v: str) -> str:
    """JSON text inside a JSON string, as JSON."""
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches(json_extract_string({v}, '$'), '^\\s*[\\[{{]') THEN json_extract_string({v}, '$')::JSON ELSE {v} END"


_BASE = f"""WITH raw AS (SELECT record_id, body::JSON AS j FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC, body DESC) AS p FROM catalog_raw) WHERE p = 1),
 top AS (SELECT record_id, {_unpacked("json_extract(j, '$.rules')")} AS rj, {_unpacked("json_extract(j, '$.requiredMods')")} AS mj FROM raw),
 rl AS (SELECT record_id, {_as_list('rj')} AS rs FROM top WHERE rj IS NOT NULL),
 ru AS (SELECT record_id, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS rule_no FROM rl),
 ls AS (SELECT record_id, -1 AS rule_no, 'requiredMods' AS list_name, mj AS v FROM top UNION ALL SELECT record_id, rule_no, n, CASE n WHEN 'conditions' THEN json_extract(r, '$.conditions') WHEN 'noiseConditions' THEN json_extract(r, '$.noiseConditions') ELSE json_extract(r, '$.requiredMods') END FROM ru CROSS JOIN (VALUES ('conditions'), ('noiseConditions'), ('requiredMods')) t(n) WHERE json_type(r) = 'OBJECT'),
 lt AS (SELECT record_id, rule_no, list_name, {_unpacked('v')} AS v FROM ls WHERE v IS NOT NULL),
 it AS (SELECT record_id, rule_no, list_name, {_as_list('v')} AS vs FROM lt),
 un AS (SELECT record_id, rule_no, list_name, unnest(vs) AS e, generate_subscripts(vs, 1) - 1 AS item_no FROM it),
 typed AS (SELECT DISTINCT ON (record_id) record_id, requiredMods AS mods, rules FROM biome_catalog ORDER BY record_id, loaded_at DESC),
 tr AS (SELECT record_id, unnest(rules) AS r, generate_subscripts(rules, 1) - 1 AS rule_no FROM typed),
 tl AS (SELECT record_id, rule_no, 'conditions' AS list_name, list_transform(r.conditions, lambda c: CASE WHEN c IS NULL THEN NULL ELSE c.variable END) AS v FROM tr WHERE r IS NOT NULL UNION ALL SELECT record_id, rule_no, 'noiseConditions', list_transform(r.noiseConditions, lambda c: CASE WHEN c IS NULL THEN NULL ELSE c.variable END) FROM tr WHERE r IS NOT NULL UNION ALL SELECT record_id, rule_no, 'requiredMods', r.requiredMods FROM tr WHERE r IS NOT NULL UNION ALL SELECT record_id, -1, 'requiredMods', mods FROM typed),
 tu AS (SELECT record_id, rule_no, list_name, unnest(v) AS item, generate_subscripts(v, 1) - 1 AS item_no FROM tl)
"""


def _number(v: str) -> str:
    return f"CASE WHEN json_type({v}) NOT IN ('BOOLEAN', 'NULL') THEN TRY_CAST(json_extract_string({v}, '$') AS DOUBLE) END"


def _flag(v: str) -> str:
    return f"CASE WHEN lower(trim(json_extract_string({v}, '$'))) IN ('true', 'false') THEN lower(trim(json_extract_string({v}, '$'))) = 'true' END"


def _field(o: str, n: str) -> str:
    return f"json_extract({o}, '$.{n}')"


_FLAGS = ("hardBoundary", "blendable", "river", "frozenRiver", "canGenerateOverworld")
_KNOWN = "'index', 'key', 'biome_index', 'biome_key', 'fallbackKey', 'kind', 'color', 'hardBoundary', 'blendable', 'river', 'frozenRiver', 'canGenerateOverworld', 'requiredMods', 'rules'"
P6 = {
    "p6_found": _BASE + """SELECT record_id, rule_no::INTEGER AS rule_no, list_name, item_no::INTEGER AS item_no, CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.variable') ELSE json_extract_string(e, '$') END AS item FROM un WHERE json_type(e) <> 'NULL'
UNION ALL SELECT record_id, rule_no::INTEGER, list_name, item_no::INTEGER, item FROM tu WHERE item IS NOT NULL""",
    "p6_mods": _BASE + """SELECT record_id, rule_no::INTEGER AS rule_no, item_no::INTEGER AS item_no, json_extract_string(e, '$') AS mod FROM un WHERE json_type(e) <> 'NULL' AND list_name = 'requiredMods'
UNION ALL SELECT record_id, rule_no::INTEGER, item_no::INTEGER, item FROM tu WHERE item IS NOT NULL AND list_name = 'requiredMods'""",
    "p6_rules": _BASE + f"""SELECT record_id, rule_no::INTEGER AS rule_no, json_extract_string(r, '$.zone') AS zone, round({_number(_field('r', 'rarity'))}, 4) AS rarity, {_flag(_field('r', 'override'))} AS override, NULL::VARCHAR AS extra FROM ru WHERE json_type(r) = 'OBJECT'
UNION ALL SELECT record_id, rule_no::INTEGER, r.zone, round(r.rarity::DOUBLE, 4), r.override, NULL FROM tr WHERE r IS NOT NULL""",
    "p6_conditions": _BASE + f"""SELECT record_id, rule_no::INTEGER AS rule_no, list_name, item_no::INTEGER AS item_no, CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.variable') ELSE json_extract_string(e, '$') END AS variable, json_extract_string(e, '$.op') AS op, {_number(_field('e', 'value'))} AS value, {_number(_field('e', 'value2'))} AS value2, {_flag(_field('e', 'bool'))} AS bool, NULL::VARCHAR AS extra FROM un WHERE json_type(e) <> 'NULL' AND list_name <> 'requiredMods'
UNION ALL SELECT record_id, rule_no::INTEGER, list_name, item_no::INTEGER, c.variable, c.op, c.value, c.value2, c.bool, NULL FROM (
  SELECT record_id, rule_no, 'conditions' AS list_name, unnest(r.conditions) AS c, generate_subscripts(r.conditions, 1) - 1 AS item_no FROM tr WHERE r IS NOT NULL
  UNION ALL SELECT record_id, rule_no, 'noiseConditions', unnest(r.noiseConditions), generate_subscripts(r.noiseConditions, 1) - 1 FROM tr WHERE r IS NOT NULL) WHERE c IS NOT NULL""",
    "p6_extras": _BASE + f"""SELECT record_id, -1::INTEGER AS rule_no, '' AS list_name, -1::INTEGER AS item_no, k AS field FROM (SELECT record_id, unnest(json_keys(j)) AS k FROM raw) WHERE k NOT IN ({_KNOWN})""",
    "p6_classes": f"""WITH raw AS (SELECT record_id, pack_id, body::JSON AS j FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC, body DESC) AS p FROM catalog_raw) WHERE p = 1)
SELECT record_id, pack_id, TRY_CAST(coalesce(json_extract_string(j, '$.biome_index'), json_extract_string(j, '$.index')) AS INTEGER) AS biome_index, coalesce(json_extract_string(j, '$.biome_key'), json_extract_string(j, '$.key')) AS biome_key, json_extract_string(j, '$.fallbackKey') AS "fallbackKey", json_extract_string(j, '$.kind') AS kind, TRY_CAST(json_extract_string(j, '$.color') AS INTEGER) AS color, {', '.join(f'{_flag(_field("j", n))} AS "{n}"' for n in _FLAGS)} FROM raw
UNION ALL SELECT * FROM (SELECT DISTINCT ON (record_id) record_id, pack_id, biome_index::INTEGER, biome_key, fallbackKey, kind, color, {', '.join(_FLAGS)} FROM biome_catalog ORDER BY record_id, loaded_at DESC)""",
}
