"""SQL twins of the queries here, where SQL can say them."""

_BASE = """WITH last AS (SELECT lower(trim(zone)) AS zone, list_distinct(list_filter(candidates, lambda x: x IS NOT NULL)) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY classified_at DESC, zone DESC NULLS LAST) AS r FROM classification_result)
  WHERE r = 1 AND zone IS NOT NULL AND candidates IS NOT NULL),
 tot AS (SELECT zone, count(*) AS n FROM last GROUP BY zone),
 long AS (SELECT zone, row_number() OVER () AS id, items FROM last),
 one AS (SELECT zone, id, unnest(items) AS i FROM long),
 cnt AS (SELECT zone, i, count(*) AS k FROM one GROUP BY ALL),
 prs AS (SELECT p.zone, p.i AS biome_a, q.i AS biome_b, count(*) AS x FROM one p JOIN one q ON p.id = q.id AND p.i < q.i GROUP BY ALL),
 f AS (SELECT prs.*, a.k AS a, b.k AS b, n FROM prs JOIN tot USING (zone) JOIN cnt a ON a.zone = prs.zone AND a.i = biome_a JOIN cnt b ON b.zone = prs.zone AND b.i = biome_b)
"""


def _h(k: str) -> str:
    return f"(CASE WHEN ({k}) > 0 THEN ({k}) * ln(({k})::DOUBLE) ELSE 0 END)"


_LLR = f"2 * ({_h('x')} + {_h('a - x')} + {_h('b - x')} + {_h('n - a - b + x')} + {_h('n')} - {_h('a')} - {_h('n - a')} - {_h('b')} - {_h('n - b')})"

SQL = {
    "p2_found": _BASE + "SELECT zone, biome_a, biome_b FROM f WHERE x >= 8 AND 200 * x >= n AND x * n >= 2 * a * b",
    "p2_pairs": _BASE + f"SELECT zone, biome_a, biome_b, x AS samples, round(x::DOUBLE * n / (a * b), 6) AS lift, round(greatest({_LLR}, 0), 3) AS llr FROM f",
    "p5_within": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY sampled_at DESC NULLS LAST, world_seed DESC NULLS LAST, temperatureC DESC NULLS LAST, precipitationMm DESC NULLS LAST) AS p FROM climate_samples) WHERE p = 1),
 k AS (SELECT sample_id, lower(trim(zone)) AS zone, biome_index FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY classified_at DESC NULLS LAST, zone DESC NULLS LAST, biome_index DESC NULLS LAST) AS p FROM classification_result) WHERE p = 1),
 j AS (SELECT zone, biome_index::VARCHAR AS biome, world_seed::VARCHAR AS world, temperatureC AS t, precipitationMm AS m FROM c LEFT JOIN k USING (sample_id)),
 v AS (SELECT zone, biome, world, 'temperatureC' AS metric, t AS x FROM j UNION ALL SELECT zone, biome, world, 'precipitationMm', m FROM j),
 ok AS (SELECT * FROM v WHERE x IS NOT NULL AND NOT isnan(x) AND x <> -9999),
 g AS (SELECT 'zone' AS "by", zone AS "key", metric FROM ok UNION ALL SELECT 'biome', biome, metric FROM ok UNION ALL SELECT 'world', world, metric FROM ok UNION ALL SELECT 'zone_biome_world', zone || '|' || biome || '|' || world, metric FROM ok)
SELECT "by", "key", metric, count(*) AS n, TRUE AS within FROM g WHERE "key" IS NOT NULL GROUP BY ALL""",
    "p9_covered": "SELECT doc_id, TRUE AS sound FROM documents WHERE regexp_matches(text, '\\S')",
    "p7_placed": "SELECT doc_id, count(*) AS copies, TRUE AS sound FROM documents GROUP BY doc_id",
}
