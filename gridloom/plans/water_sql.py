"""Longer SQL twins of the drainage queries: fill, flats, routing, flow, lakes and channel curves."""

from __future__ import annotations

from gridloom.functions import scalar
from gridloom.plans import grid
from gridloom.plans.scalars import _noise_sql

OFF = "off_ AS (SELECT row_number() OVER (ORDER BY dr, dc) AS k, dr, dc FROM range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE NOT (dr = 0 AND dc = 0))"
#: The filled surface by repeated relaxation from rim and sea.
FILL = f"""{OFF}, nx AS MATERIALIZED (SELECT a.cell AS src, b.cell AS dst, b.elev AS e FROM cells a CROSS JOIN off_ JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc),
 cn AS (SELECT src AS cell, count(*) AS n FROM nx GROUP BY src),
 fl(cell, lvl) USING KEY (cell) AS (SELECT cells.cell, elev FROM cells LEFT JOIN cn USING (cell) WHERE coalesce(n, 0) < 8 OR elev <= 0
   UNION (SELECT nx.dst, min(greatest(nx.e, fl.lvl)) AS lvl FROM fl JOIN nx ON nx.src = fl.cell LEFT JOIN recurring.fl o ON o.cell = nx.dst WHERE o.lvl IS NULL OR greatest(nx.e, fl.lvl) < o.lvl GROUP BY nx.dst))"""


def _steps(name: str, seed: str) -> str:
    """Steps inside flats from the cells with a flag."""
    return f"""{name}(cell, d) USING KEY (cell) AS (SELECT cell, 0 FROM fc WHERE {seed}
   UNION (SELECT fn.dst, min({name}.d + 1) AS d FROM {name} JOIN fn ON fn.src = {name}.cell AND fn.dl = fn.sl JOIN fc ON fc.cell = fn.dst LEFT JOIN recurring.{name} o ON o.cell = fn.dst WHERE o.d IS NULL OR {name}.d + 1 < o.d GROUP BY fn.dst))"""


FLATS = f"""{FILL}, ff AS MATERIALIZED (SELECT cells.cell, r, c, elev, lvl FROM cells JOIN fl USING (cell)),
 fn AS MATERIALIZED (SELECT a.cell AS src, a.lvl AS sl, a.elev AS se, b.cell AS dst, b.lvl AS dl, k FROM ff a CROSS JOIN off_ JOIN ff b ON b.r = a.r + dr AND b.c = a.c + dc),
 fc AS MATERIALIZED (SELECT src AS cell, bool_or(dl < sl) AS low, bool_or(dl > sl) AS high FROM fn WHERE se > 0 GROUP BY src HAVING bool_or(dl = sl)),
 {_steps('d1', 'low')}, {_steps('d2', 'high')}, fd AS (SELECT fc.cell, d1.d AS spill, d2.d AS inflow FROM fc LEFT JOIN d1 ON d1.cell = fc.cell LEFT JOIN d2 ON d2.cell = fc.cell),
 j1 AS (SELECT cell, lvl, spill, inflow, (r * {0x27D4EB2D} + c * {0x165667B1}) % 4294967296::HUGEINT AS h FROM fd JOIN ff USING (cell) WHERE spill IS NOT NULL), j2 AS (SELECT *, (xor(h, h >> 15) * {0x2545F491}) % 4294967296::HUGEINT AS g FROM j1),
 pt AS MATERIALIZED (SELECT cell, lvl, (24 * (3 * spill - coalesce(inflow, 0)) + ((xor(g, g >> 13) >> 8) % 24))::BIGINT AS pot FROM j2)"""
ROUTE = f"""{FLATS}, lw AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dl, k) AS p FROM fn WHERE dl < sl),
 sd AS (SELECT a.cell AS src, b.cell AS dst, row_number() OVER (PARTITION BY a.cell ORDER BY b.pot, b.cell) AS p FROM pt a JOIN fn ON fn.src = a.cell AND dl = sl JOIN pt b ON b.cell = fn.dst WHERE b.pot < a.pot OR (b.pot = a.pot AND b.cell < a.cell)),
 rt AS MATERIALIZED (SELECT ff.cell, coalesce(lw.dst, sd.dst) AS down FROM ff LEFT JOIN lw ON lw.src = ff.cell AND lw.p = 1 LEFT JOIN sd ON sd.src = ff.cell AND sd.p = 1)"""
_RUN = scalar.text("runoff", elev="elev", temp="temp", precip="precip", pcv="pcv")
DRAIN = f"""{grid.CLIMATE_SQL}, {ROUTE}, anc AS (SELECT cell AS src, cell AS top FROM rt UNION ALL SELECT src, down FROM anc JOIN rt ON rt.cell = anc.top WHERE down IS NOT NULL),
 dr AS MATERIALIZED (SELECT top AS cell, sum({_RUN}) AS acc FROM anc JOIN climate ON climate.cell = src GROUP BY top)"""


def _bodies(acc: str) -> str:
    """Water bodies over rt and a table (cell, acc): per wet cell its body, throughflow, depth and lake."""
    return f"""wt AS MATERIALIZED (SELECT ff.cell, elev, lvl, a.acc FROM ff JOIN {acc} a ON a.cell = ff.cell WHERE elev > 0 AND lvl > elev),
 wl AS MATERIALIZED (SELECT wt.cell, n.cell AS down FROM wt LEFT JOIN rt ON rt.cell = wt.cell LEFT JOIN wt n ON n.cell = rt.down AND n.lvl = wt.lvl),
 wa AS (SELECT cell AS src, cell AS top FROM wl UNION ALL SELECT src, down FROM wa JOIN wl ON wl.cell = wa.top WHERE down IS NOT NULL),
 wb AS (SELECT src AS cell, top AS body FROM wa JOIN wl ON wl.cell = wa.top WHERE down IS NULL),
 wg AS (SELECT body, max(acc) AS throughflow, max(lvl - elev) AS depth FROM wb JOIN wt USING (cell) GROUP BY body),
 wk AS (SELECT wb.cell, body, throughflow, depth, least(greatest(throughflow / 0.18, 0), 1) AS gate, lvl - elev AS d FROM wb JOIN wg USING (body) JOIN wt USING (cell)),
 bo AS (SELECT cell, body, throughflow, depth, CASE WHEN d >= 0.75 AND (gate > 0.05 OR depth >= 3) THEN d * (0.35 + 0.65 * gate) END AS lake FROM wk)"""


_DENSITY = scalar.text("river_density", region="region")
_BAR = f"0.16 / ({_DENSITY} * {scalar.text('precip_density', precip='precip')})"
_LK = """nb AS (SELECT a.cell, b.cell AS ncell, a.elev AS e, b.elev AS ne, k FROM cells a CROSS JOIN off_ JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc),
 lk AS MATERIALIZED (SELECT cells.cell, n.ncell AS down FROM cells LEFT JOIN (SELECT cell, ncell, row_number() OVER (PARTITION BY cell ORDER BY ne, k) AS p FROM nb WHERE ne < e) n ON n.cell = cells.cell AND p = 1)"""
_LINKED = f"{grid.CLIMATE_SQL}, {OFF}, {_LK}, dm AS MATERIALIZED (SELECT cell, up FROM (SELECT lk.down AS cell, lk.cell AS up, row_number() OVER (PARTITION BY lk.down ORDER BY floor(precip / 100) DESC, lk.cell) AS p FROM lk JOIN climate USING (cell) WHERE lk.down IS NOT NULL) WHERE p = 1)"


def _centres() -> str:
    parts = ["p0 AS (SELECT cell, down, up, floor(cell / 100) + 0.5 AS y, (cell % 100)::DOUBLE + 0.5 AS x FROM lk LEFT JOIN dm USING (cell))"]
    for i in range(3):
        pull = lambda v: f"CASE WHEN u.{v} IS NOT NULL AND d.{v} IS NOT NULL THEN a.{v} * 0.38 + u.{v} * 0.31 + d.{v} * 0.31 ELSE a.{v} END"
        near = lambda v, m: f"least(greatest({pull(v)}, {m} - 0.48), {m} + 0.48) AS {v}"
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT a.cell, a.down, a.up, {near('y', 'floor(a.cell / 100) + 0.5')}, {near('x', '(a.cell % 100)::DOUBLE + 0.5')} FROM p{i} a LEFT JOIN p{i} u ON u.cell = a.up LEFT JOIN p{i} d ON d.cell = a.down)")
    return ", ".join(parts)


def _segments() -> str:
    side = lambda v: f"CASE WHEN u.cell IS NOT NULL AND d.cell IS NOT NULL THEN (d.{v} - u.{v}) * 0.5 WHEN d.cell IS NOT NULL THEN d.{v} - a.{v} WHEN u.cell IS NOT NULL THEN a.{v} - u.{v} ELSE 0 END"
    curve = lambda v, t: f"CASE WHEN n = 0 THEN {v} ELSE (2 * s * s * s - 3 * s * s + 1) * {v} + (s * s * s - 2 * s * s + s) * {t} + (3 * s * s - 2 * s * s * s) * d_{v} + (s * s * s - s * s) * d_{t} END"
    return f"""q0 AS (SELECT climate.cell, r::DOUBLE + 0.5 AS y, c::DOUBLE + 0.5 AS x, precip / 1000 AS acc, elev AS sf, precip / 3000 AS rd, lk.down, dm.up FROM climate JOIN lk USING (cell) LEFT JOIN dm USING (cell)),
 q1 AS (SELECT a.*, {side('y')} AS ty, {side('x')} AS tx FROM q0 a LEFT JOIN q0 u ON u.cell = a.up LEFT JOIN q0 d ON d.cell = a.down),
 q2 AS MATERIALIZED (SELECT * REPLACE (ty * f AS ty, tx * f AS tx) FROM (SELECT *, CASE WHEN sqrt(ty * ty + tx * tx) > 1.35 THEN 1.35 / sqrt(ty * ty + tx * tx) ELSE 1 END AS f FROM q1)),
 q3 AS (SELECT a.*, d.y AS d_y, d.x AS d_x, d.ty AS d_ty, d.tx AS d_tx, d.acc AS d_acc, d.sf AS d_sf, d.rd AS d_rd, CASE WHEN d.cell IS NULL THEN 0 ELSE greatest(1, ceil(sqrt(power(d.y - a.y, 2) + power(d.x - a.x, 2)) / 0.2))::INT END AS n FROM q2 a LEFT JOIN q2 d ON d.cell = a.down),
 q4 AS (SELECT *, unnest(range(0, n + 1))::INT AS k FROM q3), q5 AS (SELECT *, CASE WHEN n > 0 THEN k / n ELSE 0 END AS s FROM q4)
SELECT cell, k, round({curve('y', 'ty')}, 6) AS row, round({curve('x', 'tx')}, 6) AS col, round(CASE WHEN n = 0 THEN acc ELSE acc + (d_acc - acc) * s END, 6) AS flow, round(CASE WHEN n = 0 THEN sf ELSE sf + (least(sf, d_sf) - sf) * s END, 6) AS surface, round(CASE WHEN n = 0 THEN rd ELSE rd + (d_rd - rd) * s END, 6) AS radius FROM q5"""


def _meander() -> str:
    n, last = _noise_sql("nz", "4242", "y", "x", "10.0", "m0", "mn")
    return f"""WITH {_LINKED}, m0 AS (SELECT climate.cell, r::DOUBLE + 0.5 AS y, c::DOUBLE + 0.5 AS x, precip / 1000 AS acc, pcv / 20000 AS sl, down FROM climate JOIN lk USING (cell)), {n},
 m1 AS (SELECT a.*, b.y - a.y AS dy, b.x - a.x AS dx, least(greatest((a.sl - 0.0008) / (0.018 - 0.0008), 0), 1) AS t FROM {last} a LEFT JOIN m0 b ON b.cell = a.down),
 m2 AS (SELECT *, 0.34 * (1 - t * t * (3 - 2 * t)) * (0.45 + 0.55 * (1 - least(greatest(acc / 8, 0), 1))) * nz / sqrt(dy * dy + dx * dx) AS sh FROM m1)
SELECT cell, round(least(greatest(coalesce(y - dx * sh, y), y - 0.48), y + 0.48), 8) AS row, round(least(greatest(coalesce(x + dy * sh, x), x - 0.48), x + 0.48), 8) AS col FROM m2"""


SQL = {
    "j_fill": f"WITH RECURSIVE {grid.CELLS_SQL}, {FILL} SELECT r, c, round(lvl, 6) AS filled FROM fl JOIN cells USING (cell)",
    "j_flood_levels": f"WITH RECURSIVE {grid.CELLS_SQL}, {FILL.replace('b.c = a.c + dc)', 'b.c = a.c + dc AND b.r // 25 = a.r // 25 AND b.c // 25 = a.c // 25)')} SELECT r, c, round(lvl, 6) AS filled FROM fl JOIN cells USING (cell)",
    "j_flats": f"WITH RECURSIVE {grid.CELLS_SQL}, {FLATS} SELECT cell, spill::BIGINT AS spill, inflow::BIGINT AS inflow FROM fd",
    "j_ranked": f"WITH RECURSIVE {grid.CELLS_SQL}, {FLATS} SELECT cell, pot AS potential, row_number() OVER (PARTITION BY lvl ORDER BY pot, cell) - 1 AS place FROM pt",
    "j_route": f"WITH RECURSIVE {grid.CELLS_SQL}, {ROUTE} SELECT cell, down FROM rt",
    "j_drain": f"WITH RECURSIVE {DRAIN} SELECT cell, round(lvl, 6) AS filled, down, round(acc, 6) AS acc FROM ff JOIN rt USING (cell) JOIN dr USING (cell)",
    "j_network": f"""WITH RECURSIVE {DRAIN}, vi AS MATERIALIZED (SELECT climate.cell, elev, elev > 0 AND acc >= {_BAR} AS v, acc FROM climate JOIN dr USING (cell)), {_bodies('dr')},
 fed AS (SELECT DISTINCT rt.down AS cell FROM rt JOIN vi USING (cell) WHERE v AND rt.down IS NOT NULL)
SELECT vi.cell, rt.down, round(vi.acc, 6) AS acc, v AS visible, v AND fed.cell IS NULL AS source, body, round(coalesce(lake, 0), 6) AS lake, CASE WHEN v THEN round({scalar.text('channel_radius', flow='vi.acc', elev='vi.elev')}, 6) END AS radius
FROM vi JOIN rt USING (cell) LEFT JOIN bo USING (cell) LEFT JOIN fed USING (cell)""",
    "j_bodies": f"WITH RECURSIVE {grid.CLIMATE_SQL}, {ROUTE}, ac AS (SELECT cell, precip / 1000 AS acc FROM climate), {_bodies('ac')} SELECT cell, body, round(throughflow, 6) AS throughflow, round(depth, 6) AS depth, round(lake, 6) AS lake FROM bo",
    "j_visible": f"""WITH {grid.CLIMATE_SQL}, {OFF}, {_LK}, v AS (SELECT cell FROM climate WHERE elev > 0 AND precip / 4000 >= {_BAR}), fed AS (SELECT DISTINCT down AS cell FROM lk JOIN v USING (cell) WHERE down IS NOT NULL)
SELECT v.cell, fed.cell IS NULL AS source FROM v LEFT JOIN fed USING (cell)""",
    "j_centres": f"WITH {_LINKED}, {_centres()} SELECT cell, round(y, 6) AS row, round(x, 6) AS col FROM p3",
    "j_segments": f"WITH {_LINKED}, {_segments()}",
    "j_meander": _meander(),
    "g_injection": f"""WITH {grid.CELLS_SQL}, {OFF}, {_LK}, a1 AS (SELECT a.cell, a.r, a.elev, a.c AS d0, b.c AS d1, lk2.down AS n2 FROM cells a LEFT JOIN lk ON lk.cell = a.cell LEFT JOIN cells b ON b.cell = lk.down LEFT JOIN lk lk2 ON lk2.cell = b.cell WHERE a.c = 1),
 a2 AS (SELECT a1.*, b.c AS d2, lk.down AS n3 FROM a1 LEFT JOIN cells b ON b.cell = n2 LEFT JOIN lk ON lk.cell = n2), a3 AS (SELECT a2.*, b.c AS d3, lk.down AS n4 FROM a2 LEFT JOIN cells b ON b.cell = n3 LEFT JOIN lk ON lk.cell = n3), a4 AS (SELECT a3.*, b.c AS d4 FROM a3 LEFT JOIN cells b ON b.cell = n4),
 ok AS (SELECT cell, r, elev FROM a4 WHERE greatest(d0, coalesce(d1, 0), coalesce(d2, 0), coalesce(d3, 0), coalesce(d4, 0)) >= 2)
SELECT x.r AS crossing, arg_min(ok.cell, (ok.elev, ok.r)) AS cell FROM cells x JOIN ok ON abs(ok.r - x.r) <= 5 WHERE x.c = 0 AND x.r % 10 = 0 GROUP BY x.r""",
}
