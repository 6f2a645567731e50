"""Queries over drainage operators (group J, and G09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import drainage, filling, flats, network
from gridloom.plans import grid, water_sql
from gridloom.runtime import cut

W = grid.WIDTH


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(spark, d)


def _links(spark: SparkSession, d: str) -> DataFrame:
    return cut(drainage.lowest_links(_cells(spark, d), "elev", W))


def j_links(spark: SparkSession, d: str) -> DataFrame:
    """The lowest strictly lower neighbour."""
    return drainage.lowest_links(_cells(spark, d), "elev", W)


def j_depth(spark: SparkSession, d: str) -> DataFrame:
    """Outlet and steps of every cell."""
    return drainage.depths(_links(spark, d), W)


def j_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """Runoff summed along the links."""
    g = grid.climate(spark, d).withColumn("run", scalar.col("runoff", elev="elev", temp="temp", precip="precip", pcv="pcv"))
    return drainage.accumulate(_links(spark, d), g, "run", W).select("cell", F.round("acc", 6).alias("acc"))


def j_fill(spark: SparkSession, d: str) -> DataFrame:
    """The filled surface, tile by tile, with the passages between tiles."""
    return filling.fill(_cells(spark, d)).select("r", "c", F.round("filled", 6).alias("filled"))


def j_flood(spark: SparkSession, d: str) -> DataFrame:
    """Exact priority flood, tile by tile of 25 x 25 cells; the last row of tiles may be short."""
    g = _cells(spark, d).withColumns({f"tile_{i}": F.floor(F.col(x) / 25) for i, x in (("i", "r"), ("j", "c"))})
    return drainage.flood_tiles(g, ["tile_i", "tile_j"]).select("r", "c", F.round("filled", 6).alias("filled"), "down_r", "down_c")


def j_flood_levels(spark: SparkSession, d: str) -> DataFrame:
    """The filled levels of ``j_flood``."""
    return j_flood(spark, d).select("r", "c", "filled")


def j_flood_rim(spark: SparkSession, d: str) -> DataFrame:
    """J01 with tiles of 40 x 40 cells and a rim of 12."""
    return drainage.flood_with_rim(_cells(spark, d), 40, 12).select("r", "c", F.round("filled", 6).alias("filled"), "down_r", "down_c")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return cut(c.join(filling.fill(c), ["r", "c"]))


def j_flats(spark: SparkSession, d: str) -> DataFrame:
    """Flat cells with their distances to the spill and from the inflow."""
    return flats.flat_distances(_filled(spark, d)).select((F.col("r") * W + F.col("c")).alias("cell"), "spill", "inflow")


def j_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Flat cells of each level in order of potential."""
    return flats.ranked(flats.flat_distances(_filled(spark, d)), W).select("cell", "potential", "place")


def j_route(spark: SparkSession, d: str) -> DataFrame:
    """Links over the filled surface, across flats."""
    return flats.route(_filled(spark, d), W)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    g = grid.climate(spark, d).select("cell", "r", "c", "elev", "temp", "precip", scalar.col("runoff", elev="elev", temp="temp", precip="precip", pcv="pcv").alias("load"), scalar.col("river_density", region="region").alias("density"), F.floor(F.col("elev") / 700).cast("int").alias("class_index"))
    return cut(g)


def j_drain(spark: SparkSession, d: str) -> DataFrame:
    """J23, first half: filled surface, links and flow of the whole grid."""
    return network.drain(_samples(spark, d), W, "load").select("cell", F.round("filled", 6).alias("filled"), "down", F.round("acc", 6).alias("acc"))


def j_network(spark: SparkSession, d: str) -> DataFrame:
    """With visible channels, sources, water bodies, lakes and radii."""
    n = network.network(_samples(spark, d), W, "load")
    return n.select("cell", "down", F.round("acc", 6).alias("acc"), "visible", "source", "body", F.round("lake", 6).alias("lake"), F.round("radius", 6).alias("radius"))


def j_tile(spark: SparkSession, d: str) -> DataFrame:
    """The compact canonical tile of the grid without its outermost two cells."""
    s = _samples(spark, d)
    h = s.agg(F.max("r")).first()[0] or 0
    return network.canonical_tile(s, W, (2, 2, h - 1, W - 2), 15.0, river=26, frozen=27, protected=[0, 3])


def j_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Coarse drainage tiles of 25 x 25 cells."""
    return network.coarse_tiles(_cells(spark, d), 25)


def g_injection(spark: SparkSession, d: str) -> DataFrame:
    """Where flow that crosses the west edge enters, five cells around each tenth row."""
    links, c = _links(spark, d), _cells(spark, d)
    inward = network.routes_inward(links, c.select("cell", F.col("c").alias("depth")), 2, 4)
    own = c.filter("c = 1").join(inward, "cell").select(F.lit("west").alias("side"), F.col("r").alias("position"), "cell", "elev", "inward")
    cross = c.filter("c = 0 and r % 10 = 0").select(F.col("r").alias("crossing"), F.lit("west").alias("side"), F.col("r").alias("position"))
    return network.injection_cells(cross, own, 5)


def j_meander(spark: SparkSession, d: str) -> DataFrame:
    """Centres moved sideways by noise (tangents: ``j_segments``)."""
    links, g = _links(spark, d), grid.climate(spark, d)
    centres = g.select("cell", (F.col("r") + 0.5).alias("row"), (F.col("c") + 0.5).alias("col"))
    m = network.meander(centres, links, g.select("cell", (F.col("precip") / 1000).alias("acc"), (F.col("pcv") / 20000).alias("slope")), W, 4242, 30.0)
    return m.select("cell", F.round("row", 8).alias("row"), F.round("col", 8).alias("col"))


def _watered(spark: SparkSession, d: str) -> DataFrame:
    g = grid.climate(spark, d)
    fill = filling.fill(_cells(spark, d))
    return cut(g.join(fill, ["r", "c"]).select("cell", "r", "c", "elev", "filled", "precip", (F.col("precip") / 1000).alias("acc"), scalar.col("river_density", region="region").alias("density")))


def j_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Water bodies and lakes."""
    c = _watered(spark, d)
    links = cut(flats.route(c, W))
    water = cut(drainage.bodies(c, links, W))
    lake = drainage.lakes(c, water)
    return water.join(lake, "cell", "left").select("cell", "body", F.round("throughflow", 6).alias("throughflow"), F.round("depth", 6).alias("depth"), F.round("lake", 6).alias("lake"))


def j_visible(spark: SparkSession, d: str) -> DataFrame:
    """Visible cells and the sources among them."""
    c = drainage.visible(_watered(spark, d).withColumn("acc", F.col("acc") / 4))
    links = drainage.lowest_links(_cells(spark, d), "elev", W)
    s = drainage.sources(c, links).withColumn("source", F.lit(True))
    return c.filter("visible").join(s, "cell", "left").select("cell", F.coalesce("source", F.lit(False)).alias("source"))


def j_upstream(spark: SparkSession, d: str) -> DataFrame:
    """Dominant inflow."""
    acc = grid.climate(spark, d).select("cell", F.floor(F.col("precip") / 100).alias("acc"))
    return drainage.dominant_upstream(_links(spark, d), acc).select("cell", "up")


def j_centres(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed channel centres."""
    links = _links(spark, d)
    acc = grid.climate(spark, d).select("cell", F.floor(F.col("precip") / 100).alias("acc"))
    ch = links.join(drainage.dominant_upstream(links, acc), "cell", "left")
    return drainage.smooth_centres(ch, W).select("cell", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"))


def j_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Channel discs and their merge."""
    g = grid.climate(spark, d).filter("precip > 1800")
    p = g.select((F.col("r") + 0.5).alias("row"), (F.col("c") + 0.5).alias("col"), F.col("elev").alias("surface"), scalar.col("channel_radius", flow="(precip / 3000)", elev="elev").alias("radius"), scalar.col("channel_load", flow="(precip / 1000)").alias("load"))
    s = drainage.stamp(cut(p))
    return s.select("r", "c", F.round("section", 6).alias("section"), F.round("surface", 6).alias("surface"), F.round("load", 6).alias("load"))


def g_inflow(spark: SparkSession, d: str) -> DataFrame:
    """Flow that crosses into a box."""
    c = grid.climate(spark, d).join(_links(spark, d), "cell").select("cell", "r", "c", "down", F.floor("precip").alias("acc"))
    return drainage.boundary_inflow(c, (2, 20, 8, 70))


QUERIES = {f.__name__: f for f in (j_links, j_depth, j_accumulate, j_fill, j_flood, j_flood_levels, j_flood_rim, j_flats, j_ranked, j_route, j_drain, j_network, j_tile, j_coarse, g_injection, j_meander, j_bodies, j_visible, j_upstream, j_centres, j_stamp, g_inflow)}

_OFF = "off_ AS (SELECT row_number() OVER (ORDER BY dr, dc) AS k, dr, dc FROM range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE NOT (dr = 0 AND dc = 0))"
_NB = "nb AS (SELECT a.cell, b.cell AS ncell, a.elev AS e, b.elev AS ne, k FROM cells a CROSS JOIN off_ JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc)"
_LINKS = f"{grid.CELLS_SQL}, {_OFF}, {_NB}, lk AS (SELECT cells.cell, n.ncell AS down FROM cells LEFT JOIN (SELECT cell, ncell, row_number() OVER (PARTITION BY cell ORDER BY ne, k) AS p FROM nb WHERE ne < e) n ON n.cell = cells.cell AND p = 1)"
_UP = "anc AS (SELECT cell AS src, cell AS top, 0 AS n FROM lk UNION ALL SELECT src, down, n + 1 FROM anc JOIN lk ON lk.cell = anc.top WHERE down IS NOT NULL)"
_CLIM_LINKS = f"{grid.CLIMATE_SQL}, {_OFF}, {_NB}, lk AS (SELECT cells.cell, n.ncell AS down FROM cells LEFT JOIN (SELECT cell, ncell, row_number() OVER (PARTITION BY cell ORDER BY ne, k) AS p FROM nb WHERE ne < e) n ON n.cell = cells.cell AND p = 1)"
_RUN = scalar.text("runoff", elev="elev", temp="temp", precip="precip", pcv="pcv")
SQL = {
    "j_links": f"WITH {_LINKS} SELECT cell, down FROM lk",
    "j_depth": f"WITH RECURSIVE {_LINKS}, {_UP} SELECT src AS cell, top AS root, n AS depth FROM anc JOIN lk ON lk.cell = anc.top WHERE down IS NULL",
    "j_accumulate": f"WITH RECURSIVE {_CLIM_LINKS}, {_UP} SELECT top AS cell, round(sum({_RUN}), 6) AS acc FROM anc JOIN climate ON climate.cell = src GROUP BY top",
    "j_upstream": f"WITH {_CLIM_LINKS} SELECT cell, up FROM (SELECT lk.down AS cell, lk.cell AS up, row_number() OVER (PARTITION BY lk.down ORDER BY floor(precip / 100) DESC, lk.cell) AS p FROM lk JOIN climate USING (cell) WHERE lk.down IS NOT NULL) WHERE p = 1",
    "g_inflow": f"WITH {_CLIM_LINKS}, x AS (SELECT lk.cell, down, r, c, floor(precip)::BIGINT AS acc, r >= 2 AND r < 8 AND c >= 20 AND c < 70 AS ins FROM lk JOIN climate USING (cell)) SELECT x.down AS cell, sum(x.acc)::BIGINT AS inflow FROM x JOIN x y ON y.cell = x.down WHERE NOT x.ins AND y.ins GROUP BY x.down",
    "j_stamp": f"""WITH {grid.CLIMATE_SQL}, p AS (SELECT r + 0.5 AS row, c + 0.5 AS col, elev AS surface, {scalar.text('channel_radius', flow='(precip / 3000)', elev='elev')} AS radius, {scalar.text('channel_load', flow='(precip / 1000)')} AS load FROM climate WHERE precip > 1800),
 d AS (SELECT *, sqrt(power(y + 0.5 - row, 2) + power(x + 0.5 - col, 2)) AS dist FROM p JOIN range(-20, (SELECT max(r) + 21 FROM climate)) a(y) ON y BETWEEN row - radius - 3 AND row + radius + 3 JOIN range(-20, 130) b(x) ON x BETWEEN col - radius - 3 AND col + radius + 3),
 e AS (SELECT *, least(greatest(1 - dist / greatest(0.55, radius + 0.35), 0), 1) AS q FROM d WHERE dist <= radius + 0.5), f AS (SELECT *, q * q * (3 - 2 * q) AS section FROM e WHERE q > 0)
SELECT y AS r, x AS c, round(max(section), 6) AS section, round(first(surface ORDER BY section DESC, surface), 6) AS surface, round(max(load), 6) AS load FROM f GROUP BY y, x""",
}
SQL |= water_sql.SQL
