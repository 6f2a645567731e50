"""Queries cover their whole input, against numpy on small tables."""

import datetime
import json

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.functions import hashing, noise, scalar
from gridloom.operators import filling, sites
from gridloom.plans import places


@pytest.fixture(scope="module")
def grid_dir(spark, tmp_path_factory):
    """Cells in rows of 100 with a short last row: 30 rows and 40 cells more. Returns the directory and the array."""
    d = tmp_path_factory.mktemp("grid")
    v = np.round(np.random.default_rng(1).uniform(0, 500, 3040), 2)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "event_id long, value double").write.parquet(str(d / "events.parquet"))
    a = np.full(3100, np.nan)
    a[:3040] = v * 10 - 200
    return str(d), a.reshape(31, 100)


def filled_by_sweeps(e):
    """The filled surface of one tile by plain repetition."""
    h, w = e.shape
    near = lambda i, j: [(a, b) for a in range(i - 1, i + 2) for b in range(j - 1, j + 2) if (a, b) != (i, j)]
    here = lambda a, b: 0 <= a < h and 0 <= b < w and not np.isnan(e[a, b])
    f = np.where(np.isnan(e), np.nan, np.inf)
    cells = [(i, j) for i in range(h) for j in range(w) if here(i, j)]
    seeds = {(i, j) for i, j in cells if e[i, j] <= 0 or not all(here(*x) for x in near(i, j))}
    for s in seeds:
        f[s] = e[s]
    while True:
        was = f.copy()
        for x in cells:
            if x not in seeds:
                f[x] = max(e[x], min(f[y] for y in near(*x)))
        if np.array_equal(was, f, equal_nan=True):
            return f


def test_flood_covers_every_tile(spark, grid_dir):
    d, e = grid_dir
    rows = entry.queries()["j_flood"](spark, d).collect()
    got = {(r.r, r.c): r for r in rows}
    assert len(rows) == len(got) == 3040
    for i in range(0, 31, 25):
        for j in range(0, 100, 25):
            t = e[i : i + 25, j : j + 25]
            want = filled_by_sweeps(t)
            for a, b in np.argwhere(~np.isnan(t)):
                r = got[i + a, j + b]
                assert r.filled == pytest.approx(want[a, b], abs=1e-6)
                if r.down_r >= 0:
                    assert max(abs(r.down_r - r.r), abs(r.down_c - r.c)) == 1 and r.down_r // 25 == i // 25 and r.down_c // 25 == j // 25
                    assert got[r.down_r, r.down_c].filled <= r.filled


def resized(e, target, extrapolate=False):
    def taps(n, t):
        at = (np.arange(t) + 0.5) * n / t - 0.5
        at = at if extrapolate else at.clip(0, n - 1)
        low = np.floor(at).clip(0, n - 2).astype(int)
        return low, at - low

    (y, fy), (x, fx) = taps(e.shape[0], target[0]), taps(e.shape[1], target[1])
    at = lambda a, b: e[np.ix_(y + a, x + b)]
    fy, fx = fy[:, None], fx[None, :]
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


@pytest.fixture(scope="module")
def full_dir(spark, tmp_path_factory):
    """13 full rows of 100 cells."""
    d = tmp_path_factory.mktemp("full")
    v = np.round(np.random.default_rng(2).uniform(0, 500, 1300), 2)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "event_id long, value double").write.parquet(str(d / "events.parquet"))
    return str(d), (v * 10 - 200).reshape(13, 100)


def collected(spark, name, d, shape):
    rows = entry.queries()[name](spark, d).collect()
    assert len(rows) == shape[0] * shape[1]
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.r, r.c] = r.elev
    return out


def test_resampling_covers_the_grid(spark, full_dir):
    d, e = full_dir
    assert np.allclose(collected(spark, "e_resize_extrapolated", d, (32, 330)), resized(e, (32, 330), True), atol=2e-6)
    inner = {(r.r, r.c): r.elev for r in entry.queries()["e_resize"](spark, d).collect()}
    want = resized(e, (32, 330))
    assert set(inner) == {(i, j) for i in range(3, 30) for j in range(4, 325)} and all(abs(v - want[k]) < 2e-6 for k, v in inner.items())
    i, j = np.arange(39) * 13 // 39, np.arange(250) * 100 // 250
    assert np.array_equal(collected(spark, "e_nearest", d, (39, 250)), e[np.ix_(i, j)])
    assert np.array_equal(collected(spark, "e_pad_crop", d, (14, 102)), np.pad(e, 1, "edge")[:14])
    low = np.array([[e[2 * a : 2 * a + 2, 2 * b : 2 * b + 2].mean() / 3 for b in range(50)] for a in range(7)])
    assert np.allclose(collected(spark, "e_pyramid", d, (13, 100)), e + resized(low, (13, 100)), atol=2e-6)


def differing(spark, name, d, keys):
    """Rows of a query that its SQL twin, run by DuckDB, does not give to the last digit, and the number of rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    want = {r[:keys]: r[keys:] for r in con.execute(entry.oracle_sql()[name]).fetchall()}
    got = {tuple(r)[:keys]: tuple(r)[keys:] for r in entry.queries()[name](spark, d).collect()}
    assert set(got) == set(want)
    return [k for k in want if got[k] != want[k]], len(want)


@pytest.fixture(scope="module")
def even_dir(spark, tmp_path_factory):
    """40 full rows of 100 cells: at half the size, many results lie on a half of the last digit."""
    d = tmp_path_factory.mktemp("even")
    v = np.round(np.random.default_rng(4).exponential(50, 4000), 2)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "event_id long, value double").coalesce(1).write.parquet(str(d / "events.parquet"))
    return str(d)


def test_pyramid_rounds_as_its_sql(spark, even_dir):
    assert differing(spark, "e_pyramid", even_dir, 2) == ([], 4000)


def test_conditioning_rounds_as_its_sql(spark, even_dir):
    assert differing(spark, "f_conditioning", even_dir, 2) == ([], 10 * 25 * 58)


def test_rounding_of_halves(spark):
    v = [1.0000005, -1.0000005, 0.0000015, 383.8421875, -64.6546875, 1e12, -2.5e-7, 5e-7, 0.0, 1e300, None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(v)), "i int, v double").select("i", scalar.rounded(F.col("v"), 6).alias("x")).orderBy("i").collect()]
    away = lambda x: np.copysign(np.floor(abs(x * 1e6) + 0.5), x) / 1e6
    assert got == [float(away(x)) for x in v[:9]] + [1e300, None]


def test_resize_has_no_value_beside_a_gap(spark, grid_dir):
    d, e = grid_dir
    got = {(r.r, r.c): r.elev for r in entry.queries()["e_resize_extrapolated"](spark, d).collect()}
    assert len(got) == 77 * 330 and got[76, 329] is None and got[70, 329] is not None and got[76, 0] is not None


def test_sites_reach_the_whole_raster(spark, tmp_path):
    v = np.round(np.random.default_rng(3).uniform(20, 500, 6000), 2)
    spark.createDataFrame([(100_000 + i, float(x)) for i, x in enumerate(v)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    ras = places._raster(spark, str(tmp_path))
    wide = sites.eligible(sites.feature_sites(sites.feature_table(spark, places.SEED), (0, 900, 99, 1200), cell=4), ras)
    want = sorted((r.feature, r.x, r.z) for r in wide.collect())
    got = sorted((r.feature, r.x, r.z) for r in entry.queries()["site_features"](spark, str(tmp_path)).collect())
    assert got == want and len(got) > 5 and min(z for _, _, z in got) >= 1000
    spans = [n for n, f in sites.FEATURES.items() if f.span]
    anchored = sites.opposing(wide.filter(F.col("feature").isin(spans)), ras)
    assert sorted((r.feature, r.x, r.z, r.bx, r.bz) for r in entry.queries()["site_anchors"](spark, str(tmp_path)).collect()) == sorted((r.feature, r.x, r.z, r.bx, r.bz) for r in anchored.collect())


def test_normals_of_every_cell(spark, full_dir):
    d, e = full_dir
    rows = entry.queries()["c_normals"](spark, d).collect()
    got = {(r.ty, r.tx, r.i, r.j): r.v for r in rows}
    assert len(rows) == len(got) == e.size * 16
    at = spark.createDataFrame([(0, 0), (7, 33), (12, 99)], "y long, x long")
    for r in at.select("y", "x", hashing.tile_seed(F.lit(99), F.col("y"), F.col("x")).alias("s")).collect():
        assert [got[r.y, r.x, k // 4, k % 4] for k in range(16)] == list(noise.normals(r.s, 16))


def test_upstream_of_all_missing_windows(spark, full_dir, tmp_path):
    d, e = full_dir
    held = [(i, j) for i in range(2) for j in range(20)]  # tiles of the upper rows only
    spark.read.parquet(f"{d}/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i * 20 + j, [0.0] * 64) for i, j in held], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    over = lambda n: [w for w in range(-3, n) if w * 6 - 2 < n and w * 6 + 6 > 0]
    tall = {w for r in range(13) for w in range(-3, 20) if w * 6 - 2 <= r * 4 < w * 6 + 6}
    gone = {(i, j) for i in tall for j in over(100)} - set(held)
    reads = lambda w: [u for u in range(-5, 50) if u * 12 <= w * 6 + 6 and u * 12 + 15 >= w * 6 - 3]
    want = {(a, b) for i, j in gone for a in reads(i) for b in reads(j)}
    rows = entry.queries()["f_upstream"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.w_i, r.w_j) for r in rows} == want


def test_class_and_condition_tables(spark, tmp_path):
    cond = "array<struct<variable string, op string, value double, value2 double, bool boolean>>"
    rule = f"array<struct<zone string, rarity float, override boolean, conditions {cond}, noiseConditions {cond}, requiredMods array<string>>>"
    flags = ("hardBoundary", "blendable", "river", "frozenRiver", "canGenerateOverworld")
    t = datetime.datetime(2025, 1, 1)
    rules = [None, ("LAND", 1.0, None, [None, ("slope", "between", 1.0, 2.0, None)], [], None)]
    typed = [(1, 3, 14, "a:b", None, "OCEAN", 7, *[True, False, None, False, True], None, rules, t), (2, 4, 5, "c:d", "e:f", None, None, *[None] * 5, [], None, t)]
    spark.createDataFrame(typed, f"record_id long, pack_id int, biome_index short, biome_key string, fallbackKey string, kind string, color int, {', '.join(f'{f} boolean' for f in flags)}, requiredMods array<string>, rules {rule}, loaded_at timestamp").write.parquet(str(tmp_path / "biome_catalog.parquet"))
    body = {"index": "38", "key": "g:h", "kind": "BEACH", "color": 9, "river": "true", "rules": {"zone": "X", "noiseConditions": [{"variable": "snowy", "op": "eq", "bool": False}, {"op": "lt", "value": "2.5", "seen": 1}], "when": None}, "note": ["x"]}
    spark.createDataFrame([(8, 6, t, json.dumps(body)), (9, 6, t, "{broken")], "record_id long, pack_id int, received_at timestamp, body string").write.parquet(str(tmp_path / "catalog_raw.parquet"))
    got = sorted(map(tuple, entry.queries()["p6_classes"](spark, str(tmp_path)).collect()))
    none = [None] * 5
    assert got == [(1, 3, 14, "a:b", None, "OCEAN", 7, True, False, None, False, True), (2, 4, 5, "c:d", "e:f", None, None, *none), (8, 6, 38, "g:h", None, "BEACH", 9, None, None, True, None, None), (9, 6, *none, *none)]
    rows = sorted(map(tuple, entry.queries()["p6_conditions"](spark, str(tmp_path)).collect()))
    assert rows == [(1, 1, "conditions", 1, "slope", "between", 1.0, 2.0, None, None), (8, 0, "noiseConditions", 0, "snowy", "eq", None, None, False, None), (8, 0, "noiseConditions", 1, None, "lt", 2.5, None, None, '{"seen": 1}')]
    extra = sorted(map(tuple, entry.queries()["p6_extra_values"](spark, str(tmp_path)).collect()))
    assert extra == [(8, -1, "", -1, "note", '["x"]'), (8, 0, "", -1, "when", "null"), (8, 0, "noiseConditions", 1, "seen", "1")]


def test_fill_follows_ways_of_any_length(spark):
    e = np.full((41, 41), 90.0)
    for k in range(1, 40, 2):  # one valley that winds through all rows and leaves at the last
        e[k, 1:40] = 10.0
        e[k + 1, 39 if k % 4 == 1 else 1] = 10.0
    e[40] = 90.0
    e[40, 1] = e[40, 39] = 20.0
    g = spark.createDataFrame([(i, j, float(e[i, j])) for i in range(41) for j in range(41)], "r long, c long, elev double")
    want = filled_by_sweeps(e)
    for side in (5, 128):
        got = {(r.r, r.c): r.filled for r in filling.fill(g, side=side, group=2).collect()}
        assert all(got[i, j] == want[i, j] for i in range(41) for j in range(41))
    assert filling.fill(g.limit(0)).count() == 0
