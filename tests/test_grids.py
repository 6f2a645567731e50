"""Grid, noise, drainage, site and store operators against numpy and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hashing, noise, scalar
from gridloom.operators import drainage, filling, flats, focal, network, sites, stats, tensor
from gridloom.rules import catalog as cat
from gridloom.rules import checks
from gridloom.rules import compile as comp
from gridloom.sources import stores


def frame(spark, a, name="elev"):
    h, w = a.shape
    return spark.createDataFrame([(i * w + j, i, j, float(a[i, j])) for i in range(h) for j in range(w)], f"cell long, r long, c long, {name} double")


def array(rows, shape, name):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["r"], r["c"]] = np.nan if r[name] is None else r[name]
    return out


def terrain(seed, n=14):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, n)).cumsum(0).cumsum(1) * 20 + 50, 3)


def test_hash_matches_python(spark):
    pts = [(0, 0), (1, -1), (-7, 12345), (2**31 - 1, -(2**31))]
    df = spark.createDataFrame(pts, "x long, z long")
    got = [r.h for r in hashing.with_hash(df, h=(-5, "x", "z")).collect()]

    def one(seed, x, z, m=(1 << 64) - 1):
        v = (seed & m) ^ (x * hashing.LATTICE_X & m) ^ (z * hashing.LATTICE_Z & m)
        for s, k in ((30, hashing.MIX_A), (27, hashing.MIX_B)):
            v = (v ^ (v >> s)) * k & m
        v ^= v >> 31
        return v - (1 << 64) if v >> 63 else v

    assert got == [one(-5, x, z) for x, z in pts]
    assert [int(v) for v in hashing.np_hash(-5, *np.array(pts).T).astype(np.int64)] == got


def test_flood_invariants_and_fixpoint(spark):
    for seed in (1, 2):
        e = terrain(seed)
        filled, down, order = drainage.flood(e)
        flat = filled.ravel()
        assert (filled >= e).all() and len(order) == e.size
        assert all(flat[i] >= flat[d] for i, d in enumerate(down) if d >= 0)
        for side, group in ((4, 2), (9, 2), (128, 8)):
            got = array(filling.fill(frame(spark, e), side=side, group=group).collect(), e.shape, "filled")
            assert np.allclose(got, filled)


def test_flats_by_tiles_and_routes(spark):
    e = np.round(terrain(5), -1)
    e[3:9, 2:11] = 50.0
    g = frame(spark, e)
    filled = drainage.flood(e)[0]
    d = frame(spark, filled, "filled").join(g.select("cell", "elev"), "cell")
    wide = sorted(map(str, flats.flat_distances(d).collect()))
    assert wide == sorted(map(str, flats.flat_distances(d, side=3).collect()))
    down = {r.cell: r.down for r in flats.route(d, e.shape[1], side=5).collect()}
    flat = filled.ravel()
    for cell in down:
        seen, at = set(), cell
        while down[at] is not None:
            assert at not in seen and flat[down[at]] <= flat[at]
            seen.add(at)
            at = down[at]
        r, c = divmod(at, e.shape[1])
        assert r in (0, e.shape[0] - 1) or c in (0, e.shape[1] - 1) or e[r, c] <= 0 or flat[at] <= 0
    n = {r.cell: r for r in network.drain(g.withColumn("one", F.lit(1.0)), e.shape[1], "one").collect()}
    assert sum(r.acc for r in n.values() if r.down is None) == e.size


def test_flood_rim(spark):
    e = terrain(6)
    g = frame(spark, e)
    got = array(drainage.flood_with_rim(g, 7, max(e.shape)).collect(), e.shape, "filled")
    assert np.allclose(got, drainage.flood(e)[0])
    own = drainage.flood_with_rim(g, 7, 0).collect()
    assert len(own) == e.size and all(r.filled >= e[r.r, r.c] for r in own)


def test_coarse_tiles_and_injection(spark, tmp_path):
    e = terrain(7)
    t = network.coarse_tiles(frame(spark, e), 8)
    rows = t.collect()
    assert len(rows) == e.size and all(r.downstream != r.cell for r in rows)
    per = {}
    for r in rows:
        if r.downstream < 0:
            per[r.tile_i, r.tile_j] = per.get((r.tile_i, r.tile_j), 0) + r.accumulation
    assert sum(per.values()) == e.size
    stores.write_drainage(t.withColumns({"seed": F.lit(5), "scale": F.lit(1)}), str(tmp_path / "d"))
    back = stores.read_drainage(spark, str(tmp_path / "d"), 5, 1, [(0, 1)])
    assert sorted((r.cell, r.downstream) for r in back.collect()) == sorted((r.cell, r.downstream) for r in rows if (r.tile_i, r.tile_j) == (0, 1))
    cross = spark.createDataFrame([(1, "west", 5), (2, "west", 50), (3, "east", 5)], "crossing int, side string, position int")
    cand = spark.createDataFrame([("west", 3, 30, 7.0, True), ("west", 4, 40, 1.0, False), ("west", 8, 80, 7.0, True), ("east", 9, 90, 1.0, True)], "side string, position int, cell int, elev double, inward boolean")
    assert {(r.crossing, r.cell) for r in network.injection_cells(cross, cand, 3).collect()} == {(1, 30)}


def test_flood_tiles_do_not_depend_on_partitions(spark):
    g = frame(spark, terrain(3, 12)).withColumns({"ti": F.floor(F.col("r") / 6), "tj": F.floor(F.col("c") / 6)})
    a = sorted(map(tuple, drainage.flood_tiles(g, ["ti", "tj"]).collect()))
    assert a == sorted(map(tuple, drainage.flood_tiles(g.repartition(7), ["ti", "tj"]).collect()))


def test_accumulation_is_conserved(spark):
    e = terrain(4)
    g = frame(spark, e)
    links = drainage.lowest_links(g, "elev", e.shape[1])
    acc = {r.cell: r.acc for r in drainage.accumulate(links, g.withColumn("one", F.lit(1.0)), "one", e.shape[1]).collect()}
    roots = [r.cell for r in links.collect() if r.down is None]
    assert sum(acc[k] for k in roots) == e.size


def test_resize_and_blur_keep_constants(spark):
    g = frame(spark, np.full((5, 6), 3.5))
    assert {round(r.elev, 9) for r in focal.resize(g, "elev", (5, 6), (11, 13)).collect()} == {3.5}
    assert {round(r.b, 9) for r in focal.blur(g, "elev", focal.gaussian_kernel(1.5), "b").collect()} == {3.5}


def test_lapse_recovers_slope(spark):
    i, j = np.mgrid[:15, :15]
    e = 2500.0 + 10 * (i * 15 + j)
    g = frame(spark, e).withColumn("temp", 15 + 0.005 * (F.col("elev") - 2500)).withColumn("cap", F.lit(0.024))
    r = focal.lapse(g, "temp", "elev", half=7, cap="cap").filter("beta is not null").collect()
    assert len(r) == 1 and abs(r[0].beta - 0.005) < 1e-6 and abs(r[0].baseline - 2.5) < 1e-2


def test_perlin_basics():
    x = np.arange(-5, 6).astype(float)
    assert np.allclose(noise.perlin(7, x, x), 0)
    g = np.random.default_rng(0).uniform(-1e3, 1e3, (2, 20000))
    v = noise.FIELDS["variant"].at(*g)
    assert abs(v).max() <= 1.1 and abs(v.mean()) < 0.05 and len(noise._GRAD) == 128
    assert np.allclose(np.hypot(*noise._GRAD.T), 1)


def test_field_set_equals_numpy(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in range(0, 900, 211) for b in range(-700, 300, 333)], "x double, z double")
    rows = df.select("x", "z", noise.field_set(["variant", "region_warped"], "x", "z").alias("f")).collect()
    x, z = np.array([[r.x, r.z] for r in rows]).T
    assert np.allclose([r.f.variant for r in rows], noise.FIELDS["variant"].at(x, z))
    assert np.allclose([r.f.region_warped for r in rows], noise.region(x, z))


def test_normals_are_standard():
    v = noise.normals(42, 4001)
    assert len(v) == 4001 and abs(v.mean()) < 0.05 and abs(v.std() - 1) < 0.05 and np.array_equal(v[:10], noise.normals(42, 10))


def test_overlap_add_of_ones(spark):
    w = tensor.Windows(4, 2, -1)
    t = spark.createDataFrame([(i, j, [1.0] * 16) for i in range(4) for j in range(4)], "w_i long, w_j long, tile array<double>")
    got = array(tensor.overlap_add(t, w, (2, 2, 6, 6)).collect(), (7, 7), "v")
    assert (got[2:6, 2:6] == 4).all()
    with pytest.raises(ValueError):
        w.over(5, 5)


def test_batches_are_padded(spark):
    seen = spark.createDataFrame([(k,) for k in range(7)], "w_i long").coalesce(1)

    def f(d):
        assert len(d) == 4
        return d.assign(n=len(d))

    assert sorted(r.w_i for r in tensor.compute_batched(seen, f, "w_i long, n long", 4).collect()) == list(range(7))


def test_catalog_round_trip(tmp_path):
    c = cat.sample()
    p = str(tmp_path / "c.json")
    assert cat.save(c, p) is None and cat.save(c, p).startswith(p)
    again = cat.load([str(tmp_path / "none.json"), p], c.loaded)
    assert again.classes == c.classes
    assert [n for n, _, _ in again.rules()] == [n for n, _, _ in c.rules()]
    assert not any(k.key == "amber:grove" for _, k, _ in c.rules())


def test_predicate_edge_cases(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, True), (None, False)], "temperatureC double, snowy boolean")
    C = cat.Condition
    take = lambda c: [r[0] for r in df.select(comp.predicate(c, set(df.columns))).collect()]
    assert take(C("temperatureC", "gt", 0.5)) == [False, True, False]
    assert take(C("temperatureC", "lt")) == [False, False, False]
    assert take(C("temperatureC", None, 1.0)) == [False] * 3
    assert take(C("snowy", "eq", flag=False)) == [True, False, True]
    assert take(C("slope", "eq", flag=False)) == [True] * 3


def test_selection_share_follows_weight(spark):
    rng = np.random.default_rng(5)
    m = [(0, 3, 1.0, False), (1, 8, 3.0, False)]
    df = spark.createDataFrame([(float(a), float(b), m) for a, b in rng.uniform(-4e6, 4e6, (6000, 2))], f"x double, z double, matches {comp.MATCH_DDL}")
    share = np.mean([r.class_index == 8 for r in comp.select(df, "x", "z", 1, [3, 8]).collect()])
    assert abs(share - 0.75) < 0.03


def test_exact_percentiles(spark):
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(size=3000), np.zeros(2000)]
    rows = [(k % 3 if k % 7 else None, float(x), None if k % 2 else float(k)) for k, x in enumerate(v)] + [(9, float("nan"), None), (None, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double").withColumns({"n": F.lit(1), "cut": F.lit(2.0)})
    cuts = [0.0, 0.05, 0.5, 0.61, 1.0]
    for accuracy in (100, 10_000):
        got = {(r.g, r.variable, r.cut): r.value for r in stats.exact_percentiles(df, ["g"], ["x", "y"], cuts, accuracy=accuracy).collect()}
        for g in (0, 1, 2, None):
            for i, name in ((1, "x"), (2, "y")):
                own = [r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
                assert np.allclose([got[g, name, c] for c in cuts], np.quantile(own, cuts), atol=1e-12)
        assert (9, "x", 0.5) not in got
    assert stats.exact_percentiles(df.limit(0), ["g"], ["x"], cuts).count() == 0


def test_fitted_weights_move_shares(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), [(0, 1, 1.0, False), (1, 2, 1.0, False)]) for a, b in rng.uniform(-3e6, 3e6, (1500, 2))]
    df = spark.createDataFrame(rows, f"x double, z double, matches {comp.MATCH_DDL}")
    w = checks.fit_weights(df, "matches", {1: 0.8, 2: 0.2}, [1, 2], x="x", z="z", rounds=8)
    assert w[1] / w[2] > 2.5


def test_stores(spark, tmp_path):
    rows = [(5, 1, i, j, r, c, i + r, 0, None, 3) for i in range(2) for j in range(2) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "seed long, scale int, tile_i int, tile_j int, r int, c int, elev short, mask short, surface short, class short")
    p = str(tmp_path / "tiles")
    stores.write_tiles(df, p)
    got = stores.read_tiles(spark, p, 5, 1, (2, 1, 5, 4), 3).collect()
    assert len(got) == 9 and {(r.r, r.c) for r in got} == {(a, b) for a in range(2, 5) for b in range(1, 4)}
    e = np.arange(6).reshape(2, 3)
    data = stores.encode_tile(e, e, e, -e, 5, 1)
    assert (stores.decode_tile(data, 5, 1)["surface"] == -e).all()
    assert stores.decode_tile(data[:-1], 5, 1) is None and stores.decode_tile(data, 6, 1) is None
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.bin").write_bytes(data)
    (tmp_path / "bin" / "b.bin").write_bytes(b"broken")
    assert stores.read_binary_tiles(spark, str(tmp_path / "bin"), 5, 1).count() == 6


def test_anchor_search_against_loop(spark):
    rng = np.random.default_rng(8)
    e = np.round(rng.uniform(20, 90, (40, 40)), 2)
    ras = frame(spark, e).select(F.col("c").alias("x"), F.col("r").alias("z"), "elev", F.lit(9.0).alias("slope"), F.lit("k:mesa").alias("key"), F.lit(False).alias("river"))
    t = sites.feature_table(spark, 3, ["arch"])
    el = sites.eligible(sites.feature_sites(t, (0, 0, 39, 39), cell=4), ras)
    got = {(r.x, r.z): (r.bx, r.bz) for r in sites.opposing(el, ras).collect()}
    want = {}
    unit = lambda s, x, z: float(int(hashing.np_hash(s, np.array([x]), np.array([z]))[0]) >> 40) / 16777216
    for r in el.collect():
        best = None
        for i in range(10):
            a = unit(r.site, 0, 0) * 2 * np.pi + 2 * np.pi * i / 10
            span = 6 + int(unit(r.site, i, 7) * 5)
            bx, bz = r.x + int(np.floor(np.cos(a) * span + 0.5)), r.z + int(np.floor(np.sin(a) * span + 0.5))
            if not (0 <= bx < 40 and 0 <= bz < 40):
                continue
            eb, em = e[bz, bx], e[int((r.z + bz) / 2), int((r.x + bx) / 2)]
            dip = (r.elev + eb) / 2 - em
            if abs(eb - r.elev) <= 30 and dip >= 45 and (best is None or dip > best[0]):
                best = (dip, bx, bz)
        if best:
            want[r.x, r.z] = best[1:]
    assert got == want


def test_interp_clamps(spark):
    e = scalar.interp("x", [(0.0, 1.0), (2.0, 5.0)])
    assert [r[0] for r in spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,), (9.0,)], "x double").selectExpr(e).collect()] == [1, 1, 3, 5, 5]
