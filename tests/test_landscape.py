"""Terrain assemblies and rule repairs against numpy and invariants."""

import colorsys

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import noise, text
from gridloom.operators import terrain
from gridloom.rules import catalog as cat
from gridloom.rules import checks
from gridloom.rules import compile as comp


def frame(spark, a, name="elev"):
    h, w = a.shape
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(h) for j in range(w)], f"r long, c long, {name} double")


def plane(rows, shape, name="elev"):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["r"], r["c"]] = r[name]
    return out


def test_quads_repeat_edges(spark):
    a = np.arange(12.0).reshape(3, 4)
    pts = spark.createDataFrame([(-0.5, -0.5), (0.25, 1.5), (2.5, 3.5), (-0.5, 2.5), (1.5, -0.75)], "y double, x double").withColumn("quad", F.lit("clash"))
    got = [r.v for r in terrain.bilinear_at(pts, "y", "x", frame(spark, a, "v"), ["v"]).orderBy("y", "x").collect()]
    assert np.allclose(sorted(got), sorted([0.0, 0.25 * 4 + 1.5, 11.0, 2.5, 6.0]))


def test_strided_field(spark):
    f = noise.Field(4711, 1 / 900, 2)
    cells = frame(spark, np.zeros((9, 70)))
    got = plane(terrain.strided(cells, f, 8, "v").collect(), (9, 70), "v")
    for r, c in ((0, 0), (8, 64), (3, 37), (7, 63)):
        y, x = divmod(r, 8), divmod(c, 8)
        at = lambda a, b: f.at(np.array([(x[0] + b) * 8.0]), np.array([(y[0] + a) * 8.0]))[0]
        fy, fx = y[1] / 8, x[1] / 8
        assert abs(got[r, c] - ((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy)) < 1e-12


def test_detail_spares_water_and_shores(spark):
    e = np.add.outer(np.arange(40.0) * 40 - 300, np.arange(30.0))
    got = plane(terrain.add_detail(frame(spark, e), 5, 30.0).collect(), e.shape)
    assert np.array_equal(got[e < 0], e[e < 0]) and not np.allclose(got[e > 100], e[e > 100])
    assert (np.abs(got - e)[(e >= 0) & (e < 25)] <= np.abs(got - e).max()).all()
    assert len({f.seed for f in terrain.detail_fields(5).values()}) == 6 and terrain.detail_fields(5) != terrain.detail_fields(6)


def test_elevation_of_even_bands(spark):
    flat = lambda h, w, v: frame(spark, np.full((h, w), v), "v").withColumn("w", F.lit(2.0))
    got = plane(terrain.elevation(flat(12, 16, -0.5), flat(6, 8, 4.0), (12, 16), (6, 8), (1, 1, 11, 15), stats=(0.5, 2.0, 1.0, 3.0)).collect(), (10, 14))
    assert np.allclose(got, (2.0 * 3 + 1.0) ** 2)  # the residual is 0 once it is denormalised


def test_synthetic_stays_in_its_tables(spark):
    names = ("elev", "temp", "t_std", "precip", "pcv")
    fields = {n: noise.Field(k, 1 / 20, 2) for k, n in enumerate(names)}
    data = {"elev": [-100.0, 900.0], "temp": [0.0, 30.0], "t_std": [50.0, 900.0], "precip": [0.0, 2000.0], "pcv": [10.0, 90.0]}
    rows = terrain.synthetic(frame(spark, np.zeros((20, 20))).drop("elev"), fields, {n: [-1.0, 1.0] for n in names}, data, (-8.0, 300.0, 60.0, 800.0)).collect()
    assert all(-10 <= r.elev <= 30 and -10 <= r.temp <= 40 and r.t_std >= 20 and 0 <= r.precip <= 2000 and 0 <= r.pcv <= 90 for r in rows)
    assert terrain.synthetic(frame(spark, np.zeros((1, 1))).limit(0), fields, {n: [-1.0, 1.0] for n in names}, data, (-8.0, 300.0, 60.0, 800.0)).count() == 0


def test_colour_of_a_key(spark):
    for key in ("loam:plain", "", "amber:grove", "x" * 300):
        h = 0
        for ch in key:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        want = [int(v * 255 + 0.5) for v in colorsys.hsv_to_rgb((h & 0xFFFF) / 0xFFFF, 0.55, 0.85)]
        got = spark.createDataFrame([(key,)], "k string").select(text.key_colour(F.col("k"))).first()[0]
        assert np.abs(np.array([got >> 16, got >> 8 & 255, got & 255]) - want).max() <= 1


def test_widening_one_condition_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(float(t), float(a), bool(s)) for t, a, s in zip(rng.uniform(0, 30, 4000), rng.uniform(0, 3, 4000), rng.random(4000) < 0.5)]
    df = spark.createDataFrame(rows, "temperatureC double, aridity double, snowy boolean")
    C = cat.Condition
    rule = cat.Rule("lowland", conditions=(C("temperatureC", "gt", 29.5), C("aridity", "between", 1.0, 1.2), C("snowy", "eq", flag=True)))
    fixed, rate = checks.widen_greedily(df, rule, 0.05)
    assert rate >= 0.05 - 1e-3 and fixed[0].variable == "temperatureC" and fixed[0].value < 29.5
    got = df.select(F.avg(comp.rule_predicate(cat.Rule("lowland", conditions=tuple(checks.with_conditions(rule, fixed).conditions)), set(df.columns)).cast("int"))).first()[0]
    assert abs(got - rate) < 1e-9
    same, rate = checks.widen_greedily(df, cat.Rule("lowland", conditions=(C("snowy", "eq", flag=True),)), 0.9)
    assert same == [] and 0.4 < rate < 0.6


def test_provinces(spark):
    c = cat.sample()
    gated = checks.assign_provinces(c, {"loam:plain": "east", "loam:birch_forest": "west", "loam:meadow": "west"}, {"east": cat.Condition("regionNoise", "gt", 0.1), "west": cat.Condition("regionNoise", "lt", -0.1)}, replace_gates={"loam:meadow"})
    by = {x.key: x for x in gated.classes}
    assert all(r.noise == (cat.Condition("regionNoise", "gt", 0.1),) for r in by["loam:plain"].rules) and by["loam:plain"].rules[1].weight == 0.3
    assert by["loam:birch_forest"] == next(x for x in c.classes if x.key == "loam:birch_forest")  # its own gate stays
    assert by["loam:meadow"].rules[0].noise[0].op == "lt"
