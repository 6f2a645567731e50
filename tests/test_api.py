"""The query surface on small tables."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from gridloom import api
from gridloom.rules import catalog as cat
from gridloom.sources import stores
from gridloom.streaming import tiles


def coarse(spark):
    rows = [(i, j, 3.0 * (i - 1), 1.0, 10.0 + j, 1.0, 500.0, 20.0, 2.0 if (i, j) != (0, 0) else 0.0) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "r long, c long, elev double, p5 double, temp double, t_std double, precip double, precip_cv double, w double")


def test_coarse_views(spark):
    c = coarse(spark)
    assert {(r.r, r.c): r.v for r in api.coarse_channel(c, "elev").collect()}[2, 1] == 2.25
    assert json.loads(api.coarse_data(c, "temp").first().json)[1] == [5.0, 5.5, 6.0]
    assert {r.channel: (r.lo, r.hi) for r in api.coarse_stats(c).collect()}["temp"] == (0.0, 6.0)
    v = {(r.r, r.c): r for r in api.coarse_view(c, "temp", {"temp": (5.0, 5.5)}).collect()}
    assert v[2, 2]["index"] == 255 and v[0, 0]["index"] == 0 and v[1, 1].match and not v[1, 2].match


def test_generate_and_preview(spark, tmp_path):
    c = cat.sample()
    new = api.generate(c, "loam:new", "lowland", {"temperatureC": (5.0, 9.0), "treeCoverage": (0.3, 0.9)}, "rare", ("variantNoise", 0.3))
    assert new.index == 27 and new.rules[0].weight == 0.2 and new.fallback == "loam:forest"
    p = str(tmp_path / "cat.json")
    assert api.apply(spark, c, new, p).classes[-1] == new and cat.load([p], c.loaded).classes[-1] == new
    bad = api.generate(c, "loam:bad", "lowland", {"treeCoverage": (0.4, 0.5)})
    assert api.preview(spark, c, bad).first().severity == "dead"
    try:
        api.apply(spark, c, bad, p)
        raise AssertionError
    except ValueError:
        pass


def test_lift_numbers():
    assert json.loads(api.lift_numbers('{"y": {"min": 1, "on": true}, "z": [2], "w": {"y": 3}}', frozenset({"y"}), 10)) == {"y": {"min": 11, "on": True}, "z": [2], "w": {"y": 13}}


def test_report(spark):
    text = api.report({"T": spark.range(3).withColumn("k", F.lit("a"))}, 2)
    assert text.count("| a |") == 2


def test_tiles_from_a_stream(spark, tmp_path):
    row = lambda i, e: [(5, 1, i, 0, r, c, e, 0, None, 3) for r in range(2) for c in range(2)]
    ddl = "seed long, scale int, tile_i int, tile_j int, r int, c int, elev short, mask short, surface short, class short"
    for k, rows in enumerate((row(0, 7) + row(1, 8), row(1, 99) + row(2, 9) + row(2, 9))):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = tiles.tile_sink(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), str(tmp_path / "store"), tmp_path / "at", once=True)
        q.awaitTermination()
    got = stores.read_tiles(spark, str(tmp_path / "store"), 5, 1, (0, 0, 6, 2), 2)
    assert sorted((r.tile_i, r.elev) for r in got.collect()) == [(0, 7)] * 4 + [(1, 8)] * 4 + [(2, 9)] * 4


def test_pictures_and_planes(spark):
    df = spark.createDataFrame([(1, 3, 5, 255, 0, 0, 255), (1, 4, 6, 0, 300, 0, 128)], "k int, r long, c long, red int, green int, blue int, alpha int")
    p = stores.pictures(df, ["k"], "red", "green", "blue", "alpha").first()
    assert (p.height, p.width) == (2, 2) and p.png[:8] == b"\x89PNG\r\n\x1a\n"
    at = p.png.index(b"IDAT")
    raw = zlib.decompress(p.png[at + 4 : at + 4 + struct.unpack(">I", p.png[at - 4 : at])[0]])
    assert raw == bytes([0, 255, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 255, 0, 128])
    cells = spark.createDataFrame([(1, 0, 0, -3, 7, None, 200), (1, 0, 1, 4, 8, 5, 0)], "k int, r long, c long, elev int, class int, surface int, mask int")
    d = stores.raw_details(cells, ["k"]).first()
    assert d.data == struct.pack("<6h2B", -3, 4, 7, 8, 0, 5, 200, 0) and d.layout.startswith("elev:<i2")
    assert stores.pictures(df.limit(0), ["k"], "red", "green", "blue", "alpha").count() == 0


def test_names_and_captures(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert stores.registered(spark, "three_rows", build) is stores.registered(spark, "three_rows", build) and spark.table("three_rows").count() == 3
    for _ in range(2):
        assert stores.captured(spark, str(tmp_path / "c"), build).count() == 3
    assert len(made) == 2
