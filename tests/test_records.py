"""Record operators against brute force, with their edge cases."""

import json
import random
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.operators import drift, hierarchy, keyed, shred
from gridloom.runtime import hub_join, latest


def brute_roots(links):
    out = {}
    known = {(s, v) for s, v, _ in links}
    par = {(s, v): p for s, v, p in links}
    for s, v in known:
        at, steps, seen = v, 0, []
        while True:
            p = par[s, at]
            if p is None or (s, p) not in known:
                out[s, v] = (at, steps)
                break
            if at in seen:
                ring = seen[seen.index(at):]
                out[s, v] = (min(ring), -1)
                break
            seen.append(at)
            at, steps = p, steps + 1
    return out


def make_links(seed):
    rng = random.Random(seed)
    links = []
    for s in range(3):
        n = 120
        for v in range(n):
            p = rng.choice([None, -1, 10**6]) if rng.random() < 0.04 else rng.randrange(n) if rng.random() < 0.1 else max(v - rng.randrange(1, 3), 0)
            links.append((s, v, p))
    links += [(9, k, k + 1) for k in range(400)] + [(10, 5, 5), (10, 6, 5), (11, 7, 8), (11, 8, 7), (11, 1, 7)]
    return links


def test_hierarchy_against_brute_force(spark):
    links = make_links(3)
    want = brute_roots(links)
    df = spark.createDataFrame(links, "s long, v long, p long").withColumn("root", F.lit("clash")).withColumn("low", F.lit(1))
    for kw in ({}, {"block": lambda x: F.floor(x / 16), "base_rows": 0}, {"block": lambda x: F.floor(x / 40), "base_rows": 30, "chunk": 50}):
        got = {(r.s, r.v): (r.root, r.depth) for r in hierarchy.resolve(df, **kw).collect()}
        assert got == want


def test_hierarchy_paths_and_sums_across_blocks(spark):
    links = [x for x in make_links(5) if x[0] in (0, 9, 10, 11)]
    want = brute_roots(links)
    par = {(s, v): p for s, v, p in links}

    def way(s, v):
        out = [v]
        while (s, par[s, out[-1]]) in par:
            out.append(par[s, out[-1]])
        return out

    ways = {(s, v): way(s, v) if want[s, v][1] >= 0 else None for s, v in want}
    sums = {k: 0.0 for k, w in ways.items() if w}
    for (s, v), w in ways.items():
        for q in w or []:
            sums[s, q] += v % 5
    df = spark.createDataFrame(links, "s long, v long, p long").withColumn("x", F.when(F.col("v") % 5 != 0, F.col("v") % 5)).withColumn("acc", F.lit(1))
    for kw in ({}, {"block": lambda x: F.floor(x / 16), "base_rows": 0}, {"block": lambda x: F.floor(x / 16)}):
        assert {(r.s, r.v): (r.root, r.depth, r.path) for r in hierarchy.paths(df, **kw).collect()} == {k: (*want[k], ways[k]) for k in want}
        assert {(r.s, r.v): r.acc for r in hierarchy.accumulate(df, "x", **kw).collect()} == sums


def test_hub_join(spark):
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 7), (None, 8)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k int, w string")
    want = sorted(map(str, left.join(right, ["k"], "left").collect()))
    for hub in (10, 1000):
        assert sorted(map(str, hub_join(left, right, ["k"], hub=hub).collect())) == want


def test_hierarchy_paths_and_descendants(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 8, 9), (1, 9, 8)], "s long, v long, p long")
    p = hierarchy.paths(df)
    got = {r.v: r.path for r in p.collect()}
    assert got == {1: [1], 2: [2, 1], 3: [3, 2, 1], 4: [4, 2, 1], 8: None, 9: None}
    d = {(r.ancestor, r.v, r.distance) for r in hierarchy.descendants(p).collect()}
    assert d == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 2), (2, 4, 1)}


def test_hierarchy_empty(spark):
    none = spark.createDataFrame([], "s long, v long, p long, x double")
    assert hierarchy.resolve(none).count() == hierarchy.paths(none).count() == hierarchy.accumulate(none, "x").count() == 0


def test_names_and_renames():
    assert drift.likeness("ambient_light", "amb_light") == 1
    assert drift.likeness("min_y", "bounds.min-y") == 2
    assert drift.likeness("has_ceiling", "hasCeiling")
    assert drift.likeness("monster_spawn_block_light_limit", "block_light_limit")
    assert drift.likeness("infiniburn", "inf_burn")
    assert not drift.likeness("height.type", "effects.type")
    assert not drift.likeness("logical_height", "cloud_height")
    assert not drift.likeness("x.min_inclusive", "x.max_inclusive")


def test_changes_of_kind(spark):
    old = '{"a": 1, "b": "x", "c": 2, "d": null, "e": {"x": 1}, "gone": []}'
    new = '{"a": "1", "b": null, "c": {"amount": 2}, "d": 4, "e": {}, "wrap": {"x": "1"}, "come": true}'
    files = spark.createDataFrame([(1, 7, "f", 1, None, old), (2, 7, "f", 2, None, new)], "file_id long, pack_id int, file_name string, pack_format int, received_at timestamp, body string")
    v = drift.readable_versions(files, ["pack_id", "file_name"], "pack_format", "received_at")
    got = {(r.change, r.field_path, r.new_path) for r in drift.changes(v, ["pack_id", "file_name"], "pack_format").collect()}
    assert got == {("retyped", "a", ""), ("retyped", "c", ""), ("added", "c.amount", ""), ("renamed", "e.x", "wrap.x"), ("removed", "gone", ""), ("added", "come", "")}
    n = {(r.path, r.kind): r.files for r in drift.path_statistics(v, ["file_name"], "pack_format").collect()}
    assert n["a", "number"] == n["a", "string"] == 1 and n["e", "object"] == 2 and n["d", "null"] == 1


def test_unreadable_bodies():
    assert drift.path_values(None) is None
    assert drift.path_values("") is None
    assert drift.path_values("[1]") is None
    assert drift.path_values('{"a": ') is None
    assert drift.path_values('﻿{"a": {"b": [1, {"c": 2}]}, "n": null}') == {"a": ("object", None), "a.b": ("list", '[1, {"c": 2}]'), "n": ("null", None)}


def test_versions_changes_and_table(spark):
    t = datetime(2025, 1, 1)
    rows = [
        (1, 7, "f", 3, t, '{"min_y": 1, "on": true}'),
        (2, 7, "f", 3, t.replace(month=2), '{"min_y": 2, "on": true, "x": "5"}'),
        (3, 7, "f", 3, t.replace(month=3), '{"min_y": '),
        (4, 7, "f", 5, t, '{"bounds": {"minY": 4}, "on": 1, "x": "word"}'),
        (5, 7, "f", 4, t, None),
        (6, None, "g", 1, t, "{}"),
    ]
    files = spark.createDataFrame(rows, "file_id long, pack_id int, file_name string, pack_format int, received_at timestamp, body string").withColumn("kinds", F.lit(0))
    v = drift.readable_versions(files, ["pack_id", "file_name"], "pack_format", "received_at")
    got = {(r.pack_format, r.change, r.field_path, r.new_path) for r in drift.changes(v, ["pack_id", "file_name"], "pack_format").collect()}
    assert got == {(5, "renamed", "min_y", "bounds.minY"), (5, "retyped", "on", "")}
    table, failed = drift.unify(files, ["file_id"])
    rows = {r.file_id: r for r in table.collect()}
    assert len(rows) == 6 and rows[4].min_y == 4.0 and rows[4].on is True and rows[2].x == "5" and rows[3].min_y is None
    assert failed.count() == 0
    empty = files.limit(0)
    assert drift.changes(drift.readable_versions(empty, ["pack_id", "file_name"], "pack_format", "received_at"), ["pack_id", "file_name"], "pack_format").count() == 0


def test_failed_casts(spark):
    rows = [(k, '{"n": %d}' % k) for k in range(3)] + [(8, '{"n": "many"}'), (9, '{"n": [1]}')]
    table, failed = drift.unify(spark.createDataFrame(rows, "file_id long, body string"), ["file_id"])
    assert {r.file_id: r.n for r in table.collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 8: None, 9: None}
    assert {(r.file_id, r.kind, r.raw, r.wanted, r.reason) for r in failed.collect()} == {(8, "string", "many", "number", "cast"), (9, "list", "[1]", "number", "cast")}


def test_no_value_is_lost(spark):
    rows = [(1, '{"a": {"top": 1}, "b": {"top": 2}, "x_y": 3, "xY": 4, "rare": true}'), (2, '{"a": {"top": "no"}, "b": {"top": 5}, "x_y": 6}'), (3, '{"top": 7}')]
    files = spark.createDataFrame(rows, "file_id long, body string")
    table, report = drift.unify(files, ["file_id"])
    got = {r.file_id: r.asDict() for r in table.collect()}
    # two settings of one name go by their whole path; the third file's own has the short name as its whole path
    assert got[1]["a__top"] == 1.0 and got[1]["b__top"] == 2.0 and got[2]["b__top"] == 5.0 and got[3]["top"] == 7.0
    # two spellings of one path: the first has the column, the other keeps its value
    assert got[1]["x_y"] == 4.0 and got[1]["other"] == {"x_y": "3"} and got[2]["x_y"] == 6.0
    assert {(r.path, r.raw, r.reason) for r in report.collect()} == {("a.top", "no", "cast"), ("x_y", "3", "clash")}
    # beyond the widest table: still there, and still reported
    table, report = drift.unify(files, ["file_id"], max_columns=1)
    got = {r.file_id: r.other for r in table.collect()}
    assert got[1]["rare"] == "true" and len(got[1]) == 4 and len(table.columns) == 3
    assert ("a.top", "no", "cast") in {(r.path, r.raw, r.reason) for r in report.collect()}
    assert drift.unify(files.limit(0), ["file_id"])[0].count() == 0


def test_keyed(spark):
    rows = [("a", 1.0)] * 60 + [("b", float("nan"))] * 39 + [("c", -9999.0)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("samples", F.lit(0))
    assert {r.k for r in keyed.heavy_keys(df.filter("k is not null"), ["k"], 50).collect()} == {"a", "b"}
    got = {r.k: (r.samples, r.mean_v, r.n_v) for r in keyed.profile_by_key(df, ["k"], ["v"]).collect()}
    assert got == {"a": (60, 1.0, 60), "b": (39, None, 0), "c": (1, None, 0), None: (1, 4.0, 1)}
    assert keyed.heavy_keys(df.limit(0), ["k"], 50).count() == 0


def test_latest_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, None)], "k int, t int, v string")
    assert {(r.k, r.t, r.v) for r in latest(df, ["k"], "t", ["v"]).collect()} == {(1, 5, "b"), (2, None, None)}


BODIES = [
    '{"requiredMods": "m", "rules": [null, {"zone": "z", "rarity": "1.5", "conditions": [null, {"variable": "a"}], "noiseConditions": {"variable": "n"}, "requiredMods": ["x", null, "y"]}]}',
    '{"requiredMods": "[\\"p\\", \\"q\\"]", "rules": {"zone": "z", "conditions": "[{\\"variable\\": \\"a\\"}, {\\"variable\\": \\"b\\"}]"}}',
    '{"requiredMods": {"1": "b", "0": "a"}, "rules": {"0": {"conditions": {"0": {"variable": "u"}, "10": {"variable": "w"}, "2": {"variable": "v"}}}}}',
    '{"requiredMods": null}', "not json", None, "[]", '{"rules": []}', '{"rules": [{"conditions": []}]}',
]


def brute_items(body):
    c = shred.parse_class(body) or {"requiredMods": [], "rules": []}
    out = [(-1, "requiredMods", i, m) for i, m in enumerate(c["requiredMods"]) if m is not None]
    for k, r in enumerate(c["rules"]):
        if r is None:
            continue
        for name in ("conditions", "noiseConditions"):
            out += [(k, name, i, x["variable"]) for i, x in enumerate(r[name]) if x is not None]
        out += [(k, "requiredMods", i, m) for i, m in enumerate(r["requiredMods"]) if m is not None]
    return out


def test_shredding_against_walk(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "record_id long, body string")
    nested = df.mapInArrow(shred.parse_bodies, shred.CLASS_DDL)
    got = sorted(map(tuple, nested.mapInArrow(shred.item_rows, shred.ITEM_DDL).collect()))
    want = sorted((i, *x) for i, b in enumerate(BODIES) for x in brute_items(b))
    assert got == want
    assert (2, 0, "conditions", 1, "v") in got and (1, -1, "requiredMods", 1, "q") in got and (0, 1, "conditions", 1, "a") in got
    assert nested.mapInArrow(shred.rule_rows, shred.RULE_ROW_DDL).count() == 4
    assert nested.limit(0).mapInArrow(shred.item_rows, shred.ITEM_DDL).count() == 0


def test_levels_tell_nulls_apart():
    col = pa.array([None, [], [None], [["a", None], [], None]], pa.list_(pa.list_(pa.string())))
    (lv,) = shred.shred(col, "x")
    assert lv.rep.tolist() == [0, 0, 0, 0, 2, 1, 1]
    assert lv.dfn.tolist() == [0, 1, 2, 5, 4, 3, 2]
    record, places = shred.ordinals(lv)
    assert record.tolist() == [0, 1, 2, 3, 3, 3, 3] and places[0].tolist() == [0, 0, 0, 0, 0, 1, 2] and places[1].tolist()[3:] == [0, 1, 0, 0]


def test_bottomless_nesting():
    deep = '{"rules": ' + "[" * 200_000 + "]" * 200_000 + "}"
    assert shred.parse_class(deep) is None and drift.path_values(deep) is None


def test_long_values(spark):
    body = json.dumps({"requiredMods": ["m" * 300_000], "rules": []})
    df = spark.createDataFrame([(1, body)], "record_id long, body string")
    r = df.mapInArrow(shred.parse_bodies, shred.CLASS_DDL).mapInArrow(shred.item_rows, shred.ITEM_DDL).first()
    assert len(r.item) == 300_000
