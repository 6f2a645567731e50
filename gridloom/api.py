"""The query surface: regions, heightmaps, coarse views, probes and rule previews, each returning a DataFrame (group L).

Every function takes tables, not connections, and builds a plan; nothing is served over a network.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import focal, stats
from gridloom.rules import catalog as cat
from gridloom.rules import checks
from gridloom.rules import compile as comp
from gridloom.sources import stores

#: A function from (window cells) to (window cells), called once per window; and one on batches of windows.
TensorFunction = Callable[[DataFrame], DataFrame]


def region(spark: SparkSession, store: str, seed: int, scale: int, box: tuple[int, int, int, int], side: int = 2048) -> DataFrame:
    """Elevation, mask, surface and class of a box, from the tile store; only its tiles are read."""
    return stores.read_tiles(spark, store, seed, scale, box, side).select("r", "c", "elev", "mask", "surface", "class")


def heightmap(spark: SparkSession, store: str, seed: int, scale: int, box: tuple[int, int, int, int], side: int = 2048, resolution: float = 30.0) -> DataFrame:
    """(r, c, height): block heights of a box."""
    return region(spark, store, seed, scale, box, side).select("r", "c", scalar.col("block_height", m="elev", res=float(resolution)).cast("int").alias("height"))


CHANNELS = ("elev", "p5", "temp", "t_std", "precip", "precip_cv")


def coarse_channel(coarse: DataFrame, channel: str) -> DataFrame:
    """(r, c, v): one channel of a coarse map with weights, decoded from signed roots where it is an elevation."""
    v = scalar.text("normalise", v=channel, w="w")
    return coarse.select("r", "c", F.expr(scalar.text("signed_square", v=v) if channel in ("elev", "p5") else v).alias("v"))


def coarse_stats(coarse: DataFrame) -> DataFrame:
    """(channel, lo, hi) of every channel."""
    wide = coarse.select(*[F.expr(scalar.text("normalise", v=ch, w="w")).alias(ch) for ch in CHANNELS])
    return stats.extremes(wide, list(CHANNELS))


def coarse_data(coarse: DataFrame, channel: str) -> DataFrame:
    """One row: a channel of the window as a JSON list of rows, rounded to two places."""
    return stores.nested_window(coarse_channel(coarse, channel), "v")


def coarse_view(coarse: DataFrame, channel: str, ranges: dict[str, tuple[float | None, float | None]] | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """(r, c, v, index, match, status): a channel on a 256-step colour scale, with inclusive channel ranges as a flag
    that dims instead of dropping, and optionally a class's spawn status."""
    shown = coarse_channel(coarse, channel)
    if channel == "precip":
        shown = shown.withColumn("v", F.expr(scalar.text("log_display", v="v")))
    lo_hi = shown.agg(F.min(F.when(~F.isnan("v"), F.col("v"))).alias("lo"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("hi"))
    lo, hi = lo_hi.select("lo").scalar(), lo_hi.select("hi").scalar()
    t = F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    out = shown.withColumn("index", F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5))
    match: Column = F.lit(True)
    for ch, (a, b) in (ranges or {}).items():
        v = F.expr(scalar.text("normalise", v=ch, w="w"))
        match = match & (F.lit(True) if a is None else v >= a) & (F.lit(True) if b is None else v <= b)
    out = out.join(coarse.select("r", "c", match.alias("match")), ["r", "c"])
    return out.join(overlay, ["r", "c"], "left") if overlay is not None else out.withColumn("status", F.lit(None).cast("string"))


def probe(samples: DataFrame, catalog: cat.Catalog, x: str = "c", z: str = "r") -> DataFrame:
    """The class of hypothetical sample records."""
    return comp.classify(samples, catalog, x, z)


def spawn_status(probes: DataFrame, catalog: cat.Catalog, class_index: int, key: list[str]) -> DataFrame:
    """(key, status): WINS, ELIGIBLE or NONE as the best over each key's probes (sub-samples, flat and steep)."""
    m = comp.select(comp.zone_matches(probes, catalog), "c", "r", catalog.default_index, catalog.indices())
    can = F.exists("matches", lambda e: (e["class_index"] == class_index) & (e["weight"] > 0))
    level = F.when(can & (F.col("class_index") == class_index), 2).when(can, 1).otherwise(0)
    best = m.withColumn("level", level).groupBy(*key).agg(F.max("level").alias("level"))
    return best.select(*key, F.element_at(F.array(F.lit("NONE"), F.lit("ELIGIBLE"), F.lit("WINS")), F.col("level") + 1).alias("status"))


def detail(cells: DataFrame, mode: str, pixel: float) -> DataFrame:
    """(r, c, v, water): a detail view (relief, elevation, temperature or class) with the overlay's opacity."""
    alpha = F.when(F.col("mask") > 0, F.expr(scalar.text("overlay_alpha", mask="mask")))
    if mode == "relief":
        d = focal.relief(cells, "elev", pixel)
        return d.select("r", "c", F.col("relief").alias("v"), alpha.alias("water"))
    column = {"elevation": "elev", "temperature": "temp", "class": "class"}[mode]
    return cells.select("r", "c", F.col(column).cast("double").alias("v"), alpha.alias("water"))


def status(catalog: cat.Catalog, seed: int, scale: int) -> dict:
    """Seed, scale, channel names and the class maps."""
    return {"seed": seed, "scale": scale, "channels": list(CHANNELS), "keys": {c.index: c.key for c in catalog.classes}, "colors": {c.index: c.color for c in catalog.classes}}


#: Climate bands of the rule generator: fixed values.
RARITY = {"common": 1.0, "uncommon": 0.5, "rare": 0.2}


def generate(catalog: cat.Catalog, key: str, zone: str, bands: dict[str, tuple[float, float]], rarity: str = "common", gate: tuple[str, float] | None = None) -> cat.Class:
    """A new class at the next free index: one rule of a between per band, weighted by rarity, optionally behind a
    noise gate; its colour and flags come from the class nearest in the bands (its anchor)."""
    rule = cat.Rule(zone, RARITY[rarity], False, tuple(cat.Condition(v, "between", lo, hi) for v, (lo, hi) in bands.items()), (cat.Condition(gate[0], "gt", gate[1]),) if gate else ())
    anchor = find_anchor(catalog, zone, bands)
    index = max((c.index for c in catalog.classes), default=0) + 1
    return cat.Class(index, key, anchor.kind if anchor else zone.upper(), (rule,), anchor.key if anchor else None, anchor.hard if anchor else False, anchor.blendable if anchor else False, False, anchor.color if anchor else 0)


def find_anchor(catalog: cat.Catalog, zone: str, bands: dict[str, tuple[float, float]]) -> cat.Class | None:
    """The class with a rule in the zone that overlaps every band it constrains; the heaviest, then the lowest index."""

    def overlaps(r: cat.Rule) -> bool:
        for v, (lo, hi) in bands.items():
            for c in r.conditions:
                if c.variable == v and c.flag is None and c.op:
                    a = -1e300 if c.op in ("lt", "lte") else float(c.value or 0.0)
                    b = 1e300 if c.op in ("gt", "gte") else float((c.value2 if c.op == "between" else c.value) or 0.0)
                    if a > hi or b < lo:
                        return False
        return True

    fits = [(-r.weight, c.index, c) for _, c, r in catalog.rules(zone) if overlaps(r)]
    return min(fits, key=lambda f: f[:2])[2] if fits else None


def preview(spark: SparkSession, catalog: cat.Catalog, new: cat.Class) -> DataFrame:
    """Findings for a catalog with the class upserted: dead discrete conditions and hard-bound violations."""
    t = cat.condition_table(spark, catalog.with_class(new)).filter(F.col("class_index") == new.index)
    dead = checks.dead_discrete(t).select("rule", "variable", F.lit("dead").alias("severity"))
    return dead.unionByName(checks.against_bounds(t).select("rule", "variable", "severity"))


def apply(spark: SparkSession, catalog: cat.Catalog, new: cat.Class, path: str) -> cat.Catalog:
    """Writes the catalog with the class upserted, if nothing about it is dead."""
    if preview(spark, catalog, new).filter("severity = 'dead'").limit(1).count():
        raise ValueError("the rules can never match")
    out = catalog.with_class(new)
    cat.save(out, path)
    return out


def report(tables: dict[str, DataFrame], rows: int = 25) -> str:
    """Markdown sections of small result tables, cut to their first rows."""
    out = []
    for title, df in tables.items():
        head = df.limit(rows).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(str(v) for v in r) + " |" for r in head], ""]
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    """Lab run: load, check, classify samples, report; exit code 1 if any condition is dead."""
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("--catalog", required=True)
    p.add_argument("--samples", help="parquet of sample records with zone, c and r")
    p.add_argument("--loaded", default="", help="comma-separated loaded packs")
    p.add_argument("--validate-only", action="store_true")
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    c = cat.load([a.catalog], frozenset(filter(None, a.loaded.split(","))) or None)
    t = cat.condition_table(spark, c)
    findings = checks.dead_discrete(t).select("class_key", "rule", "variable", F.lit("dead").alias("severity")).unionByName(checks.against_bounds(t).select("class_key", "rule", "variable", "severity"))
    tables = {"Findings": findings}
    dead = findings.filter("severity = 'dead'").limit(1).count()
    if a.samples and not a.validate_only:
        k = comp.classify(spark.read.parquet(a.samples), c)
        tables["Shares"] = stats.shares(k, "zone", "class_index").orderBy("share")
        tables["Collisions"] = stats.collisions(comp.zone_matches(spark.read.parquet(a.samples), c), "matches").orderBy(F.desc("n"))
    text = report(tables, a.top)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return int(bool(dead))


def lift_numbers(body: str, keys: frozenset[str], by: float) -> str:
    """JSON with every number under one of the keys raised by ``by``, at any depth."""

    def walk(v: object, under: bool) -> object:
        if isinstance(v, dict):
            return {k: walk(x, under or k in keys) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, under) for x in v]
        return v + by if under and isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return json.dumps(walk(json.loads(body), False))


if __name__ == "__main__":
    sys.exit(main())
