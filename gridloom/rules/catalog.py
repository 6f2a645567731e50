"""The rule catalog: classes with rules of conditions, as plain data, as a table, and as SQL values."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import checked_broadcast

# fixed values: names a condition may use
NUMERIC = ("elevationM", "temperatureC", "temperatureSeasonality", "precipitationMm", "precipitationCv", "moisture", "aridity", "treeMoisture", "treeCoverage", "sparsity", "slope", "growingSeasonDays")
FLAGS = ("ocean", "snowy", "bareSlope", "mountain", "lowland")
NOISE = ("variantNoise", "cherryNoise", "paleNoise", "clearingNoise", "flowerNoise", "regionNoise")
ZONES = ("ocean", "beach", "mountain", "lowland", "bareSlope")
OPERATORS = ("eq", "gt", "gte", "lt", "lte", "between")
#: Bounds that a variable cannot leave, whatever the climate.
HARD_BOUNDS = {
    "precipitationMm": (0.0, None), "aridity": (0.0, None), "moisture": (0.0, None), "treeMoisture": (0.0, None),
    "slope": (0.0, None), "growingSeasonDays": (0.0, 365.0), "treeCoverage": (0.0, 1.0), "sparsity": (0.0, 1.0),
}
#: The only values of the two bucketed variables.
DISCRETE = {"treeCoverage": (0.0, 0.35, 0.62, 0.85, 1.0), "sparsity": (0.0, 0.15, 0.38, 0.65, 1.0)}


@dataclass(frozen=True)
class Condition:
    variable: str
    op: str | None = None
    value: float | None = None
    value2: float | None = None
    flag: bool | None = None

    def describe(self) -> str:
        if self.flag is not None:
            return f"{self.variable} == {str(self.flag).lower()}"
        if self.op == "between":
            return f"{self.variable} between {self.value} {self.value2}"
        return f"{self.variable} {self.op} {self.value}"


@dataclass(frozen=True)
class Rule:
    zone: str
    weight: float = 1.0
    override: bool = False
    conditions: tuple[Condition, ...] = ()
    noise: tuple[Condition, ...] = ()
    needs: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Class:
    index: int
    key: str
    kind: str
    rules: tuple[Rule, ...] = ()
    fallback: str | None = None
    hard: bool = False
    blendable: bool = False
    river: bool = False
    color: int = 0
    needs: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Catalog:
    classes: tuple[Class, ...]
    default_index: int = 1
    loaded: frozenset[str] | None = None

    def available(self, needs: frozenset[str]) -> bool:
        """Every requirement is loaded; an unknown or empty loaded set satisfies all."""
        return not self.loaded or needs <= self.loaded

    def rules(self, zone: str | None = None, *, usable: bool = True) -> list[tuple[int, Class, Rule]]:
        """(ordinal, class, rule) in catalog order; usable: available and of positive weight."""
        out, n = [], 0
        for c in self.classes:
            for r in c.rules:
                keep = not usable or (r.weight > 0 and self.available(c.needs) and self.available(r.needs))
                if keep and (zone is None or r.zone == zone):
                    out.append((n, c, r))
                n += 1
        return out

    def indices(self) -> list[int]:
        """The classes' indices, in order."""
        return sorted({c.index for c in self.classes})

    def with_class(self, new: Class) -> Catalog:
        """Upsert by index."""
        return replace(self, classes=(*[c for c in self.classes if c.index != new.index], new))


def _cond(d: dict) -> Condition:
    return Condition(d.get("variable", ""), d.get("op"), d.get("value"), d.get("value2"), d.get("bool"))


def from_json(text: str, loaded: frozenset[str] | None = None) -> Catalog:
    """A catalog from its JSON list of classes; absent fields take their defaults."""
    classes = []
    for c in json.loads(text):
        rules = tuple(
            Rule(r.get("zone", ""), float(r.get("rarity", 1.0)), bool(r.get("override", False)), tuple(map(_cond, r.get("conditions") or [])), tuple(map(_cond, r.get("noiseConditions") or [])), frozenset(r.get("requiredMods") or []))
            for r in c.get("rules") or []
        )
        classes.append(Class(int(c["index"]), c["key"], c.get("kind", ""), rules, c.get("fallbackKey"), bool(c.get("hardBoundary")), bool(c.get("blendable")), bool(c.get("river") or c.get("frozenRiver")), int(c.get("color", 0)), frozenset(c.get("requiredMods") or [])))
    return Catalog(tuple(classes), loaded=loaded)


def to_json(catalog: Catalog) -> str:
    """The whole declared list, gated-off entries included."""
    cond = lambda c: {k: v for k, v in (("variable", c.variable), ("op", c.op), ("value", c.value), ("value2", c.value2), ("bool", c.flag)) if v is not None}
    rule = lambda r: {"zone": r.zone, "rarity": r.weight, "override": r.override, "conditions": [cond(c) for c in r.conditions], "noiseConditions": [cond(c) for c in r.noise], "requiredMods": sorted(r.needs)}
    return json.dumps([{"index": c.index, "key": c.key, "kind": c.kind, "fallbackKey": c.fallback, "hardBoundary": c.hard, "blendable": c.blendable, "river": c.river, "color": c.color, "requiredMods": sorted(c.needs), "rules": [rule(r) for r in c.rules]} for c in catalog.classes], indent=1)


def load(paths: list[str], loaded: frozenset[str] | None = None) -> Catalog:
    """The first of the files that exists and lists at least one class."""
    for p in paths:
        if os.path.exists(p):
            with open(p, encoding="utf-8") as f:
                c = from_json(f.read(), loaded)
            if c.classes:
                return c
    raise FileNotFoundError("no catalog among the paths")


def save(catalog: Catalog, path: str) -> str | None:
    """Writes the catalog in one step; an existing file is first copied to a timestamped backup, which is returned."""
    backup = None
    if os.path.exists(path):
        backup = f"{path}.{time.strftime('%Y%m%d-%H%M%S')}.bak"
        with open(path, "rb") as a, open(backup, "wb") as b:
            b.write(a.read())
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(to_json(catalog))
    os.replace(f"{path}.tmp", path)
    return backup


CONDITION_DDL = "class_index int, class_key string, rule int, zone string, weight double, override boolean, part string, no int, variable string, op string, value double, value2 double, flag boolean"


def condition_rows(catalog: Catalog, *, usable: bool = False) -> list[tuple]:
    return [
        (c.index, c.key, n, r.zone, r.weight, r.override, part, i, x.variable, x.op, x.value, x.value2, x.flag)
        for n, c, r in catalog.rules(usable=usable)
        for part, conds in (("climate", r.conditions), ("noise", r.noise))
        for i, x in enumerate(conds)
    ]


def condition_table(spark: SparkSession, catalog: Catalog, *, usable: bool = False) -> DataFrame:
    """One row per condition."""
    return spark.createDataFrame(condition_rows(catalog, usable=usable), CONDITION_DDL)


def rule_table(spark: SparkSession, catalog: Catalog, *, usable: bool = False) -> DataFrame:
    """One row per rule."""
    rows = [(n, c.index, c.key, c.kind, r.zone, float(r.weight), r.override) for n, c, r in catalog.rules(usable=usable)]
    return spark.createDataFrame(rows, "rule int, class_index int, class_key string, kind string, zone string, weight double, override boolean")


def class_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(c.index, c.key, c.kind, c.fallback, c.hard, c.blendable, c.river, c.color, sorted(c.needs), catalog.available(c.needs)) for c in catalog.classes]
    return spark.createDataFrame(rows, "class_index int, class_key string, kind string, fallback string, hard boolean, blendable boolean, river boolean, color int, needs array<string>, available boolean")


def with_flags(df: DataFrame, classes: DataFrame, index: str, default_index: int) -> DataFrame:
    """Adds the class's columns; an unknown index takes those of the default class."""
    known = checked_broadcast(classes.select(F.col("class_index").alias("_k"), *[c for c in classes.columns if c != "class_index"]))
    rest = classes.filter(F.col("class_index") == default_index).limit(1)
    d = df.join(known, df[index] == known["_k"], "left")
    fill = {r: v for row in rest.collect() for r, v in row.asDict().items() if r != "class_index"}
    lit = lambda v: F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return d.select(*df.columns, *[F.when(F.col("_k").isNull(), lit(fill.get(c))).otherwise(F.col(c)).alias(c) for c in classes.columns if c != "class_index"])


def sample() -> Catalog:
    """An authored catalog that meets every case: overrides, zero weight, gates, missing values, dead rules."""
    c = Condition
    r = Rule
    classes = (
        Class(1, "loam:plain", "LOWLAND", (r("lowland", 1.0), r("mountain", 0.2)), blendable=True, color=0x7FB238),
        Class(2, "loam:deep_sea", "OCEAN", (r("ocean", 1.2, conditions=(c("elevationM", "lt", -120.0),)),), hard=True, color=0x1F3F7F),
        Class(3, "loam:shelf_sea", "OCEAN", (r("ocean", 1.0, conditions=(c("elevationM", "gte", -150.0),)),), hard=True),
        Class(4, "loam:frozen_sea", "OCEAN", (r("ocean", 3.0, override=True, conditions=(c("temperatureC", "lt", 2.0), c("variantNoise", "gt", -2.0))),), hard=True),
        Class(5, "loam:sand_beach", "BEACH", (r("beach", 1.0, conditions=(c("temperatureC", "gt", 6.0),)), r("beach", 0.4))),
        Class(6, "loam:stony_beach", "BEACH", (r("beach", 0.8, conditions=(c("slope", "gt", 0.3),)),)),
        Class(7, "loam:forest", "LOWLAND", (r("lowland", 1.5, conditions=(c("treeCoverage", "gte", 0.6), c("temperatureC", "between", 2.0, 22.0))),), blendable=True),
        Class(8, "loam:birch_forest", "LOWLAND", (r("lowland", 0.7, conditions=(c("treeCoverage", "between", 0.3, 0.9),), noise=(c("variantNoise", "gt", 0.2),)),), blendable=True),
        Class(9, "loam:desert", "LOWLAND", (r("lowland", 2.0, conditions=(c("aridity", "lt", 0.5), c("temperatureC", "gt", 12.0))),), blendable=True),
        Class(10, "loam:savanna", "LOWLAND", (r("lowland", 1.1, conditions=(c("moisture", "between", 0.2, 0.9), c("temperatureC", "gt", 14.0), c("treeMoisture", "lt", 0.8))),), blendable=True),
        Class(11, "loam:snow_plain", "LOWLAND", (r("lowland", 1.0, override=True, conditions=(c("snowy", "eq", flag=True),)),), blendable=True),
        Class(12, "loam:swamp", "LOWLAND", (r("lowland", 0.9, conditions=(c("lowland", "eq", flag=True), c("moisture", "gte", 0.9))),), blendable=True),
        Class(13, "loam:peaks", "MOUNTAIN", (r("mountain", 1.0, conditions=(c("snowy", "eq", flag=False),)), r("bareSlope", 0.5, conditions=(c("elevationM", "gt", 1800.0),))), hard=True),
        Class(14, "loam:snow_peaks", "MOUNTAIN", (r("mountain", 1.3, conditions=(c("snowy", "eq", flag=True),)), r("bareSlope", 2.0, override=True, conditions=(c("snowy", "eq", flag=True),))), hard=True),
        Class(15, "loam:scree", "MOUNTAIN", (r("bareSlope", 1.0),)),
        Class(16, "loam:meadow", "MOUNTAIN", (r("mountain", 0.6, conditions=(c("treeCoverage", "lte", 0.4),), noise=(c("regionNoise", "between", -0.3, 0.3),)),)),
        Class(17, "loam:never_weighted", "LOWLAND", (r("lowland", 0.0),)),
        Class(18, "amber:grove", "LOWLAND", (r("lowland", 5.0, needs=frozenset({"amber"})),), needs=frozenset({"amber"})),
        Class(19, "loam:dead_cover", "LOWLAND", (r("lowland", 1.0, conditions=(c("treeCoverage", "between", 0.36, 0.5),)),)),
        Class(20, "loam:missing_value", "LOWLAND", (r("lowland", 0.3, conditions=(c("temperatureC", "lt"), c("sparsity", "gt"))),)),
        Class(21, "loam:no_operator", "LOWLAND", (r("lowland", 1.0, conditions=(c("temperatureC", None, 3.0),)),)),
        Class(22, "loam:odd_flag", "MOUNTAIN", (r("mountain", 0.1, conditions=(c("slope", "eq", flag=False),)),)),
        Class(23, "loam:too_loud", "LOWLAND", (r("lowland", 1.0, noise=(c("variantNoise", "gt", 1.2),)),)),
        Class(24, "loam:below_zero_slope", "LOWLAND", (r("lowland", 1.0, conditions=(c("slope", "lt", -0.1), c("growingSeasonDays", "lte", 400.0))),)),
        Class(25, "loam:old_forest", "LOWLAND", (r("lowland", 0.8, conditions=(c("treeCoverage", "eq", 0.85),)), r("mountain", 0.15, conditions=(c("treeCoverage", "gt", 0.5), c("growingSeasonDays", "gt", 90.0)))), blendable=True),
        Class(26, "loam:river", "RIVER", river=True, hard=True),
    )
    return Catalog(classes, loaded=frozenset({"loam", "cobalt"}))
