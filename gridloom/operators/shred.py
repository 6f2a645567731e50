"""Columnar shredding of nested records into levels, and tables rebuilt from the levels.

Every leaf path of a nested column becomes a flat column with two small integers per entry, as in columnar
file formats: the repetition level tells at which repeated ancestor a new element starts (0: a new record),
the definition level how much of the path is present. Tables per repeated ancestor are then rebuilt from the
level sequences alone: ordinals are running counts of starts, reset where an outer level starts. All of it is
offset arithmetic on Arrow arrays, one batch at a time, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Levels:
    """One leaf path of a batch. rep, dfn: levels; values: as long as the entries, null where not present."""

    path: str
    rep: np.ndarray
    dfn: np.ndarray
    values: pa.Array
    max_rep: int
    #: definition level from which on the element of repeated level k (1..max_rep) exists
    exists: list[int]


def _valid(a: pa.Array) -> np.ndarray:
    return np.asarray(a.is_valid()) if len(a) else np.zeros(0, bool)


def shred(column: pa.Array, name: str) -> list[Levels]:
    """The levels of every leaf path under ``column``, whose entries are the records.

    Null and empty lists, null elements, null structs and null leaves stay apart by their definition level.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    out: list[Levels] = []

    # src: entry's index in a (or -1 if an ancestor is missing); rep, dfn: levels so far
    def walk(a: pa.Array, path: str, src: np.ndarray, rep: np.ndarray, dfn: np.ndarray, depth: int, full: int, exists: list[int]) -> None:
        ok = np.zeros(len(src), bool)
        here = src >= 0
        ok[here] = _valid(a)[src[here]]
        dfn = dfn + ok
        if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
            offsets = np.asarray(a.offsets, dtype=np.int64)
            size = np.zeros(len(src), np.int64)
            start = np.zeros(len(src), np.int64)
            size[ok] = offsets[src[ok] + 1] - offsets[src[ok]]
            start[ok] = offsets[src[ok]]
            copies = np.maximum(size, 1)
            at = np.repeat(np.arange(len(src)), copies)
            first = np.cumsum(copies) - copies
            inner = np.arange(len(at)) - first[at]
            filled = size[at] > 0
            child = np.where(filled, start[at] + inner, -1)
            rep2 = np.where(inner == 0, rep[at], depth + 1)
            dfn2 = dfn[at] + filled
            walk(a.values, path, child, rep2, dfn2, depth + 1, full + 2, [*exists, full + 2])
        elif pa.types.is_struct(a.type):
            for i in range(a.type.num_fields):
                f = a.type.field(i)
                walk(a.field(i), f"{path}.{f.name}", np.where(ok, src, -1), rep, dfn, depth, full + 1, exists)
        else:
            take = pa.array(np.where(ok, src, 0), mask=~ok)
            values = a.take(take) if len(a) else pa.nulls(len(src), a.type)
            out.append(Levels(path, rep, dfn, values, depth, exists))

    walk(column, name, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0, [])
    return out


def ordinals(levels: Levels) -> tuple[np.ndarray, list[np.ndarray]]:
    """From the level sequence alone: each entry's record number, and its 0-based place at each repeated level."""
    rep = levels.rep
    record = np.cumsum(rep == 0) - 1
    places = []
    for k in range(1, levels.max_rep + 1):
        seen = np.cumsum(rep <= k)
        base = np.maximum.accumulate(np.where(rep < k, seen, 0)) if len(rep) else seen
        places.append(seen - base)
    return record, places


def present_elements(levels: Levels, *, not_null: bool) -> np.ndarray:
    """Entries whose innermost repeated element exists; not_null: and is not null itself."""
    return levels.dfn >= levels.exists[-1] + int(not_null)


# ---------------------------------------------------------------- lenient JSON to the canonical nested record


def as_list(v: object) -> list:
    """The list that a value stands for: itself, numbered keys in order, JSON text, or a single element."""
    if v is None:
        return []
    if isinstance(v, list):
        return v
    if isinstance(v, str):
        t = v.strip()
        if not t:
            return []
        if t[0] in "[{":
            try:
                return as_list(json.loads(t))
            except ValueError:
                return [v]
        return [v]
    if isinstance(v, dict):
        if v and all(k.isdigit() for k in v):
            return [v[k] for k in sorted(v, key=int)]
        return [v] if v else []
    return [v]


def _num(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _whole(v: object) -> int | None:
    """A whole number of 32 bits, also written as text."""
    n = _num(v)
    return int(n) if n is not None and n.is_integer() and -(2**31) <= n < 2**31 else None


def _flag(v: object) -> bool | None:
    if isinstance(v, bool):
        return v
    if isinstance(v, str) and v.strip().lower() in ("true", "false"):
        return v.strip().lower() == "true"
    return None


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


def _extra(v: dict, known: set[str]) -> str | None:
    """The fields that the schema does not know, as JSON text; None without any."""
    rest = {k: x for k, x in v.items() if k not in known}
    return json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None


def _cond(v: object) -> dict | None:
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            v = {"variable": v}
    if not isinstance(v, dict):
        return None
    return {"variable": _text(v.get("variable")), "op": _text(v.get("op")), "value": _num(v.get("value")), "value2": _num(v.get("value2")), "bool": _flag(v.get("bool")), "extra": _extra(v, {"variable", "op", "value", "value2", "bool"})}


def _rule(v: object) -> dict | None:
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    if not isinstance(v, dict):
        return None
    return {
        "zone": _text(v.get("zone")), "rarity": _num(v.get("rarity")), "override": _flag(v.get("override")),
        "conditions": [_cond(c) for c in as_list(v.get("conditions"))],
        "noiseConditions": [_cond(c) for c in as_list(v.get("noiseConditions"))],
        "requiredMods": [_text(m) for m in as_list(v.get("requiredMods"))],
        "extra": _extra(v, {"zone", "rarity", "override", "conditions", "noiseConditions", "requiredMods"}),
    }


#: The scalar fields of a class, their types and how they are read from JSON; a body has two under shorter names.
CLASS_FIELDS = [("biome_index", pa.int32(), _whole), ("biome_key", pa.string(), _text), ("fallbackKey", pa.string(), _text), ("kind", pa.string(), _text), ("color", pa.int32(), _whole)]
CLASS_FIELDS += [(n, pa.bool_(), _flag) for n in ("hardBoundary", "blendable", "river", "frozenRiver", "canGenerateOverworld")]
_SHORT = {"biome_index": "index", "biome_key": "key"}


def parse_class(body: str | None) -> dict | None:
    """The canonical class record of a JSON body; None if the body is not a readable object."""
    if body is None:
        return None
    try:
        j = json.loads(body.lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None
    if not isinstance(j, dict):
        return None
    own = {n: read(next((j[k] for k in (n, _SHORT.get(n)) if k in j), None)) for n, _, read in CLASS_FIELDS}
    known = {n for n, _, _ in CLASS_FIELDS} | set(_SHORT.values()) | {"requiredMods", "rules"}
    return own | {"extra": _extra(j, known), "requiredMods": [_text(m) for m in as_list(j.get("requiredMods"))], "rules": [_rule(r) for r in as_list(j.get("rules"))]}


COND = pa.struct([("variable", pa.string()), ("op", pa.string()), ("value", pa.float64()), ("value2", pa.float64()), ("bool", pa.bool_()), ("extra", pa.string())])
RULE = pa.struct([("zone", pa.string()), ("rarity", pa.float64()), ("override", pa.bool_()), ("conditions", pa.list_(COND)), ("noiseConditions", pa.list_(COND)), ("requiredMods", pa.list_(pa.string())), ("extra", pa.string())])
CLASS_DDL = (
    "record_id long, pack_id int, biome_index int, biome_key string, fallbackKey string, kind string, color int, hardBoundary boolean, "
    "blendable boolean, river boolean, frozenRiver boolean, canGenerateOverworld boolean, extra string, requiredMods array<string>, rules array<struct<zone string, rarity double, override boolean, "
    "conditions array<struct<variable string, op string, value double, value2 double, bool boolean, extra string>>, "
    "noiseConditions array<struct<variable string, op string, value double, value2 double, bool boolean, extra string>>, requiredMods array<string>, extra string>>"
)


def parse_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, pack_id if there is one, body) to the canonical nested record; unreadable bodies give a record without fields or lists."""
    for b in batches:
        rows = [parse_class(x) or {"requiredMods": [], "rules": []} for x in b.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("record_id"), b.column("pack_id") if "pack_id" in b.schema.names else pa.nulls(len(rows), pa.int32()), *[pa.array([r.get(n) for r in rows], t) for n, t, _ in CLASS_FIELDS], pa.array([r.get("extra") for r in rows], pa.string()), pa.array([r["requiredMods"] for r in rows], pa.list_(pa.string())), pa.array([r["rules"] for r in rows], pa.list_(RULE))],
            names=["record_id", "pack_id", *[n for n, _, _ in CLASS_FIELDS], "extra", "requiredMods", "rules"],
        )


ITEM_DDL = "record_id long, rule_no int, list_name string, item_no int, item string"


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical records to one row per non-null element of the condition and mod lists, through the levels."""
    wanted = {"requiredMods": "requiredMods", "rules.requiredMods": "requiredMods", "rules.conditions.variable": "conditions", "rules.noiseConditions.variable": "noiseConditions"}
    for b in batches:
        ids = np.asarray(b.column("record_id"))
        for lv in [*shred(b.column("requiredMods"), "requiredMods"), *shred(b.column("rules"), "rules")]:
            if lv.path not in wanted:
                continue
            record, places = ordinals(lv)
            keep = present_elements(lv, not_null=True)
            if not keep.any():
                continue
            n = int(keep.sum())
            rule = places[0][keep] if lv.max_rep == 2 else np.full(n, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[record[keep]], pa.int64()), pa.array(rule, pa.int32()), pa.array([wanted[lv.path]] * n, pa.string()), pa.array(places[-1][keep], pa.int32()), lv.values.filter(pa.array(keep)).cast(pa.string())],
                names=["record_id", "rule_no", "list_name", "item_no", "item"],
            )


RULE_ROW_DDL = "record_id long, rule_no int, zone string, rarity double, override boolean, extra string"


def rule_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical records to one row per non-null rule, with its scalar fields."""
    for b in batches:
        ids = np.asarray(b.column("record_id"))
        by = {lv.path: lv for lv in shred(b.column("rules"), "rules")}
        lv = by["rules.zone"]
        record, places = ordinals(lv)
        keep = present_elements(lv, not_null=True)
        take = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[record[keep]], pa.int64()), pa.array(places[0][keep], pa.int32()), lv.values.filter(take), by["rules.rarity"].values.filter(take).cast(pa.float64()), by["rules.override"].values.filter(take), by["rules.extra"].values.filter(take).cast(pa.string())],
            names=["record_id", "rule_no", "zone", "rarity", "override", "extra"],
        )


CONDITION_DDL = "record_id long, rule_no int, list_name string, item_no int, variable string, op string, value double, value2 double, bool boolean, extra string"


def condition_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical records to one row per non-null condition of either list, with all its fields, through the levels."""
    for b in batches:
        ids = np.asarray(b.column("record_id"))
        by = {lv.path: lv for lv in shred(b.column("rules"), "rules")}
        for name in ("conditions", "noiseConditions"):
            lv = by[f"rules.{name}.variable"]
            record, places = ordinals(lv)
            keep = present_elements(lv, not_null=True)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[record[keep]], pa.int64()), pa.array(places[0][keep], pa.int32()), pa.array([name] * int(keep.sum()), pa.string()), pa.array(places[1][keep], pa.int32()), *[by[f"rules.{name}.{f.name}"].values.filter(take).cast(f.type) for f in COND]],
                names=["record_id", "rule_no", "list_name", "item_no", *[f.name for f in COND]],
            )


EXTRA_DDL = "record_id long, rule_no int, list_name string, item_no int, field string, value string"


def extra_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per field that the schema does not know, with its value as JSON text and the place of its owner: a class
    (rule_no -1), a rule, or a condition (list_name and item_no, else empty and -1)."""
    wanted = {"rules.extra": "", "rules.conditions.extra": "conditions", "rules.noiseConditions.extra": "noiseConditions"}
    for b in batches:
        ids = np.asarray(b.column("record_id"))
        rows = [(i, -1, "", -1, x) for i, x in zip(ids.tolist(), b.column("extra").to_pylist()) if x]
        for lv in shred(b.column("rules"), "rules"):
            if lv.path in wanted:
                record, places = ordinals(lv)
                for k in np.flatnonzero(_valid(lv.values)):
                    rows.append((int(ids[record[k]]), int(places[0][k]), wanted[lv.path], int(places[1][k]) if lv.max_rep == 2 else -1, lv.values[int(k)].as_py()))
        out = [(*r[:4], f, json.dumps(v, ensure_ascii=False)) for r in rows for f, v in json.loads(r[4]).items()]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["record_id", "rule_no", "list_name", "item_no", "field", "value"])


LEVEL_DDL = "record_id long, path string, entry int, rep int, def int, value string"


def level_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Canonical records to their raw level sequences: (record_id, path, entry, rep, def, value)."""
    for b in batches:
        ids = np.asarray(b.column("record_id"))
        for lv in [*shred(b.column("requiredMods"), "requiredMods"), *shred(b.column("rules"), "rules")]:
            record, _ = ordinals(lv)
            first = np.maximum.accumulate(np.where(lv.rep == 0, np.arange(len(lv.rep)), 0)) if len(lv.rep) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[record], pa.int64()), pa.array([lv.path] * len(record), pa.string()), pa.array(np.arange(len(record)) - first, pa.int32()), pa.array(lv.rep, pa.int32()), pa.array(lv.dfn, pa.int32()), lv.values.cast(pa.string())],
                names=["record_id", "path", "entry", "rep", "def", "value"],
            )
