"""Schemas that drift between files: path-value maps, path-type statistics, typed projection, change list.

A body becomes a list of its paths with kind and raw text. Statistics of path and type by file decide what changed
from one version of a file to the next, and over all files what type each setting has in the one consistent table;
typed columns are then projected from the path-value lists, with a report of every value that could not be cast or
had to share its column. Only names that say the same thing are compared outside the engine.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.runtime import checked_broadcast, cut

FIELDS_DDL = "array<struct<path:string,kind:string,raw:string,name:string,whole:string>>"
#: Settings that get a column of their own in the unified table; the rest stay in the map ``other``, none is lost.
MAX_COLUMNS = 400
#: Last names that say nothing without the name before them.
GENERIC = frozenset({"type", "amount", "value", "kind", "unit"})
#: One letter per kind, put before a path in lists of types.
LETTERS = {"null": "0", "boolean": "b", "number": "n", "string": "s", "list": "l", "object": "o"}


def kind_of(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "list" if isinstance(v, list) else "object"


def _leaves(body: str | None) -> list[tuple[str, str, object]] | None:
    """(path, kind, value) of a JSON object, objects included; None if unreadable. A path met twice counts as last met."""
    if body is None:
        return None
    try:
        j = json.loads(body.lstrip("\ufeff \t\r\n"))
    except (ValueError, RecursionError):
        return None
    if not isinstance(j, dict):
        return None
    out: dict[str, tuple[str, object]] = {}
    stack: list[tuple[str, dict]] = [("", j)]
    while stack:
        at, d = stack.pop()
        for k, v in d.items():
            path, kind = f"{at}{k}", kind_of(v)
            out[path] = (kind, v)
            if kind == "object":
                stack.append((f"{path}.", v))
    return [(p, k, v) for p, (k, v) in out.items()]


def path_values(body: str | None) -> dict[str, tuple[str, str | None]] | None:
    """Path to (kind, raw text) of a JSON object; objects are listed with kind ``object``; None if unreadable."""
    found = _leaves(body)
    raw = lambda k, v: None if k in ("null", "object") else v if k == "string" else json.dumps(v, ensure_ascii=False)
    return None if found is None else {p: (k, raw(k, v)) for p, k, v in found}


def _with(b: pa.RecordBatch, name: str, col: pa.Array) -> pa.RecordBatch:
    names = [n for n in b.schema.names if n != "body"]
    return pa.RecordBatch.from_arrays([*[b.column(n) for n in names], col], names=[*names, name])


def parse_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts ``fields`` in place of ``body``: every path with kind, raw text and names; null if the body is unreadable."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("path", "kind", "raw", "name", "whole")]))
    for b in batches:
        maps = [path_values(x) for x in b.column("body").to_pylist()]
        yield _with(b, "fields", pa.array([None if m is None else [{"path": p, "kind": k, "raw": r, "name": column_name(p), "whole": whole_name(p)} for p, (k, r) in m.items()] for m in maps], kind))


def parse_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts ``types`` in place of ``body``: every path behind the letter of its kind, in order; null if unreadable."""
    for b in batches:
        found = [_leaves(x) for x in b.column("body").to_pylist()]
        yield _with(b, "types", pa.array([None if f is None else sorted(LETTERS[k] + p for p, k, _ in f) for f in found], pa.list_(pa.string())))


# ------------------------------------------------------------------------------------------------ names


@lru_cache(100_000)
def words(segment: str) -> tuple[str, ...]:
    """The words of one name, without namespace, whatever the spelling (snake, kebab, camel)."""
    s = segment.rsplit(":", 1)[-1]
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s).lower()
    return tuple(re.findall(r"[a-z0-9]+", s)) or (s,)


@lru_cache(100_000)
def setting(path: str) -> tuple[tuple[str, ...], ...]:
    """What a path names: its last name's words, preceded by the enclosing name where the last one is generic."""
    parts = [words(p) for p in path.split(".")]
    k = len(parts) - 1
    while k > 0 and len(parts[k]) == 1 and parts[k][0] in GENERIC:
        k -= 1
    return tuple(parts[k:])


def _short_for(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """a abbreviates b: each word of a starts the next stretch of b, from its first letter on to a last word."""
    if len(a) == len(b):
        return all(y.startswith(x) for x, y in zip(a, b))
    if len(a) >= 2 and b[-len(a):] == a:
        return True
    return len(a) >= 2 and len(b) == 1 and re.fullmatch("".join(re.escape(x) + "[a-z]*" for x in a), b[0]) is not None


@lru_cache(500_000)
def likeness(old: str, new: str) -> int:
    """0: other settings; else higher where the names agree more closely."""
    a, b = setting(old), setting(new)
    if len(a) != len(b):
        return 0
    if a == b:
        return 3 if old.split(".")[0] == new.split(".")[0] else 2
    return int(all(x == y or _short_for(x, y) or _short_for(y, x) for x, y in zip(a, b)))


def pair_names(gone: list[str], come: list[str]) -> list[tuple[str, str, str]]:
    """(change, field_path, new_path) of the paths of one version that are not in the next one (``gone``) and the
    reverse (``come``), each behind its kind's letter: renamed where the names agree, the closest first, else
    removed and added."""
    kind = {p[1:]: p[0] for p in gone}
    kind_new = {p[1:]: p[0] for p in come}
    out, used_old, used_new = [], set(), set()
    pairs = sorted((-n, kind[o] != kind_new[p], o, p) for o in kind for p in kind_new if (n := likeness(o, p)))
    for _, _, o, p in pairs:
        if o not in used_old and p not in used_new:
            used_old.add(o)
            used_new.add(p)
            out.append(("renamed", o, p))
    out += [("removed", p, "") for p in kind if p not in used_old]
    return out + [("added", p, "") for p in kind_new if p not in used_new]


# -------------------------------------------------------------------------------------------- operators


def _parsed(files: DataFrame, cols: list[str], parse, name: str, ddl: str) -> DataFrame:  # noqa: ANN001
    types = dict(files.dtypes)
    return files.select(*cols, "body").mapInArrow(parse, ", ".join(f"`{c}` {types[c]}" for c in cols) + f", {name} {ddl}")


def readable_versions(files: DataFrame, keys: list[str], version: str, received: str) -> DataFrame:
    """(keys, version, file_id, types): per key and version the types by path of the readable body received last
    (ties: the greater file_id)."""
    parsed = _parsed(files, [*keys, version, received, "file_id"], parse_types, "types", "array<string>").filter("types is not null")
    return parsed.groupBy(*keys, version).agg(F.max_by(F.struct("file_id", "types"), F.struct(received, "file_id")).alias("b")).select(
        *keys, version, "b.file_id", "b.types"
    )


def path_statistics(versions: DataFrame, by: list[str], version: str) -> DataFrame:
    """(by, path, kind, files, first, last): in how many file versions each path has each kind, and from which version to which."""
    letter = F.create_map(*[F.lit(x) for k, c in LETTERS.items() for x in (c, k)])
    e = versions.select(*by, version, F.explode("types").alias("t")).select(*by, version, F.expr("substring(t, 2)").alias("path"), letter[F.left("t", F.lit(1))].alias("kind"))
    return e.groupBy(*by, "path", "kind").agg(F.count("*").alias("files"), F.min(version).alias("first"), F.max(version).alias("last"))


def shifts(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """(keys, version, retyped, gone, come) from each version's statistics and those of the next lower one.

    retyped: paths whose kind differs, where both have one (a null has none). gone, come: paths that only the lower
    or only the later version has, behind the letter of their kind; objects are left out, as they only hold others.
    """
    w = Window.partitionBy(*keys).orderBy(version)
    d = versions.select(*keys, version, "types").withColumn("before", F.lag("types").over(w)).filter("before is not null")
    # entries are kind and path in one text, so what differs is found by hashed array operations
    d = d.select(*keys, version, F.array_except("before", "types").alias("a"), F.array_except("types", "before").alias("b"))
    path = lambda x: F.expr(f"transform({x}, e -> substring(e, 2))")
    d = d.withColumns({"_a": path("a"), "_b": path("b")})
    typed = F.array_intersect(F.expr("transform(filter(a, e -> left(e, 1) <> '0'), e -> substring(e, 2))"), F.expr("transform(filter(b, e -> left(e, 1) <> '0'), e -> substring(e, 2))"))
    only = lambda x, other: F.expr(f"filter({x}, e -> left(e, 1) <> 'o' and not array_contains({other}, substring(e, 2)))")
    return d.select(*keys, version, typed.alias("retyped"), only("a", "_b").alias("gone"), only("b", "_a").alias("come"))


def changes(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Every change between each version of a key and the next lower one: (keys, version, change, paths).

    A scalar that becomes an object is retyped, what is below it added (and the reverse: retyped, what was below
    removed). Of what is gone and what has come, names that say the same thing are renamed.
    """

    @F.pandas_udf("array<struct<change:string,field_path:string,new_path:string>>")
    def pair(gone: pd.Series, come: pd.Series) -> pd.Series:
        return pd.Series([[{"change": c, "field_path": f, "new_path": n} for c, f, n in pair_names(list(a), list(b))] for a, b in zip(gone, come)])

    d = shifts(versions, keys, version)
    retyped = F.transform("retyped", lambda p: F.struct(F.lit("retyped").alias("change"), p.alias("field_path"), F.lit("").alias("new_path")))
    return d.select(*keys, version, F.explode(F.concat(retyped, pair("gone", "come"))).alias("x")).select(*keys, version, "x.*")


@lru_cache(100_000)
def column_name(path: str) -> str:
    """The name of the setting: its own words, with the enclosing name where they say nothing by themselves."""
    return "__".join("_".join(w) for w in setting(path))


@lru_cache(100_000)
def whole_name(path: str) -> str:
    """The words of the whole path, without enclosing names that say nothing."""
    parts = [words(p) for p in path.split(".")]
    kept = [w for k, w in enumerate(parts) if k == len(parts) - 1 or len(w) > 1 or w[0] not in GENERIC]
    return "__".join("_".join(w) for w in kept)


def _castable(kind: Column, raw: Column) -> Column:
    """Whether a raw text fits the wanted kind."""
    number = raw.try_cast("double")
    return (
        F.when(kind == "number", number.isNotNull())
        .when(kind == "boolean", raw.isin("true", "false") | F.coalesce(number.isin(0.0, 1.0), F.lit(False)))
        .otherwise(True)
    )


def _before(array: str) -> Column:
    """The array with each element in the place of the next one, and null in the first."""
    return F.when(F.size(array) > 0, F.concat(F.array(F.lit(None)), F.slice(array, 1, F.size(array) - 1))).otherwise(F.col(array))


def unify(files: DataFrame, ids: list[str], *, max_columns: int = MAX_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """One consistent table over all files (``ids`` and ``body``), and a report of the values that did not fit.

    A setting's column carries its name; where some file has two paths of one name, these are different settings and
    each goes by its whole path. A column's type is the commonest kind over all files (number: double, boolean, else
    string; ties in the order boolean, number, string, list). Settings beyond the ``max_columns`` commonest stay with
    their raw values in the map column ``other``. Report: (ids, path, column, kind, raw, wanted, reason); reason
    ``cast``: the value has another kind and reads as null in its column; ``clash``: two spellings of one path stand
    side by side, the first (in order of paths) has the column and the other is in ``other`` under its own path.
    Unreadable bodies give rows without values. Nothing is dropped. Two files with equal ids have a row each.
    """
    rows = cut(_parsed(files, ids, parse_fields, "fields", FIELDS_DDL))
    own = F.filter(F.coalesce(F.col("fields"), F.array().cast(FIELDS_DDL)), lambda x: ~x["kind"].isin("object", "null"))
    rows = rows.select(*ids, own.alias("fields"))
    # a name that one file holds twice stands for several settings; the list is part of the schema
    names = rows.select(F.array_sort(F.transform("fields", lambda x: x["name"])).alias("n"))
    twice = names.select(F.filter(F.zip_with("n", _before("n"), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()).alias("x")).filter(F.size("x") > 0)
    split = sorted(r.x for r in twice.select(F.explode("x").alias("x")).distinct().collect())
    column = lambda x: (F.when(x["name"].isin(split), x["whole"]).otherwise(x["name"]) if split else x["name"])
    placed = F.array_sort(F.transform("fields", lambda x: F.struct(column(x).alias("column"), x["path"].alias("path"), x["kind"].alias("kind"), x["raw"].alias("raw"))))
    rows = rows.select(*ids, placed.alias("f"))
    again = lambda x, y: F.struct(x["column"].alias("column"), x["path"].alias("path"), x["kind"].alias("kind"), x["raw"].alias("raw"), F.coalesce(x["column"] == y["column"], F.lit(False)).alias("again"))
    rows = rows.select(*ids, F.zip_with("f", _before("f"), again).alias("f"))
    order = F.when(F.col("kind") == "boolean", 0).when(F.col("kind") == "number", 1).when(F.col("kind") == "string", 2).otherwise(3)
    cells = rows.select(*ids, F.explode("f").alias("x")).select(*ids, "x.*")
    kinds = cells.groupBy("column", "kind").agg(F.count("*").alias("n")).groupBy("column").agg(F.max_by("kind", F.struct("n", -order)).alias("wanted"), F.sum("n").alias("n"))
    kinds = cut(kinds)
    wanted = {r["column"]: r["wanted"] for r in kinds.orderBy(F.desc("n"), "column").limit(max_columns).collect()}  # the schema of the table

    def typed(kind: str, raw: Column) -> Column:
        number = raw.try_cast("double")
        if kind == "number":
            return number
        return F.when(raw.isin("true", "false"), raw.try_cast("boolean")).when(number == 1, True).when(number == 0, False) if kind == "boolean" else raw

    mapped = F.map_from_entries(F.transform(F.filter("f", lambda x: ~x["again"]), lambda x: F.struct(x["column"], x["raw"])))
    known = sorted(wanted)
    kept = lambda x: ~x["again"] & x["column"].isin(known) if known else F.lit(False)
    other = F.map_from_entries(F.transform(F.filter("f", lambda x: ~kept(x)), lambda x: F.struct(x["path"], x["raw"])))
    # all columns are found in one walk through the map, as the fields of a JSON object, not by a look-up each
    schema = T.StructType([T.StructField(c, T.StringType()) for c in known])
    wide = F.from_json(F.to_json(mapped), schema) if known else F.struct(F.lit(0))
    table = rows.select(*ids, wide.alias("_m"), other.alias("other")).select(*ids, *[typed(wanted[c], F.col("_m").getField(c)).alias(c) for c in known], "other")
    fits = F.when(F.col("again"), "clash").when(~_castable(F.col("wanted"), F.col("raw")) | ((F.col("wanted") == "list") & (F.col("kind") != "list")), "cast")
    report = cells.join(checked_broadcast(kinds.select("column", "wanted")), "column").withColumn("reason", fits).filter("reason is not null")
    return table, report.select(*ids, "path", "column", "kind", "raw", "wanted", "reason")
