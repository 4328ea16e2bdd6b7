"""Small files: routes and branches as JSON, parameters as flat YAML, reports as JSON and Markdown, CSV tables."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from dataclasses import fields, replace
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

P = TypeVar("P")


def read_route(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``route, i, x, y, z, curv`` of a file {"points": [{x, y, z, curv}]}."""
    schema = "points array<struct<x:double,y:double,z:double,curv:double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.lit(name).alias("route"), F.posexplode("points").alias("i", "p")).select("route", "i", "p.*")


def read_branches(spark: SparkSession, path: str) -> DataFrame:
    """``loop, from, to, branch, k, x, y, z`` of a file {loop: {from, to, branches: [{name, x, y, z}]}}."""
    return branches_of(spark.read.text(path, wholetext=True))


def branches_of(texts: DataFrame) -> DataFrame:
    """The same of files' texts, as ``value``."""
    branch = "struct<name:string,x:array<double>,y:array<double>,z:array<double>>"
    schema = f"loops map<string,struct<`from`:string,`to`:string,branches:array<{branch}>>>"
    raw = texts.select(F.from_json(F.concat(F.lit('{"loops":'), "value", F.lit("}")), schema).alias("f"))
    loops = raw.select(F.explode("f.loops").alias("loop", "l")).select("loop", "l.from", "l.to", F.explode("l.branches").alias("b"))
    points = loops.select("loop", "from", "to", F.col("b.name").alias("branch"), F.posexplode(F.arrays_zip("b.x", "b.y", "b.z")).alias("k", "p"))
    return points.select("loop", "from", "to", "branch", "k", "p.x", "p.y", "p.z")


def write_branches(points: DataFrame, path: str) -> None:
    """The inverse of ``read_branches``: the file is written aside and then put in place.

    Branches are parts of a map, so they pass through the driver, one row a point.
    """
    loops: dict[str, dict] = {}
    for r in points.orderBy("loop", "branch", "k").toLocalIterator():
        loop = loops.setdefault(r["loop"], {"from": r["from"], "to": r["to"], "branches": {}})
        b = loop["branches"].setdefault(r["branch"], {"name": r["branch"], "x": [], "y": [], "z": []})
        for c in "xyz":
            b[c].append(r[c])
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump({n: {**loop, "branches": list(loop["branches"].values())} for n, loop in loops.items()}, f)
    os.replace(path + ".new", path)


def _value(text: str) -> Any:
    if text.startswith("["):
        return tuple(json.loads(text))
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def parse_params(text: str) -> dict[str, Any]:
    """Flat ``key: value`` lines; headings (a node's name, ``ros__parameters``) and comments are skipped."""
    out = {}
    for line in text.splitlines():
        key, colon, rest = line.split("#")[0].strip().partition(":")
        if colon and rest.strip():
            out[key.strip()] = _value(rest.strip())
    return out


def read_params(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return parse_params(f.read())


def write_params(params: Any, node: str | None = None, notes: Mapping[str, str] | None = None) -> str:
    """Flat lines or, for a ``node``, under its headings; ``notes`` are comments by field."""
    notes = notes or {}
    indent = "    " if node else ""
    head = f"{node}:\n  ros__parameters:\n" if node else ""
    line = lambda n: f"{indent}{n}: {json.dumps(getattr(params, n))}" + (f"  # {notes[n]}" if n in notes else "")
    return head + "".join(line(f.name) + "\n" for f in fields(params))


def verify_params(text: str, params: Any) -> list[str]:
    """What a parameter file's text says otherwise than ``params``, by value and type."""
    found, errors = parse_params(text), []
    for f in fields(params):
        want = getattr(params, f.name)
        got = found.pop(f.name, None)
        if got is None:
            errors.append(f"{f.name} is missing")
        elif type(got) is not type(want) or got != want:
            errors.append(f"{f.name}: {got!r} ({type(got).__name__}) instead of {want!r} ({type(want).__name__})")
    return errors + [f"unknown: {name}" for name in sorted(found)]


def with_values(params: P, values: Mapping[str, Any]) -> P:
    """``params`` with some fields replaced, coerced to the fields' types; unknown names are errors."""
    known = {f.name: type(getattr(params, f.name)) for f in fields(params)}  # type: ignore[arg-type]
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise KeyError(f"unknown parameters: {', '.join(unknown)}")
    return replace(params, **{k: known[k](v) for k, v in values.items()})  # type: ignore[type-var]


def parse_sets(text: str) -> dict[str, Any]:
    """``a=1,b=x`` to a dict."""
    return {k.strip(): _value(v.strip()) for k, _, v in (p.partition("=") for p in text.split(",") if p.strip())}


def plain(value: Any) -> Any:
    """JSON-ready: numbers that are not finite become null."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def report_json(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([plain(r.asDict(recursive=True)) for r in rows.toLocalIterator()], f, indent=1)


def report_markdown(rows: DataFrame) -> str:
    cell = lambda v: "–" if v is None else f"{v:.3g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.toLocalIterator()]) + "\n"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
