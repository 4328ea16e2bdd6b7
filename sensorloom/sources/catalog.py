"""Names of runs and selections of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(names: DataFrame, wanted: str) -> DataFrame:
    """All runs whose names end in ``wanted``."""
    return names.filter(F.endswith("name", F.lit(wanted)))


def resolve(names: DataFrame, wanted: str) -> DataFrame:
    """The run whose name is ``wanted``, or the only one that ends so; else an error."""
    found = candidates(names, wanted)
    rows = found.orderBy(F.col("name") != wanted, "name").limit(3).collect()
    if len([r for r in rows if r["name"] == wanted]) == 1:
        return names.filter(F.col("name") == wanted)
    if len(rows) != 1:
        raise ValueError(f"{wanted!r} names {'no run' if not rows else 'several runs: ' + ', '.join(r['name'] for r in rows)}")
    return found


def predicate(selector: str, known: Mapping[str, Callable[[str], Column]]) -> Column:
    """``a:1&b:2,c`` as a condition: commas join alternatives, ampersands conditions."""

    def one(term: str) -> Column:
        name, _, arg = term.strip().partition(":")
        if name == "all":
            return F.lit(True)
        if name not in known:
            raise ValueError(f"unknown selector {name!r}; known: {', '.join(sorted(known))}")
        return known[name](arg)

    alternatives = [reduce(lambda a, b: a & b, map(one, part.split("&"))) for part in selector.split(",")]
    return reduce(lambda a, b: a | b, alternatives)


def select_runs(runs: DataFrame, selector: str, known: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    return runs.filter(predicate(selector, known))
