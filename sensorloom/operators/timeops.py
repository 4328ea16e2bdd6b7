"""Joins of streams sampled on different clocks, keyed and in event time.

Times are whole microseconds.  A join is one shuffle: both sides are tagged, united and ordered
within their key, and neighbours are looked up with window functions, so no plan has a nested loop.
With a tolerance (``within``) the key also holds a time bucket, rows near an edge go to both sides, and
a long run is spread over many tasks; without one a run's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances that one time bucket spans.
_BUCKET = 64


def last_per_key(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """One row of each key: the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def neighbours(left: DataFrame, right: DataFrame, *, key: str = "run", t: str = "t", values: Sequence[str] = ("v",), order: str = "seq", within: int | None = None) -> DataFrame:
    """Rows of ``left`` with ``prev`` and ``next``: structs (t, values) of the nearest rows of
    ``right`` at or before, and after; equal stamps count as before, the last by ``order`` first."""
    shown = F.struct(F.col(t).alias("t"), *[F.col(c) for c in values])
    lcols = [c for c in left.columns]
    a = left.select(F.col(key).alias("__k"), F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__o"), F.struct(*lcols).alias("__row"))
    b = right.select(F.col(key).alias("__k"), F.col(t).alias("__t"), F.lit(0).alias("__side"), F.col(order).cast("long").alias("__o"), shown.alias("__hit"))
    keys = ["__k"]
    if within is not None:
        width = max(1, within) * _BUCKET
        at = lambda c: F.floor(c / F.lit(width)).cast("long")
        a = a.withColumn("__b", at(F.col("__t")))
        b = b.withColumn("__b", F.explode(F.sequence(at(F.col("__t") - within), at(F.col("__t") + within))))
        keys = ["__k", "__b"]
    both = a.unionByName(b, allowMissingColumns=True)
    # What comes after is what came before in the opposite order: both frames grow by a row a row,
    # while one that reaches ahead to the end is added up anew for every row.
    here = Window.partitionBy(*keys)
    newest = lambda w: F.last("__hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = newest(here.orderBy("__t", "__side", "__o"))
    after = newest(here.orderBy(F.desc("__t"), F.desc("__side"), F.desc("__o")))
    found = both.select("__side", "__row", before.alias("prev"), after.alias("next")).filter("__side = 1")
    out = found.select(*[F.col(f"__row.{c}").alias(c) for c in lcols], "prev", "next")
    if within is not None:
        near = lambda c: F.when(F.abs(F.col(f"{c}.t") - F.col(t)) <= within, F.col(c))
        out = out.withColumn("prev", near("prev")).withColumn("next", near("next"))
    return out


def asof(left: DataFrame, right: DataFrame, *, values: Sequence[str] = ("v",), key: str = "run", t: str = "t", stale: int | None = None, strict: bool = False, shift: int = 0, prefix: str = "r_") -> DataFrame:
    """Zero-order hold: the last row of ``right`` at or before ``t - shift``.

    With ``stale`` older rows do not count (``strict``: nor does one of exactly that age).
    """
    probe = left.withColumn("__t0", F.col(t)).withColumn(t, F.col(t) - shift) if shift else left
    found = neighbours(probe, right, key=key, t=t, values=values, within=stale)
    hit = F.col("prev")
    if stale is not None:
        age = F.col(t) - F.col("prev.t")
        hit = F.when(age < stale if strict else age <= stale, hit)
    found = found.withColumn("__hit", hit)
    if shift:
        found = found.withColumn(t, F.col("__t0")).drop("__t0")
    return found.select(*left.columns, F.col("__hit.t").alias(f"{prefix}t"), *[F.col(f"__hit.{c}").alias(f"{prefix}{c}") for c in values])


def nearest(left: DataFrame, right: DataFrame, *, tol: int, values: Sequence[str] = ("v",), key: str = "run", t: str = "t", strict: bool = False, prefix: str = "r_") -> DataFrame:
    """The nearest row of ``right``, the earlier one of two; null beyond ``tol``."""
    found = neighbours(left, right, key=key, t=t, values=values, within=tol)
    back, ahead = F.col(t) - F.col("prev.t"), F.col("next.t") - F.col(t)
    hit = F.when(F.col("next.t").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    found = found.withColumn("__hit", hit)
    gap = F.abs(F.col("__hit.t") - F.col(t))
    found = found.withColumn("__hit", F.when(gap < tol if strict else gap <= tol, F.col("__hit")))
    return found.select(*left.columns, F.col("__hit.t").alias(f"{prefix}t"), *[F.col(f"__hit.{c}").alias(f"{prefix}{c}") for c in values])


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    return F.when(t1 > t0, v0 + (v1 - v0) * (t - t0) / (t1 - t0)).otherwise(v0)


def interpolate(left: DataFrame, right: DataFrame, *, value: str = "v", key: str = "run", t: str = "t", max_gap: int | None = None, bracket: int | None = None, clamp: bool = True, half_open: bool = False, out: str = "interp") -> DataFrame:
    """Piecewise linear value of ``right`` at the times of ``left``.

    Outside: the end values, or null without ``clamp``.  Null if the nearest row is further than
    ``max_gap``, or the rows around are further apart than ``bracket``.  ``half_open``: null from the last row on.
    """
    found = neighbours(left, right, key=key, t=t, values=(value,))
    p, n = F.col("prev"), F.col("next")
    between = lerp(F.col(t), p["t"], p[value], n["t"], n[value])
    exact = p["t"] == F.col(t)
    result = F.when(exact, p[value]).when(p["t"].isNull(), n[value] if clamp else F.lit(None)).when(n["t"].isNull(), p[value] if clamp else F.lit(None)).otherwise(between)
    if half_open:
        result = F.when(n["t"].isNotNull(), result)
    if max_gap is not None:
        result = F.when(F.least(F.col(t) - p["t"], n["t"] - F.col(t)) <= max_gap, result)
    if bracket is not None:
        result = F.when(exact | (n["t"] - p["t"] <= bracket), result)
    return found.withColumn(out, result).select(*left.columns, out)


def extrapolating_asof(left: DataFrame, right: DataFrame, *, stale: int, horizon: int, least_span: int, value: str = "v", key: str = "run", t: str = "t", out: str = "extrap") -> DataFrame:
    """Last value plus the slope of the last two rows times the age, floored at 0.

    The age counts up to ``horizon`` ahead and the rows' span back; the slope is 0 if they are closer
    than ``least_span``.  Null beyond ``stale``.
    """
    line = Window.partitionBy(key).orderBy(t, "seq")
    pairs = right.withColumn("__t1", F.lag(t).over(line)).withColumn("__v1", F.lag(value).over(line))
    held = asof(left, pairs, values=(value, "__t1", "__v1"), key=key, t=t, stale=stale)
    span = F.col("r_t") - F.col("r___t1")
    slope = F.when(span >= least_span, (F.col(f"r_{value}") - F.col("r___v1")) / span).otherwise(0.0)
    age = F.greatest(F.least(F.col(t) - F.col("r_t"), F.lit(horizon)), -F.coalesce(span, F.lit(0)))
    return held.withColumn(out, F.when(F.col("r_t").isNotNull(), F.greatest(F.col(f"r_{value}") + slope * age, F.lit(0.0)))).select(*left.columns, out)


def merge_streams(streams: Sequence[tuple[int, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """Rows of all streams with ``rank``, a total order being (t, rank, seq)."""
    parts = [df.select(*columns, F.lit(rank).alias("rank")) for rank, df in streams]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_match(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on exact stamps."""
    return left.join(right, list(on))


def synchronise(df: DataFrame, *, first: str, second: str, slop: int, depth: int = 100) -> DataFrame:
    """Approximate-time pairs of two streams of each run, in arrival order.

    A message waits under its stamp; a later one of equal stamp and stream takes its place, and a
    stream over ``depth`` loses its least stamp before anything is matched.  Then the arrival takes the
    waiting message of the other stream with the closest stamp, of equally close ones the first
    arrived, if it is nearer than ``slop``; both are used up.  The outcome depends on order, so a
    run is one group.
    """

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[str, dict[int, int]] = {first: {}, second: {}}  # in order of arrival: stamp to seq
        out = []
        for stream, t, seq in pdf.sort_values("seq")[["stream", "t", "seq"]].itertuples(index=False):
            mine, theirs = waiting[stream], waiting[second if stream == first else first]
            mine[t] = seq  # an equal stamp keeps its place in the order
            if len(mine) > depth:
                del mine[min(mine)]
            best = min(theirs, key=lambda x: abs(x - t), default=None)
            if t in mine and best is not None and abs(best - t) < slop:
                hit = (t, mine.pop(t)), (best, theirs.pop(best))
                a, b = hit if stream == first else hit[::-1]
                out.append((pdf["run"].iloc[0], a[0], b[0], a[1], b[1]))
        return pd.DataFrame(out, columns=["run", "t_first", "t_second", "seq_first", "seq_second"])

    two = df.filter(F.col("stream").isin(first, second)).select("run", "stream", "t", "seq")
    return two.groupBy("run").applyInPandas(pair, "run long, t_first long, t_second long, seq_first long, seq_second long")
