"""Ordered analytics within a run.  All functions return columns over ``Window.partitionBy(key).orderBy(t, seq)``."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def line(key: str = "run", t: str = "t", seq: str = "seq") -> WindowSpec:
    return Window.partitionBy(key).orderBy(t, seq)


def backward(key: str = "run", t: str = "t", seq: str = "seq") -> WindowSpec:
    """``line`` from the end: its ``so_far`` covers a row and all after it, at a row's cost a row."""
    return Window.partitionBy(key).orderBy(F.desc(t), F.desc(seq))


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def odometer(t: Column, v: Column, w: WindowSpec, longest: float, unit: float = 1e6) -> Column:
    """Trapezoid integral of ``v``; a step counts ``longest`` seconds at most and not less than 0."""
    dt = F.least(F.greatest((t - F.lag(t).over(w)) / unit, F.lit(0.0)), F.lit(longest))
    return dt * (v + F.lag(v).over(w)) / 2


def moving_average(v: Column, n: int, w: WindowSpec) -> Column:
    """Centred mean of ``n`` values, the ends padded with the end values."""
    lo, hi = n // 2, n - 1 - n // 2
    row, size = F.row_number().over(w), F.count(F.lit(1)).over(whole(w))
    frame = w.rowsBetween(-lo, hi)
    short_lo = F.greatest(F.lit(0), F.lit(lo) - (row - 1))
    short_hi = F.greatest(F.lit(0), F.lit(hi) - (size - row))
    return (F.sum(v).over(frame) + short_lo * F.first(v).over(whole(w)) + short_hi * F.last(v).over(whole(w))) / n


def gradient(v: Column, t: Column, w: WindowSpec) -> Column:
    """Second-order differences on uneven steps, one-sided at the ends."""
    h0, h1 = t - F.lag(t).over(w), F.lead(t).over(w) - t
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    inner = (h0 * h0 * after + (h1 * h1 - h0 * h0) * v - h1 * h1 * before) / (h0 * h1 * (h0 + h1))
    return F.when(before.isNull(), (after - v) / h1).when(after.isNull(), (v - before) / h0).otherwise(inner)


def unwrap(angle: Column, w: WindowSpec, period: float = 6.283185307179586) -> Column:
    """What to add to ``angle`` so that steps are at most half a period: sum it over ``so_far``."""
    return -period * F.bround((angle - F.lag(angle).over(w)) / period)


def held(flag: Column, t: Column, w: WindowSpec, hold: int) -> Column:
    """True for ``hold`` from the last true row on."""
    last = F.max(F.when(flag, t)).over(so_far(w))
    return F.coalesce(t - last < hold, F.lit(False))


def running_median(v: Column, n: int, w: WindowSpec) -> Column:
    return F.percentile(v, F.lit(0.5)).over(w.rowsBetween(-(n // 2), n // 2))

