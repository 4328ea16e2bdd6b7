"""Fault injection: row transforms inside a window [t0, t0 + dur) from each run's first stamp."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("drop", "zero", "freeze", "nan", "scale", "slip", "stamp_jump", "spikes", "noise", "noise_moving")


@dataclass(frozen=True)
class Fault:
    kind: str
    streams: tuple[str, ...] = ()
    t0: int = 0
    dur: int = 0
    amp: float = 0.0
    ramp: int = 0
    rate: float = 0.0
    jump: int = 0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown fault {self.kind!r}")


def uniform(seed: int, *on: str) -> Column:
    """A repeatable number in [0, 1) from the row's own columns, whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *on), 11) / F.lit(float(1 << 53))


def normal(seed: int, *on: str) -> Column:
    u = F.greatest(uniform(seed, *on), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *on))


def inject(df: DataFrame, fault: Fault, *, key: str = "run", t: str = "t", v: str = "v", seed: int = 1) -> DataFrame:
    """``df`` with the fault applied to the named streams (all if none is named)."""
    f = fault
    run = Window.partitionBy(key)
    since = F.col(t) - F.min(t).over(run)
    touched = F.col("stream").isin(*f.streams) if f.streams else F.lit(True)
    inside = touched & (since >= f.t0) & (since < f.t0 + f.dur)
    d = df.withColumn("__in", inside).withColumn("__since", since)
    value = F.col(v)
    if f.kind == "drop":
        return d.filter("not __in").select(*df.columns)
    if f.kind == "zero":
        value = F.when(F.col("__in"), 0.0).otherwise(value)
    elif f.kind == "nan":
        value = F.when(~F.col("__in"), value)
    elif f.kind == "freeze":
        stream = Window.partitionBy(key, "stream")
        held = F.max(F.when(F.col("__since") < f.t0, F.struct(t, "seq", v))).over(stream)[v]
        first = F.min(F.struct(t, "seq", v)).over(stream)[v]
        value = F.when(F.col("__in"), F.coalesce(held, first)).otherwise(value)
    elif f.kind == "scale":
        value = F.when(F.col("__in"), value * f.amp).otherwise(value)
    elif f.kind == "slip":
        grown = F.least(F.lit(1.0), (F.col("__since") - f.t0) / max(f.ramp, 1)) if f.ramp else F.lit(1.0)
        value = F.when(F.col("__in"), value * (1 + f.amp * grown)).otherwise(value)
    elif f.kind == "spikes":
        struck = F.col("__in") & (uniform(seed, key, "seq") < f.rate)
        sign = F.when(uniform(seed + 7, key, "seq") < 0.5, -1.0).otherwise(1.0)
        value = F.when(struck, F.greatest(value + sign * f.amp, F.lit(0.0))).otherwise(value)
    elif f.kind in ("noise", "noise_moving"):
        on = F.col("__in") & (value > 0) if f.kind == "noise_moving" else F.col("__in")
        value = F.when(on, F.greatest(value + f.amp * normal(seed, key, "seq"), F.lit(0.0))).otherwise(value)
    elif f.kind == "stamp_jump":
        return d.withColumn(t, F.when(F.col("__in"), F.col(t) + f.jump).otherwise(F.col(t))).select(*df.columns)
    return d.withColumn(v, value).select(*df.columns)
