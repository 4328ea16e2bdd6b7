"""The evaluation layer: reference building, pluggable estimators, on-map errors, fault roll-ups, alignment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import scalars
from sensorloom.operators import aggregates, geometry, timeops
from sensorloom.operators.windows import line

#: name -> function of (messages of one run in order of arrival, options) to rows (seq, t, v).
Estimator = Callable[[pd.DataFrame, Mapping], pd.DataFrame]
ESTIMATORS: dict[str, Estimator] = {}


def estimator(name: str) -> Callable[[Estimator], Estimator]:
    def add(f: Estimator) -> Estimator:
        ESTIMATORS[name] = f
        return f

    return add


@estimator("hold_mean")
def _hold_mean(pdf: pd.DataFrame, options: Mapping) -> pd.DataFrame:
    """Mean of the newest value of each wheel stream."""
    newest: dict[str, float] = {}
    out = []
    for seq, t, stream, v in pdf[["seq", "t", "stream", "value"]].itertuples(index=False):
        if stream != "cmd":
            newest[stream] = v
        out.append((seq, t, float(np.mean(list(newest.values()))) if newest else None))
    return pd.DataFrame(out, columns=["seq", "t", "v"])


@estimator("integrate_command")
def _integrate(pdf: pd.DataFrame, options: Mapping) -> pd.DataFrame:
    """Speed from commands alone: gain times command, integrated and held at 0."""
    gain, second = float(options.get("gain", 0.05)), float(options.get("second", 1.0))
    v, notch, before, out = 0.0, 0.0, None, []
    for seq, t, stream, x in pdf[["seq", "t", "stream", "value"]].itertuples(index=False):
        v = max(0.0, v + (0.0 if before is None else gain * notch * (t - before) / 1e6 / second))
        before = t
        notch = x if stream == "cmd" else notch
        out.append((seq, t, v))
    return pd.DataFrame(out, columns=["seq", "t", "v"])


def replay(messages: DataFrame, name: str, options: Mapping | None = None) -> DataFrame:
    """Runs a registered estimator over each run: ``run, seq, t, v``."""
    f, chosen = ESTIMATORS[name], dict(options or {})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values("seq"), chosen)[["seq", "t", "v"]]
        out.insert(0, "run", int(pdf["run"].iloc[0]))
        return out

    return messages.select("run", "seq", "t", "stream", "value").groupBy("run").applyInPandas(run, "run long, seq long, t long, v double")


def build_reference(fixes: DataFrame, *, good: Column, jump: float, key: str = "run") -> DataFrame:
    """Good rows in time order, the last of equal stamps, without those that jump from both neighbours."""
    kept = timeops.last_per_key(fixes.filter(good), [key, "t"])
    w = line(key, "t", "seq")
    before, after = F.abs(F.col("v") - F.lag("v").over(w)), F.abs(F.col("v") - F.lead("v").over(w))
    out = kept.withColumn("__far", F.coalesce((before > jump) & (after > jump), F.lit(False)))
    return out.filter(~F.col("__far")).drop("__far")


REGIMES = ("stopped", "accel", "brake", "cruise")


def evaluate(estimate: DataFrame, reference: DataFrame, *, tol: int, unit: float = 1e6, still: float = 0.1, edge: float = 0.15, key: str = "run") -> DataFrame:
    """All metrics of an estimate (run, seq, t, v) against a reference, one row a run.

    Each reference row meets the nearest answer within ``tol``: coverage, error statistics, those of
    each regime of the reference, the error at the end, and both ways (``unit`` of t to a second).  A
    reference as its own estimate has no error.
    """
    w = line(key, "t", "seq")
    met = timeops.nearest(reference.select(key, "seq", "t", "v"), estimate, tol=tol, key=key).withColumn("e", F.col("r_v") - F.col("v"))
    dt = (F.col("t") - F.lag("t").over(w)) / unit
    part = lambda c: dt * (F.col(c) + F.lag(c).over(w)) / 2
    step = F.when(dt > 0, (F.col("v") - F.lag("v").over(w)) / dt)
    x = met.withColumn("regime", scalars.regime(F.coalesce(step, F.lit(0.0)), F.col("v"), edge=edge, still=still)).withColumn("way", part("v")).withColumn("r_way", part("r_v"))
    of = lambda r: F.when(F.col("regime") == r, F.col("e"))
    by_regime = [c for r in REGIMES for c in (F.count(of(r)).alias(f"{r}_n"), F.sqrt(F.avg(of(r) * of(r))).alias(f"{r}_rmse"))]
    end = F.max_by("e", F.when(F.col("e").isNotNull(), F.struct("t", "seq"))).alias("end")
    return x.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("e").isNotNull().cast("double")).alias("coverage"), *aggregates.error_stats(F.col("e")), *by_regime, end, F.sum("way").alias("way"), F.sum("r_way").alias("r_way"))


def on_map_summary(df: DataFrame, points: Sequence[tuple[float, float]], *, s_true: str, gate: float, key: str = "run") -> DataFrame:
    """Along-track and cross-track errors of positions within ``gate`` of the map and not past its ends."""
    p = geometry.project(df, points).withColumn("on_map", (F.col("foot.dist") <= gate) & ~F.col("beyond"))
    along, cross = F.when(F.col("on_map"), F.col("foot.s") - F.col(s_true)), F.when(F.col("on_map"), F.abs("foot.lateral"))
    off = F.when(~F.col("on_map"), F.col("foot.dist"))
    return p.groupBy(key).agg(
        F.count_if("on_map").alias("n_on_map"), F.avg(along).alias("along_mean"), F.sqrt(F.avg(along * along)).alias("along_rmse"), F.percentile(F.abs(along), F.lit(0.95)).alias("along_p95"),
        F.avg(cross).alias("cross_mean"), F.max(cross).alias("cross_max"), F.avg(off).alias("off_mean"), F.max(off).alias("off_max"),
    )


def fault_roll_up(windows: DataFrame, scenario: str, metric: str, limit: float) -> DataFrame:
    """Per scenario: median, p90, extremes, share within ``limit`` and runs without recovery (null)."""
    x = F.col(metric)
    return windows.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("n"), F.median(x).alias("median"), F.percentile(x, F.lit(0.9)).alias("p90"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.avg(F.coalesce((x <= limit).cast("double"), F.lit(0.0))).alias("within"), F.count_if(x.isNull()).alias("never"),
    )


def project_over(df: DataFrame, branches: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """Adds ``best``: (dist, order, branch, s) of the nearest branch; the first named wins ties."""
    feet = df
    for name, points in branches.items():
        feet = geometry.project(feet, points, beyond=False).withColumnRenamed("foot", f"__{name}").drop("beyond")
    options = F.array(*[F.struct(F.col(f"__{n}.dist").alias("dist"), F.lit(k).alias("order"), F.lit(n).alias("branch"), F.col(f"__{n}.s").alias("s")) for k, n in enumerate(branches)])
    return feet.withColumn("best", F.array_min(options)).drop(*[f"__{n}" for n in branches])


def align(fixes: DataFrame, branches: Mapping[str, Sequence[tuple[float, float]]], *, window: int, least: int, near: float, far: float, key: str = "run") -> DataFrame:
    """Start position of each run from the fixes of its first ``window``.

    Rules in order: ``onmap`` (median within ``near`` of a branch), ``near`` (within ``far``), else
    ``free``; ``none`` with fewer than ``least`` fixes.  sigma is the upper-median distance to the median.
    """
    first = Window.partitionBy(key)
    w = fixes.withColumn("__t0", F.min("t").over(first)).filter(F.col("t") <= F.col("__t0") + window)
    mid = w.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("mx"), F.median("y").alias("my"))
    spread = F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))
    start = w.join(mid, key).groupBy(key, "n", "mx", "my").agg(F.median(spread).alias("sigma")).withColumnsRenamed({"mx": "x", "my": "y"})
    best = project_over(start, branches)
    d = F.col("best.dist")
    rule = F.when(F.col("n") < least, "none").when(d <= near, "onmap").when(d <= far, "near").otherwise("free")
    return best.select(key, "n", "x", "y", "sigma", rule.alias("rule"), F.when(d <= far, F.col("best.branch")).alias("branch"), F.when(d <= far, F.col("best.s")).alias("s"))


def termini(df: DataFrame, on_map: Column, *, key: str = "run") -> DataFrame:
    """Rows before the first and after the last on-map row of each run, as ``part`` head and tail."""
    w = Window.partitionBy(key)
    marked = df.withColumn("__on", on_map).withColumn("__a", F.min(F.when(F.col("__on"), F.col("t"))).over(w)).withColumn("__b", F.max(F.when(F.col("__on"), F.col("t"))).over(w))
    part = F.when(F.col("t") < F.col("__a"), "head").when(F.col("t") > F.col("__b"), "tail")
    return marked.withColumn("part", part).filter("part is not null").drop("__on", "__a", "__b")


def cluster_tracks(tracks: Mapping[str, np.ndarray], limit: float) -> dict[str, int]:
    """Greedy clusters of a few polylines: a track joins the first cluster whose founder lies within
    ``limit`` of 90 % of its points."""
    founders: list[np.ndarray] = []
    out = {}
    for name in sorted(tracks, key=lambda n: (-len(tracks[n]), n)):
        p = tracks[name]
        for k, f in enumerate(founders):
            d = np.sqrt(((p[:, None, :] - f[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
            if np.percentile(d, 90) <= limit:
                out[name] = k
                break
        else:
            out[name] = len(founders)
            founders.append(p)
    return out


def median_template(samples: DataFrame, points: Sequence[tuple[float, float]], *, step: float, passes: int = 4) -> list[tuple[float, float]]:
    """Moves a polyline to the median lateral offset of the samples around it, bin by bin, a few times.

    What comes back each pass is one number a bin of the line's length.
    """
    for _ in range(passes):
        table = geometry.segments_of(points)
        feet = geometry.project(samples, points, beyond=False)
        rows = feet.groupBy(F.floor(F.col("foot.s") / step).alias("bin")).agg(F.median("foot.lateral").alias("off")).collect()
        off = {int(r["bin"]): float(r["off"]) for r in rows}
        moved = []
        for k, (x, y) in enumerate(points):
            seg = table[min(k, len(table) - 1)]
            shift = off.get(int((seg[6] if k < len(table) else seg[6] + seg[5] - 1e-9) // step), 0.0)
            moved.append((x - seg[4] * shift, y + seg[3] * shift))
        points = moved
    return list(points)
