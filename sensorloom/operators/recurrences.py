"""Ordered recurrences: what a row gives depends on what the rows before it gave.

A run is walked in one task, so parallelism is the number of runs.  Rows come sorted by (t, seq); state
is small.  Rows without a run are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rows = Callable[[pd.DataFrame], Iterator[tuple] | pd.DataFrame]


def by_run(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by run to as many partitions as shuffles have.

    The number is given, as the walk costs far more than its bytes tell: partitions must not be united.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def per_run(df: DataFrame, step: Rows, schema: str, *, key: str = "run", order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """``step`` over each run's ordered rows.

    Runs are dealt to partitions and sorted there; a partition is walked run by run, each gathered from
    the batches that hold it.
    """
    names = T.StructType.fromDDL(schema).fieldNames()

    def answer(parts: list[pd.DataFrame]) -> pd.DataFrame:
        out = step(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True))
        return out if isinstance(out, pd.DataFrame) else pd.DataFrame(list(out), columns=names)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            k = pdf[key].to_numpy()
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            done = []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(k)], strict=True):
                if held and held[0][key].iloc[0] != k[lo]:
                    done.append(answer(held))
                    held = []
                held.append(pdf.iloc[lo:hi])
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield answer(held)

    return by_run(df.filter(F.col(key).isNotNull()), key).sortWithinPartitions(key, *order).mapInPandas(walk, schema)


def lag_filter(df: DataFrame, *, tau: float) -> DataFrame:
    """First-order lag: z += (1 - exp(-dt / tau)) (u - z), dt in seconds."""

    def step(pdf):
        z = before = None
        for run, t, seq, u in pdf[["run", "t", "seq", "v"]].itertuples(index=False):
            z = u if z is None else z + (1 - exp(-(t - before) / 1e6 / tau)) * (u - z)
            before = t
            yield run, t, seq, z

    return per_run(df, step, "run long, t long, seq long, filtered double")


def keep_spaced(df: DataFrame, *, by: str, least: float) -> DataFrame:
    """Rows at least ``least`` of ``by`` away from the last row that was kept."""

    def step(pdf):
        last = None
        for run, t, seq, x in pdf[["run", "t", "seq", by]].itertuples(index=False):
            if last is None or abs(x - last) >= least:
                last = x
                yield run, t, seq, float(x)

    return per_run(df, step, f"run long, t long, seq long, {by if by != 't' else 'at'} double")


def keep_progress(df: DataFrame, *, by: str, least: float) -> DataFrame:
    """Rows whose ``by`` exceeds that of the last kept row by more than ``least``."""

    def step(pdf):
        last = None
        for run, t, seq, x in pdf[["run", "t", "seq", by]].itertuples(index=False):
            if last is None or x - last > least:
                last = x
                yield run, t, seq, float(x)

    return per_run(df, step, f"run long, t long, seq long, {by} double")


def sample_targets(df: DataFrame, *, targets: tuple[float, ...], spacing: int) -> DataFrame:
    """For each target share of a run's span the first free row from there on, ``spacing`` apart from all chosen."""

    def step(pdf):
        t = pdf["t"].to_numpy()
        chosen: list[int] = []
        for k, share in enumerate(targets):
            for i in np.flatnonzero(t >= t[0] + share * (t[-1] - t[0])):
                if all(abs(t[i] - t[j]) >= spacing for j in chosen):
                    chosen.append(i)
                    yield int(pdf["run"].iloc[0]), k, int(t[i]), int(pdf["seq"].iloc[i])
                    break

    return per_run(df, step, "run long, target int, t long, seq long")


def reject_spikes(df: DataFrame, *, jump: float, per_second: float) -> DataFrame:
    """Adds ``accepted``: false for a jump beyond jump + per_second * dt from the last accepted row,
    unless the row before was rejected too."""

    def step(pdf):
        v0 = t0 = None
        rejected = False
        for run, t, seq, v in pdf[["run", "t", "seq", "v"]].itertuples(index=False):
            bad = v0 is not None and not rejected and abs(v - v0) > jump + per_second * (t - t0) / 1e6
            rejected = bad
            if not bad:
                v0, t0 = v, t
            yield run, t, seq, v, not bad

    return per_run(df, step, "run long, t long, seq long, v double, accepted boolean")


def skip_recent(df: DataFrame, *, by: str, depth: int = 64) -> DataFrame:
    """Rows whose ``by`` is not among the last ``depth`` values emitted."""

    def step(pdf):
        recent: dict = {}
        for run, seq, x in pdf[["run", "seq", by]].itertuples(index=False):
            if x not in recent:
                recent[x] = None
                if len(recent) > depth:
                    del recent[next(iter(recent))]
                yield run, seq, x

    return per_run(df, step, f"run long, seq long, {by} long", order=("seq",))


def ramp(df: DataFrame, *, rate: float) -> DataFrame:
    """Follows ``v`` by at most ``rate`` a second."""

    def step(pdf):
        y = before = None
        for run, t, seq, v in pdf[["run", "t", "seq", "v"]].itertuples(index=False):
            room = 0.0 if before is None else rate * (t - before) / 1e6
            y = v if y is None else y + min(max(v - y, -room), room)
            before = t
            yield run, t, seq, y

    return per_run(df, step, "run long, t long, seq long, ramped double")


def offset_runs(df: DataFrame, *, offset: float, release: float, least: int) -> DataFrame:
    """Spans where |v| > ``offset`` for ``least`` or longer, prolonged while it stays above ``release``."""

    def step(pdf):
        t, e = pdf["t"].to_numpy(), pdf["v"].abs().to_numpy()
        i = 0
        while i < len(t):
            if e[i] <= offset:
                i += 1
                continue
            j = i
            while j + 1 < len(t) and e[j + 1] > offset:
                j += 1
            if t[j] - t[i] >= least:
                while j + 1 < len(t) and e[j + 1] > release:
                    j += 1
                yield int(pdf["run"].iloc[0]), int(t[i]), int(t[j]), j - i + 1
            i = j + 1

    return per_run(df, step, "run long, start long, stop long, n int")


def kinematic_filter(df: DataFrame, *, q: float, r: float, second: float = 1.0) -> DataFrame:
    """Constant-acceleration Kalman filter of speed (speed, acceleration); ``second``: seconds of a unit of time."""

    def step(pdf):
        x, p, before = np.zeros(2), np.diag([1e4, 1.0]), None
        for run, t, seq, z in pdf[["run", "t", "seq", "v"]].itertuples(index=False):
            dt = 0.0 if before is None else (t - before) / 1e6 / second
            before = t
            f = np.array([[1.0, dt], [0.0, 1.0]])
            x = f @ x
            p = f @ p @ f.T + q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
            k = p[:, 0] / (p[0, 0] + r)
            x = x + k * (z - x[0])
            p = p - np.outer(k, p[0])
            yield run, t, seq, float(x[0]), float(x[1]), float(p[0, 0])

    return per_run(df, step, "run long, t long, seq long, speed double, accel double, var double")


def best_window(segments: DataFrame, *, longest: int, most: int = 3) -> DataFrame:
    """Of 1 to ``most`` consecutive segments within ``longest``, those with the highest total of ``vmax``."""

    def step(pdf):
        rows = pdf[["start", "stop", "vmax"]].to_numpy()
        options = [(rows[i : i + c, 2].sum(), -i, -c) for i in range(len(rows)) for c in range(1, most + 1) if i + c <= len(rows) and rows[i + c - 1, 1] - rows[i, 0] <= longest]
        if options:
            total, i, c = max(options)
            yield int(pdf["run"].iloc[0]), int(rows[-i, 0]), int(rows[-i - c - 1, 1]), -c, float(total)

    return per_run(segments, step, "run long, start long, stop long, segments int, total double", order=("start",))
