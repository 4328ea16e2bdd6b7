"""One step function, two ways to run it: whole runs in batch, or messages as they come."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorloom.operators.recurrences import by_run
from sensorloom.streaming.steps import Config, State, Track, dump, load, replay

OUTPUT = "run long, seq long, t_eff long, flag int, v double, var double, state string, slip boolean, way double, var_way double, bias double, mode string"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.string()]


def estimate(messages: DataFrame, config: Config = Config(), track: Track | None = None) -> DataFrame:
    """Batch: ``messages`` (run, seq, t, stream, value) to one answer for each.

    Runs are dealt to partitions and sorted there, and a partition is walked once: a run costs its rows
    and holds one state, however many runs or rows there are.
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, s = object(), State()
        for batch in batches:
            out = []
            runs = batch.column("run").to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("seq", "t", "stream", "value")), strict=True)
            for this, row in zip(runs, rows, strict=True):
                if this != run:
                    run, s = this, State()
                out += [(this, *a) for a in replay([row], s, config, track)]
            cols = list(zip(*out, strict=True)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES, strict=True)], _NAMES)

    m = messages.select(F.col("run").cast("long").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("t").cast("long").alias("t"), "stream", F.col("value").cast("double").alias("value"))
    return by_run(m, "run").sortWithinPartitions("run", "seq").mapInArrow(walk, OUTPUT)


def estimate_stream(messages: DataFrame, config: Config = Config(), *, idle: str | None = None, track: Track | None = None) -> DataFrame:
    """Streaming: the same, with each run's state in the state store.

    Messages of one trigger are put in order of arrival; across triggers the trigger's order holds.
    With ``idle`` (as "1 minute") a run without messages for so long gets one row of state ``idle``,
    with the filter's last speed and no ``seq``; its state stays for what may still come.  A batch that a
    step cannot handle (a broken state or message) is answered by one row of state ``error`` for the run
    and the state kept as it was, so that one run does not stop the others.
    """
    wait = pd.Timedelta(idle).value // 1_000_000 if idle else None

    def one(run: int, s: State, state: str) -> pd.DataFrame:
        p = None if s.p is None else float(s.p[0, 0])
        return pd.DataFrame([(run, None, None, None, s.v, p, state, False, float(s.x[4]), None, float(s.x[1]), s.mode)], columns=_NAMES)

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = load(json.loads(state.get[0]) if state.exists else None)
        if state.hasTimedOut:
            yield one(int(key[0]), s, "idle")
            return
        rows = pd.concat(list(batches)).sort_values("seq")  # order of arrival
        try:
            out = [(int(key[0]), *a) for a in replay(rows[["seq", "t", "stream", "value"]].itertuples(index=False, name=None), s, config, track)]
        except (ArithmeticError, LookupError, TypeError, ValueError):
            s = load(json.loads(state.get[0]) if state.exists else None)
            yield one(int(key[0]), s, "error")
            return
        state.update((json.dumps(dump(s)),))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=_NAMES)

    grouped = messages.select("run", "seq", "t", "stream", "value").groupBy("run")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return grouped.applyInPandasWithState(run, OUTPUT, "state string", "append", timeout)


def rate_windows(outputs: DataFrame, *, at: str, width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Messages, mean and largest speed and percentiles of it in each window of a stream with event time ``at``."""
    spread = F.percentile_approx("v", [0.5, 0.95]).alias("v_p50_p95")
    return outputs.withWatermark(at, delay).groupBy(F.window(at, width), "run").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.max("v").alias("max_v"), spread)
