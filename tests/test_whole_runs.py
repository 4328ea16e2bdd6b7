"""Queries over whole runs reach every run's own end."""

import pytest
from pyspark.sql import functions as F

from sensorloom import plans
from sensorloom.plans.registry import front, log, rear
from sensorloom.sources import logs
from tests.compare import SF


def test_resampling_reaches_each_runs_end(spark):
    got = {r.run: r for r in plans.queries()["g1_arc_length_and_resampling"](spark, SF).groupBy("run").agg(F.max("way").alias("end"), F.count(F.lit(1)).alias("n"), F.max_by("x", "way").alias("x")).collect()}
    runs: dict = {}
    for r in front(spark, SF).orderBy("run", "t", "seq").collect():
        runs.setdefault(r.run, []).append(r.v)
    assert got.keys() == runs.keys()
    for run, v in runs.items():
        total = sum(((a - b) ** 2 + (a % 37 - b % 37) ** 2) ** 0.5 for a, b in zip(v, v[1:], strict=False))
        assert got[run].end == pytest.approx(total) and got[run].x == pytest.approx(v[-1], abs=1e-5)
        assert got[run].n == total // 50 + 1 + (total % 50 > 0)
    assert max(r.end for r in got.values()) > 300


def test_cache_holds_and_returns_every_run(spark, monkeypatch):
    written = []
    write = logs.write_cache
    monkeypatch.setattr(logs, "write_cache", lambda samples, path: (written.append(path), write(samples, path)))
    got = plans.queries()["s6_cache_read"](spark, SF).collect()
    assert len(written) == 1
    whole = log(spark, SF).groupBy("run", "stream").count().collect()
    assert sorted((r.run, r.stream, r.n) for r in got) == sorted((r["run"], r["stream"], r["count"]) for r in whole)
    assert len({r.run for r in got}) > 1


def test_ways_are_looked_up_to_each_runs_last(spark):
    got = {r.run: r.n for r in plans.queries()["j25_inverse_interpolation"](spark, SF).groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {r.run: r.total for r in rear(spark, SF).groupBy("run").agg(F.sum("v").alias("total")).collect()}
    assert got == {run: int(total // 100) for run, total in totals.items() if total >= 100}
    assert max(got.values()) > 5
