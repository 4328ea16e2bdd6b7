"""Queries that write what a source or sink handles and read it back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sensorloom.plans.evaluation import BRANCHES
from sensorloom.plans.registry import front, log, over, register
from sensorloom.sources import logs, messages
from sensorloom.storage import scratch_path

_STAMPED = "SELECT run, seq, t, round(v, 6) AS v FROM front"


def _through(kind: str, field: str):
    """Samples of the first wheel encoded as messages and decoded again."""

    def query(s, d):
        @F.pandas_udf("binary")
        def encoded(t: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series([messages.encode(kind, a // 1_000_000, a % 1_000_000 * 1000, "car", {field: b}) for a, b in zip(t, v, strict=True)])

        raw = front(s, d).select("run", "seq", encoded("t", "v").alias("data"))
        m = raw.withColumn("m", messages.decoded(F.lit(f"msgs/{kind}"), F.col("data")))
        return m.select("run", "seq", F.col("m.t_us").alias("t"), F.round(F.col("m.fields")[field], 6).alias("v"))

    return query


register("s2_binary_decode", over("", _STAMPED))(_through("VelocitySensor", "v"))
register("s3_odometry_decode", over("", _STAMPED))(_through("Odometry", "vx"))


@register("s5_cache_build", over("", "SELECT run, count(*) AS n, CASE WHEN run % 2 = 0 THEN round(sum(v), 4) ELSE round(sum(v + 1), 4) END AS total FROM s GROUP BY run"))
def _(s, d):
    """Even runs are cached first; a second build with other values skips them and adds the odd ones."""
    path = scratch_path(s, "cache-build")
    logs.write_cache(log(s, d).filter("run % 2 = 0"), path)
    logs.write_cache(log(s, d).withColumn("v", F.col("v") + 1), path)
    return logs.read_cache(s, path).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@register("s8_metadata", over("", "SELECT run, min(t) AS start_us, max(t) - min(t) AS duration_us FROM s GROUP BY run"))
def _(s, d):
    path = scratch_path(s, "metadata")
    us = lambda c: c.cast("decimal(20,0)")
    spans = log(s, d).groupBy("run").agg(us(F.min("t")).alias("a"), us(F.max("t")).alias("b"))
    ns = lambda c: (c * 1000).cast("string")
    yaml = F.format_string("info:\n  run: %s\n  duration:\n    nanoseconds: %s\n  starting_time:\n    nanoseconds_since_epoch: %s\n", F.col("run").cast("string"), ns(F.col("b") - F.col("a")), ns(F.col("a")))
    spans.select("run", yaml.alias("value")).repartition("run").write.partitionBy("run").text(path)
    found = logs.read_metadata(s, path)
    # several runs that share a task still have a file each; the folder of rows without a run holds no number
    return found.select(F.regexp_extract("path", r"/run=([^/]*)/[^/]*$", 1).try_cast("long").alias("run"), "start_us", "duration_us")


@register("s10_branches", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, {float(x)!r}, {float(y)!r})" for n, points in BRANCHES.items() for k, (x, y) in enumerate(points)) + ") p(branch, k, x, y)")
def _(s, d):
    import os
    import tempfile

    from sensorloom.sources import files

    rows = [("loop", "a", "b", n, k, float(x), float(y), 0.0) for n, points in BRANCHES.items() for k, (x, y) in enumerate(points)]
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver: it is read before the folder goes
        path = os.path.join(folder, "branches.json")
        files.write_branches(s.createDataFrame(rows, "loop string, from string, to string, branch string, k int, x double, y double, z double"), path)
        with open(path, encoding="utf-8") as f:
            text = f.read()
    return files.branches_of(s.createDataFrame([(text,)], "value string")).select("branch", "k", "x", "y")


@register("s13_estimate_files", over("", _STAMPED))
def _(s, d):
    path = scratch_path(s, "estimate")
    logs.write_estimate(front(s, d), path)
    return logs.read_estimate(s, path).select("run", "seq", "t", F.round("v", 6).alias("v"))
