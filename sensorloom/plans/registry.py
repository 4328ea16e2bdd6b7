"""Registered queries and, where SQL can tell, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
#: The telemetry log stand-in: run, stream, arrival order, event time in microseconds, value.
S = "s AS (SELECT user_id AS run, event_type AS stream, event_id AS seq, epoch_us(ts) AS t, value AS v FROM events)"
STREAMS = ", ".join(f"{name} AS (SELECT run, seq, t, v FROM s WHERE stream = '{kind}')" for name, kind in {"front": "view", "rear": "click", "cmd": "purchase", "fix": "signup", "other": "error"}.items())


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def over(ctes: str, select: str) -> str:
    """SQL over the log and its streams."""
    return f"WITH RECURSIVE {S}, {STREAMS}{', ' + ctes if ctes else ''} {select}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))


def stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return log(spark, sf_dir).filter(F.col("stream") == kind).select("run", "seq", "t", "v")


def front(spark, d):
    return stream(spark, d, "view")


def rear(spark, d):
    return stream(spark, d, "click")


def cmd(spark, d):
    return stream(spark, d, "purchase")


def fix(spark, d):
    return stream(spark, d, "signup")


def other(spark, d):
    return stream(spark, d, "error")


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]
