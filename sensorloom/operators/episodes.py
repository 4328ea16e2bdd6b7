"""Gaps and islands: episodes, sessions, segments and recovery times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.windows import backward, line, so_far


def islands(df: DataFrame, *, gap: int, key: str = "run", t: str = "t") -> DataFrame:
    """``key, start, stop, n`` of runs of rows whose stamps are at most ``gap`` apart."""
    w = line(key, t)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)).cast("int")
    numbered = df.withColumn("__new", new).withColumn("__no", F.sum("__new").over(so_far(w)))
    return numbered.groupBy(key, F.col("__no").alias("episode")).agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, label: Column, *, key: str = "run", t: str = "t") -> DataFrame:
    """``df`` with ``label`` and ``run_no``, counted up where the label changes."""
    w = line(key, t)
    labelled = df.withColumn("label", label)
    change = F.coalesce(F.col("label") != F.lag("label").over(w), F.lit(True)).cast("int")
    return labelled.withColumn("__c", change).withColumn("run_no", F.sum("__c").over(so_far(w))).drop("__c")


def intervals(df: DataFrame, flag: Column, *, key: str = "run", t: str = "t") -> DataFrame:
    """First and last row number (from 0) of each run of true rows."""
    w = line(key, t)
    numbered = runs(df, flag, key=key, t=t).withColumn("i", F.row_number().over(w) - 1)
    return numbered.filter("label").groupBy(key, "run_no").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("run_no")


def sessions(df: DataFrame, *, gap: int, most: int, key: str = "run", t: str = "t") -> DataFrame:
    """Bursts: closed by a gap over ``gap`` or after ``most`` rows."""
    w = line(key, t)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)).cast("int")
    numbered = df.withColumn("__new", new).withColumn("__s", F.sum("__new").over(so_far(w)))
    inner = Window.partitionBy(key, "__s").orderBy(t, "seq")
    return numbered.withColumn("burst", F.floor((F.row_number().over(inner) - 1) / most)).withColumnRenamed("__s", "session").drop("__new")


def recovery(df: DataFrame, bad: Column, *, hold: int, key: str = "run", t: str = "t") -> DataFrame:
    """First good stamp with no bad row until more than ``hold`` later; null if there is none."""
    ahead = so_far(backward(key, t))
    marked = df.withColumn("__bad", F.coalesce(bad, F.lit(True)))
    next_bad = F.min(F.when(F.col("__bad"), F.col(t))).over(ahead)
    end = F.max(t).over(ahead)
    good = ~F.col("__bad") & (next_bad.isNull() | (next_bad > F.col(t) + hold)) & (end >= F.col(t) + hold)
    return marked.withColumn("__good", F.when(good, F.col(t))).groupBy(key).agg(F.min("__good").alias("recovered"), F.min(t).alias("start"))


def merge_short_runs(df: DataFrame, label: Column, *, least: int, key: str = "run", t: str = "t") -> DataFrame:
    """Runs of one label, those shorter than ``least`` taken into the one before, by a fold."""
    r = runs(df, label, key=key, t=t).groupBy(key, "run_no").agg(F.first("label").alias("label"), F.min(t).alias("start"), F.max(t).alias("stop"))
    rows = F.array_sort(F.collect_list(F.struct("start", "stop", "label")))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), x["stop"].alias("stop"), last["label"].alias("label"))))
        return F.when(F.size(a) == 0, F.array(x)).when((x["stop"] - x["start"] < least) | (last["label"] == x["label"]), joined).otherwise(F.concat(a, F.array(x)))

    empty = F.array().cast("array<struct<start:bigint,stop:bigint,label:string>>")
    merged = r.withColumn("label", F.col("label").cast("string")).groupBy(key).agg(F.aggregate(rows, empty, step).alias("__r"))
    return merged.select(key, F.inline("__r"))
