"""Error metrics, robust statistics and roll-ups over runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_stats(e: Column, prefix: str = "") -> list[Column]:
    """n, rmse, mae, bias, p99 and largest of |e|; null without rows."""
    a = F.abs(e)
    named = {"n": F.count(e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(a), "bias": F.avg(e), "p99": F.percentile(a, F.lit(0.99)), "max": F.max(a)}
    return [c.alias(prefix + k) for k, c in named.items()]


def summary(e: Column, prefix: str = "") -> list[Column]:
    named = {"rmse": F.sqrt(F.avg(e * e)), "mean": F.avg(e), "median": F.median(e), "p95": F.percentile(e, F.lit(0.95)), "max": F.max(e)}
    return [c.alias(prefix + k) for k, c in named.items()]


def consistency(ea: Column, ec: Column, va: Column, vc: Column) -> list[Column]:
    """Share of errors inside the 95 % ellipse, mean normalised square and median sigma."""
    m2 = ea * ea / va + ec * ec / vc
    return [
        F.avg((m2 <= 5.991).cast("double")).alias("inside95"),
        (F.avg(F.least(m2, F.lit(1e4))) / 2).alias("nees"),
        F.median(F.sqrt((va + vc) / 2)).alias("sigma_median"),
    ]


def unpivoted(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def score(df: DataFrame, key: str, weights: Mapping[str, tuple[float, float]], coverage: Column, *, worst: float = 10.0) -> DataFrame:
    """Weighted mean of min(|m| / yardstick, worst) over known metrics, blended with ``worst`` by
    the share that is not covered.  ``weights``: metric to (weight, yardstick)."""
    parts = [(F.when(F.col(m).isNotNull(), w * F.least(F.abs(F.col(m)) / y, F.lit(worst))), F.when(F.col(m).isNotNull(), F.lit(w))) for m, (w, y) in weights.items()]
    zero = F.lit(0.0)
    top = sum((F.coalesce(a, zero) for a, _ in parts), zero)
    base = sum((F.coalesce(b, zero) for _, b in parts), zero)
    loss = F.when(base > 0, top / base).otherwise(worst)
    return df.select(key, F.when(coverage.isNull(), worst).otherwise(loss * coverage + worst * (1 - coverage)).alias("score"))


def across_runs(long: DataFrame, by: Sequence[str] = ("metric",), signed: Sequence[str] = ()) -> DataFrame:
    """Median, mean, p90 and largest of |value| over finite values; signed median for some."""
    x = F.when(F.col("metric").isin(*signed), F.col("value")).otherwise(F.abs("value")) if signed else F.abs("value")
    return long.filter(F.col("value").isNotNull()).groupBy(*by).agg(
        F.count("value").alias("n"), F.median(x).alias("median"), F.avg(x).alias("mean"), F.percentile(F.abs("value"), F.lit(0.9)).alias("p90"), F.max(F.abs("value")).alias("max")
    )


def worst(long: DataFrame, k: int = 8, key: str = "run") -> DataFrame:
    w = Window.partitionBy("metric").orderBy(F.abs("value").desc_nulls_last(), key)
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def upper_median(x: Column) -> Column:
    """The upper of the two middle values; a group is one array, so for bounded groups."""
    a = F.array_sort(F.collect_list(x))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def nearest_rank(x: Column, q: float) -> Column:
    a = F.array_sort(F.collect_list(x))
    return F.get(a, F.least(F.size(a) - 1, F.floor(q * F.size(a)).cast("int")))


def robust_sigma(df: DataFrame, key: str, x: str) -> DataFrame:
    mid = df.groupBy(key).agg(F.median(x).alias("__m"))
    return df.join(mid, key).groupBy(key).agg((1.4826 * F.median(F.abs(F.col(x) - F.col("__m")))).alias("sigma"))


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def trimmed_circular_mean(df: DataFrame, key: str, angle: str, limit_deg: float = 20.0) -> DataFrame:
    """Mean of angles within a limit of the first mean; of all if none is."""
    first = df.groupBy(key).agg(circular_mean(F.col(angle)).alias("__m"))
    off = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.cos(F.col(angle) - F.col("__m")))))
    near = off <= F.radians(F.lit(limit_deg))
    return df.join(first, key).groupBy(key).agg(F.coalesce(circular_mean(F.when(near, F.col(angle))), F.first("__m")).alias("mean_angle"))


def majority(df: DataFrame, key: str, label: str) -> DataFrame:
    """The label of more than half of the rows, else null."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy(key).agg(F.max(F.struct("c", label)).alias("__b"), F.sum("c").alias("n")).select(key, F.when(2 * F.col("__b.c") > F.col("n"), F.col(f"__b.{label}")).alias("majority"))


def binned_mean(df: DataFrame, x: str, y: str, edges: Sequence[float]) -> DataFrame:
    """Mean of ``y`` in each bin of ``x``; bins without rows are null."""
    bins = df.sparkSession.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    number = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        number = F.when((F.col(x) >= edges[i]) & (F.col(x) < edges[i + 1]), i).otherwise(number)
    sums = df.withColumn("bin", number).filter("bin is not null").groupBy("bin").agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    return F.broadcast(bins).join(sums, "bin", "left").select("bin", "lo", "hi", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def log_histogram_quantile(df: DataFrame, key: str, x: str, q: float, *, per_decade: int = 40) -> DataFrame:
    """Upper edge of the log-spaced bin that holds the quantile."""
    bins = df.filter(F.col(x) > 0).withColumn("bin", F.floor(F.log10(x) * per_decade)).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = bins.withColumn("cum", F.sum("c").over(run)).withColumn("n", F.sum("c").over(w))
    return cum.filter(F.col("cum") >= q * F.col("n")).groupBy(key).agg(F.pow(F.lit(10.0), (F.min("bin") + 1) / per_decade).alias("q"))


def normal_equations(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Sums of products as rows (i, j, value), j = -1 for X'y and i = j = -1 for y'y: partial sums
    only, whatever the number of rows."""
    cols = [F.col(x) for x in xs]
    sums = [F.sum(a * b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    sums += [F.sum(a * F.col(y)).alias(f"{i}_-1") for i, a in enumerate(cols)] + [F.sum(F.col(y) * F.col(y)).alias("-1_-1")]
    one = df.agg(*sums)
    pairs = [F.struct(F.lit(int(n.split("_")[0])).alias("i"), F.lit(int(n.split("_")[1])).alias("j"), F.col(n).alias("value")) for n in one.columns]
    return one.select(F.inline(F.array(*pairs)))


def leave_one_group_out(df: DataFrame, group: str, value: str, loss: str) -> DataFrame:
    """For each group the value with the least mean loss on the other groups, and its loss on the group itself."""
    per = df.groupBy(group, value).agg(F.sum(loss).alias("s"), F.count(loss).alias("c"))
    total = per.groupBy(value).agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    rest = per.join(total, value).withColumn("other", (F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))).withColumn("own", F.col("s") / F.col("c"))
    best = rest.groupBy(group).agg(F.min(F.struct(F.round("other", 9).alias("other"), F.col(value).alias("value"), F.col("own").alias("own"))).alias("b"))
    return best.select(group, F.col("b.value").alias("chosen"), F.col("b.other").alias("train_loss"), F.col("b.own").alias("test_loss"))
