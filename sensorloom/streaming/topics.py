"""Topic streams in, several sinks out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "run long, seq long, t long, value double"


def topic_streams(spark: SparkSession, folders: Mapping[str, str], files_per_trigger: int = 10) -> DataFrame:
    """One file stream a topic, united, with the topic's name as ``stream``."""
    parts = [spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("stream", F.lit(name)) for name, path in folders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def valid(row: Mapping[str, Column]) -> Column:
    return row["seq"].isNotNull() & row["t"].isNotNull() & row["value"].isNotNull() & ~F.isnan(row["value"])


def quarantined(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that can be used, and the others."""
    good = valid({c: F.col(c) for c in ("seq", "t", "value")})
    return messages.filter(good), messages.filter(~good)


def publish(outputs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each trigger's answers go to three tables: speeds, per-run diagnostics and rows whose slip flag is set.

    A trigger writes to folders of its own number, so that one run twice replaces what it wrote.
    """

    def fan_out(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.select("run", "seq", "t_eff", "v", "var").write.mode("overwrite").parquet(f"{folder}/speed/batch={number}")
            batch.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") == 2).alias("late"), F.count_if(F.col("flag") == 3).alias("invalid")).write.mode("overwrite").parquet(f"{folder}/diagnostics/batch={number}")
            batch.filter("slip").select("run", "seq", "t_eff").write.mode("overwrite").parquet(f"{folder}/slip/batch={number}")
        finally:
            batch.unpersist()

    return outputs.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_released(fixes: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Fixes up to ``limit`` after each run's start; later ones are no longer wanted."""
    return fixes.join(starts.select("run", F.col("t").alias("__t0")), "run").filter(F.col("t") <= F.col("__t0") + limit).drop("__t0")


def blended(a: Column, var_a: Column, b: Column, var_b: Column, limit: float = 3.0) -> Column:
    """Inverse-variance mean of two estimates, the second limited to ``limit`` sigma around the first."""
    room = limit * F.sqrt(var_a + var_b)
    near = F.greatest(a - room, F.least(a + room, b))
    return (a * var_b + near * var_a) / (var_a + var_b)
