"""Recorded logs: SQLite files of one run each as a Spark data source, and the columnar cache."""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class LogFile(InputPartition):
    pass


class LogReader(DataSourceReader):
    """One partition a file; only wanted topics are read, in order of arrival."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.topics = [t for t in options.get("topics", "").split(",") if t]

    def partitions(self) -> list[InputPartition]:
        return [LogFile(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        run = os.path.basename(path).removesuffix(".db3")
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            topics = {i: (name, kind) for i, name, kind in con.execute("select id, name, type from topics")}
            wanted = [i for i, (name, _) in topics.items() if not self.topics or name in self.topics]
            marks = ",".join("?" * len(wanted))
            rows = con.execute(f"select topic_id, timestamp, data from messages where topic_id in ({marks}) order by timestamp, id", wanted)
            for seq, (topic, stamp, data) in enumerate(rows):
                yield run, *topics[topic], seq, stamp // 1000, bytes(data)
        finally:
            con.close()


class LogSource(DataSource):
    """``spark.read.format("sensorlog").option("paths", "a.db3,b.db3").option("topics", "/x,/y")``."""

    @classmethod
    def name(cls) -> str:
        return "sensorlog"

    def schema(self) -> str:
        return "run string, stream string, kind string, seq long, t_rec long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)


def log_file(path: str) -> str:
    """The log that ``path`` names: itself, or the first of its folder by name; else an error."""
    if path.endswith(".db3"):
        return path
    found = sorted(glob.glob(os.path.join(glob.escape(path), "*.db3")))
    if not found:
        raise FileNotFoundError(f"no .db3 in {path}")
    return found[0]


def read_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, start_us, duration_us`` of log folders' metadata files; null where a file does not say.

    Nanoseconds are decimals until they are whole microseconds: a double holds them to some 200 only.
    """
    text = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    said = lambda key, unit: F.try_element_at(F.regexp_extract_all("value", F.lit(rf"{key}:\s*{unit}:\s*(-?\d+)"), 1), F.lit(1)).try_cast("decimal(30,0)")
    number = lambda key, unit: F.floor(said(key, unit) / F.lit(1000).cast("decimal(4,0)")).cast("long")
    return text.select("path", number("starting_time", "nanoseconds_since_epoch").alias("start_us"), number("duration", "nanoseconds").alias("duration_us"))


def read_logs(spark: SparkSession, paths: list[str], topics: tuple[str, ...] = ()) -> DataFrame:
    """Messages of logs, each a file or a folder with one."""
    paths = [log_file(p) for p in paths]
    spark.dataSource.register(LogSource)
    return spark.read.format("sensorlog").option("paths", ",".join(paths)).option("topics", ",".join(topics)).load()


def _entries(spark: SparkSession, path: str, key: str) -> tuple:
    """Hadoop's file system, its path class, and the names of the runs' folders under ``path``."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = new(path)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(base)] if files.exists(base) else []
    return files, new, [n for n in names if n.startswith(f"{key}=")]


def write_cache(samples: DataFrame, path: str, key: str = "run", force: bool = False) -> int:
    """Columnar cache, one folder a run; returns the number of runs written.

    Runs that it holds are skipped, or replaced with ``force``.  A run appears by one rename of a whole
    folder, so readers see all of it or none, and a job that dies leaves no half run behind.
    """
    spark = samples.sparkSession
    files, new, there = _entries(spark, path, key)
    if there and not force:
        known = spark.createDataFrame([(n.split("=", 1)[1],) for n in there], "__run string")
        samples = samples.join(F.broadcast(known), F.col(key).cast("string") == F.col("__run"), "left_anti")
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    out = samples.repartition(F.col(key)).sortWithinPartitions(key, "stream", "seq")
    try:
        out.write.partitionBy(key).parquet(aside)
        _, _, written = _entries(spark, aside, key)
        for name in written:
            target = new(f"{path}/{name}")
            if files.exists(target):
                files.delete(target, True)
            files.rename(new(f"{aside}/{name}"), target)
    finally:
        files.delete(new(aside), True)
    return len(written)


def read_cache(spark: SparkSession, path: str, runs: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("run").isin(*runs)) if runs else df


ESTIMATE = "run long, seq long, t long, v double"


def write_estimate(estimate: DataFrame, path: str) -> None:
    """An estimator's answers, as any evaluation reads them."""
    estimate.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ESTIMATE.split(", ")]).write.mode("overwrite").parquet(path)


def read_estimate(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ESTIMATE).parquet(path)
