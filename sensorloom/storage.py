"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session whose executors live in the driver's own process may do without: a temporary
    folder is made and set for it.  Anywhere else a folder of one machine would lose results.
    """
    path = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share (master is {master})")
    path = tempfile.mkdtemp(prefix="sensorloom-")
    spark.conf.set(_SETTING, path)
    return path


def _path(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{scratch_dir(spark)}/sensorloom-{name}-{uuid.uuid4().hex}"
    hpath, files = _path(spark, path)
    files.deleteOnExit(hpath)
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``drop_since``."""
    return len(_written)


def drop_since(spark: SparkSession, point: int, keep: DataFrame) -> None:
    """Delete scratch tables written since ``point`` but for those that ``keep`` reads."""
    kept = " ".join(keep.inputFiles())
    for path in _written[point:]:
        if path.rsplit("/", 1)[1] not in kept:
            hpath, files = _path(spark, path)
            files.delete(hpath, True)
            _written.remove(path)
