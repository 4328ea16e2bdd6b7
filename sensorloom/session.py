"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker, where the session does not say; Spark's own 64 MB are
#: held several times over by the executor and the worker.
_BATCH_SETTING, _BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this package, wherever they run, and bound their batches.

    Spark's own file server hands the archive out; done once an application.
    """
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, _BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    folder = tempfile.mkdtemp(prefix="sensorloom-ship-")
    path = os.path.join(folder, f"sensorloom-{app}.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
