"""What Python workers need to run this package's functions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quire-code-")) / "quire.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(spark.sparkContext.applicationId)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by key, never sent whole to the driver and every task. What is read out of pages is many times larger than the files, from whose sizes Spark reckons, and would be broadcast as if it were small."""
    return df.hint("merge")


_local: list[str] = []


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the one that driver and executors share (spark.checkpoint.dir); it goes when the application ends. Only where the setting is missing, on one machine, a temporary folder stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="quire-"))
        found = _local[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()
