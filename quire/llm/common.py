"""Helpers shared by the training-data operators: reading, shared scratch storage, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import ship

#: A word is a maximal run of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns can't clash with its own."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in extra))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is missing, as in local tests, a temporary folder of this machine stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="quire-"))
    return _local[0]


def small_batches(spark: SparkSession) -> None:
    """Python workers get the package, and rows in batches that are bounded by their bytes, however long the texts are."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


class Scratch:
    """Intermediate tables in the shared folder. A written table cuts the lineage and survives lost executors. What is left of them goes when the application ends, since results may be read from them until then."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def save(self, df: DataFrame, step: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step))

    def drop(self, *steps: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for step in steps:
            path = jvm.org.apache.hadoop.fs.Path(self.path(step))
            path.getFileSystem(conf).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable double in (0, 1) from the columns' hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)
