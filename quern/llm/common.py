"""Shared helpers: the work folder that all executors see, tables cut from lineage, checked sizes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode with none set."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _local_root


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file system removes it when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: Parquet options for large rows: row groups, which are read and written whole, of about 16 MB, looked at after each row.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


@contextmanager
def rows_at_once(spark: SparkSession, rows: int):
    """Tasks exchange at most ``rows`` rows at a time with Python in the actions inside: for large rows, which otherwise fill batches of 64 MB."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def megabytes_at_once(spark: SparkSession, size: int):
    """As ``rows_at_once``, where steps with large and small rows are one action: a batch ends after ``size`` MB."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{size}m"):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends there and lost executors cost no recomputation."""
    df.write.options(**options).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
