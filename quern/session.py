"""The shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode with none set, a temporary one."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _local_root


class Scratch:
    """Tables that end lineage, in a folder of the shared storage that goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.path, self.n = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


@contextmanager
def rows_at_once(spark: SparkSession, rows: int):
    """Tasks exchange at most ``rows`` rows at a time with Python in the actions inside: for large rows, which otherwise fill batches of 64 MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Parquet options for large rows: row groups, which are read and written whole, of about 16 MB, looked at after each row.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}
