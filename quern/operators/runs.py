"""Runs that can be cut anywhere and go on: results and scores of systems in pieces, with a manifest that says what is done.

Layout of a run's folder: ``<stage>/system=<name>/piece=<n>`` (Parquet), and ``manifest/<stage>-<name>`` (one row).  A piece
is written beside its place and renamed, so it is there whole or not at all; a stage of a system is done when its manifest
row is there.  At a start, finished systems are skipped, and of the rest only items without a row in some piece are made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, system string, n_rows long, saved_at timestamp"


class Run:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(f"{self.path}/{name}"))

    def _commit(self, df: DataFrame, name: str) -> None:
        """Write whole, then rename: a reader sees all rows or none."""
        aside = f"{self.path}/_writing/{uuid.uuid4().hex}"
        df.write.parquet(aside)
        place = self._hadoop(f"{self.path}/{name}")
        self._fs.mkdirs(place.getParent())
        if not self._fs.rename(self._hadoop(aside), place):
            raise OSError(f"{name} is there already")

    def done(self, stage: str, system: str) -> bool:
        return self._there(f"manifest/{stage}-{system}")

    def manifest(self) -> DataFrame:
        """(stage, system, n_rows, saved_at) of what is done."""
        if not self._there("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*")

    def rows(self, stage: str, system: str | None = None) -> DataFrame | None:
        """What the pieces of a stage hold, finished or not; None if there is none."""
        if not self._there(f"{stage}/system={system}" if system else stage):
            return None
        read = self.spark.read.option("basePath", f"{self.path}/{stage}").parquet(f"{self.path}/{stage}/system={system or '*'}/piece=*")
        return read.drop("piece") if not system else read.drop("piece", "system")

    def advance(self, stage: str, systems: list[str], items: DataFrame, key: str, make: Callable[[str, DataFrame], DataFrame], pieces: int = 4) -> None:
        """Make what is missing of a stage. ``make`` maps a system and some of the items to rows that hold ``key``."""
        for system in systems:
            if self.done(stage, system):
                continue
            held, left = self.rows(stage, system), items
            if held is not None:
                left = items.join(held.select(key).distinct(), key, "left_anti")
            for n in range(pieces):
                place = f"{stage}/system={system}/piece={n}"
                if not self._there(place):
                    self._commit(make(system, left.where(F.pmod(F.xxhash64(key), F.lit(pieces)) == n)), place)
            total = self.rows(stage, system).count()
            row = self.spark.range(1).select(F.lit(stage).alias("stage"), F.lit(system).alias("system"), F.lit(total).cast("long").alias("n_rows"), F.current_timestamp().alias("saved_at"))
            self._commit(row.coalesce(1), f"manifest/{stage}-{system}")

    def complete(self) -> None:
        self._commit(self.spark.range(1).select(F.current_timestamp().alias("completed_at")).coalesce(1), "completed")

    @staticmethod
    def latest(spark: SparkSession, root: str) -> str | None:
        """The newest run below ``root`` that isn't complete."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s for s in (fs.listStatus(path(root)) if fs.exists(path(root)) else []) if s.isDirectory() and not fs.exists(path(s.getPath(), "completed"))]
        return max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString() if found else None
