"""Mergeable summaries with stated errors: quantiles by buckets of a constant ratio, frequent items by bounded counters."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

ACCURACY = 0.01
COUNTERS = 1000


def quantile_sketch(df: DataFrame, by: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(by..., sign, bucket, n): values counted in buckets whose bounds grow by (1 + a) / (1 - a).

    Sketches of parts of a table are merged by adding counts (``merge_sketches``); their size doesn't follow the rows
    but the range of magnitudes: some 1,400 buckets for values from 1e-6 to 1e6.
    """
    width = math.log((1 + accuracy) / (1 - accuracy))
    v = F.col(value).cast("double")
    bucket = F.when(v != 0, F.ceil(F.log(F.abs(v)) / width)).otherwise(0)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, by: list[str], percents: list[int], accuracy: float = ACCURACY) -> DataFrame:
    """(by..., pct, value): the value at 0-based place floor(n * p / 100), at most ``accuracy`` of itself away."""
    order = Window.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("bucket"))  # a group is one sketch
    upto = sketch.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    ratio = (1 + accuracy) / (1 - accuracy)
    middle = F.col("sign") * 2 * F.pow(F.lit(ratio), F.col("bucket")) / (ratio + 1)
    wanted = upto.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
    place = F.least(F.floor(F.col("total") * F.col("pct") / 100), F.col("total") - 1)
    return wanted.where((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)).select(*by, "pct", middle.alias("value"))


def frequent_sketch(df: DataFrame, item: str, counters: int = COUNTERS) -> DataFrame:
    """(item, n, lost): at most ``counters`` counts of each task; a count is at most ``lost`` under the true one of its task.

    When a task holds too many items, all counts are lowered by the one that must go (several at a time), which can
    happen for at most ``rows / counters`` in sum.
    """
    kind = df.schema[item].dataType.simpleString()

    def run(batches):
        held: dict = {}
        lost, arrow = 0, None
        for batch in batches:
            arrow = batch.column(0).type
            for row in batch.column(0).value_counts().to_pylist():
                held[row["values"]] = held.get(row["values"], 0) + row["counts"]
            if len(held) > 2 * counters:
                low = sorted(held.values(), reverse=True)[counters]
                lost += low
                held = {k: n - low for k, n in held.items() if n > low}
        if len(held) > counters:
            low = sorted(held.values(), reverse=True)[counters]
            lost += low
            held = {k: n - low for k, n in held.items() if n > low}
        if arrow is not None:  # a row without an item tells what was lost
            yield pa.RecordBatch.from_arrays([pa.array([*held, None], arrow), pa.array([*held.values(), 0]), pa.array([0] * len(held) + [lost])], [item, "n", "lost"])

    return df.where(F.col(item).isNotNull()).select(item).mapInArrow(run, f"{item} {kind}, n long, lost long")


def merge_frequent(sketch: DataFrame, item: str) -> DataFrame:
    """(item, least, most): bounds of each held item's count; an item that isn't held has at most ``most - least`` rows."""
    sketch = Scratch(sketch.sparkSession, "frequent").keep(sketch)
    lost = sketch.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    return sketch.where(F.col(item).isNotNull()).groupBy(item).agg(F.sum("n").alias("least")).withColumn("most", F.col("least") + lost)


def heavy_items(df: DataFrame, item: str, share: float, counters: int = COUNTERS) -> DataFrame:
    """(item, n): exactly the items with more than ``share`` of the rows; a sketch names candidates, a second pass counts those.

    ``counters`` must be over ``2 / share``, as a task's counts can be short by its rows over ``counters``.
    """
    if counters * share < 2:
        raise ValueError("too few counters for this share")
    total = df.where(F.col(item).isNotNull()).count()
    candidates = merge_frequent(frequent_sketch(df, item, counters), item).where(F.col("most") > share * total)
    counted = df.join(candidates.select(item), item, "left_semi").groupBy(item).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > share * total)
