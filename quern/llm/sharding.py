"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays in one shard.  Groups, sorted by size, go to the
least-loaded shard through a heap.  The heap runs on the driver, so what it sees is bounded
whatever the number of groups: a group of at least ``1 / (n_shards * units_per_shard)`` of all
bytes is a unit of its own (there are at most ``n_shards * units_per_shard`` of them), and smaller
groups are bundled by (power-of-two size class, hash) into at most ``classes * bundles_per_class``
units of groups of like size.  Bundles of the small classes come last and level what is left.

Nulls: a null text counts no bytes; null texts are a group by id.  Empty texts are equal texts.  Repeated rows and
repeated ids keep a row each.  Rows without an id have the last slots of their shard, in any order.  Ties of sizes go
by the key of the unit, then to the lowest shard, so the same rows get the same shards and slots again.  A very long
text is one unit.  Empty input gives empty output.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, workspace

NULL_BUCKETS = 64  # over which rows without an id are dealt


def lpt_schedule(units: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Largest unit first, each to the least-loaded shard (ties: unit key, then lowest shard)."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for key, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_overhead: int = 8,
    units_per_shard: int = 512,
    bundles_per_class: int = 512,
    rows_per_slot_bucket: int = 512,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, group_key, unit, shard, slot (gapless from 0 in each shard).

    ``text_crc32`` is the unsigned CRC-32 of the UTF-8 bytes (null text: null).
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + row_overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)))
        .otherwise(F.unhex(F.substring(F.sha2(F.concat(F.lit("null text "), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 32)))
        .alias("group_key"),
    )
    rows = materialise(rows, workspace(spark, "shard-rows"))
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    groups = materialise(groups, workspace(spark, "shard-groups"))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    heavy = max(1.0, total / (n_shards * units_per_shard))
    size_class = F.floor(F.log2("group_size")).cast("int")
    unit = F.when(
        F.col("group_size") >= heavy, F.concat(F.lit("g"), F.hex("group_key"))
    ).otherwise(
        F.concat_ws(":", F.lit("b"), size_class, F.pmod(F.xxhash64("group_key"), F.lit(bundles_per_class)))
    )
    groups = groups.withColumn("unit", unit)
    units = [(r[0], r[1]) for r in groups.groupBy("unit").agg(F.sum("group_size")).collect()]
    placed = lpt_schedule(units, n_shards)
    unit_shard = spark.createDataFrame(
        list(placed.items()), "unit string, shard int"
    )  # at most n_shards * units_per_shard + 64 * bundles_per_class rows
    assigned = groups.join(F.broadcast(unit_shard), "unit").select("group_key", "unit", "shard")
    placed_rows = rows.join(assigned, "group_key").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(NULL_BUCKETS)))
    placed_rows = materialise(placed_rows, workspace(spark, "shard-placed"))

    n_rows = placed_rows.count()
    buckets = max(1, -(-n_rows // (rows_per_slot_bucket * n_shards)))
    key = F.struct("doc_id", "group_key")
    by_hash = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))
    # rows without an id come after the others, where any order will do, so equal ones can be dealt out
    bucketed = placed_rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(buckets) + by_hash * NULL_BUCKETS + F.col("salt")).otherwise(by_hash))
    before = (
        bucketed.groupBy("shard", "bucket")
        .count()
        .withColumn(
            "before",
            F.coalesce(
                F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("shard", "bucket", "before")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(key))
    return (
        bucketed.join(before, ["shard", "bucket"])
        .withColumn("slot", (F.col("before") + rank - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", "group_key", "unit", "shard", "slot")
    )


def op4_sharding(spark, sf_dir):
    """All documents in shards 0 to 23 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
