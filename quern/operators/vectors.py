"""A vector index kept as tables, searched exactly: coarse cells, bounds by radius, best k of each task.

``cells`` holds centroids (k-means over all rows, a few rounds of sums made in the tasks that read them; it starts from
a bounded sample), ``blocks`` holds the rows of a cell in blocks of at most ``BLOCK`` vectors, nearest to the centroid
first, each with the largest distance from it.  For a query q and a block of radius r around c, no inner product in the
block is over ``q.c + |q| r``; blocks below a query's k-th score so far aren't read for it.

Vectors that are null, hold null or non-finite components, or differ in length from most, aren't indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .index import keep_best

BLOCK = 512
QUERIES = 512  # of one broadcast
CELLS = 1024  # at most
ROUNDS = 3
PART = 1 << 16  # vectors of a cell that one task packs


def sound(vec: Column) -> Column:
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def train_cells(vectors: DataFrame, n_cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``vectors`` (id, vector); a task sends a sum and a count for each cell."""
    spark = vectors.sparkSession
    n = vectors.count()
    few = vectors.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * n_cells / max(1, n))))
    start = few.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(n_cells).collect()
    centers = np.array([r[0] for r in start] or [vectors.first()["vector"]], np.float64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centers)

        def sums(batches, shared=shared):
            total, count = np.zeros(shared.value.shape), np.zeros(len(shared.value))
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    x = _matrix(batch.column(0).slice(lo, 4096))
                    own = _nearest(x, shared.value)
                    np.add.at(total, own, x)
                    count += np.bincount(own, minlength=len(count))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.float64())), pa.array(count[at])], ["cell", "total", "n"])

        some = vectors.select("vector").mapInArrow(sums, "cell long, total array<double>, n double")
        flat = some.select("cell", F.posexplode("total").alias("j", "v"), "n").groupBy("cell", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
        cell, j, v, n_of = (flat.column(c).to_numpy() for c in ("cell", "j", "v", "n"))
        centers = centers.copy()
        centers[cell, j] = v / n_of
        shared.unpersist()
    return centers


def write_vectors(df: DataFrame, path: str, id_col: str, vec_col: str, n_cells: int | None = None) -> str:
    """Keep the index of (id, vector) under ``path``."""
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).where(sound(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = Scratch(spark, "vectors").keep(rows.where(F.size("vector") == (common[0] if common else 0)))
    n = rows.count()
    centers = train_cells(rows, n_cells or max(1, min(CELLS, int(n**0.5 / 2)))) if n else np.zeros((0, 1))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _matrix(part.column(1))
                own = _nearest(x, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.linalg.norm(x - shared.value[own], axis=1)), part.column(0), part.column(1)], ["cell", "distance", "id", "vector"])

    placed = rows.mapInArrow(assign, f"cell int, distance double, id {id_type}, vector array<double>")
    placed = Scratch(spark, "placed").keep(placed)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))  # at most CELLS rows
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts"))).drop("parts")

    def pack(batches):
        held, key = [], None

        def block():
            ids, vectors, distance = (pa.concat_arrays([p.column(i) for p in held]) for i in (2, 3, 1))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([distance[-1].as_py()]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([_matrix(vectors).tobytes()], pa.binary())], ["cell", "radius", "ids", "vectors"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True))
            lo = 0
            while lo < len(keys):
                n_held = sum(p.num_rows for p in held)
                if held and (keys[lo] != key or n_held >= BLOCK):
                    yield block()
                    held, n_held = [], 0
                key, hi = keys[lo], lo
                while hi < len(keys) and keys[hi] == key and hi - lo < BLOCK - n_held:
                    hi += 1
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield block()

    ordered = dealt.select("cell", "distance", "id", "vector", "part").repartition("cell", "part").sortWithinPartitions("cell", "part", "distance", "id")
    ordered.mapInArrow(pack, f"cell int, radius double, ids array<{id_type}>, vectors binary").write.mode("overwrite").parquet(f"{path}/blocks")
    return path


def _scan(shared, k: int):
    """Each task's best k of every query, and how many blocks it read and met."""

    def run(batches):
        names, q, floor, centers, probes = shared.value
        norm, about = np.linalg.norm(q, axis=1), q @ centers.T
        best, ids = np.zeros((len(q), 0)), np.zeros((len(q), 0), object)
        read, met, kind = np.zeros(len(q), np.int64), 0, pa.int64()
        for batch in batches:
            kind = batch.column(2).type.value_type
            for i in range(batch.num_rows):
                cell, radius = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                least = floor if best.shape[1] < k else np.maximum(floor, np.partition(best, -k, axis=1)[:, -k])
                asking = np.flatnonzero((about[:, cell] + norm * radius >= least - 1e-9) if probes is None else probes[:, cell])
                met += 1
                if not len(asking):
                    continue
                read[asking] += 1
                own = np.array(batch.column(2)[i].values.to_pylist(), object)
                x = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(len(own), -1)
                score = np.full((len(q), len(own)), -np.inf)
                score[asking] = q[asking] @ x.T
                best, ids = keep_best(np.concatenate([best, score], axis=1), np.concatenate([ids, np.broadcast_to(own, (len(q), len(own)))], axis=1), k)
        at, j = np.nonzero(np.isfinite(best))
        asked = names.take(pa.array(np.concatenate([at, np.arange(len(q))])))
        none, zeros = len(q), np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays(
            [asked, pa.array(ids[at, j].tolist() + [None] * none, kind), pa.array(best[at, j].tolist() + [None] * none, pa.float64()), pa.array(np.concatenate([zeros, read])), pa.array(np.concatenate([zeros, np.full(none, met)]))],
            ["query", "id", "score", "blocks_read", "blocks"],
        )

    return run


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, *, query_col: str, vec_col: str, id_col: str, k: int, probe: int = 2) -> tuple[DataFrame, DataFrame]:
    """(query, id, score, rank) of the exact k best, ties to the smaller id, and (query, blocks_read, blocks).

    Queries go in broadcasts of at most ``QUERIES``.  For each, the blocks of a query's ``probe`` cells of best centroid are
    read first; its k-th score there is its floor in the scan of all blocks.
    """
    centers = np.array([r[0] for r in spark.read.parquet(f"{path}/cells").orderBy("cell").select("centroid").collect()], np.float64)
    blocks = spark.read.parquet(f"{path}/blocks")
    q_type, id_type = queries.schema[query_col].dataType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"query {q_type}, id {id_type}, score double, blocks_read long, blocks long"
    out, n_cells = spark.createDataFrame([], schema), len(centers)
    if n_cells:
        asked = queries.select(F.col(query_col).alias("q"), F.col(vec_col).cast("array<double>").alias("v")).where(sound(F.col("v")) & (F.size("v") == centers.shape[1]))
        asked = Scratch(spark, "asked").keep(asked)
        n_parts = max(1, -(-asked.count() // QUERIES))
        for part in range(n_parts):
            rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_parts)) == part).toArrow()
            if not rows.num_rows:
                continue
            names, q = rows.column("q").combine_chunks(), _matrix(rows.column("v").combine_chunks())
            probes = np.zeros((len(q), n_cells), bool)
            few = np.argsort(-(q @ centers.T), axis=1)[:, :probe]
            np.put_along_axis(probes, few, True, axis=1)
            scan = lambda floor, probes, names=names, q=q: _scan(spark.sparkContext.broadcast((names, q, floor, centers, probes)), k)
            first = blocks.where(F.col("cell").isin(np.unique(few).tolist())).mapInArrow(scan(np.full(len(q), -np.inf), probes), schema).where("score is not null")
            at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
            floors = dict(first.withColumn("at", at).where(F.col("at") == k).select("query", "score").collect())  # one for each query of the broadcast
            floor = np.array([floors.get(name, -np.inf) for name in names.to_pylist()])
            out = out.unionAll(blocks.mapInArrow(scan(floor, None), schema))
    out = Scratch(spark, "found").keep(out)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    hits = out.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    reading = out.groupBy("query").agg(F.sum("blocks_read").alias("blocks_read"), F.sum("blocks").alias("blocks"))
    return hits.select(F.col("query").alias(query_col), F.col("id").alias(id_col), "score", "rank"), reading.withColumnRenamed("query", query_col)
