"""A content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts a document's id stream into chunks, so equal stretches
give equal chunks wherever they stand.  A chunk's address is the BLAKE2b hash of its bytes; each is
stored once.  A document's recipe lists its chunks' addresses; its root is a Merkle tree over them.

Layout under the store's path (Parquet, zstd):

* ``objects``  kind ``chunk``: address, n ids, payload (little-endian ids, 2 or 4 bytes each)
* ``recipes``  in ascending doc_id order: ordinal, doc_id, start, n_tokens, root, recipe (16-byte addresses)
* ``manifest`` per ``PART`` neighbouring documents, and again per ``PART`` such nodes up to one: level, node, n_docs, start,
  n_tokens, Merkle root over the roots below; no row gathers more than ``PART`` of them

``read_documents`` rebuilds ids; ``verify`` checks every chunk against its address, every recipe against
its root and every node against the manifest, and gives each document's CRC-32, combined from those of its
chunks (each chunk is read once, however many documents hold it).

Nulls: a null text is an empty text (only the end id); a null id sorts first.  Rows with equal ids
keep a row each, ordered by root.  An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenizer_definition
from .common import documents, workspace
from .library_encoder import library_encoder
from .textbatch import U64, mix64, texts_of

WINDOW = 4
MEAN_BITS = 8  # a boundary about every 2 ** MEAN_BITS ids
MIN_CHUNK, MAX_CHUNK = 64, 1024
ADDRESS = 16
SEEN = 200_000  # addresses that a task remembers having sent
PART = 1024  # documents, or nodes below, of a manifest row
END_ID = 2
OBJECTS = "kind string, doc_id long, n long, address binary, payload binary"


@lru_cache(2)
def _id_codes(size: int) -> np.ndarray:
    return mix64(np.arange(size, dtype=np.uint64) + U64(0x9E3779B97F4A7C15))


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places of a stream after which the hash of the last WINDOW ids asks for a cut."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    codes = _id_codes(1 << 16)
    h = codes[ids] if ids.dtype.itemsize == 2 else mix64(ids.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
    n = len(ids) - WINDOW + 1
    rolled = h[WINDOW - 1 :].copy()
    for j in range(1, WINDOW):  # older ids have higher rotations
        x, r = h[WINDOW - 1 - j : WINDOW - 1 - j + n], U64(j * 13)
        rolled ^= (x << r) | (x >> (U64(64) - r))
    return np.flatnonzero((rolled >> U64(64 - MEAN_BITS)) == 0) + WINDOW


def ends_between(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids, from its marks, within the least and the greatest length."""
    ends, last = [], 0
    for mark in marks:
        while mark - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if mark - last >= MIN_CHUNK:
            ends.append(mark)
            last = mark
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of a stream's chunks."""
    return ends_between(cut_marks(ids).tolist(), len(ids))


def boundaries_of(streams: list[np.ndarray]) -> list[list[int]]:
    """The same for many streams, hashed in one go; marks whose window spans two streams are left out."""
    first = np.cumsum([0, *(len(x) for x in streams)])
    marks = cut_marks(np.concatenate(streams)) if streams else np.zeros(0, np.int64)
    owner = np.searchsorted(first, marks, side="left") - 1
    ok = marks - first[owner] >= WINDOW
    marks, owner = marks[ok] - first[owner[ok]], owner[ok]
    cut = np.searchsorted(owner, np.arange(len(streams) + 1))
    marks = marks.tolist()
    return [ends_between(marks[a:b], len(x)) for a, b, x in zip(cut.tolist(), cut[1:].tolist(), streams, strict=False)]


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=ADDRESS).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed with different prefixes; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def split_recipe(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + ADDRESS] for i in range(0, len(recipe), ADDRESS)]


def _encode(definition, end_id: int):
    def run(batches):
        encoder = library_encoder(definition.value)
        end, seen = np.array([end_id], encoder.dtype), set()  # a task sends a chunk at most once
        for batch in batches:
            for t in texts_of(batch.column(1)):
                doc_ids, rows = batch.column(0).slice(t.lo, len(t)).to_pylist(), []
                streams = [np.concatenate([x, end]) for x in encoder.ids_of(t)]
                for doc_id, ids, stops in zip(doc_ids, streams, boundaries_of(streams), strict=True):
                    raw, width, last, recipe = ids.tobytes(), ids.itemsize, 0, []
                    for stop in stops:
                        payload = raw[last * width : stop * width]
                        recipe.append(key := address(payload))
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            rows.append(("chunk", None, stop - last, key, payload))
                        last = stop
                    rows.append(("recipe", doc_id, len(ids), merkle_root(recipe), b"".join(recipe)))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "doc_id", "n", "address", "payload"])

    return run


def _once(batches):
    """Chunks come sorted by address: only the first of equal ones goes on, all recipes do."""
    last = None
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        chunk = np.array(batch.column(0).to_pylist(), object) == "chunk"
        for i, key in enumerate(batch.column(3).to_pylist()):
            if chunk[i]:
                keep[i], last = key != last, key
        yield batch.filter(pa.array(keep))


STAGED = "doc_id long, n_tokens long, root binary, recipe binary, part int, at long, first long"


def _number(batches):
    """Rows of a range, in order, with their place in it and the ids before them in it."""
    at = first = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        before = first + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at + np.arange(len(n))), pa.array(before)], [c.split()[0] for c in STAGED.split(", ")])
        at, first = at + len(n), first + int(n.sum())


def write_store(docs: DataFrame, path: str, *, end_id: int = END_ID, tokenizer_path: str | None = None) -> str:
    """Encode whole texts with the tokenizers library, append ``end_id`` to each, and store the ids."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_definition(tokenizer_path, "byte_bpe_50k.json"))
    # a recipe goes anywhere, a chunk to where its address says
    place = F.when(F.col("kind") == "chunk", F.xxhash64("address")).otherwise(F.xxhash64("doc_id", "address", "n"))
    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_encode(definition, end_id), OBJECTS)
        .withColumn("place", place)
        .repartition("place")
        .drop("place")
        .sortWithinPartitions("kind", "address")
        .mapInArrow(_once, OBJECTS)
        .write.option("compression", "zstd")
        .parquet(f"{path}/objects")
    )
    recipes = spark.read.schema(OBJECTS).parquet(f"{path}/objects").where("kind = 'recipe'")
    order = ["doc_id", "address"]
    staged = f"{path}/recipes-unplaced"
    (
        recipes.select("doc_id", F.col("n").alias("n_tokens"), F.col("address").alias("root"), F.col("payload").alias("recipe"))
        .repartitionByRange("doc_id", "root")
        .sortWithinPartitions("doc_id", "root")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_number, STAGED)
        .write.option("compression", "zstd")
        .parquet(staged)
    )
    placed = spark.read.schema(STAGED).parquet(staged)
    sizes = placed.groupBy("part").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("size", "rows")])
    (
        placed.join(F.broadcast(sizes), "part")  # a row for each range
        .select((F.col("rows_before") + F.col("at")).alias("ordinal"), "doc_id", (F.col("size_before") + F.col("first")).alias("start"), "n_tokens", "root", "recipe")
        .repartitionByRange("ordinal")
        .sortWithinPartitions("ordinal")  # so files in the order of their names are in ascending doc_id order
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    _manifest(spark, path).write.parquet(f"{path}/manifest")
    return path


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


NODE = "level int, node long, n_docs long, start long, n_tokens long, root binary"


def _roots(batches):
    for batch in batches:
        roots = [merkle_root([x["root"] for x in below]) for below in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(roots, pa.binary())], ["level", "node", "n_docs", "start", "n_tokens", "root"])


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """From the recipes as they are on disk: level 1 has a node per ``PART`` documents, each next level one per ``PART`` nodes."""
    below = _recipes(spark, path).select(F.col("ordinal").alias("node"), F.lit(1).cast("long").alias("n_docs"), "start", "n_tokens", "root")
    n_nodes, level, out = below.count(), 0, None
    while n_nodes > 1 or not level:
        level, n_nodes = level + 1, -(-n_nodes // PART)
        above = (
            below.groupBy(F.floor(F.col("node") / PART).alias("node"))
            .agg(
                F.sum("n_docs").alias("n_docs"),
                F.min("start").alias("start"),
                F.sum("n_tokens").alias("n_tokens"),
                F.sort_array(F.collect_list(F.struct(F.col("node").alias("place"), "root"))).alias("below"),
            )
            .select(F.lit(level).alias("level"), "node", "n_docs", "start", "n_tokens", "below")
            .mapInArrow(_roots, NODE)
        )
        out = above if out is None else out.unionAll(above)
        below = above.drop("level")
    return out


def _links(spark: SparkSession, path: str) -> DataFrame:
    """A row per document and chunk; ``start`` names a document, as each has at least the end id."""
    many = F.expr(f"sequence(0, cast(length(recipe) / {ADDRESS} as int) - 1)")
    return (
        _recipes(spark, path)
        .select("doc_id", "start", "n_tokens", "root", "recipe", F.explode(many).alias("seq"))
        .select("doc_id", "start", "n_tokens", "root", "seq", F.expr(f"substring(recipe, seq * {ADDRESS} + 1, {ADDRESS})").alias("address"))
    )


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBJECTS).parquet(f"{path}/objects").where("kind = 'chunk'").select("address", "n", "payload")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of each document, rebuilt from its chunks."""

    def rebuild(batches):
        for batch in batches:
            ids = []
            for pieces, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = b"".join(p["payload"] for p in pieces)
                got = np.frombuffer(raw, f"<u{len(raw) // n}")
                if len(got) != n:
                    raise ValueError("a document's chunks don't hold its ids")
                ids.append(got.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return (
        _links(spark, path)
        .join(_chunks(spark, path), "address", "left")
        .groupBy("doc_id", "start", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("pieces"))
        .select("doc_id", "start", "pieces", "n_tokens")
        .mapInArrow(rebuild, "doc_id long, start long, ids array<int>")
    )


def _zeros_operator(n: int) -> list[int]:
    """Columns of the GF(2) matrix that appends n zero bytes to a CRC-32, by squaring."""
    one = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    result, power, bits = [1 << i for i in range(32)], one, 8 * n
    while bits:
        if bits & 1:
            result = [times(power, c) for c in result]
        power, bits = [times(power, c) for c in power], bits >> 1
    return result


@lru_cache(4096)
def _shift_tables(n_bytes: int) -> tuple[list[int], ...]:
    columns = _zeros_operator(n_bytes)
    tables = []
    for byte in range(4):
        table = [0] * 256
        for v in range(256):
            for bit in range(8):
                if v >> bit & 1:
                    table[v] ^= columns[8 * byte + bit]
        tables.append(table)
    return tuple(tables)


def crc_join(left: int, right: int, right_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from theirs."""
    a, b, c, d = _shift_tables(right_bytes)
    return a[left & 255] ^ b[left >> 8 & 255] ^ c[left >> 16 & 255] ^ d[left >> 24] ^ right


def _check_chunks(batches):
    for batch in batches:
        crcs = []
        for key, n, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if address(payload) != key:
                raise ValueError("a chunk doesn't have its address")
            crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{len(payload) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["address", "n", "crc"])


def _check_documents(batches):
    for batch in batches:
        crcs = []
        for n_tokens, root, pieces in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            if sum(p["n"] or 0 for p in pieces) != n_tokens or merkle_root([p["address"] for p in pieces]) != root:
                raise ValueError("a document's chunks don't hold its ids")
            crc = 0
            for p in pieces:
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of ids as 32-bit integers); raises if the store isn't whole."""
    sides = [spark.read.parquet(f"{path}/manifest").select("*", F.lit(1).alias("side")), _manifest(spark, path).select("*", F.lit(-1).alias("side"))]
    met = sides[0].unionByName(sides[1]).groupBy("level", "node", "n_docs", "start", "n_tokens", "root").agg(F.sum("side").alias("side"))
    if met.where("side <> 0").limit(1).count():  # a node that only one of them has
        raise ValueError("the recipes don't match the manifest")
    chunks = _chunks(spark, path).mapInArrow(_check_chunks, "address binary, n long, crc long")
    return (
        _links(spark, path)
        .join(chunks, "address", "left")
        .groupBy("doc_id", "start", "n_tokens", "root")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "address", "n", "crc"))).alias("pieces"))
        .mapInArrow(_check_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op3_token_store(spark, sf_dir):
    path = write_store(documents(spark, sf_dir), workspace(spark, "token-store"))
    return verify(spark, path)
