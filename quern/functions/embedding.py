"""Vectors of texts without a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MADE_DIM = 64


def hashed_vectors(df: DataFrame, id_col: str, tokens: Column, dim: int = MADE_DIM) -> DataFrame:
    """(id, vector): a stand-in for an embedding model. Each token adds to two hashed places with a hashed sign; unit length."""
    h = lambda t, seed: F.xxhash64(t, F.lit(seed))
    found = df.select(F.col(id_col), F.transform(tokens, lambda t: h(t, 0)).alias("h")).where(F.size("h") > 0)

    def run(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            row, code = np.repeat(np.arange(len(size)), size), batch.column(1).flatten().to_numpy().view(np.uint64)
            x = np.zeros((len(size), dim))
            for shift in (0, 20):
                bits = code >> np.uint64(shift)
                np.add.at(x, (row, (bits % np.uint64(dim)).astype(int)), 1 - 2.0 * ((bits >> np.uint64(16)) & np.uint64(1)))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat)], [id_col, "vector"])

    return found.mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, vector array<float>")
