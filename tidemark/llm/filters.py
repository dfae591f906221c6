"""A filter of ids of fixed size, which spares tasks work on rows that a later join would drop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import words as W

FILTER_BITS = 1 << 26


def _spots(ids: np.ndarray) -> np.ndarray:
    return W.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)


def in_filter(only: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _spots(ids)
    return (only[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def id_filter(df: DataFrame) -> np.ndarray:
    """A bit for the hash of each `doc_id`: FILTER_BITS / 8 bytes however many ids there are.

    It only spares work: an id that passes by accident is dropped by the next join.
    """
    size = FILTER_BITS // 8

    def bits(batches):
        own = np.zeros(size, np.uint8)
        for batch in batches:
            at = _spots(batch["doc_id"].to_numpy(zero_copy_only=False))
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        chunk = np.flatnonzero(own.reshape(-1, 1024).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk, pa.int32()), pa.array([own[i * 1024 : i * 1024 + 1024].tobytes() for i in chunk.tolist()], pa.binary())],
            ["chunk", "bits"],
        )

    # Parts are put together by hashed chunk before the driver sees each chunk once.
    def merged(group):
        import pandas as pd

        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"]])
        return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "bits": [whole.tobytes()]})

    parts = df.select("doc_id").distinct().mapInArrow(bits, "chunk int, bits binary")
    out = np.zeros(size, np.uint8)
    for row in parts.groupBy("chunk").applyInPandas(merged, "chunk int, bits binary").toLocalIterator():
        out[row["chunk"] * 1024 : row["chunk"] * 1024 + 1024] = np.frombuffer(row["bits"], np.uint8)
    return out
