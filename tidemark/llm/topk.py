"""Exact top-k by inner product with the threshold algorithm over sorted lists, one per dimension.

Candidates are dealt into blocks; a block keeps its vectors and, for each dimension, the order of its
vectors by that component.  Queries come in parts; a task holds one part and meets a group of blocks, one after the
other in a sorted stream, so a part travels once for a group and no pair of a part and a block is ever a row.  A query
goes down the lists, from the end that suits the sign of its component, looks up the whole score of every vector met
for the first time, and stops when the best score an unseen vector could have, from the last values of all lists, is
below the kth score it has from this block or those before.  Ties go to the smaller id, so it goes on while they could
be equal.  Scores of the groups are then merged by query.

Vectors that are null, hold a null or a component that is not finite, or lack an id take no part.
Vectors of different lengths are refused with an error, and so are components of 2^53 or more and scores
that do not fit 64 bits; all other scores are exact.  Rows that repeat an id are candidates each; a query is not
compared with rows of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

BLOCK = 4096
QUERIES = 8192
DEEPER = 128
# Groups of blocks for each task that runs at once, and the most blocks of a group.
WAVES = 4
MET = 32


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """`vec_id, vector`: finite vectors with each component x as floor(scale * x)."""
    # Beyond this a number with a point no longer tells whole numbers apart.
    whole = lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("bigint"))
    numbers = F.transform(F.col(vector_col).cast("array<double>"), lambda x: whole(x * F.lit(float(scale))).cast("bigint"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"), numbers.alias("vector")
    )


def _dealt(vectors: DataFrame, rows: int) -> DataFrame:
    """`block, ids, matrix, order`: vectors in blocks of about `rows`, with the sorted lists of each block."""
    blocks = F.greatest(F.lit(1), F.ceil(vectors.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(rows)))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))

    def pack(group):
        import pandas as pd

        if group["vector"].str.len().nunique() > 1:
            raise ValueError("vectors of different lengths")
        matrix = np.array(group["vector"].tolist(), np.int64)
        order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)
        return pd.DataFrame({
            "block": [int(group["block"].iloc[0])], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
            "matrix": [matrix.tobytes()], "order": [np.ascontiguousarray(order).tobytes()],
        })

    return dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, matrix binary, order binary")


def _leading(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best, best first."""
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def threshold_search(matrix: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, least: int | None = None):
    """Rows of the block's k best for one query, with their scores and how many rows were looked up.

    Rows that score less than `least` may be missing.
    """
    n, size = matrix.shape
    seen = np.zeros(n, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The list of a dimension is read from its large end where the query is positive.
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    used = np.concatenate([up, down])
    wanted, depth, step, looked = query.astype(matrix.dtype), 0, DEEPER, 0
    while looked < n:
        low, depth = depth, min(n, depth + step)
        step *= 2
        met = seen.copy()
        if len(used):
            met[order[up, n - depth : n - low]] = True
            met[order[down, low:depth]] = True
        else:
            met[low:depth] = True
        fresh = np.flatnonzero(met != seen)
        seen = met
        looked += len(fresh)
        found = (matrix[fresh] @ wanted).astype(np.int64)  # an error where whole numbers of any size do not fit
        own = ids[fresh] != query_id
        rows, scores = np.concatenate([rows, fresh[own]]), np.concatenate([scores, found[own]])
        best = _leading(ids[rows], scores, k)
        rows, scores = rows[best], scores[best]
        kth = [int(scores[-1])] * (len(rows) == k) + [least] * (least is not None)
        if kth:
            last = np.concatenate([matrix[order[up, n - depth], up], matrix[order[down, depth - 1], down]])
            bound = sum(int(x) * int(q) for x, q in zip(last.tolist(), query[used].tolist(), strict=True))
            if bound < max(kth):
                break
    return rows, scores, looked


class _Asked:
    """A part of the queries, with the k best so far and how many vectors were looked up for each."""

    def __init__(self, rows: pa.StructArray, k: int):
        self.k = k
        # Copies, as a view would hold the whole batch.
        self.ids = rows.field("vec_id").to_numpy().copy()
        lists = rows.field("vector")
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.queries = np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(self.sizes)[:-1])
        self.most = max((int(abs(x).max()) for x in self.queries if len(x)), default=0)
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(self.ids)
        self.looked = np.zeros(len(self.ids), np.int64)

    def meet(self, ids: np.ndarray, matrix: np.ndarray, order: np.ndarray) -> None:
        matrix = matrix.reshape(len(ids), -1)
        if (self.sizes != matrix.shape[1]).any():
            raise ValueError("vectors of different lengths")
        most = self.most * int(np.abs(matrix).max()) * matrix.shape[1]
        # Sums of whole numbers are exact in floating point while they fit its digits; the largest ones need Python's.
        matrix = matrix.astype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object)
        order = order.reshape(-1, len(ids))
        for i, (query_id, query) in enumerate(zip(self.ids.tolist(), self.queries, strict=True)):
            held, had = self.best[i]
            rows, scores, looked = threshold_search(matrix, order, ids, query, query_id, self.k, int(had[-1]) if len(had) == self.k else None)
            self.looked[i] += looked
            held, had = np.concatenate([held, ids[rows]]), np.concatenate([had, scores])
            best = _leading(held, had, self.k)
            self.best[i] = held[best], had[best]

    def result(self) -> pa.RecordBatch:
        found = np.array([len(held) for held, _ in self.best], np.int64)
        looked = np.zeros(found.sum(), np.int64)
        # With the first row of each query.
        looked[(np.cumsum(found) - found)[found > 0]] = self.looked[found > 0]
        held, had = (np.concatenate(x) for x in zip(*self.best, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.repeat(self.ids, found), held, had, looked)], ["query_id", "vec_id", "score", "looked"]
        )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """`query_id, rank, vec_id, score, looked_up` for the rows of `vec_id, vector` where `is_query` holds.

    `looked_up` is the number of vectors whose whole score the query needed, over all blocks.
    """
    lists = cut(_dealt(vectors, block), "sorted-lists")
    asked = vectors.where(is_query)
    parts = F.greatest(F.lit(1), F.ceil(asked.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(queries)))
    batches = cut(
        asked.withColumn("part", F.pmod(F.xxhash64(F.lit("query"), "vec_id"), parts).cast("int"))
        .groupBy("part").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries")), "queries"
    )
    # Every part of the queries meets every group of blocks once, by the number of the pair.  Joined by it, Spark could
    # take the copies of either side for as small as the table they are of, and send them all through the driver.
    n_parts, n_blocks = (F.coalesce(F.max(c), F.lit(-1)) + 1 for c in ("part", "block"))
    n_parts, n_blocks = max(1, batches.agg(n_parts).first()[0]), max(1, lists.agg(n_blocks).first()[0])
    at_once = WAVES * vectors.sparkSession.sparkContext.defaultParallelism
    groups = min(n_blocks, max(-(-at_once // n_parts), -(-n_blocks // MET)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = batches.withColumn("group", each(groups)).withColumn("block", F.lit(-1))
    right = lists.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("part", each(n_parts))
    stream = left.unionByName(right, allowMissingColumns=True).select("part", "group", "block", "ids", "matrix", "order", "queries")
    stream = stream.repartitionById(n_parts * groups, F.col("part") * F.lit(groups) + F.col("group")).sortWithinPartitions("part", "group", "block")

    def search(batches_):
        key, held = None, None
        for batch in batches_:
            for r in range(batch.num_rows):
                here = batch["part"][r], batch["group"][r]
                if here != key:
                    if held:
                        yield held.result()
                    key, held = here, None
                if batch["block"][r].as_py() < 0:
                    held = _Asked(batch["queries"].slice(r, 1).flatten(), k)
                elif held:
                    held.meet(*(np.frombuffer(batch[c][r].as_buffer(), kind) for c, kind in (("ids", np.int64), ("matrix", np.int64), ("order", np.int32))))
        if held:
            yield held.result()

    found = stream.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint, looked bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("looked_up", F.sum("looked").over(Window.partitionBy("query_id")))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.lit(k))
        .select("query_id", "rank", "vec_id", "score", "looked_up")
    )
