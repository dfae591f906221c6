"""Few coordinates that keep neighbours: the slowest patterns of a random walk on the graph of nearest neighbours.

Neighbours are weighed by their distance in relation to those of the point's other neighbours, so dense and sparse
regions count alike.  The leading eigenvectors of the normalised weights are found in a block Krylov space: a few
deterministic start columns are multiplied by the matrix again and again, each time a join and an aggregate over the
edges, and one small eigenproblem then picks the best directions of all that was met.  Nothing but that small matrix
reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.density import distinct_points
from tidemark.operators.factors import combined
from tidemark.plans.lineage import cut, drop
from tidemark.plans.nearest import nearest

STEPS = 12
EXTRA = 3
DIGITS = 6


def weighted_graph(points: DataFrame, neighbours: int) -> DataFrame:
    """`u, v, s`: both directions of each edge, with the weights scaled by the square roots of the ends' sums.

    The nearest neighbour of a point weighs 1, the others exp(-(d - nearest) / mean excess); of the weights a and b
    that two points give each other the edge has a + b - a * b.
    """
    near = cut(nearest(points, neighbours), "neighbours")
    scale = near.groupBy("point").agg(F.min("distance").alias("low"), F.avg("distance").alias("mean"))
    excess = F.greatest(F.col("mean") - F.col("low"), F.lit(1e-12))
    one_way = near.join(scale, "point").select(
        F.least("point", "other").alias("u"), F.greatest("point", "other").alias("v"), (F.exp(-(F.col("distance") - F.col("low")) / excess)).alias("a")
    )
    both = one_way.groupBy("u", "v").agg((F.lit(1.0) - F.min(1 - F.col("a")) * F.when(F.count(F.lit(1)) > 1, F.max(1 - F.col("a"))).otherwise(1.0)).alias("a"))
    edges = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "a")), "weighted")
    degree = cut(edges.groupBy("u").agg(F.sum("a").alias("d")), "degrees")
    ends = edges.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    graph = cut(ends.select("u", "v", (F.col("a") / F.sqrt(F.col("d") * F.col("e"))).alias("s"), F.col("d").alias("degree")), "graph")
    drop(near, edges, degree)
    return graph


def neighbour_places(
    vectors: DataFrame, k: int = 5, neighbours: int = 15, *, steps: int = STEPS, id: str = "id", column: str = "vector", out: str = "coords"
) -> DataFrame:
    """`id` and `out`: `k` coordinates of unit spread for each distinct vector's rows, the slowest pattern first.

    Ids are whole numbers.  Rows with equal vectors have equal places; a null vector has null ones.  A point without any
    other one, or without a direction of its own, is at zero.  Coordinates are rounded to DIGITS, and each points so
    that its largest value is positive.
    """
    width = k + 1 + EXTRA
    points = cut(distinct_points(vectors, [], id, column), "points")
    graph = weighted_graph(points.select("point", "weight", "coords"), neighbours)
    names = [f"y{i}" for i in range(width)]
    root = F.sqrt("degree")
    sign = lambda i: F.pmod(F.xxhash64(F.lit(i), "point"), F.lit(1 << 20)) / F.lit(float(1 << 19)) - F.lit(1.0)
    nodes = graph.groupBy(F.col("u").alias("point")).agg(F.first("degree").alias("degree"))
    # The first column is the pattern that never changes; the others start at random, by a hash.
    start = cut(nodes.select("point", "degree", root.alias("y0"), *[sign(i).alias(f"y{i}") for i in range(1, width)]), "block")
    sums = start.agg(*[F.sqrt(F.sum(F.col(n) * F.col(n))).alias(n) for n in names]).first()
    blocks = [start.select("point", *[(F.col(n) / F.lit(float(sums[n] or 1.0))).alias(n) for n in names])]
    for _ in range(steps):
        last = blocks[-1]
        times = graph.join(last, graph["v"] == last["point"]).groupBy("u").agg(*[F.sum(F.col("s") * F.col(n)).alias(n) for n in names])
        times = times.withColumnRenamed("u", "point")
        if len(blocks) > 1:
            # The recurrence of Chebyshev polynomials keeps the blocks apart.
            before = blocks[-2].select("point", *[F.col(n).alias(f"_{n}") for n in names])
            times = times.join(before, "point").select("point", *[(2 * F.col(n) - F.col(f"_{n}")).alias(n) for n in names])
        blocks.append(cut(times, "block"))
    rows = None
    for i, block in enumerate(blocks):
        part = block.select("point", F.struct(F.lit(i).alias("i"), F.array(*names).alias("y")).alias("b"))
        rows = part if rows is None else rows.unionByName(part)
    all_blocks = F.flatten(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["y"]))
    basis = cut(rows.groupBy("point").agg(all_blocks.alias("y")).join(nodes, "point"), "basis")
    drop(graph, start, *blocks)
    size = width * (steps + 1)

    def squares(batches):
        total = np.zeros((size, size))
        for batch in batches:
            y = batch["y"].flatten().to_numpy().reshape(-1, size)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    data = combined(basis.select("y").mapInArrow(squares, "data binary"), lambda found: np.sum([np.frombuffer(x) for x in found], axis=0).tobytes())
    turn = _best(np.frombuffer(data).reshape(size, size) if data else np.zeros((size, size)), width, k)

    def place(batches):
        for batch in batches:
            y = batch["y"].flatten().to_numpy().reshape(-1, size)
            x = (y @ turn) / np.sqrt(batch["degree"].to_numpy())[:, None]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch["point"], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["point", "x"])

    raw = cut(basis.mapInArrow(place, "point bigint, x array<double>"), "places")
    spread = raw.agg(
        *[F.sqrt(F.avg(F.col("x")[j] * F.col("x")[j])).alias(f"s{j}") for j in range(k)],
        *[F.max_by(F.col("x")[j], F.struct(F.round(F.abs(F.col("x")[j]), DIGITS), F.col("point"))).alias(f"t{j}") for j in range(k)],
    ).first()
    by = [(-1.0 if (spread[f"t{j}"] or 0.0) < 0 else 1.0) / (spread[f"s{j}"] or 1.0) for j in range(k)]
    placed = raw.select("point", F.array(*[F.round(F.col("x")[j] * F.lit(by[j]), DIGITS) for j in range(k)]).alias(out))
    zeros = F.array(*[F.lit(0.0)] * k)
    known = points.select("point", F.col("coords").alias("_at")).join(placed, "point", "left").select("_at", F.coalesce(out, zeros).alias(out))
    keyed = vectors.select(id, F.col(column).cast("array<double>").alias("_at"))
    return keyed.join(known, "_at", "left").select(id, out)


def _best(gram: np.ndarray, width: int, k: int) -> np.ndarray:
    """Combinations of the blocks that change slowest, without the one that never changes, from products of blocks."""
    size = len(gram)
    inner = size - width
    # Times the matrix, a block is the mean of its neighbours in the recurrence, and the first one is the second.
    shift = np.zeros((size, inner))
    for i in range(inner // width):
        at = slice(i * width, (i + 1) * width)
        after = slice((i + 1) * width, (i + 2) * width)
        if i == 0:
            shift[after, at] = np.eye(width)
        else:
            shift[after, at] = 0.5 * np.eye(width)
            shift[slice((i - 1) * width, i * width), at] += 0.5 * np.eye(width)
    values, basis = np.linalg.eigh(gram[:inner, :inner])
    kept = values > max(values[-1], 1e-300) * 1e-10 if inner else values > 0
    white = basis[:, kept] / np.sqrt(values[kept])
    times = white.T @ (gram[:inner] @ shift) @ white
    found, turn = np.linalg.eigh((times + times.T) / 2)
    order = np.argsort(-found)
    chosen = white @ turn[:, order]
    # The constant pattern is the start's first column; what is left of the others is told apart from it.
    constant = np.abs(gram[0, :inner] @ chosen)
    first = int(constant.argmax()) if len(constant) else 0
    wanted = [c for c in range(chosen.shape[1]) if c != first][:k]
    out = np.zeros((size, k))
    out[:inner, : len(wanted)] = chosen[:, wanted]
    return out
