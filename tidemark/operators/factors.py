"""Vectors of texts without a model: weighted terms, projected at random or by truncated factors.

Terms are places of a fixed range, by a hash.  How many texts have each place is the only thing that is counted
over all texts and the only thing broadcast: one number for each place, however many texts there are.  With it every
text is weighted and projected where it is; no term is shuffled to meet its count.

`project_text` adds terms up at random signs.  `factor_text` approximates the best low-rank factors of the text by
term matrix by a randomized range finder in two passes: texts are multiplied by random columns, the tall result is
made orthonormal by a tree of small QR factorisations, and a second pass projects the matrix to that range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans.lineage import cut, drop

PLACES = 1 << 22
FACTOR_PLACES = 1 << 18
SPREAD = 8
# Multipliers of the random signs come from a generator modulo a prime.
PRIME, STEP = 2_147_483_647, 48_271
# Rows of a product are computed in chunks of one shape, so that equal texts get equal vectors.
CHUNK = 512
# Entries whose products are made at once: those stay in the cache of a core.
ENTRIES = 1 << 11
# Terms of a batch that are worked on at once: a batch may be of any size.
PORTION = 1 << 19
FAN_IN = 64
STRIPE = 16


def places_of(column: Column | str, places: int) -> Column:
    """The places of the terms of a text, sorted, one for each occurrence; none for null."""
    hashed = F.transform(tx.terms(column), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(places)).cast("int"))
    # Numbers that cannot be null are sorted as such, without a call for each comparison.
    return F.coalesce(F.sort_array(F.array_compact(hashed)), F.array().cast("array<int>"))


def weights_of(rows: DataFrame, places: int) -> np.ndarray:
    """For each place ln((texts + 1) / (texts with it + 1)), from the `places` of each row; bounded by `places`."""
    texts = rows.count()
    counts = rows.select(F.explode(F.array_distinct("places")).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).toArrow()
    found = np.zeros(places)
    found[counts["place"].to_numpy()] = counts["n"].to_numpy()
    return np.log((texts + 1.0) / (found + 1.0))


def _portions(lists: pa.ListArray) -> Iterator[slice]:
    """The rows of a batch in parts of about PORTION terms, each of whole rows."""
    ends = lists.offsets.to_numpy()
    low = 0
    while low < len(lists):
        high = max(int(np.searchsorted(ends, ends[low] + PORTION, "right")) - 1, low + 1)
        yield slice(low, high)
        low = high


class _Entries:
    """The weighted terms of a batch of texts: the row, place and weight of each, by row and place."""

    def __init__(self, lists: pa.ListArray, weights: np.ndarray):
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        self.rows = len(lists)
        self.row, self.place = row[first], flat[first]
        self.weight = np.diff(np.append(first, len(flat))) * weights[self.place]

    def unit(self) -> _Entries:
        norm = np.sqrt(np.bincount(self.row, self.weight * self.weight, self.rows))
        self.weight = self.weight / np.where(norm > 0, norm, 1.0)[self.row]
        return self

    def texts(self) -> Iterator[slice]:
        """The entries in parts of about ENTRIES, each of whole texts, so that a text adds up the same way anywhere."""
        ends = np.searchsorted(self.row, np.arange(1, self.rows + 1))
        low = 0
        while low < len(self.row):
            high = ends[max(np.searchsorted(ends, low + ENTRIES, "right") - 1, np.searchsorted(ends, low, "right"))]
            yield slice(low, int(high))
            low = int(high)


def _list_of(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix, np.float32).ravel()))


def _multiplied(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), by.shape[1]))
    for low in range(0, len(rows), CHUNK):
        chunk = np.zeros((CHUNK, rows.shape[1]))
        some = rows[low : low + CHUNK]
        chunk[: len(some)] = some
        out[low : low + CHUNK] = (chunk @ by)[: len(some)]
    return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1.0)


def project_text(posts: DataFrame, dims: int = 512, column: str = "text", places: int = PLACES) -> DataFrame:
    """`vector`: TF-IDF of the terms of a text in a sparse random projection to unit length.

    Every place has a random sign at SPREAD of the `dims` positions, so products of vectors keep their expected
    value, and differ from it by about 1 / sqrt(dims).  Texts without terms get zeros.
    """
    if dims % SPREAD or dims < SPREAD:
        raise ValueError(f"dims must be a multiple of {SPREAD}")
    width = dims // SPREAD
    # Terms are found twice, as storing them takes longer than finding them.
    placed = posts.withColumn("_places", places_of(column, places))
    weights = weights_of(placed.select(F.col("_places").alias("places")), places)

    @F.arrow_udf("array<float>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for part in _portions(lists):
                for low in range(part.start, part.stop, CHUNK):
                    some = lists.slice(low, min(CHUNK, part.stop - low))
                    e = _Entries(some, weights)
                    total = np.zeros(len(some) * dims)
                    for k in range(SPREAD):
                        h = (e.place * pow(STEP, k + 1, PRIME) + k) % PRIME
                        sign = 1.0 - 2.0 * ((h // width) % 2)
                        total += np.bincount(e.row * dims + k * width + h % width, e.weight * sign, len(total))
                    yield _list_of(_scaled(total.reshape(len(some), dims)))

    return placed.withColumn("vector", project("_places")).drop("_places")


def _in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def batches(given):
        for columns in run(given):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[n] for n in names)], names)

    return df.mapInArrow(batches, schema)


def combined(parts: DataFrame, join: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One small value from those of `data`, put together by `join` in a tree of FAN_IN at a time."""
    import pandas as pd

    def merge(group):
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "data": [join(list(group["data"]))]})

    level = cut(parts.withColumn("part", F.spark_partition_id()).select("part", "data"), "parts")
    while True:
        rows = level.select("part").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).first()
        if not rows["n"]:
            return None
        if rows["n"] <= FAN_IN:
            return join([r["data"] for r in level.orderBy("part").collect()])
        after = cut(level.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group").applyInPandas(merge, "part int, data binary"), "parts")
        drop(level)
        level = after


def _orthonormal(sketched: DataFrame, width: int) -> np.ndarray:
    """What the rows of `y` must be multiplied by to be orthonormal, from a tree of QR factorisations."""

    def triangle(stacked: np.ndarray) -> np.ndarray:
        return np.linalg.qr(stacked, mode="r")

    def run(batches):
        r = np.zeros((0, width))
        for batch in batches:
            y = np.frombuffer(b"".join(batch["y"].to_pylist())).reshape(-1, width)
            for low in range(0, len(y), 1 << 14):
                r = triangle(np.concatenate([r, y[low : low + (1 << 14)]]))
        if len(r):
            yield {"data": pa.array([r.tobytes()], pa.binary())}

    def join(parts):
        return triangle(np.concatenate([np.frombuffer(p).reshape(-1, width) for p in parts])).tobytes()

    r = combined(_in_arrow(sketched.select("y"), run, "data binary"), join)
    if r is None:
        return np.zeros((width, 0))
    _, s, vt = np.linalg.svd(np.frombuffer(r).reshape(-1, width))
    kept = s > max(s[0], 1e-300) * 1e-9
    return vt[: len(s)][kept].T / s[kept]


def _core(sketched: DataFrame, basis: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """B B' for B, the text by term matrix projected to the orthonormal `basis` of its range.

    Each task adds up its part of B; parts are summed by stripes of places, in a stream, and only the square
    of each stripe goes on.
    """
    places, k = len(weights), basis.shape[1]
    if not k:
        return np.zeros((0, 0))

    def add(batches):
        total = np.zeros((places, k))
        for batch in batches:
            for part in _portions(batch["places"]):
                some = batch.slice(part.start, part.stop - part.start)
                q = np.frombuffer(b"".join(some["y"].to_pylist())).reshape(some.num_rows, -1) @ basis
                e = _Entries(some["places"], weights).unit()
                order = np.argsort(e.place, kind="stable")
                for low in range(0, len(order), ENTRIES):
                    at = order[low : low + ENTRIES]
                    place = e.place[at]
                    first = np.flatnonzero(np.diff(place, prepend=-1))
                    total[place[first]] += np.add.reduceat(q[e.row[at]] * e.weight[at][:, None], first, axis=0)
        stripes = total.reshape(-1, STRIPE * k)
        used = np.flatnonzero(stripes.any(1))
        for low in range(0, len(used), 1 << 10):
            some = used[low : low + (1 << 10)]
            yield {"stripe": some.astype(np.int32), "data": pa.array([stripes[i].tobytes() for i in some.tolist()], pa.binary())}

    def square(batches):
        out, held, name = np.zeros((k, k)), np.zeros(STRIPE * k), None
        for batch in batches:
            for stripe, data in zip(batch["stripe"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if stripe != name:
                    b = held.reshape(STRIPE, k)
                    out += b.T @ b
                    held, name = np.zeros(STRIPE * k), stripe
                held += np.frombuffer(data)
        b = held.reshape(STRIPE, k)
        yield {"data": pa.array([(out + b.T @ b).tobytes()], pa.binary())}

    # A part for each task of a wave and no more: what they send does not grow with the texts.
    at_once = sketched.sparkSession.sparkContext.defaultParallelism
    parts = _in_arrow(sketched.select("places", "y").coalesce(at_once), add, "stripe int, data binary")
    squares = _in_arrow(parts.repartition("stripe").sortWithinPartitions("stripe"), square, "data binary")
    total = combined(squares, lambda found: np.sum([np.frombuffer(x) for x in found], axis=0).tobytes())
    return np.frombuffer(total).reshape(k, k) if total else np.zeros((k, k))


def factor_text(
    posts: DataFrame, rank: int = 64, *, oversample: int = 8, id: str = "id", column: str = "text",
    places: int = FACTOR_PLACES, unit: bool = True, seed: int = 7,
) -> DataFrame:
    """`id, vector`: texts in the `rank` leading factors of the matrix of unit-length TF-IDF rows.

    Products of the vectors are those of the matrix's best approximation, as far as `rank + oversample` random
    columns find its range; `unit` scales them to length one.  Texts without terms get zeros, and directions that
    the texts do not have are zero.  Vectors point so that the largest loading of each factor is positive.
    """
    width = rank + oversample
    found = cut(posts.select(id, places_of(column, places).alias("places")), "places")
    weights = weights_of(found, places)

    def sketch(batches):
        signs = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (places, width), np.int8) * 2 - 1
        for batch in batches:
            for portion in _portions(batch["places"]):
                some = batch.slice(portion.start, portion.stop - portion.start)
                e = _Entries(some["places"], weights).unit()
                y = np.zeros((some.num_rows, width))
                for part in e.texts():
                    row = e.row[part]
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    y[row[first]] = np.add.reduceat(signs[e.place[part]] * e.weight[part][:, None], first, axis=0)
                yield {id: some[id], "places": some["places"], "y": pa.array([r.tobytes() for r in y], pa.binary())}

    kind = posts.schema[id].dataType.simpleString()
    sketched = cut(_in_arrow(found, sketch, f"{id} {kind}, places array<int>, y binary"), "sketched")
    drop(found)
    basis = _orthonormal(sketched, width)
    values, turn = np.linalg.eigh(_core(sketched, basis, weights))
    largest = np.argsort(-values)[:rank]
    turn, values = turn[:, largest], np.sqrt(np.maximum(values[largest], 0))
    if turn.size:
        turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(turn.shape[1])] < 0, -1.0, 1.0)
    factors = np.zeros((width, rank))
    factors[:, : len(values)] = basis @ (turn * values)

    def place(batches):
        for batch in batches:
            y = np.frombuffer(b"".join(batch["y"].to_pylist())).reshape(batch.num_rows, width)
            v = _multiplied(y, factors)
            yield {id: batch[id], "vector": _list_of(_scaled(v) if unit else v)}

    return _in_arrow(sketched.select(id, "y"), place, f"{id} {kind}, vector array<float>")
