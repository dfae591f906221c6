"""The k nearest neighbours of every point, exact, without meeting all pairs.

Points are dealt to the nearest of some pivots.  The distance of two pivots and the largest distances in their
cells bound how near and how far points of two cells can be, so a cell meets only those that can hold one of its
k nearest: the others cannot.  Cells that are near each other are a group, and a group sees the blocks of partners
that any of its cells wants, its own and the nearest first, in one sorted stream; each cell skips those beyond what it has.
A task holds the points of one group and their best partners, and a block travels once for a group, not for each cell.
There are no more groups than keep the tasks busy unless one would not fit a task, so what travels grows with the points.

Pivots are a sample of the points and only guide the work; the result does not depend on them.  There are at most
PIVOTS for each corpus, so cells grow beyond that many times CELL points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

CELL = 768
BLOCK = 1024
PIVOTS = 4096
STRIP = 256
# Groups of a corpus for each task that runs at once, and the most that the points of a group and their partners take.
WAVES = 2
GROUP_BYTES = 64_000_000


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("points of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), sizes[0] if len(sizes) else 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; the same for two points whichever comes first and wherever they stand."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        d = x[:, None] - y[None, :]
        out += d * d
    return out


def _pivots(points: DataFrame, by: list[str]) -> DataFrame:
    """`by, pivots`: some points of each corpus, one for about CELL points and at most PIVOTS."""
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "point"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(chance.alias("c"), "point")).alias("_first"))
    share = F.least(F.ceil(F.col("_n") / CELL), F.lit(PIVOTS)) / F.col("_n")
    met = points.join(sizes, by)
    # Never none: the first by the same hash is always taken.
    chosen = met.where((chance <= share) | (F.col("point") == F.col("_first.point")))
    return chosen.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "coords"))), lambda p: p["coords"]).alias("pivots"))


def _assigned(points: DataFrame, by: list[str]) -> DataFrame:
    """`by, cell, point, weight, coords, far`: every point with its nearest pivot and the distance to it."""
    kinds = ", ".join(f"{b} {points.schema[b].dataType.simpleString()}" for b in by) + ", "
    sizes = points.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_blocks"))
    packed = (
        points.join(sizes, by).withColumn("_block", F.pmod(F.xxhash64("point"), F.col("_blocks")).cast("int"))
        .groupBy(*by, "_block").agg(F.collect_list(F.struct("point", "weight", "coords")).alias("points"))
    )

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                rows = batch["points"].slice(r, 1).flatten()
                x, pivots = _matrix(rows.field("coords")), _matrix(batch["pivots"].slice(r, 1).flatten())
                cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
                for low in range(0, len(x), STRIP):
                    d = squares(x[low : low + STRIP], pivots)
                    cell[low : low + STRIP] = d.argmin(1)
                    far[low : low + STRIP] = np.sqrt(d.min(1))
                own = [pa.array([batch[b][r].as_py()] * len(x), batch[b].type) for b in by]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(cell), rows.field("point"), rows.field("weight"), rows.field("coords"), pa.array(far)],
                    [*by, "cell", "point", "weight", "coords", "far"],
                )

    return packed.join(_pivots(points, by), by).select(*by, "points", "pivots").mapInArrow(
        run, f"{kinds}cell int, point bigint, weight bigint, coords array<double>, far double"
    )


def _cells(placed: DataFrame, pivots: DataFrame, by: list[str]) -> DataFrame:
    """`by, cell, n, reach, place`: the cells that have points, how many and how far from the pivot."""
    cells = placed.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach"))
    return cells.join(pivots.select(*by, F.posexplode("pivots").alias("cell", "place")), [*by, "cell"])


def halved(places: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """The group of each cell: halves of about equal points along the longest axis, again and again."""
    out, todo, made = np.zeros(len(places), np.int32), [(np.arange(len(places)), groups)], 0
    while todo:
        cells, parts = todo.pop()
        if parts < 2 or len(cells) < 2:
            out[cells] = made
            made += 1
            continue
        at = places[cells]
        axis = int(np.ptp(at, axis=0).argmax()) if at.shape[1] else 0
        order = cells[np.argsort(at[:, axis], kind="stable")] if at.shape[1] else cells
        held = np.cumsum(n[order])
        middle = int(np.searchsorted(held, held[-1] * (parts // 2) / parts)) + 1
        middle = min(max(middle, 1), len(order) - 1)
        todo += [(order[middle:], parts - parts // 2), (order[:middle], parts // 2)]
    return out


def grouped(cells: DataFrame, by: list[str], parts: Callable[[int, int], int]) -> DataFrame:
    """`by, cell, group`: cells near each other together, in `parts` groups by the points and the dimensions of a corpus."""
    kinds = ", ".join(f"{b} {cells.schema[b].dataType.simpleString()}" for b in by)
    packed = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cell", "n", "place"))).alias("cells"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                rows = batch["cells"].slice(r, 1).flatten()
                places, n = _matrix(rows.field("place")), rows.field("n").to_numpy()
                group = halved(places, n, parts(int(n.sum()), places.shape[1]))
                own = [pa.array([batch[b][r].as_py()] * len(rows), batch[b].type) for b in by]
                yield pa.RecordBatch.from_arrays([*own, rows.field("cell"), pa.array(group)], [*by, "cell", "group"])

    return packed.mapInArrow(run, f"{kinds}, cell int, group int")


def _grouped(cells: DataFrame, by: list[str], k: int, at_once: int) -> DataFrame:
    """Groups whose points and partners fit a task, and enough of them."""
    held = GROUP_BYTES
    return grouped(cells, by, lambda n, size: max(at_once, -(-n * (8 * size + 24 * k) // held)))


def cells_of(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """`by, point, cell` of `by, point, weight, coords`, and the cells with their number of points and their place."""
    placed = cut(_assigned(points, by), "placed")
    return placed.select(*by, "point", "cell"), cut(_cells(placed, _pivots(points, by), by), "cells")


def _meetings(cells: DataFrame, *given) -> DataFrame:
    """`by, cell, other, least`: the cells that can hold one of the k nearest of a point of `cell`, and how near.

    Given `cells, by, k`, or the points and pivots that cells are made of: `placed, pivots, by, k`.
    """
    *pivots, by, k = given
    if pivots:
        cells = _cells(cells, *pivots, by)
    mine = cells.select(*by, "cell", F.col("reach").alias("r"), F.col("place").alias("p"))
    theirs = cells.select(*by, F.col("cell").alias("other"), F.col("reach").alias("s"), F.col("place").alias("q"), "n")
    between = mine.join(theirs, by).withColumn("d", _distance(F.col("p"), F.col("q"))).select(*by, "cell", "other", "r", "s", "d", "n")
    # All points of a cell are within `most`; once they are more than k, no farther one is wanted.  A hair is
    # added, as bounds are rounded otherwise than distances.
    most = F.col("r") + F.col("d") + F.col("s")
    so_far = Window.partitionBy(*by, "cell").orderBy("most", "other").rowsBetween(Window.unboundedPreceding, 0)
    within = Window.partitionBy(*by, "cell")
    bounded = between.withColumn("most", most).withColumn("held", F.sum("n").over(so_far))
    bounded = bounded.withColumn("bound", F.min(F.when(F.col("held") > k, F.col("most"))).over(within))
    least = F.greatest(F.lit(0.0), (F.col("d") - F.col("r") - F.col("s")) * F.lit(1 - 1e-9) - F.lit(1e-12))
    return bounded.withColumn("least", least).where(F.col("bound").isNull() | (F.col("least") <= F.col("bound"))).select(
        *by, "cell", "other", "least"
    )


class _Best:
    """The k nearest partners so far of the points of one block."""

    def __init__(self, rows: pa.StructArray, k: int):
        self.k = k
        # Copies, as a view would hold the whole batch.
        self.own, self.x = rows.field("point").to_numpy().copy(), _matrix(rows.field("coords"))
        self.d = np.full((len(self.x), k), np.inf)
        self.point = np.full((len(self.x), k), -1, np.int64)
        self.weight = np.zeros((len(self.x), k), np.int64)

    def see(self, point: np.ndarray, weight: np.ndarray, y: np.ndarray, least: float) -> None:
        if least * least > self.d[:, -1].max():
            return
        yy = (y * y).sum(1)
        for low in range(0, len(self.x), STRIP):
            strip = slice(low, low + STRIP)
            x = self.x[strip]
            xx = (x * x).sum(1)
            # A product tells roughly which pairs may be near; only those get their distance.
            rough = xx[:, None] + yy[None, :] - 2 * (x @ y.T)
            may = rough <= self.d[strip][:, -1:] + 1e-12 * (xx.max() + yy.max())
            may &= self.own[strip][:, None] != point[None, :]
            some = np.flatnonzero(may.any(1))
            if not len(some):
                continue
            i, j = np.nonzero(may[some])
            exact = np.zeros(len(i))
            for u, v in zip(x[some].T, y.T, strict=True):
                apart = u[i] - v[j]
                exact += apart * apart
            d = np.full((len(some), len(y)), np.inf)
            d[i, j] = exact
            at = some + low
            every = np.concatenate([self.d[at], d], axis=1)
            near = np.argpartition(every, self.k - 1, axis=1)[:, : self.k]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(every, near, 1), axis=1, kind="stable"), 1)
            self.d[at] = np.take_along_axis(every, near, 1)
            for held, new in ((self.point, point), (self.weight, weight)):
                held[at] = np.take_along_axis(np.concatenate([held[at], np.broadcast_to(new, (len(at), len(new)))], axis=1), near, 1)

    def result(self) -> tuple[np.ndarray, ...]:
        row, column = np.nonzero(np.isfinite(self.d))
        return self.own[row], self.point[row, column], np.sqrt(self.d[row, column]), self.weight[row, column]


def nearest(points: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """`by, point, other, distance, weight`: the `k` nearest other points of each point of its corpus, and their weights.

    `points` has `by, point, weight, coords`, a bigint that is unique within a corpus, a count of copies that are one
    point, and an array of numbers, all of one length and finite.  Equal distances at the kth place may go to any.
    """
    by, keep = list(by), list(by)
    points = points.select(*by, F.col("point").cast("bigint").alias("point"), F.col("weight").cast("bigint").alias("weight"), F.col("coords").cast("array<double>").alias("coords"))
    if not by:
        by, points = ["_all"], points.withColumn("_all", F.lit(0))
    points = cut(points, "points")
    placed = cut(_assigned(points, by), "placed")
    spark = points.sparkSession
    at_once = WAVES * spark.sparkContext.defaultParallelism
    cells = cut(_cells(placed, _pivots(points, by), by), "cells")
    grouped = cut(_grouped(cells, by, k, at_once), "groups")
    counts = placed.groupBy(*by, "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("_blocks"))
    blocks = cut(
        placed.join(counts, [*by, "cell"]).withColumn("block", F.pmod(F.xxhash64("point"), F.col("_blocks")).cast("int"))
        .groupBy(*by, "cell", "block").agg(F.array_sort(F.collect_list(F.struct("point", "weight", "coords"))).alias("points"))
        .join(grouped, [*by, "cell"]), "blocks"
    )
    none = F.array().cast("array<struct<cell:int,least:double>>")
    own = blocks.select(*by, "group", F.lit(-2.0).alias("least"), F.col("cell").alias("other"), F.col("block").alias("part"), none.alias("wanted"), "points")
    # A block goes to each group where a cell wants it, with the cells and how near it may be to them.
    wanted = (
        _meetings(cells, by, k).join(grouped, [*by, "cell"]).groupBy(*by, "group", "other")
        .agg(F.min("least").alias("least"), F.array_sort(F.collect_list(F.struct("cell", "least"))).alias("wanted"))
    )
    others = blocks.select(*by, F.col("cell").alias("other"), F.col("block").alias("part"), F.col("group").alias("_home"), "points")
    met = wanted.join(others, [*by, "other"]).withColumn(
        "least", F.when(F.col("_home") == F.col("group"), F.lit(-1.0)).otherwise(F.col("least"))
    ).select(*by, "group", "least", "other", "part", "wanted", "points")
    names = [*by, "group"]
    # Groups of a corpus go to partitions side by side, so that none gets many.
    parts = max(at_once, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.pmod(F.xxhash64(*by), F.lit(parts)) + F.col("group"), F.lit(parts)).cast("int")
    stream = own.unionByName(met).repartitionById(parts, spread).sortWithinPartitions(*names, "least", "other", "part")
    kinds = ", ".join(f"{b} {points.schema[b].dataType.simpleString()}" for b in by)

    def told(key, held):
        for best in (b for cell in held.values() for b in cell):
            found = best.result()
            n = len(found[0])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v.as_py()] * n, v.type) for v in key[: len(by)]], *map(pa.array, found)], [*by, "point", "other", "distance", "weight"]
            )

    def run(batches):
        key, held = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                here = tuple(batch[c][r] for c in names)
                if here != key:
                    yield from told(key, held)
                    key, held = here, {}
                rows, other = batch["points"].slice(r, 1).flatten(), batch["other"][r].as_py()
                if batch["least"][r].as_py() == -2.0:
                    held.setdefault(other, []).append(_Best(rows, k))
                    continue
                block = rows.field("point").to_numpy(), rows.field("weight").to_numpy(), _matrix(rows.field("coords"))
                wanted = batch["wanted"].slice(r, 1).flatten()
                for cell, least in zip(wanted.field("cell").to_pylist(), wanted.field("least").to_pylist(), strict=True):
                    for best in held[cell]:
                        best.see(*block, least)
        yield from told(key, held)

    found = stream.mapInArrow(run, f"{kinds}, point bigint, other bigint, distance double, weight bigint")
    return found.select(*keep, "point", "other", "distance", "weight")
