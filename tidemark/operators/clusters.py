"""Principal components of vectors, and clusters as connected dense grid cells.

Both cost little beside `operators.spectral`, whose coordinates keep neighbours, and `operators.density`, whose
clusters may differ in density.  Vectors come from `operators.factors` or from any model (see `operators.infer`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop
from tidemark.plans.ordered import running_total
from tidemark.plans.skew import hot_keys, salted_join


def reduce_dims(vectors: DataFrame, k: int = 5, column: str = "vector", out: str = "coords") -> DataFrame:
    """`out`: the first `k` principal components of the unit vectors.

    Fitting aggregates one matrix of features by features, whose size does not depend on the rows.
    Each component points so that its largest weight is positive.
    """
    prepared = vectors.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    unit = Normalizer(inputCol="_v", outputCol="_unit").transform(prepared)
    model = PCA(k=k, inputCol="_unit", outputCol="_pc").fit(unit)
    weights = model.pc.toArray()
    signs = [1.0 if w[abs(w).argmax()] >= 0 else -1.0 for w in weights.T]
    turned = F.zip_with(vector_to_array("_pc"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s)
    return model.transform(unit).withColumn(out, turned).drop("_v", "_unit", "_pc")


def _with_neighbours(cell: str) -> Column:
    """The cell and the cells that share a face with it."""

    def moved(axis: Column, by: int) -> Column:
        return F.transform(cell, lambda v, i: v + F.when(i == axis, by).otherwise(0))

    axes = F.sequence(F.lit(0), F.size(cell) - 1)
    return F.concat(
        F.array(F.col(cell)), F.transform(axes, lambda a: moved(a, 1)), F.transform(axes, lambda a: moved(a, -1))
    )


def _components(cells: DataFrame, by: list[str]) -> DataFrame:
    """`_root`: the smallest cell of the connected component, cells joined by a common face."""
    labels, before = cells.select(*by, "_cell", F.col("_cell").alias("_root")), None
    while True:
        # Every cell sends its label to itself and its neighbours; only cells that exist receive it.
        # A cell hears from at most two neighbours per axis, so no group is large.
        hooked = (
            labels.select(*by, "_root", F.col("_cell").alias("_from"), F.explode(_with_neighbours("_cell")).alias("_cell"))
            .groupBy(*by, "_cell")
            .agg(F.min("_root").alias("_new"), F.max(F.when(F.col("_from") == F.col("_cell"), F.col("_root"))).alias("_old"))
            .where(F.col("_old").isNotNull())
        )
        # Changes are counted while the round is written.
        seen = Observation()
        hooked = cut(hooked.observe(seen, F.count_if(F.col("_new") != F.col("_old")).alias("changes")), "hooked")
        if before is not None:
            drop(before)
        before = hooked
        # Jump to the label of the label.  A large component makes its label hot: it is joined in slices.
        in_use = hooked.select(*by, F.col("_new").alias("_cell")).distinct()
        targets = hooked.join(in_use, [*by, "_cell"], "left_semi").select(
            *by, F.col("_cell").alias("_new"), F.col("_new").alias("_root")
        )
        hot = hot_keys(hooked, [*by, "_new"])
        labels = salted_join(hooked, targets, [*by, "_new"], spread=["_cell"], hot=hot).select(*by, "_cell", "_root")
        if not seen.get["changes"]:
            return labels


def _widths(points: DataFrame, by: list[str], coords: str) -> DataFrame:
    """`_width` per corpus: twice the normal-reference bin width of its mean spread, 1 without spread."""
    spread = (
        points.where(F.col(coords).isNotNull())
        .select(*by, F.size(coords).alias("_dims"), F.posexplode(coords).alias("_axis", "_v"))
        .groupBy(*by, "_dims", "_axis")
        .agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("_v").alias("_sd"))
    )
    width = F.lit(2.0) * F.avg("_sd") * F.pow(F.max("_n"), F.lit(-1.0) / (F.max("_dims") + 4))
    return spread.groupBy(*by).agg(width.alias("_w")).select(
        *by, F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0)).alias("_width")
    )


def density_cluster(
    points: DataFrame,
    *,
    width: float | None = None,
    min_points: int = 3,
    min_cluster_size: int = 35,
    by: Sequence[str] = (),
    id: str = "id",
    coords: str = "coords",
) -> DataFrame:
    """`by`, id, `topic` and `strength`: clusters of points in connected dense cells, noise -1.

    Points are counted per grid cell of side `width` (by default fitted to the spread and number of
    points of each corpus); cells with `min_points` are dense, and dense cells sharing a face belong
    together.  Clusters under `min_cluster_size` points become noise.  Topics are numbered from 0 by
    falling size within `by`.  The strength is the cell's count over the largest in its cluster.  Work
    on pairs happens between cells only, never between points.
    """
    by = list(by)
    if width is not None:
        located = points.withColumn("_width", F.lit(width))
    elif by:
        # Stored: a width computed again may differ in its last bit and move a point to another cell.
        located = points.join(cut(_widths(points, by, coords), "widths"), by, "left")
    else:
        located = points.withColumn("_width", cut(_widths(points, by, coords), "widths").select("_width").scalar())
    cell = F.transform(coords, lambda v: F.floor(v / F.col("_width")))
    placed = located.select(*by, id, cell.alias("_cell"))
    dense = cut(
        placed.where(F.col("_cell").isNotNull())
        .groupBy(*by, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_points),
        "dense",
    )
    labelled = dense.join(_components(dense, by), [*by, "_cell"])
    sizes = (
        labelled.groupBy(*by, "_root")
        .agg(F.sum("_n").alias("_size"), F.max("_n").alias("_top"))
        .where(F.col("_size") >= min_cluster_size)
        .withColumn("_rank", -F.col("_size"))
    )
    numbers = running_total(sizes, by, ["_rank", "_root"], F.lit(1), "topic").drop("_rank")
    named = sizes.join(numbers, [*by, "_root"])
    # A large cluster owns many cells.
    of_cell = salted_join(labelled, named, [*by, "_root"], spread=["_cell"], hot=hot_keys(labelled, [*by, "_root"])).select(
        *by, "_cell", F.col("topic").cast("bigint").alias("topic"), (F.col("_n") / F.col("_top")).alias("strength")
    )
    return placed.join(of_cell, [*by, "_cell"], "left").select(
        *by,
        id,
        F.coalesce("topic", F.lit(-1)).alias("topic"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"),
    )
