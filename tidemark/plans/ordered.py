"""Running totals per key in a given order, computed as a distributed scan.

A plain window would sort a whole key in one task.  Here rows are range-partitioned by key and
order, summed inside each range, and shifted by the totals of the earlier ranges of the same key, so
no task holds more than one range however hot the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join that also matches null with null, so undated rows stay in."""
    renamed = right.select(
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on]
    )
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return left.join(renamed, same).drop(*[f"_r{i}" for i in range(len(on))])


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str = "before"
) -> DataFrame:
    """`keys`, `order` and `name`: the sum of `weight` over the earlier rows of the same key.

    `keys + order` must identify a row; pass only rows, no wide text, since this is written once.
    """
    keys, order = list(keys), list(order)
    skinny = df.select(*keys, *order, weight.alias("_w"))
    ranged = skinny.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # Range bounds come from a sample, so they are fixed by writing them before being read twice.
    ranged = cut(ranged)

    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("_w").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return _join_null_safe(local, offsets, [*keys, "_range"]).select(
        *keys, *order, (F.col("_offset") + F.col("_local")).alias(name)
    )


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str = "text",
    *,
    max_chars: int,
    separator: str = "\n",
) -> DataFrame:
    """All texts of a key joined in order, as one row per part of about `max_chars` characters.

    A part starts at the first text whose preceding characters fill the previous parts; texts are
    never cut, dropped or reordered.  Parts are numbered from 0; keys below `max_chars` have only that one.
    `keys + order` must identify a row.
    """
    keys, order = list(keys), list(order)
    sep = len(separator)
    starts = running_total(df, keys, order, F.coalesce(F.length(text), F.lit(0)).cast("bigint") + F.lit(sep))
    filled = starts.select(
        *keys, *order, F.floor(F.col("before") / F.lit(max_chars)).cast("bigint").alias("_filled")
    )
    # A long text may fill several parts; the parts in use are numbered from 0.
    used = Window.partitionBy(*keys).orderBy("_filled")
    numbers = filled.select(*keys, "_filled").distinct().withColumn("part", F.row_number().over(used).cast("bigint") - 1)
    placed = _join_null_safe(filled, numbers, [*keys, "_filled"]).drop("_filled")
    texts = df.select(*keys, *order, F.col(text).alias("_text"))
    return (
        _join_null_safe(texts, placed, [*keys, *order])
        .groupBy(*keys, "part")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(*order, F.coalesce("_text", F.lit("")).alias("_text")))),
                    lambda row: row["_text"],
                ),
                separator,
            ).alias("text"),
            F.count(F.lit(1)).alias("n_texts"),
        )
    )
