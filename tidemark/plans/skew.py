"""Joins that survive a key holding a large part of all rows.

Adaptive execution broadcasts a side of measured small size and splits hot keys of plain joins, so most
joins are left to it.  It cannot split a key when one side comes grouped by it; for those joins hot keys
are salted.  A key is hot when it owns more than `share` of the rows, so there are at most `1 / share` hot
keys whatever the data: that list, and only that list, is broadcast.  Rows of a hot key are spread over
salts by a hash of the row; the other side repeats its few rows once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1.0 / 4096
MIN_ROWS = 100_000


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    *,
    rows: Column | None = None,
    share: float = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Hot keys with `_salts`, the number of slices each needs. At most `1 / share` rows.

    `rows` sums a row-count column where `df` is already aggregated.
    """
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    for k in keys:
        # Filtered before counting, so that the total and the list share one shuffle.
        df = df.where(F.col(k).isNotNull())
    counts = df.groupBy(*keys).agg(n.alias("_n"))
    limit = F.greatest(
        counts.select((F.sum("_n") * F.lit(share)).alias("limit")).scalar(), F.lit(float(min_rows))
    )
    return counts.where(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    *,
    spread: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Equi-join (inner or left) of a possibly skewed `big` with `small`, whole and exact.

    `spread` names the columns of `big` whose hash picks the slice, `hot` the keys to slice as
    `hot_keys` gives them.  `condition` is an extra predicate over columns present on one side only.
    """
    on = list(on)
    slices = F.broadcast(hot)
    row_hash = F.xxhash64(*spread)
    # A null key matches nothing; spreading it keeps a left join's null group off one task.
    any_null = " OR ".join(f"`{k}` IS NULL" for k in on)
    left = (
        big.join(slices, on, "left")
        .withColumn(
            "_salt",
            F.when(F.expr(any_null), F.pmod(row_hash, F.lit(1 << 20)).cast("int"))
            .otherwise(F.coalesce(F.pmod(row_hash, F.col("_salts")).cast("int"), F.lit(0))),
        )
        .drop("_salts")
    )
    right = (
        small.join(slices, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return equi_join(left, right, [*on, "_salt"], how, condition).drop("_salt")


def equi_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", condition: Column | None = None
) -> DataFrame:
    """Join on equal names, plus a condition over names present on one side only."""
    if condition is None:
        return left.join(right, on, how)
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on]
    )
    same = condition
    for k in on:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in on])
