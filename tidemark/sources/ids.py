"""Ids for posts that come without any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ids(posts: DataFrame, name: str = "id") -> DataFrame:
    """`posts` with a bigint id from all their values and, for equal posts, the number of the copy.

    The ids are the same however the files are dealt out and whenever they are read.  Equal posts are
    counted map-side, so a post repeated any number of times is one row until its copies are numbered.
    """
    counted = posts.groupBy(*posts.columns).agg(F.count(F.lit(1)).alias("_copies"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return copies.select(F.xxhash64(*posts.columns, "_copy").alias(name), *posts.columns)
