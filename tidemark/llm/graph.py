"""Connected components of links, as rounds of joins over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop


def _towards_smallest(links: DataFrame, forward: bool, tables: list[DataFrame]) -> DataFrame:
    """One half round: the neighbours of each node move to the smallest of them.  Adds the table it writes.

    `forward` moves larger neighbours of a node, otherwise the node with its smaller ones moves.
    """
    if forward:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The smallest is counted map-side and written, so that the join below can split a hub's links.
    smallest = cut(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "smallest")
    tables.append(smallest)
    met = near.join(smallest, "u")
    if forward:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """`node, root`: the smallest node that each linked node can reach; unlinked nodes are absent.

    Links are contracted by alternating half rounds until they are stars around the smallest node;
    the number of rounds grows with the logarithm of the nodes.  No component is ever one task's.
    """
    links = cut(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, old = state, [links]
        links = cut(_towards_smallest(_towards_smallest(links, True, old), False, old), "links")
        drop(*old)


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the groups of `i` and `j`; labels stay the smallest place of each group."""
    while len(i):
        x, y = labels[i], labels[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        if not len(i):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
