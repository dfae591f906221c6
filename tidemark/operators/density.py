"""Density clusters of varying density, as rounds of joins over the graph of nearest neighbours.

A point's core distance is that of its `min_samples`-th neighbour, and two neighbours are as far apart as the
largest of their core distances and their distance (mutual reachability).  Joining points from the shortest edge on
gives a tree of clusters; here it is built from below in rounds: while a component is smaller than a cluster must be,
it takes its shortest edge, and two that take the same edge become one, with whatever else leads to them by edges that are
shorter than any other of theirs.  One whose shortest edge leads to a component that is large enough falls to it at
that length, and so does, each at its own, every one whose chain of shortest edges, which only get shorter, ends at such
a component.  So every point gets the core it belongs to and the length at
which it joins; only cores, and the shortest edges between them, make the tree of clusters.  A point that joins at
the very length at which its cluster merges belongs to the cluster.

Of that tree the most stable clusters that do not contain each other are taken: the stability of a cluster sums, over its
points, by how much the density (1 / length) at which a point leaves exceeds that at which the cluster appears.

Edges are ordered by length and then by their ends, so results do not depend on how the data is dealt.  Equal points are
one point with a weight.  Components that no edge of the graph connects are apart, as if infinitely far.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop
from tidemark.plans.nearest import cells_of, grouped, nearest

# Lengths below this are this; equal points would have an infinite density.
SHORTEST = 1e-9
# A corpus of up to so many different points is solved by one task, with the same result; one of up to FORESTS times as
# many too, once tasks for near points have left out edges that close cycles.
WHOLE = 1 << 15
FORESTS = 128
_ALL = "_corpus"


def distinct_points(points: DataFrame, by: Sequence[str], id: str, coords: str) -> DataFrame:
    """`by, point, weight, coords`: equal coordinates as one point, named by its smallest id; null ones are left out."""
    return (
        points.where(F.col(coords).isNotNull() & F.col(id).isNotNull())
        .groupBy(*by, F.col(coords).cast("array<double>").alias("coords"))
        .agg(F.min(id).cast("bigint").alias("point"), F.count(F.lit(1)).alias("weight"))
    )


def neighbour_graph(points: DataFrame, neighbours: int, min_samples: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The core distance of each of `by, point, weight, coords`, and the mutual reachability edges of the graph of its
    `neighbours` nearest: (`by, point, weight, core`) and (`by, u, v, w`) with u < v, each edge once.

    With fewer than `min_samples` others, the core distance is that of the farthest.
    """
    by = list(by)
    most = max(neighbours, min_samples)
    near = cut(nearest(points, most, by), "neighbours")
    place = Window.partitionBy(*by, "point").orderBy("distance", "other")
    sums = place.rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("rank", F.row_number().over(place)).withColumn("held", F.sum("weight").over(sums))
    enough = F.min(F.when(F.col("held") + F.col("own") - 1 >= min_samples, F.col("distance")))
    own = points.select(*by, "point", F.col("weight").alias("own"))
    core = (
        ranked.join(own, [*by, "point"]).groupBy(*by, "point").agg(F.coalesce(enough, F.max("distance")).alias("core"))
    )
    copies = F.col("weight") > min_samples
    cores = cut(
        points.select(*by, "point", "weight").join(core, [*by, "point"], "left")
        .withColumn("core", F.greatest(F.when(copies, F.lit(0.0)).otherwise(F.coalesce("core", F.lit(0.0))), F.lit(SHORTEST))), "cores"
    )
    ends = ranked.where(F.col("rank") <= neighbours).select(
        *by, F.least("point", "other").alias("u"), F.greatest("point", "other").alias("v"), "distance"
    ).groupBy(*by, "u", "v").agg(F.min("distance").alias("d"))
    at = {end: cores.select(*by, F.col("point").alias(end), F.col("core").alias(f"c{end}")) for end in "uv"}
    edges = ends.join(at["u"], [*by, "u"]).join(at["v"], [*by, "v"])
    edges = cut(edges.select(*by, "u", "v", F.greatest("d", "cu", "cv").alias("w")), "edges")
    drop(near)
    return cores, edges


def _followed(moves: list[DataFrame], by: list[str]) -> DataFrame:
    """`by, c, leaf, joined`: where each component that a core took in ended, from all moves `by, c, n, at`.

    A component moves into another at most once before it is of a core, so moves are chains; each round doubles how
    far all of them have been followed.
    """
    all_moves = moves[0]
    for part in moves[1:]:
        all_moves = all_moves.unionByName(part)
    links = cut(all_moves.where("c <> n OR at IS NOT NULL"), "moves")
    while True:
        step = links.select(*by, F.col("c").alias("n"), F.col("n").alias("_n"), F.col("at").alias("_at"))
        # One that has joined a core has come to its end.
        after = links.where("at IS NULL").join(step, [*by, "n"]).select(*by, "c", F.col("_n").alias("n"), F.col("_at").alias("at"))
        if after.isEmpty():
            return links.where("at IS NOT NULL").select(*by, "c", F.col("n").alias("leaf"), F.col("at").alias("joined"))
        links = cut(links.where("at IS NOT NULL").unionByName(after), "moves")


def _forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges do not close a cycle of shorter ones."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = ends[: len(u)], ends[len(u) :]
    order, kept, up = np.lexsort((v, u, w)), np.zeros(len(u), bool), list(range(len(names)))
    for low in range(0, len(order), 1 << 16):
        at = order[low : low + (1 << 16)]
        for e, a, b in zip(at.tolist(), i[at].tolist(), j[at].tolist(), strict=True):
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            while up[b] != b:
                up[b] = up[up[b]]
                b = up[b]
            if a != b:
                up[a] = b
                kept[e] = True
    return kept


def _spanning(nodes: DataFrame, edges: DataFrame, by: list[str], points: int) -> DataFrame:
    """`edges` without many that close a cycle of shorter ones, which join nothing.

    Those between points of a group of near cells are looked at by one task; groups of WHOLE points come first, then
    four times as many in each, up to FORESTS times as many or all `points` of the largest corpus.
    """
    sizes = [WHOLE << 2 * i for i in range(16) if WHOLE and WHOLE << 2 * i < min(points, WHOLE * FORESTS)]
    if not sizes:
        return edges
    placed, cells = cells_of(nodes, by)
    left = edges
    for end in "uv":
        left = left.join(placed.select(*by, F.col("point").alias(end), F.col("cell").alias(f"c{end}")), [*by, end])
    names = [*by, "u", "v", "w", "cu", "cv"]
    left = cut(left.select(names), "placed-edges")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)

    def spanned(rows):
        return rows.loc[_forest(*(rows[c].to_numpy() for c in ("u", "v", "w"))), names]

    for size in sizes:
        groups = cut(grouped(cells, by, lambda n, _, size=size: -(-n // size)), "groups")
        met = left
        for end in "uv":
            met = met.join(groups.select(*by, F.col("cell").alias(f"c{end}"), F.col("group").alias(f"g{end}")), [*by, f"c{end}"])
        within = met.where("gu = gv").groupBy(*by, "gu").applyInPandas(spanned, schema)
        after = cut(within.unionByName(met.where("gu <> gv").select(names)), "spanning")
        drop(groups, left)
        left = after
    drop(cells)
    return left.select(*by, "u", "v", "w")


def cores_in_order(point: np.ndarray, weight: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list]:
    """The same as the rounds of `_cores` for one corpus, one edge after the other: for each point the smallest of its
    core, or -1, and the length, and the edges (a, b, w, u, v) that join cores."""
    names = np.sort(point)
    n = len(names)
    place = np.searchsorted(names, point)
    size = array("q", weight[np.argsort(place)].astype(np.int64).tobytes())
    # `up` is shortened on the way; `into` stays, and `at` is the length at which what is here joined a core or became one.
    up, into = array("q", range(n)), np.arange(n)
    core = bytearray(s >= least for s in size)
    at = np.where(np.frombuffer(core, np.uint8) > 0, SHORTEST, np.nan)
    core_up, between = {}, []

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def top_core(x):
        while core_up.get(x, x) != x:
            core_up[x] = core_up.get(core_up[x], core_up[x])
            x = core_up[x]
        return x

    order = np.lexsort((v, u, w))
    for low in range(0, len(order), 1 << 16):
        some = order[low : low + (1 << 16)]
        ends = (np.searchsorted(names, x[some]).tolist() for x in (u, v))
        for length, i, j in zip(w[some].tolist(), *ends, strict=True):
            a, b = top(i), top(j)
            if a == b:
                continue
            if core[a] and core[b]:
                x, y = top_core(a), top_core(b)
                if x != y:
                    core_up[x] = y
                    between.append((a, b, length, names[i], names[j]))
                continue
            # The part that is no core, or the smaller one, goes into the other.
            if core[a] or (not core[b] and size[a] > size[b]):
                a, b = b, a
            up[a] = into[a] = b
            if core[b]:
                at[a] = length
            else:
                size[b] += size[a]
                if size[b] >= least:
                    core[b], at[b] = 1, length
    joined, here = at.copy(), into.copy()
    while True:
        open_ = np.flatnonzero(np.isnan(joined) & (into[here] != here))
        joined = np.where(np.isnan(joined), at[here], joined)
        if not len(open_):
            break
        here[open_] = into[here[open_]]
    leaf = np.array([top(x) for x in range(n)], np.int64)
    found = np.frombuffer(core, np.uint8)[leaf] > 0
    # A core is named by its smallest point; names are in order.
    first = np.full(n, n)
    np.minimum.at(first, leaf, np.arange(n))
    name = lambda x: int(names[first[leaf[x]]])
    leaves = np.where(found, names[first[leaf]], -1) if n else leaf
    return leaves[place], np.where(found, joined, np.nan)[place], [(name(a), name(b), length, int(i), int(j)) for a, b, length, i, j in between]


def _cores_of_small(nodes: DataFrame, edges: DataFrame, by: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """`_cores` for corpora of at most WHOLE points, or FORESTS times as many with few edges, each in one task."""
    import pandas as pd

    kinds = ", ".join(f"{b} {nodes.schema[b].dataType.simpleString()}" for b in by)
    names = [*by, "point", "weight", "leaf", "joined", "a", "b", "w", "u", "v"]

    def solve(own, links):
        if not len(own):
            return pd.DataFrame({n: [] for n in names})
        leaf, joined, between = cores_in_order(*(own[c].to_numpy() for c in ("point", "weight")), *(links[c].to_numpy() for c in ("u", "v", "w")), least)
        members = own[[*by, "point", "weight"]].assign(leaf=pd.array(leaf, "Int64"), joined=joined)
        members.loc[leaf < 0, "leaf"] = pd.NA
        rows = pd.DataFrame(between, columns=["a", "b", "w", "u", "v"])
        for b in by:
            rows[b] = own[b].iloc[0]
        out = pd.concat([members, rows], ignore_index=True).reindex(columns=names)
        return out.astype({c: "Int64" for c in ("point", "weight", "leaf", "a", "b", "u", "v")})

    found = cut(
        nodes.groupBy(*by).cogroup(edges.groupBy(*by)).applyInPandas(
            solve, f"{kinds}, point bigint, weight bigint, leaf bigint, joined double, a bigint, b bigint, w double, u bigint, v bigint"
        ), "small-corpora"
    )
    return (
        found.where("point IS NOT NULL").select(*by, "point", "weight", "leaf", F.when(F.col("leaf").isNotNull(), F.col("joined")).alias("joined")),
        found.where("a IS NOT NULL").select(*by, "a", "b", "w", "u", "v"),
    )


def _leading_to_cores(first: DataFrame, by: list[str], least: int) -> DataFrame:
    """`by, c, n`: the components whose chain of shortest edges ends at a core, and that core.

    Along a chain edges get shorter, so what a component leads to has fallen to the core before it does.  Each round
    doubles how far all chains have been followed; where none has come to a core, none is longer.
    """
    chains = first.select(*by, "c", F.col("to").alias("n"), (F.col("other") >= least).alias("done"))
    written = None
    while True:
        step = chains.select(*by, F.col("c").alias("n"), F.col("n").alias("_n"), F.col("done").alias("_done"))
        seen = Observation()
        new = ~F.col("done") & F.coalesce("_done", F.lit(False))
        after = chains.join(step, [*by, "n"], "left").select(
            *by, "c", F.when(F.col("done"), F.col("n")).otherwise(F.coalesce("_n", "n")).alias("n"), (F.col("done") | new).alias("done"), new.alias("_new")
        ).observe(seen, F.count_if("_new").alias("n")).drop("_new")
        chains, last = cut(after, "chains"), written
        if last is not None:
            drop(last)
        written = chains
        if not seen.get["n"]:
            return chains.where("done").select(*by, "c", "n")


def _cores(nodes: DataFrame, edges: DataFrame, by: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Rounds until every component is of `least` points or has no edge out.

    Gives (`by, point, weight, leaf, joined`), the core each point falls to and at what length (null where it never
    does), and (`by, a, b, w, u, v`), the edges between cores.
    """
    # Edges between components, which are named by a point of theirs, with the sizes of both; that of a core is
    # not counted on.
    sizes = nodes.select(*by, "point", "weight")
    state = edges.select("*", F.col("u").alias("a"), F.col("v").alias("b"))
    for end in "ab":
        state = state.join(sizes.select(*by, F.col("point").alias(end), F.col("weight").alias(f"n{end}")), [*by, end])
    state = cut(state.select(*by, "a", "b", "w", "u", "v", "na", "nb"), "edges")
    small = {end: F.col(f"n{end}") < least for end in "ab"}
    # Stored beside the edges of a round, which are deleted after the next.
    moves, between = [], [cut(state.where(~small["a"] & ~small["b"]), "between")]
    while True:
        alive = state.where(small["a"] | small["b"])
        ways = [
            alive.where(small[x]).select(*by, F.col(x).alias("c"), "w", "u", "v", F.col(y).alias("to"), F.col(f"n{x}").alias("own"), F.col(f"n{y}").alias("other"))
            for x, y in ("ab", "ba")
        ]
        seen = Observation()
        ways = cut(ways[0].unionByName(ways[1]).observe(seen, F.count(F.lit(1)).alias("n")), "ways")
        if not seen.get["n"]:
            drop(ways, state)
            break
        place = Window.partitionBy(*by, "c").orderBy("w", "u", "v")
        edge = F.struct("w", "u", "v")
        # The shortest edge of each component and the next one; each leads to another component.
        two = ways.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= 2)
        first = cut(two.groupBy(*by, "c").agg(
            F.min(F.struct("w", "u", "v", "to", "own", "other")).alias("e"), F.max(F.when(F.col("_r") == 2, edge)).alias("next")
        ).select(*by, "c", "e.*", "next"), "first-edges")
        # To a core at once, or through others that do.
        chains = _leading_to_cores(first, by, least)
        settled = cut(first.join(chains, [*by, "c"]).select(*by, "c", "n", F.col("w").alias("at"), F.lit(least).cast("bigint").alias("size")), "settled")
        waiting = cut(first.join(settled.select(*by, "c"), [*by, "c"], "left_anti"), "waiting")
        back = waiting.select(*by, F.col("c").alias("to"), F.col("u").alias("bu"), F.col("v").alias("bv"))
        pulls = waiting.groupBy(*by, F.col("to").alias("c")).agg(F.count(F.lit(1)).alias("pull"))
        # Two that take the same edge become one.  The one that more lead to is the centre.
        mutual = waiting.join(back, [*by, "to"]).where("u = bu AND v = bv").join(pulls, [*by, "c"])
        centre = F.max(F.struct("pull", (-F.col("c")).alias("m"), "own")).alias("x")
        centres = cut(mutual.groupBy(*by, F.least("c", "to").alias("pair")).agg(centre).select(
            *by, (-F.col("x.m")).alias("n"), F.col("x.own").alias("held")), "centres")
        around = Window.partitionBy(*by, "n").orderBy("w", "u", "v")
        star = waiting.select(*by, F.col("to").alias("n"), "c", "w", "u", "v", "own", "next").join(centres, [*by, "n"])
        star = cut(star.withColumn("_r", F.row_number().over(around)).where(F.col("_r") <= least).drop("_r"), "stars")
        # Those that lead to the centre join it in the order of their edges, while these are shorter than any other
        # edge of what has joined.
        elsewhere = ways.join(centres.select(*by, F.col("n").alias("c")), [*by, "c"]).join(
            star.select(*by, F.col("n").alias("c"), F.col("c").alias("to")), [*by, "c", "to"], "left_anti"
        ).groupBy(*by, F.col("c").alias("n")).agg(F.min(edge).alias("out"))
        before, up_to = around.rowsBetween(Window.unboundedPreceding, -1), around.rowsBetween(Window.unboundedPreceding, 0)
        limit = F.least("out", F.min("next").over(before))
        joining = star.join(elsewhere, [*by, "n"], "left").withColumn("limit", limit).where(F.col("limit").isNull() | (edge < F.col("limit")))
        grown = joining.withColumn("size", F.col("held") + F.sum("own").over(up_to))
        core = F.min(F.when(F.col("size") >= least, F.col("w"))).over(Window.partitionBy(*by, "n"))
        grown = grown.withColumn("core", core).withColumn("all", F.max("size").over(Window.partitionBy(*by, "n")))
        joined = grown.select(*by, "c", "n", F.greatest("core", "w").alias("at"), F.col("all").alias("size"), "core")
        joined = joined.select(*by, "c", "n", F.when(F.col("core").isNotNull(), F.col("at")).alias("at"), "size").unionByName(
            grown.groupBy(*by, "n").agg(F.max("core").alias("at"), F.max("all").alias("size")).select(*by, F.col("n").alias("c"), "n", "at", "size")
        )
        moved = cut(settled.unionByName(joined), "moved")
        moves.append(moved.select(*by, "c", "n", "at"))
        for end in "ab":
            turn = moved.select(*by, F.col("c").alias(end), F.col("n").alias("_n"), F.col("size").alias("_size"))
            alive = alive.join(turn, [*by, end], "left").withColumns(
                {end: F.coalesce("_n", end), f"n{end}": F.coalesce("_size", f"n{end}")}
            ).drop("_n", "_size")
        turned = F.col("a") > F.col("b")
        ordered = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
        inside = alive.where("a <> b").select(*by, "w", "u", "v", *ordered).groupBy(*by, "a", "b").agg(F.min(F.struct("w", "u", "v", "na", "nb")).alias("e"))
        last, state = state, cut(inside.select(*by, "a", "b", "e.*"), "edges")
        # Cores stay as they are, so edges between two of them are done with.
        between.append(cut(state.where(~small["a"] & ~small["b"]), "between"))
        drop(ways, first, settled, waiting, centres, star, last)
    shortest = between[0]
    for part in between[1:]:
        shortest = shortest.unionByName(part)
    shortest = shortest.groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
    ended = nodes.select(*by, "point", "weight", F.when(F.col("weight") >= least, F.col("point")).alias("leaf"))
    ended = ended.withColumn("joined", F.when(F.col("leaf").isNotNull(), F.lit(SHORTEST)))
    if moves:
        there = _followed(moves, by).select(*by, F.col("c").alias("point"), F.col("leaf").alias("_leaf"), F.col("joined").alias("_joined"))
        ended = ended.join(there, [*by, "point"], "left").select(
            *by, "point", "weight", F.coalesce("leaf", "_leaf").alias("leaf"), F.coalesce("joined", "_joined").alias("joined")
        )
    return cut(ended, "members"), cut(shortest.select(*by, "a", "b", "e.*"), "between")


def merged(leaves: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of cores joined along edges in order: `parent` and `w` of each node, where nodes are the leaves and
    then one for each edge that joins, and the place of each node's tree.  Roots have parent -1 and w infinite."""
    n = len(leaves)
    up, parent, length = list(range(n)), [-1] * n, [np.inf] * n
    top = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j, x in zip(np.searchsorted(leaves, a).tolist(), np.searchsorted(leaves, b).tolist(), w.tolist(), strict=True):
        i, j = find(i), find(j)
        if i == j:
            continue
        node = len(parent)
        for side in (top[i], top[j]):
            parent[side], length[side] = node, x
        parent.append(-1)
        length.append(np.inf)
        up[j] = i
        top[i] = node
    parent = np.array(parent, np.int64)
    tree = np.arange(len(parent))
    for x in range(len(parent) - 1, -1, -1):
        if parent[x] >= 0:
            tree[x] = tree[parent[x]]
    return parent, np.array(length), tree


def chosen(parent: np.ndarray, stability: np.ndarray, whole: bool) -> np.ndarray:
    """For each node the selected cluster it is in, or -1: of each cluster and all those in it, what is more stable.

    `whole` says that the only root is all there is, and is no cluster.
    """
    n = len(parent)
    below, best, pick = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    inner = np.zeros(n, bool)
    inner[parent[parent >= 0]] = True
    for x in range(n):
        # Children come before their parents.
        own = stability[x] if not (whole and parent[x] < 0) else -np.inf
        pick[x] = own >= below[x] or not inner[x]
        if own == -np.inf:
            pick[x] = False
        best[x] = max(own, below[x])
        if parent[x] >= 0:
            below[parent[x]] += best[x]
    out = np.full(n, -1)
    for x in range(n - 1, -1, -1):
        if parent[x] >= 0 and out[parent[x]] >= 0:
            out[x] = out[parent[x]]
        elif pick[x]:
            out[x] = x
    return out


def _tree(members: DataFrame, between: DataFrame, by: list[str]) -> DataFrame:
    """`by, node, leaf, up, w, jump, far`: the tree of clusters of each corpus.

    Node numbers of leaves follow the leaves' names.  `up` is the parent and `w` the length at which they join;
    `far[i]` is the ancestor 2^i steps up and `jump[i]` the length at which it came to be.
    """
    leaves = members.where("leaf IS NOT NULL").groupBy(*by, "leaf").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    edges = between.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("w", "u", "v", "a", "b"))).alias("edges"))
    kinds = ", ".join(f"{b} {members.schema[b].dataType.simpleString()}" for b in by)
    schema = f"{kinds}, node bigint, leaf bigint, up bigint, w double, born double, roots bigint, far array<bigint>, jump array<double>"

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                names = np.sort(batch["leaves"].slice(r, 1).flatten().to_numpy())
                rows = batch["edges"].slice(r, 1).flatten()
                a, b, w = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))
                parent, length, _ = merged(names, a, b, w)
                n = len(parent)
                born = np.zeros(n)
                has = parent >= 0
                born[parent[has]] = length[has]
                far, jump, step = [], [], parent.copy()
                while (step >= 0).any():
                    far.append(step)
                    jump.append(np.where(step >= 0, born[step], np.inf))
                    step = np.where(step >= 0, step[step], -1)
                leaf = np.full(n, -1, np.int64)
                leaf[: len(names)] = names
                levels = np.array(far, np.int64).reshape(len(far), n).T if far else np.zeros((n, 0), np.int64)
                jumps = np.array(jump).reshape(len(jump), n).T if jump else np.zeros((n, 0))
                for low in range(0, n, 1 << 16):
                    part = slice(low, low + (1 << 16))
                    size = len(parent[part])
                    ends = pa.array(np.arange(size + 1, dtype=np.int32) * levels.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array([batch[c][r].as_py()] * size, batch[c].type) for c in by], pa.array(np.arange(n)[part]), pa.array(leaf[part]),
                            pa.array(parent[part]), pa.array(length[part]), pa.array(born[part]), pa.array(np.full(size, int((~has).sum()))),
                            pa.ListArray.from_arrays(ends, pa.array(levels[part].ravel())), pa.ListArray.from_arrays(ends, pa.array(jumps[part].ravel())),
                        ],
                        [*by, "node", "leaf", "up", "w", "born", "roots", "far", "jump"],
                    )

    none = F.array().cast(edges.schema["edges"].dataType)
    met = leaves.join(edges, by, "left").withColumn("edges", F.coalesce("edges", none))
    return met.mapInArrow(run, schema)


def _left_from(members: DataFrame, tree: DataFrame, by: list[str]) -> DataFrame:
    """`by, point, weight, node, joined`: the cluster that each point of a core falls out of.

    It is the last one on the way up that came to be before the point joined; steps of halving size find it.
    """
    levels = tree.agg(F.coalesce(F.max(F.size("far")), F.lit(0))).first()[0]
    start = tree.where("leaf >= 0").select(*by, "leaf", "node", "w")
    here = members.where("leaf IS NOT NULL").join(start, [*by, "leaf"]).select(*by, "point", "weight", "joined", "node", "w")
    settled, climbing = here.where("joined <= w").drop("w"), here.where("joined > w").drop("w")
    if levels:
        climbing = cut(climbing, "climbing")
        for i in range(levels - 1, -1, -1):
            step = tree.where(F.size("far") > i).select(*by, "node", F.col("far")[i].alias("_to"), F.col("jump")[i].alias("_born"))
            goes = F.col("_to").isNotNull() & (F.col("_to") >= 0) & (F.col("_born") < F.col("joined"))
            climbing = climbing.join(step, [*by, "node"], "left").withColumn("node", F.when(goes, F.col("_to")).otherwise(F.col("node"))).drop("_to", "_born")
    return settled.unionByName(climbing.select(settled.columns))


def varying_density_cluster(
    points: DataFrame,
    *,
    min_cluster_size: int = 35,
    min_samples: int | None = None,
    neighbours: int | None = None,
    by: Sequence[str] = (),
    id: str = "id",
    coords: str = "coords",
) -> DataFrame:
    """`by`, id, `topic` and `strength`: the most stable clusters of any density in each corpus, noise -1.

    `min_samples` (default `min_cluster_size`) sets the core distance and `neighbours` (default the same) the edges of
    the graph.  Topics are numbered from 0 by falling size within `by`.  The strength is the density at which a point
    leaves its cluster over the largest there; a corpus that never splits has no cluster.  Ids are whole numbers; rows
    with null coordinates are noise, and rows with a null id or corpus are left out.

    Cores, at most one for `min_cluster_size` points of a corpus, and the edges between them are the largest
    thing that a single task holds: the tree of a corpus is made in one.
    """
    samples = min_samples or min_cluster_size
    keep, by = list(by), list(by) or [_ALL]
    if not keep:
        points = points.withColumn(_ALL, F.lit(0))
    points = points.where(F.col(id).isNotNull())
    for b in by:
        points = points.where(F.col(b).isNotNull())
    nodes = cut(distinct_points(points, by, id, coords), "nodes")
    cores, edges = neighbour_graph(nodes, neighbours or samples, samples, by)
    # Corpora of a user's size are one task's work each; larger ones are worked on by all before that, or only by all.
    sizes = cut(nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    made = []
    for low, high, solve in ((0, WHOLE, _cores_of_small), (WHOLE, WHOLE * FORESTS, _cores_of_small), (WHOLE * FORESTS, None, _cores)):
        some = sizes.where((F.col("_n") > low) & (F.lit(True) if high is None else F.col("_n") <= high))
        most = some.agg(F.max("_n")).first()[0]
        if most is not None:
            own, links = (t.join(some.select(*by), by) for t in (cores, edges))
            if low or high is None:
                links = _spanning(nodes.join(some.select(*by), by), links, by, most)
            made.append(solve(own, links, by, min_cluster_size))
    if not made:
        return points.select(*keep, id, F.lit(-1).cast("bigint").alias("topic"), F.lit(0.0).alias("strength"))
    members, between = made[0]
    for more, others in made[1:]:
        members, between = members.unionByName(more), between.unionByName(others)
    tree = cut(_tree(members, between, by), "tree")
    left = cut(_left_from(members, tree, by), "left-from")

    density = lambda x: F.lit(1.0) / F.greatest(x, F.lit(SHORTEST))
    # What falls out of each cluster: how much, at which density in sum and at most.
    fell = left.groupBy(*by, "node").agg(
        F.sum("weight").alias("n"), F.sum((F.col("weight") * density(F.col("joined"))).cast("decimal(38,9)")).cast("double").alias("sum"),
        F.max(density(F.col("joined"))).alias("most"),
    )
    told = tree.select(*by, "node", "up", "w", "born", "roots").join(fell, [*by, "node"], "left").na.fill({"n": 0, "sum": 0.0, "most": 0.0})
    per_corpus = told.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", "up", "w", "born", "roots", "n", "sum", "most"))).alias("tree"))
    kinds = ", ".join(f"{b} {points.schema[b].dataType.simpleString()}" for b in by)

    def select(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                rows = batch["tree"].slice(r, 1).flatten()
                up, w, born, roots, n, sums, most = (
                    rows.field(c).to_numpy(zero_copy_only=False) for c in ("up", "w", "born", "roots", "n", "sum", "most")
                )
                inside, size = np.zeros(len(up)), n.astype(np.float64)
                for x in range(len(up)):
                    if up[x] >= 0:
                        inside[up[x]] += size[x]
                        size[up[x]] += size[x]
                appears = np.where(np.isfinite(w), 1 / np.maximum(w, SHORTEST), 0.0)
                splits = 1 / np.maximum(born, SHORTEST)
                # Points in smaller clusters leave when it splits, the others when they fall out.
                stability = sums + inside * np.where(inside > 0, splits, 0) - (n + inside) * appears
                pick = chosen(up, stability, len(roots) > 0 and roots[0] == 1)
                best = np.where(inside > 0, splits, most)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([batch[c][r].as_py()] * len(up), batch[c].type) for c in by], rows.field("node"), pa.array(pick),
                        pa.array(np.where(pick >= 0, best[pick], 0.0)), pa.array(np.where(pick >= 0, size[pick], 0).astype(np.int64)),
                    ],
                    [*by, "node", "cluster", "best", "size"],
                )

    picks = cut(per_corpus.mapInArrow(select, f"{kinds}, node bigint, cluster bigint, best double, size bigint").where("cluster >= 0"), "picks")
    order = Window.partitionBy(*by).orderBy(F.desc("size"), "cluster")
    numbers = picks.select(*by, "cluster", "size").distinct().select(*by, "cluster", (F.row_number().over(order) - 1).cast("bigint").alias("topic"))
    named = picks.join(numbers, [*by, "cluster"]).select(*by, "node", "topic", "best")
    of_point = left.join(named, [*by, "node"]).select(
        *by, "point", "topic", (F.least(density(F.col("joined")), F.col("best")) / F.col("best")).alias("strength")
    )
    labelled = nodes.join(of_point, [*by, "point"]).select(*by, F.col("coords").alias("_at"), "topic", "strength")
    rows = points.select(*by, id, F.col(coords).cast("array<double>").alias("_at"))
    return rows.join(labelled, [*by, "_at"], "left").select(
        *keep, id, F.coalesce("topic", F.lit(-1)).cast("bigint").alias("topic"), F.coalesce("strength", F.lit(0.0)).alias("strength")
    )
