"""SimHash fingerprints of whole texts and the groups that few differing bits link.

Fingerprints meet in a self-join of a binary trie: pairs of nodes are walked down together, differing
bits add up, and a pair is dropped when they exceed the budget.  Of at most `bits` differing bits one
half of the fingerprint has at most `bits // 2`, so the trie is walked twice, each time with the other
half first and that smaller budget while in it; without this, nearly all nodes of the dense upper levels
would meet.  The upper levels are walked by Spark, four bits a round, until a pair of nodes holds few
enough fingerprints for one task; only nodes with many fingerprints go deeper, so a crowded corner of
the space is cut finer than the rest.  A task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.graph import components, unite
from tidemark.llm.tables import in_arrow, texts
from tidemark.plans.lineage import cut

SEED = 42
STEP_BITS = 4
NODE_PRINTS = 16_000
FRONTIER = 500_000


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits set in over half of 64-bit hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def shingle_hashes(found: W.Words, shingle: int) -> Iterator[np.ndarray]:
    """For each text the XXH64 of every run of `shingle` words joined by one space; all its words if fewer."""
    from xxhash import xxh64_intdigest as digest

    # One byte between words is as good as a space once it is one.
    raw = np.where(W.VISIBLE[found.data], found.data, np.uint8(0x20)).tobytes()
    start, end = found.start, found.end
    gap = np.zeros(len(start), bool)
    if len(start):
        gap[:-1] = start[1:] - end[:-1] != 1
    for low, high in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        n = high - low
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        k = min(shingle, n)
        s, e = start[low : high - k + 1].tolist(), end[low + k - 1 : high].tolist()
        if gap[low : high - 1].any():
            own = [raw[a:b] for a, b in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True)]
            hashes = [digest(b" ".join(own[i : i + k]), SEED) for i in range(n - k + 1)]
        else:
            hashes = [digest(raw[a:b], SEED) for a, b in zip(s, e, strict=True)]
        yield np.array(hashes, np.uint64)


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, print` (64 bits as a signed long) of every row; without words the print is 0."""

    def rows(batch: pa.RecordBatch):
        text, ids = batch["text"], batch["doc_id"]
        for a, b in W.slices(text):
            found = W.words(text.slice(a, b - a), W.VISIBLE, True)
            prints = np.fromiter((fingerprint_of(h) for h in shingle_hashes(found, shingle)), np.uint64, b - a)
            yield {"doc_id": ids.slice(a, b - a), "print": W.signed(prints)}

    return in_arrow(texts(df, id_col, text_col), rows, "doc_id bigint, print bigint")


def _rotated(value: Column, by: int) -> Column:
    return value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _prefix(level: int) -> Column:
    return F.shiftrightunsigned("r", 64 - STEP_BITS * level) if level else F.lit(0).cast("bigint")


def _node_pairs(prints: DataFrame, bits: int, node_prints: int) -> DataFrame:
    """`level, a, b`: pairs of trie nodes whose prints must meet, deep enough for one task each."""
    spark, half = prints.sparkSession, bits // 2
    pairs, done = None, []
    for level in range(0, 64 // STEP_BITS + 1):
        nodes = prints.groupBy(_prefix(level).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        if pairs is None:
            pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("err"), (F.col("n") * 2).alias("n"))
        else:
            parent = F.shiftrightunsigned("node", STEP_BITS)
            left = nodes.select(parent.alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"))
            right = nodes.select(parent.alias("b"), F.col("node").alias("cb"), F.col("n").alias("nb"))
            budget = half if level * STEP_BITS <= 32 else bits
            pairs = (
                pairs.select("a", "b").join(left, "a").join(right, "b")
                .where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
                .select(
                    F.col("ca").alias("a"), F.col("cb").alias("b"),
                    # A node is named by its whole prefix, so this is all that differs down to here.
                    F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))).alias("err"),
                    (F.col("na") + F.col("nb")).alias("n"),
                )
                .where(F.col("err") <= F.lit(budget))
            )
        pairs = cut(pairs, "node-pairs")
        last = level * STEP_BITS == 64
        small = pairs if last else pairs.where(F.col("n") <= F.lit(2 * node_prints))
        done.append(small.select(F.lit(level).alias("level"), "a", "b"))
        pairs = pairs.where(F.col("n") > F.lit(2 * node_prints))
        if last or pairs.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out if done else spark.createDataFrame([], "level int, a bigint, b bigint")


def near_links(prints: DataFrame, bits: int = 4, node_prints: int = NODE_PRINTS) -> DataFrame:
    """`u, v`: links between distinct values of `print`, enough of them to connect whatever is linked.

    Every pair of prints with at most `bits` differing bits is connected by the links returned, and every
    link returned joins prints that such pairs connect.
    """
    distinct = cut(prints.select("print").where("print IS NOT NULL").distinct(), "prints")
    out = None
    for by in (0, 32):
        rotated = distinct.select(_rotated(F.col("print"), by).alias("r"))
        tasks = cut(_node_pairs(rotated, bits, node_prints), "trie-tasks")
        levels = [row["level"] for row in tasks.select("level").distinct().collect()]  # 17 at most
        for level in levels:
            here = tasks.where(F.col("level") == F.lit(level)).drop("level")
            placed = rotated.withColumn("node", _prefix(level))
            first = placed.join(here.withColumn("node", F.col("a")), "node").withColumn("side", F.lit(0))
            second = placed.join(here.where("a <> b").withColumn("node", F.col("b")), "node").withColumn("side", F.lit(1))
            met = (
                first.unionByName(second).select("a", "b", "side", "r")
                .groupBy("a", "b").applyInPandas(_meet(level * STEP_BITS, bits), "u bigint, v bigint")
                .select(_rotated(F.col("u"), by).alias("u"), _rotated(F.col("v"), by).alias("v"))
            )
            out = met if out is None else out.unionByName(met)
    return distinct.sparkSession.createDataFrame([], "u bigint, v bigint") if out is None else out


def _meet(depth: int, bits: int):
    import pandas as pd

    def meet(group):
        values = group["r"].to_numpy(np.int64).view(np.uint64)
        side = group["side"].to_numpy()
        a, b = np.sort(values[side == 0]), np.sort(values[side == 1])
        forest = trie_forest(a, b, depth, bits)
        every = np.concatenate([a, b]).view(np.int64)
        node = np.flatnonzero(forest != np.arange(len(forest)))
        return pd.DataFrame({"u": every[node], "v": every[forest[node]]})

    return meet


def trie_forest(a: np.ndarray, b: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """For sorted prints under one trie node (`b` empty) or two, the smallest place each is linked to.

    Places count through `a` and then `b`.  Pairs of one side are left to the task of that side, so with
    two nodes only pairs across them are linked.
    """
    values = np.concatenate([a, b])
    n, half = len(values), bits // 2
    labels = np.arange(n)
    if not len(a) or (not len(b) and len(a) < 2):
        return labels
    across = len(b) > 0
    node_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def nodes(level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where nodes of `level` bits begin, and at each beginning the first place with the next bit set."""
        if level not in node_of:
            new = np.ones(n, bool)
            if level:
                new[1:] = (values[1:] >> np.uint64(64 - level)) != (values[:-1] >> np.uint64(64 - level))
            else:
                new[1:] = False
            if across:
                new[len(a)] = True
            starts = np.flatnonzero(new)
            mid = np.zeros(n, np.int64)
            zero = ((values >> np.uint64(63 - level)) & np.uint64(1)) == 0
            mid[starts] = starts + np.add.reduceat(zero.astype(np.int64), starts)
            node_of[level] = starts, mid
        return node_of[level]

    low_a, high_a = 0, len(a)
    low_b, high_b = (len(a), n) if across else (0, len(a))
    shift = np.uint64(64 - depth) if depth else np.uint64(0)
    shared = int(np.bitwise_count((values[low_a] ^ values[low_b]) >> shift)) if depth else 0
    top = max(0, depth - 32)
    if depth and int(np.bitwise_count((values[low_a] ^ values[low_b]) >> np.uint64(64 - depth + top))) > half:
        return labels
    if shared > bits:
        return labels
    stack = [(depth, *(np.array([x]) for x in (low_a, high_a, low_b, high_b, shared)))]
    while stack:
        level, la, ha, lb, hb, err = stack.pop()
        if len(la) > FRONTIER:
            at = len(la) // 2
            stack += [(level, *(x[:at] for x in (la, ha, lb, hb, err))), (level, *(x[at:] for x in (la, ha, lb, hb, err)))]
            continue
        if level < 64:
            starts, mid = nodes(level)
            # Two nodes that are one connected group already need no visit.
            least, most = np.empty(n, np.int64), np.empty(n, np.int64)
            least[starts], most[starts] = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            keep = (least[la] != most[la]) | (least[lb] != most[lb]) | (least[la] != least[lb])
            la, ha, lb, hb, err = (x[keep] for x in (la, ha, lb, hb, err))
        few = ((ha - la) * (hb - lb) <= 32) | (level == 64)
        if few.any():
            i, j = _all_of(la[few], ha[few], lb[few], hb[few])
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= bits)
            unite(labels, i[near], j[near])
        la, ha, lb, hb, err = (x[~few] for x in (la, ha, lb, hb, err))
        if not len(la):
            continue
        ma, mb = mid[la], mid[lb]
        other = (la, ma, mb, hb, err + 1)
        twin = la != lb
        parts = [(la, ma, lb, mb, err), (ma, ha, mb, hb, err), other, tuple(x[twin] for x in (ma, ha, lb, mb, err + 1))]
        la, ha, lb, hb, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ha > la) & (hb > lb) & (err <= (half if level < 32 else bits))
        if keep.any():
            stack.append((level + 1, *(x[keep] for x in (la, ha, lb, hb, err))))
    return labels


def _all_of(la, ha, lb, hb) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of places of each pair of ranges."""
    wide, count = hb - lb, (ha - la) * (hb - lb)
    owner = np.repeat(np.arange(len(la)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return la[owner] + inside // wide[owner], lb[owner] + inside % wide[owner]


def near_duplicates(
    df: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id, print, fingerprint, component_id` of every row.

    `component_id` is the smallest `doc_id` that links reach, the row's own included; texts without words
    have print 0 and are linked like any other.  Rows that repeat a `doc_id` stay as they are; a row
    without one has a print and takes the component of its group, null if nobody in it has an id.
    """
    prints = cut(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    roots = components(near_links(prints, bits))
    smallest = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    grouped = cut(
        smallest.join(roots.withColumnRenamed("node", "print"), "print", "left")
        .withColumn("root", F.coalesce("root", "print")), "grouped"
    )
    first = cut(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "first")
    named = cut(grouped.join(first, "root").select("print", "component_id"), "named")
    return prints.join(named, "print").select(
        "doc_id", "print", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
