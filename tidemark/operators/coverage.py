"""Semantic coverage: how well a sample of vectors covers a full set, within each key.

The reference quantity is the row and column maxima of a similarity matrix.  The matrix is never
built and its pairs are never emitted: distinct vectors of a key are packed into blocks of bounded
size, pairs of blocks are rows of an ordinary join, and a task multiplies the two small
matrices of a row and returns only the maxima, which an ordinary aggregate combines.  Copies collapse
before the product, so a group of equal vectors costs one entry however large it is.  Blocks of large keys
hold vectors that are near one pivot, and pairs of blocks that are too far apart to hold a maximum are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import preview
from tidemark.functions.vectors import l2_normalise
from tidemark.plans.lineage import cut
from tidemark.plans.skew import hot_keys, salted_join

# Vectors of a block: a block travels once for each block of the other side, so blocks are large.  A task
# multiplies as many rows of a block at a time as give PRODUCTS cosines or distances, at most STRIP, and tells at most
# about MAXIMA maxima at once.
BLOCK = 8192
PRODUCTS = 1 << 20
STRIP = PRODUCTS
MAXIMA = 1 << 15
# Vectors of larger keys are dealt to about one pivot for CELL vectors, and at most PIVOTS.
CELL = 2048
PIVOTS = 2048
STEPS = 20
DIGITS = 12


def _distinct_vectors(items: DataFrame, key: str, item: str, vector: str) -> DataFrame:
    """One row per distinct vector and key: the lowest item that has it and the number of copies."""
    return (
        items.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .groupBy(key, F.col(vector).alias("vector"))
        .agg(F.min(item).alias("item"), F.count(F.lit(1)).alias("copies"))
    )


def _block_counts(items: DataFrame, key: str, vector: str, name: str, block: int) -> DataFrame:
    # Counting hashes shuffles 8 bytes per vector; a collision only makes a block slightly larger.
    distinct = F.count_distinct(F.xxhash64(vector))
    return (
        items.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .groupBy(key)
        .agg(distinct.alias(f"_n_{name}"))
        .withColumn(f"_{name}_blocks", F.ceil(F.col(f"_n_{name}") / F.lit(block)).cast("int"))
    )


def _unit_matrix(rows: pa.StructArray, start: int, end: int) -> np.ndarray:
    """The vectors of one block as rows of unit length; a zero vector stays zero."""
    vectors = rows.field("vector")
    offsets = vectors.offsets.to_numpy()
    if len(set(np.diff(offsets[start: end + 1]).tolist())) > 1:
        raise ValueError("vectors of different lengths")
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[start]: offsets[end]]
    m = flat.astype(np.float64).reshape(end - start, -1)
    if not np.isfinite(m).all():
        raise ValueError("a vector holds a null, NaN or infinite entry")
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    norms[norms == 0] = 1.0
    return m / norms


def _block_maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row and column maxima of every block pair of a batch; pairs themselves stay in the task."""
    names = ["key", "side", "item", "copies", "cosine", "partner"]
    for batch in batches:
        keys = batch.column("key")
        blocks = {side: batch.column(side) for side in ("full", "sample")}
        bounds = {side: b.offsets.to_numpy() for side, b in blocks.items()}
        found = {side: [] for side in blocks}

        def told() -> Iterator[pa.RecordBatch]:
            for side, other in (("full", "sample"), ("sample", "full")):
                if not found[side]:
                    continue
                row, own, cosine, partner = (np.concatenate(c) for c in zip(*found[side]))
                found[side].clear()
                mine = blocks[side].values
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row)),
                        pa.array([side] * len(row), pa.string()),
                        mine.field("item").take(pa.array(own)),
                        mine.field("copies").take(pa.array(own)),
                        pa.array(cosine),
                        blocks[other].values.field("item").take(pa.array(partner)),
                    ],
                    names=names,
                )

        waiting = 0
        for r in range(batch.num_rows):
            (f0, f1), (s0, s1) = bounds["full"][r: r + 2], bounds["sample"][r: r + 2]
            a, b = _unit_matrix(blocks["full"].values, f0, f1), _unit_matrix(blocks["sample"].values, s0, s1)
            if a.shape[1] != b.shape[1]:
                raise ValueError("vectors of different lengths")
            # Blocks are in item order, so the first maximum is the lowest partner.
            rows, columns = [], (np.full(len(b), -np.inf), np.zeros(len(b), np.int64))
            strip = max(1, min(STRIP, PRODUCTS // max(len(b), 1)))
            for i in range(0, len(a), strip):
                # The last digits of a product depend on the shapes multiplied; rounded, equal ones stay equal.
                cos = a[i: i + strip] @ b.T
                np.round(cos, DIGITS, out=cos)
                rows.append((cos.max(axis=1), cos.argmax(axis=1) + s0))
                top = cos.max(axis=0)
                better = top > columns[0]
                columns[0][better] = top[better]
                columns[1][better] = cos.argmax(axis=0)[better] + i + f0
            for side, own, best in (
                ("full", (f0, f1), tuple(np.concatenate(x) for x in zip(*rows))), ("sample", (s0, s1), columns)
            ):
                found[side].append((np.full(own[1] - own[0], r), np.arange(*own), *best))
            waiting += f1 - f0 + s1 - s0
            if waiting >= MAXIMA:
                yield from told()
                waiting = 0
        yield from told()


def _with_cells(vectors: DataFrame, pivots: DataFrame, item_type: str, key_type: str, entry: str) -> DataFrame:
    """`vectors` of `key, side, item, copies, vector` with the nearest pivot of their key and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows, centres = batch["rows"].slice(r, 1).flatten(), batch["pivots"].slice(r, 1).flatten()
                x = _unit_matrix(rows, 0, len(rows))
                p = _unit_matrix(pa.StructArray.from_arrays([centres], ["vector"]), 0, len(centres))
                if x.shape[1] != p.shape[1]:
                    raise ValueError("vectors of different lengths")
                far, cell = [], []
                strip = max(1, min(STRIP, PRODUCTS // len(p)))
                for i in range(0, len(x), strip):
                    d = _chords(x[i: i + strip], p)
                    cell.append(d.argmin(axis=1).astype(np.int32))
                    far.append(d.min(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["key"][r].as_py()] * len(rows), batch["key"].type),
                        *[rows.field(c) for c in ("side", "item", "copies", "vector")],
                        pa.array(np.concatenate(cell)), pa.array(np.concatenate(far)),
                    ],
                    names=["key", "side", "item", "copies", "vector", "cell", "far"],
                )

    sizes = vectors.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL)).cast("int").alias("_parts"))
    packed = (
        vectors.join(sizes, "key")
        .withColumn("_part", F.pmod(F.xxhash64("vector"), F.col("_parts")).cast("int"))
        .groupBy("key", "_part").agg(F.collect_list(F.struct("side", "item", "copies", "vector")).alias("rows"))
    )
    return packed.join(pivots, "key").select("key", "rows", "pivots").mapInArrow(
        run, f"key {key_type}, side string, item {item_type}, copies bigint, vector {entry}, cell int, far double"
    )


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of unit vectors (or zero ones) through the ball."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _near_cells(cells: DataFrame, pivots: DataFrame) -> DataFrame:
    """`key, mine, theirs`: cells of the full side and of the sample that may hold a maximum of each other.

    Vectors of two cells are no farther apart than `most` and no nearer than `least`, by the triangle inequality.  The
    maximum of any vector of a cell is within the least `most` of the cell, so a pair that is farther for
    both of its cells is not needed.
    """
    places = pivots.select("key", F.posexplode("pivots").alias("cell", "_p"))
    unit = l2_normalise(F.col("_p"))
    sides = cut(cells.join(places, ["key", "cell"]).select("key", "side", "cell", "reach", unit.alias("at")), "cells")
    mine = sides.where("side = 'full'").select("key", F.col("cell").alias("mine"), F.col("reach").alias("r"), F.col("at").alias("p"))
    theirs = sides.where("side = 'sample'").select("key", F.col("cell").alias("theirs"), F.col("reach").alias("s"), F.col("at").alias("q"))
    squares = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    between = mine.join(theirs, "key").select("key", "mine", "theirs", F.sqrt(squares).alias("d"), "r", "s")
    # Lengths through the ball and products are rounded differently; the room covers products that are rounded to
    # the same digits.
    room = F.lit(1e-7)
    most = F.col("d") + F.col("r") + F.col("s") + room
    least = F.greatest(F.col("d") - F.col("r") - F.col("s") - room, F.lit(0.0))
    bounded = between.withColumn("_most", most).withColumn("_least", least)
    for side in ("mine", "theirs"):
        bounded = bounded.withColumn(f"_{side}", F.min("_most").over(Window.partitionBy("key", side)))
    # A vector of zeros has no direction: its product is 0 with any, which is no length through the ball.
    return bounded.where(
        (F.col("_least") * F.col("_least") <= F.greatest("_mine", "_theirs") * F.greatest("_mine", "_theirs") + F.lit(1e-10))
    ).select("key", "mine", "theirs")


def block_pairs(
    full: DataFrame, sample: DataFrame, *, key: str = "key", item: str = "item", vector: str = "vector", block: int = BLOCK
) -> DataFrame:
    """`key, full, sample`: the pairs of blocks that must be multiplied to find all maxima of both sides.

    Keys of one block on each side are one pair.  The distinct vectors of larger keys are dealt to the nearest of some
    pivots, and blocks of two cells meet only if they can hold a maximum.  Zero vectors are blocks of their
    own that meet all others.
    """
    key_type, item_type = full.schema[key].dataType.simpleString(), full.schema[item].dataType.simpleString()
    entry = "array<double>"
    f_blocks = _block_counts(full, key, vector, "full", block)
    s_blocks = _block_counts(sample, key, vector, "sample", block)
    # Only keys present on both sides go on.
    blocks = cut(f_blocks.join(s_blocks, key).withColumn("_large", F.col("_full_blocks") * F.col("_sample_blocks") > 1), "block-counts")

    def of(side: DataFrame, large: bool) -> DataFrame:
        wanted = blocks.where(F.col("_large") == large).select(key)
        # Hot keys are found from the per-key counts, not from the vectors.
        hot = hot_keys(blocks.withColumn("_n", F.col("_n_full") + F.col("_n_sample")), [key], rows=F.col("_n"))
        kept = salted_join(_distinct_vectors(side, key, item, vector), wanted, [key], spread=["item"], hot=hot)
        return kept.select(F.col(key).alias("key"), "item", "copies", F.col("vector").cast(entry).alias("vector"))

    def packed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("item", "copies", "vector"))).alias(name))

    pairs = packed(of(full, False), ["key"], "full").join(packed(of(sample, False), ["key"], "sample"), "key").select("key", "full", "sample")
    if blocks.where("_large").isEmpty():
        return pairs
    both = cut(
        of(full, True).withColumn("side", F.lit("full")).unionByName(of(sample, True).withColumn("side", F.lit("sample"))), "vectors"
    )
    empty = F.coalesce(F.forall("vector", lambda x: x == 0), F.lit(False))
    points = both.where(~empty)
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "vector"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = points.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(chance).alias("_first"))
    share = F.least(F.ceil(F.col("_n") / CELL), F.lit(PIVOTS)) / F.col("_n")
    chosen = points.join(sizes, "key").where((chance <= share) | (chance == F.col("_first"))).select("key", "vector").distinct()
    pivots = cut(chosen.groupBy("key").agg(F.array_sort(F.collect_list("vector")).alias("pivots")), "pivots")
    placed = _with_cells(points, pivots, item_type, key_type, entry)
    zeros = both.where(empty).select("key", "side", "item", "copies", "vector", F.lit(-1).alias("cell"), F.lit(0.0).alias("far"))
    placed = cut(placed.unionByName(zeros), "placed")
    cells = placed.groupBy("key", "side", "cell").agg(F.max("far").alias("reach"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_slices"))
    cells = cut(cells, "cell-sizes")
    nearby = _near_cells(cells.where("cell >= 0"), pivots)
    # Zero vectors meet everything, and what has only zeros on the other side, or may be nearest to them, too.
    own = {s: cells.where(F.col("side") == s).select("key", F.col("cell").alias(c)) for s, c in (("full", "mine"), ("sample", "theirs"))}
    for side, other, mine, theirs in (("full", "sample", "mine", "theirs"), ("sample", "full", "theirs", "mine")):
        with_zeros = own[side].where(F.col(mine) == -1).join(own[other], "key").select("key", "mine", "theirs")
        nearby = nearby.unionByName(with_zeros)
    nearby = nearby.distinct()
    sliced = placed.join(cells.select("key", "side", "cell", "_slices"), ["key", "side", "cell"]).withColumn(
        "_slice", F.pmod(F.xxhash64("vector"), F.col("_slices")).cast("int")
    )
    left = packed(sliced.where("side = 'full'"), ["key", "cell", "_slice"], "full").select("key", F.col("cell").alias("mine"), "full")
    right = packed(sliced.where("side = 'sample'"), ["key", "cell", "_slice"], "sample").select("key", F.col("cell").alias("theirs"), "sample")
    met = left.join(nearby, ["key", "mine"]).join(right, ["key", "theirs"]).select("key", "full", "sample")
    return pairs.unionByName(met)


def cosine_maxima(
    full: DataFrame,
    sample: DataFrame,
    *,
    key: str = "key",
    item: str = "item",
    vector: str = "vector",
    block: int = BLOCK,
) -> DataFrame:
    """For every distinct vector on both sides its best cosine on the other side of the same key.

    Columns: key, side ('full' or 'sample'), item (lowest with that vector), copies, cosine, partner
    (lowest item reaching the cosine).  Keys with an empty side have no rows.  Vectors of a key that differ
    in length, or hold a null or an entry that is not finite, raise an error.  Both sides are read more
    than once, so vectors that are costly to compute should be stored first.
    """
    key_type = full.schema[key].dataType.simpleString()
    item_type = full.schema[item].dataType.simpleString()
    pairs = block_pairs(full, sample, key=key, item=item, vector=vector, block=block)
    parts = pairs.select("key", "full", "sample").mapInArrow(
        _block_maxima,
        f"key {key_type}, side string, item {item_type}, copies bigint, cosine double, partner {item_type}",
    )
    # Larger cosine first, then the lower partner; min over the negated cosine keeps any item type.
    best = F.min(F.struct((-F.col("cosine")).alias("neg"), "partner"))
    return (
        parts.groupBy("key", "side", "item", "copies")
        .agg(best.alias("b"))
        .select(
            F.col("key").alias(key),
            "side",
            "item",
            "copies",
            (-F.col("b.neg")).alias("cosine"),
            F.col("b.partner").alias("partner"),
        )
    )


def best_match(
    full: DataFrame,
    sample: DataFrame,
    threshold: float = 0.75,
    *,
    key: str = "key",
    item: str = "item",
    vector: str = "vector",
    block: int = BLOCK,
) -> DataFrame:
    """Per full item: the best sample item, its cosine, and whether it reaches the threshold."""
    maxima = cosine_maxima(full, sample, key=key, item=item, vector=vector, block=block)
    scored = maxima.where(F.col("side") == "full").select(
        key, F.col("item").alias("lowest"), "cosine", F.col("partner").alias("sample_item")
    )
    # Every item beside the lowest one with its vector: stored once, without the vectors.
    items = full.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        key, F.col(item).alias("full_item"), F.col(vector).alias("vector")
    )
    lowest = items.groupBy(key, "vector").agg(F.min("full_item").alias("lowest"))
    copies = cut(items.join(lowest, [key, "vector"]).select(key, "full_item", "lowest"), "copies")
    return copies.join(scored, [key, "lowest"]).select(
        key,
        "full_item",
        "sample_item",
        "cosine",
        (F.col("cosine") >= threshold).alias("matched"),
    )


def matched_only(matches: DataFrame) -> DataFrame:
    return matches.where("matched")


def matched_texts(
    matches: DataFrame, full: DataFrame, sample: DataFrame, *, key: str = "key", shorten: int = 100
) -> DataFrame:
    """Matches with both texts, and `sample_preview`, the sample's text shortened for display.

    `full` and `sample` hold key, item and text, one row per item.
    """
    sample_text = sample.select(
        key, F.col("item").alias("sample_item"), F.col("text").alias("sample_text"), preview("text", shorten).alias("sample_preview")
    )
    full_text = full.select(key, F.col("item").alias("full_item"), F.col("text").alias("full_text"))
    # One sample, such as a narrative, may be the best match of very many full items, so its text comes last.
    return matches.join(full_text, [key, "full_item"]).join(sample_text, [key, "sample_item"]).select(
        key, "full_item", "full_text", "sample_item", "sample_text", "sample_preview", "cosine", "matched"
    )


def topic_sides(topics: DataFrame, candidate: str = "narrative_base") -> tuple[DataFrame, DataFrame]:
    """Full and sample items (key, item, text) from flattened topics: the posts' topics and a narrative's.

    `topics` has subject_id, source, position and topic, as `reports.flatten_topics` gives them.
    """
    items = topics.select(
        F.col("subject_id").alias("key"), "source", F.col("position").alias("item"), F.col("topic").alias("text")
    )
    return items.where(F.col("source") == "posts").drop("source"), items.where(F.col("source") == candidate).drop("source")


def text_sides(
    posts: DataFrame, reports: DataFrame, narrative: str = "base_analysis"
) -> tuple[DataFrame, DataFrame]:
    """Full and sample items (key, item, text) from posts and one narrative per user; empty ones are left out.

    A narrative is a text, item 0, or a list of texts, numbered by place.
    """
    full = posts.select(F.col("subject_id").alias("key"), F.col("id").alias("item"), "text")
    listed = dict(reports.dtypes)[narrative].startswith("array")
    texts = F.col(narrative) if listed else F.array(narrative)
    sample = reports.select(F.col("subject_id").alias("key"), F.posexplode(texts).alias("item", "text"))
    return full, sample.where(F.length("text") > 0).withColumn("item", F.col("item").cast("bigint"))


def _with_scores(counts: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return counts.select(
        "*",
        F.coalesce(F.try_divide(F.col("tp_sample").cast("double"), F.col("n_sample")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp_full").cast("double"), F.col("n_full")), zero).alias("recall"),
    ).select(
        "*",
        F.coalesce(
            F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            zero,
        ).alias("f1"),
    )


def coverage_metrics(maxima: DataFrame, threshold: float = 0.75, *, key: str = "key") -> DataFrame:
    """Precision, recall and F1 per key at a threshold, from `cosine_maxima`."""
    hit, n = F.col("cosine") >= threshold, F.col("copies")
    full, sample = F.col("side") == "full", F.col("side") == "sample"

    def total(*conditions):
        keep = conditions[0]
        for c in conditions[1:]:
            keep = keep & c
        return F.sum(F.when(keep, n).otherwise(F.lit(0))).cast("bigint")

    return _with_scores(
        maxima.groupBy(key).agg(
            total(full, hit).alias("tp_full"),
            total(sample, hit).alias("tp_sample"),
            total(full).alias("n_full"),
            total(sample).alias("n_sample"),
        )
    ).withColumn("threshold", F.lit(float(threshold)))


def coverage_sensitivity(maxima: DataFrame, *, key: str = "key", steps: int = STEPS) -> DataFrame:
    """The same metrics at thresholds 0, 1/steps, ... 1.

    Maxima are first counted by how many thresholds they reach, so the thresholds multiply at most
    2 * (steps + 2) rows per key.
    """
    grid = F.sequence(F.lit(0), F.lit(steps))
    step = 1.0 / steps
    reached = F.size(F.filter(grid, lambda i: F.col("cosine") >= i * F.lit(step)))
    counted = maxima.groupBy(key, "side", reached.alias("reached")).agg(F.sum("copies").alias("n"))
    full, sample = F.col("side") == "full", F.col("side") == "sample"
    hit = F.col("reached") > F.col("i")

    def total(keep):
        return F.sum(F.when(keep, F.col("n")).otherwise(F.lit(0))).cast("bigint")

    return _with_scores(
        counted.withColumn("i", F.explode(grid))
        .groupBy(key, "i")
        .agg(
            total(full & hit).alias("tp_full"),
            total(sample & hit).alias("tp_sample"),
            total(full).alias("n_full"),
            total(sample).alias("n_sample"),
        )
        .withColumn("threshold", F.col("i") * F.lit(step))
    ).drop("i")


def topic_ground_truth(
    topics: DataFrame, truths: DataFrame, *, keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Nearest ground-truth label of every topic vector; the noise topic -1 maps to ("Outliers", 0).

    `topics` has topic and vector, `truths` item (list position), label and vector, both with `keys`
    if given.  Columns: keys, topic, gt_label, gt_score.
    """
    keys = list(keys)

    # Vectors meet those of the same corpus and length, in the numbered blocks of `cosine_maxima`.
    corpus = F.to_json(F.struct(*keys, F.size("vector").alias("_length")))
    clusters = topics.where("topic <> -1").select(
        *keys, corpus.alias("key"), F.col("topic").cast("bigint").alias("item"), "vector"
    )
    labels = truths.select(corpus.alias("key"), F.col("item").cast("bigint").alias("item"), "label", "vector")
    near = best_match(clusters, labels.select("key", "item", "vector"), 0.0, block=block).select(
        "key", F.col("full_item").alias("topic"), F.col("sample_item").alias("item"), F.col("cosine").alias("gt_score")
    )
    found = near.join(labels.select("key", "item", F.col("label").alias("gt_label")), ["key", "item"])
    named = topics.withColumn("key", corpus).select(*keys, "key", F.col("topic").cast("bigint").alias("topic"))
    noise = F.col("topic") == -1
    return named.join(found, ["key", "topic"], "left").select(
        *keys,
        "topic",
        F.when(noise, F.lit("Outliers")).otherwise(F.col("gt_label")).alias("gt_label"),
        F.when(noise, F.lit(0.0)).otherwise(F.col("gt_score")).alias("gt_score"),
    )
