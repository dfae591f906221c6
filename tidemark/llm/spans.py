"""Long runs of words that an earlier document already has, found by windows of the corpus that repeat.

A window is a run of `window` words.  Only windows that can repeat are ever built: of each one run of
ANCHOR words is chosen by its content alone (the smallest hash), so equal windows choose equal anchors,
and a window whose anchor is in one text only is unique.  Equal texts are one text: all windows of a copy
begin in the first document that has it.  What is removed is every word of a window that a smaller document
has; no nodes or branches of a graph are needed for that.

Where words came from is told by `repeated_paths`: each window carries its first place in its source
document, neighbouring windows whose place in the source is equally far from their own are one path, and
so a path ends where the source goes on differently.  The words of both documents are compared over each
path at last.

Words and runs are compared by hashes of theirs, 64 bits for anchors and 128 for windows.  Null texts have
no words; rows that repeat an id count as one document, so nothing is removed for repeating only
there; rows without an id are left whole and are no source for others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.tables import in_arrow, texts
from tidemark.plans.lineage import cut

WINDOW = 50
ANCHOR = 20
SLICE = 2 << 20
WHOLE = (1 << 31) - 1
_SECOND = np.uint64(0x165667B19E3779F9)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """`of` (minimum or maximum) over each run of `width` values."""
    size, y = 1, x
    while 2 * size <= width:
        y = of(y[: len(y) - size], y[size:])
        size *= 2
    n = len(x) - width + 1
    return of(y[:n], y[width - size : width - size + n])


def _smallest(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all anchor-sized runs, the smallest of each window, and which windows lie in one text."""
    k, wide = ANCHOR, window - ANCHOR + 1
    runs = W.window_hashes(h, k)
    runs[doc[: len(runs)] != doc[k - 1 :]] = np.iinfo(np.uint64).max
    least = _sliding(runs, wide, np.minimum)
    return runs, least, doc[: len(least)] == doc[window - 1 :]


def _anchors(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen runs among all words, and their hashes."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide = window - ANCHOR + 1
    runs, least, whole = _smallest(h, doc, window)
    # A run is chosen if it is the smallest of some whole window.
    padded = np.zeros(len(least) + 2 * (wide - 1), np.uint64)
    padded[wide - 1 : wide - 1 + len(least)] = np.where(whole, least, 0)
    chosen = np.flatnonzero(_sliding(padded, wide, np.maximum) == runs)
    return chosen, runs[chosen]


def _words(batch: pa.RecordBatch, a: int, b: int):
    found = W.words(batch["text"].slice(a, b - a), W.VISIBLE, False)
    return found, W.word_hashes(found), found.doc()


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`anchor, copy, doc_id, place` of every chosen run; `copy` is a hash of the whole text."""

    def rows(batch: pa.RecordBatch):
        batch = batch.filter(batch["doc_id"].is_valid())
        for a, b in W.slices(batch["text"], SLICE) if batch.num_rows else ():
            found, h, doc = _words(batch, a, b)
            at, run = _anchors(h, doc, window)
            yield {
                "anchor": W.signed(run), "copy": batch["copy"].slice(a, b - a).take(pa.array(doc[at])),
                "doc_id": batch["doc_id"].slice(a, b - a).take(pa.array(doc[at])),
                "place": (at - found.first[doc[at]]).astype(np.int32),
            }

    return in_arrow(docs.withColumn("copy", F.xxhash64("text")), rows, "anchor bigint, copy bigint, doc_id bigint, place int")


def packed(docs: DataFrame) -> DataFrame:
    """`doc_id, packed`: the texts compressed, to be shuffled."""

    def rows(batch: pa.RecordBatch):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        yield {"doc_id": batch["doc_id"], "packed": pa.array([press(t.encode()) for t in batch["text"].to_pylist()], pa.binary())}

    return in_arrow(docs, rows, "doc_id bigint, packed binary")


def _unpacked(batch: pa.RecordBatch) -> pa.Array:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(x).decode() for x in batch["packed"].to_pylist()], pa.large_string())


def edges(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """`edge, check, doc_id, place` of the windows of `doc_id, packed, places` whose anchor is in `places`."""

    def rows(batch: pa.RecordBatch):
        text, places = _unpacked(batch), batch["places"]
        for a, b in W.slices(text, SLICE):
            found = W.words(text.slice(a, b - a), W.VISIBLE, False)
            h, doc = W.word_hashes(found), found.doc()
            if len(h) < window:
                continue
            runs, least, whole = _smallest(h, doc, window)
            own = places.slice(a, b - a)
            shared = np.zeros(len(runs), bool)
            shared[own.flatten().to_numpy(zero_copy_only=False) + np.repeat(
                found.first[:-1], own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))] = True
            # A window can repeat only if its own smallest run does.
            known = _sliding(np.where(shared, runs, np.iinfo(np.uint64).max), window - ANCHOR + 1, np.minimum)
            start = np.arange(len(least))
            ok = whole & (known == least)
            start = start[ok]
            first, second = W.window_hashes(h, window)[start], W.window_hashes(h, window, _SECOND)[start]
            yield {
                "edge": W.signed(first), "check": W.signed(second),
                "doc_id": batch["doc_id"].slice(a, b - a).take(pa.array(doc[start])),
                "place": (start - found.first[doc[start]]).astype(np.int32),
            }

    return in_arrow(placed, rows, "edge bigint, check bigint, doc_id bigint, place int")


def copies(docs: DataFrame) -> DataFrame:
    """`doc_id, source`: documents whose whole text the smaller document `source` has."""
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.md5("text").alias("content"))
    first = cut(
        named.groupBy("content").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high")).where("source < high").drop("high"),
        "first-copies",
    )
    return named.join(first, "content").where("doc_id > source").select("doc_id", "source").distinct()


def repeated_windows(docs: DataFrame, texts_packed: DataFrame, copied: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All windows that may repeat, and `edge, check, doc_id, place, source`: those that begin in a smaller document.

    `source` is the smallest document that holds the window.  Documents of `copied` have no windows.
    """
    found = anchors(docs, window)
    shared = cut(
        found.groupBy("anchor").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).where("low < high").select("anchor"),
        "anchors",
    )
    places = found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    graph = cut(edges(texts_packed.join(places.join(copied, "doc_id", "left_anti"), "doc_id"), window), "edges")
    first = cut(
        graph.groupBy("edge", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high"))
        .where("source < high").drop("high"),
        "sources",
    )
    later = graph.join(first, ["edge", "check"]).where("doc_id > source")
    return graph, later.select("edge", "check", "doc_id", "place", "source")


def paths(later: DataFrame) -> DataFrame:
    """`doc_id, start, n_windows, source`: runs of neighbouring windows with one source.

    A place that rows of a repeated id name twice counts once.
    """
    order = Window.partitionBy("doc_id").orderBy("place")
    step = (F.col("place") - F.lag("place").over(order) > 1) | (F.lag("source").over(order) != F.col("source"))
    return (
        later.withColumn("path", F.sum(F.coalesce(step, F.lit(True)).cast("int")).over(order))
        .groupBy("doc_id", "path", "source")
        .agg(F.min("place").alias("start"), (F.max("place") - F.min("place") + 1).cast("bigint").alias("n_windows"))
        .select("doc_id", "start", "n_windows", "source")
    )


def aligned(placed: DataFrame) -> DataFrame:
    """`doc_id, start, n_windows, source, source_start` of `doc_id, place, source, source_place`: runs equally far from their source."""
    shifted = placed.withColumn("shift", F.col("place") - F.col("source_place")).distinct()
    same = ["doc_id", "source", "shift"]
    order = Window.partitionBy(*same).orderBy("place")
    step = F.coalesce(F.col("place") - F.lag("place").over(order) > 1, F.lit(True))
    return (
        shifted.withColumn("path", F.sum(step.cast("int")).over(order)).groupBy(*same, "path")
        .agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n_windows"), F.min("source_place").alias("source_start"))
        .select("doc_id", "start", "n_windows", "source", "source_start")
    )


def confirmed(found: DataFrame, texts_packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `aligned` over which document and source have the same words."""
    lists = found.groupBy("doc_id", "source").agg(F.collect_list(F.struct("start", "n_windows", "source_start")).alias("paths"))
    source = texts_packed.select(F.col("doc_id").alias("source"), F.col("packed").alias("source_packed"))

    def words_of(text: pa.Array) -> list[bytes]:
        of = W.words(text, W.VISIBLE, False)
        raw = of.data.tobytes()
        return [raw[a:b] for a, b in zip(of.start.tolist(), of.end.tolist(), strict=True)]

    def rows(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            own = words_of(_unpacked(row))
            other = words_of(_unpacked(pa.RecordBatch.from_arrays([row["source_packed"]], ["packed"])))
            ok = []
            for x in row["paths"][0].as_py():
                size = x["n_windows"] + window - 1
                a, b = own[x["start"] : x["start"] + size], other[x["source_start"] : x["source_start"] + size]
                if len(a) == size and a == b:
                    ok.append(x)
            if ok:
                yield {
                    "doc_id": pa.array([row["doc_id"][0].as_py()] * len(ok), pa.int64()),
                    "start": pa.array([x["start"] for x in ok], pa.int32()), "n_windows": pa.array([x["n_windows"] for x in ok], pa.int64()),
                    "source": pa.array([row["source"][0].as_py()] * len(ok), pa.int64()),
                    "source_start": pa.array([x["source_start"] for x in ok], pa.int32()),
                }

    # Rows that repeat an id may have different texts: one that has the words is enough.
    both = lists.join(texts_packed, "doc_id").join(source, "source")
    return in_arrow(both, rows, "doc_id bigint, start int, n_windows bigint, source bigint, source_start int").distinct()


def repeated_paths(documents: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, start, n_windows, source, source_start`: where documents repeat `source` and where in it the words stand.

    Every path has its words at `source_start`; a passage that the source has more than once is told by its
    first place there.  A copy of a whole document has no number of windows, and begins at 0 in both.
    """
    docs = texts(documents, doc_col, text_col)
    copied = cut(copies(docs), "copies")
    small = cut(packed(docs), "packed")
    graph, later = repeated_windows(docs, small, copied, window)
    later = cut(later, "later")
    wanted = later.select("edge", "check", "source").distinct()
    origin = cut(
        graph.select("edge", "check", F.col("doc_id").alias("source"), "place").join(wanted, ["edge", "check", "source"], "left_semi")
        .groupBy("edge", "check", "source").agg(F.min("place").alias("source_place")), "origins"
    )
    found = aligned(later.join(origin, ["edge", "check", "source"]).select("doc_id", "place", "source", "source_place"))
    whole = copied.select("doc_id", F.lit(0).alias("start"), F.lit(None).cast("bigint").alias("n_windows"), "source", F.lit(0).alias("source_start"))
    return confirmed(found, small, window).unionByName(whole)


def without_repeats(documents: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, n_removed, kept` of every document row; `kept` is the words left, joined by one space."""
    return _applied(documents, window, doc_col, text_col, False)


def repeats_digest(documents: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256`: as `without_repeats`, the text as its digest."""
    return _applied(documents, window, doc_col, text_col, True)


def _applied(documents: DataFrame, window: int, doc_col: str, text_col: str, digest: bool) -> DataFrame:
    docs = texts(documents, doc_col, text_col)
    small = packed(docs)
    copied = cut(copies(docs), "copies")
    _, later = repeated_windows(docs, small, copied, window)
    end = (F.col("start") + F.col("n_windows") + F.lit(window - 1)).cast("int").alias("end")
    whole = copied.select("doc_id", F.lit(0).alias("start"), F.lit(WHOLE).alias("end"))
    ranges = (
        paths(later).select("doc_id", "start", end).unionByName(whole)
        .groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    )
    name = "kept_sha256" if digest else "kept"

    def rows(batch: pa.RecordBatch):
        text = _unpacked(batch)
        starts, ends = batch["starts"].to_pylist(), batch["ends"].to_pylist()
        for a, b in W.slices(text, SLICE):
            found = W.words(text.slice(a, b - a), W.VISIBLE, False)
            raw, s, e = found.data.tobytes(), found.start.tolist(), found.end.tolist()
            kept, removed = [], []
            for i in range(a, b):
                low, high = int(found.first[i - a]), int(found.first[i - a + 1])
                keep = np.ones(high - low, bool)
                for x, y in zip(starts[i] or (), ends[i] or (), strict=True) if high - low >= window else ():
                    keep[x:y] = False
                removed.append(int((~keep).sum()))
                places = range(low, high) if not removed[-1] else (np.flatnonzero(keep) + low).tolist()
                left = b" ".join([raw[s[p] : e[p]] for p in places])
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield {
                "doc_id": batch["doc_id"].slice(a, b - a), "n_words": np.diff(found.first), "n_removed": np.array(removed, np.int64),
                name: pa.array(kept, pa.string()),
            }

    return in_arrow(small.join(ranges, "doc_id", "left"), rows, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")
