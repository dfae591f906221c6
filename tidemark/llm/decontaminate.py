"""Benchmark passages in documents, found through a positional inverted index.

The index is a table of postings `term, doc_id, pos`.  Term frequencies over all documents come first;
each benchmark window then probes only its two rarest terms, whose lists are moved by the terms' offsets
and intersected.  What survives are alignments (item, document, shift); for the documents in them, and
only those, postings of every benchmark term are stored, and the item's whole list is intersected along
the alignment.  Runs of matching positions as long as a window are its occurrences.

Words are compared by a 64-bit hash of theirs.  Items and documents without words match nothing, null
texts have no words, rows that repeat an id count as that document's, rows without an id get a result
but are not searched for matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.filters import id_filter, in_filter
from tidemark.llm.tables import in_arrow, texts
from tidemark.plans.lineage import cut

WINDOW = 13
# A list of terms goes to the tasks only up to this number (8 bytes each); without it all postings are stored.
LISTED = 2_000_000


def benchmark_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`item_id, n, pos, term` for every word of every item; items that repeat an id are kept apart by `item`."""

    def rows(batch: pa.RecordBatch):
        for a, b in W.slices(batch["text"]):
            found = W.words(batch["text"].slice(a, b - a), W.LETTERS, True)
            doc = found.doc()
            ids = batch["doc_id"].slice(a, b - a).take(pa.array(doc))
            yield {
                "item": batch["item"].slice(a, b - a).take(pa.array(doc)), "item_id": ids,
                "n": np.diff(found.first)[doc].astype(np.int32),
                "pos": found.place().astype(np.int32), "term": W.signed(W.word_hashes(found)),
            }

    items = texts(benchmark, id_col, text_col).withColumn("item", F.xxhash64("doc_id", "text"))
    return in_arrow(items.distinct(), rows, "item bigint, item_id bigint, n int, pos int, term bigint")


def _listed(df: DataFrame, column: str) -> np.ndarray | None:
    """The distinct values of a column, sorted, if there are few enough to send; else None."""
    found = df.select(column).where(f"{column} IS NOT NULL").distinct().limit(LISTED + 1).toPandas()[column]
    return None if len(found) > LISTED else np.sort(found.to_numpy(np.int64))


def _inside(values: np.ndarray, listed: np.ndarray | None) -> np.ndarray:
    if listed is None:
        return np.ones(len(values), bool)
    if not len(listed):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def term_counts(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """`doc_id, n_words, term, count`: a row per document with its words, and rows per batch with its counts."""
    schema = "doc_id bigint, n_words bigint, term bigint, count bigint"

    def rows(batch: pa.RecordBatch):
        for a, b in W.slices(batch["text"]):
            found = W.words(batch["text"].slice(a, b - a), W.LETTERS, True)
            h = W.word_hashes(found).view(np.int64)
            term, count = np.unique(h[_inside(h, terms)], return_counts=True)
            none = pa.nulls(b - a, pa.int64())
            yield {"doc_id": batch["doc_id"].slice(a, b - a), "n_words": np.diff(found.first), "term": none, "count": none}
            none = pa.nulls(len(term), pa.int64())
            yield {"doc_id": none, "n_words": none, "term": term, "count": count}

    return in_arrow(docs, rows, schema)


def postings(docs: DataFrame, terms: np.ndarray | None, only: np.ndarray | None = None) -> DataFrame:
    """`term, doc_id, pos` of the listed terms, of documents whose id passes the filter of ids, if one is given."""

    def rows(batch: pa.RecordBatch):
        keep = np.array(batch["doc_id"].is_valid())
        if only is not None:
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            keep &= in_filter(only, ids)
        batch = batch.filter(pa.array(keep))
        for a, b in W.slices(batch["text"]) if batch.num_rows else ():
            found = W.words(batch["text"].slice(a, b - a), W.LETTERS, True)
            h = W.word_hashes(found).view(np.int64)
            hit = np.flatnonzero(_inside(h, terms))
            yield {
                "term": h[hit], "doc_id": batch["doc_id"].slice(a, b - a).take(pa.array(found.doc()[hit])),
                "pos": found.place()[hit].astype(np.int32),
            }

    return in_arrow(docs, rows, "term bigint, doc_id bigint, pos int")


def _probes(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """`item, first, off1, term1, off2, term2`: the two rarest places of each window, by count, then place."""
    counted = words.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    length = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - length + 1), F.least(F.col("pos"), F.col("n") - length))
    rank = F.row_number().over(Window.partitionBy("item", "first").orderBy("count", "pos"))
    ranked = (
        counted.select("item", "n", "term", "count", "pos", F.explode(starts).alias("first"))
        .withColumn("rank", rank).where("rank <= 2")
    )
    return ranked.groupBy("item", "first").agg(
        F.min(F.when(F.col("rank") == 1, F.struct("pos", "term"))).alias("one"),
        F.min(F.when(F.col("rank") == 2, F.struct("pos", "term"))).alias("two"),
        F.min("count").alias("least"),
    ).where("least > 0").selectExpr(
        "item", "first", "one.pos AS pos1", "one.term AS term1", "coalesce(two, one).pos AS pos2", "coalesce(two, one).term AS term2"
    )


def phrase_matches(docs: DataFrame, words: DataFrame, counts: DataFrame, terms, window: int = WINDOW) -> DataFrame:
    """`item, item_id, doc_id, shift, pos`: places of documents inside an occurrence of a window of an item.

    `docs` and `words` as `texts` and `benchmark_words` give them; `terms` the listed terms of `words`.
    """
    probes = cut(_probes(words, counts, window), "probes")
    rare = _listed(probes.select(F.explode(F.array("term1", "term2")).alias("term")), "term")
    index = cut(postings(docs, rare), "postings")

    def aligned(k: int) -> DataFrame:
        asked = probes.select("item", "first", F.col(f"pos{k}").alias("at"), F.col(f"term{k}").alias("term"))
        return asked.join(index, "term").select("item", "first", "doc_id", (F.col("pos") - F.col("at")).alias("shift"))

    # One alignment serves all windows of an item that it holds.
    alignments = cut(
        aligned(1).join(aligned(2), ["item", "first", "doc_id", "shift"]).select("item", "doc_id", "shift").distinct(), "alignments"
    )
    full = postings(docs, terms, id_filter(alignments))
    expected = alignments.join(words, "item").select(
        "item", "item_id", "n", "doc_id", "shift", F.col("pos").alias("at"), "term", (F.col("shift") + F.col("pos")).alias("pos")
    )
    matched = expected.join(full, ["doc_id", "pos", "term"]).distinct()
    line = Window.partitionBy("item", "doc_id", "shift")
    runs = matched.withColumn("run", F.col("at") - F.row_number().over(line.orderBy("at")))
    return (
        runs.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("item", "doc_id", "shift", "run")))
        .where(F.col("length") >= F.least(F.lit(window), F.col("n")))
        .select("item", "item_id", "doc_id", "shift", "pos")
    )


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`item_id, doc_id, pos`: places of a phrase's rarest term with all its terms within `slop` places of it.

    Every distinct term of the phrase must stand at most `slop` words before or after that place.
    """
    words = benchmark_words(phrases, id_col, text_col).select("item", "item_id", "term").distinct()
    terms = _listed(words, "term")
    index = cut(postings(texts(docs), terms), "postings")
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    per_item = words.groupBy("item").agg(F.count(F.lit(1)).alias("terms"))
    rarest = (
        words.join(counts, "term").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("count", "term")))
        .where("rank = 1").select("item", "item_id", "term")
    )
    centre = rarest.join(index, "term").select("item", "item_id", "doc_id", F.col("pos").alias("at"))
    # A place asks for the terms in its own and the neighbouring stretches of `slop + 1` words.
    size = slop + 1
    asked = centre.withColumn("stretch", F.explode(F.array(*[F.expr(f"at div {size} + {i}") for i in (-1, 0, 1)])))
    around = words.select("item", "term").join(index, "term").withColumn("stretch", F.expr(f"pos div {size}"))
    return (
        asked.join(around, ["item", "doc_id", "stretch"])
        .where(F.abs(F.col("pos") - F.col("at")) <= F.lit(slop))
        .groupBy("item", "item_id", "doc_id", "at").agg(F.count_distinct("term").alias("found"))
        .join(per_item, "item").where("found = terms").select("item_id", "doc_id", F.col("at").alias("pos")).distinct()
    )


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """`doc_id, n_words, n_hit, items, contaminated` of every document row.

    `n_hit` counts words inside any occurrence of a window of `window` words (an item of fewer is one
    window), `items` lists the ids of items with occurrences, sorted as strings; a document is
    contaminated from one hit in twenty words.
    """
    docs = texts(documents, doc_col, text_col)
    words = cut(benchmark_words(benchmark, item_col, text_col), "benchmark")
    terms = _listed(words, "term")
    counted = cut(term_counts(docs, terms), "term-counts")
    counts = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("count").alias("count"))
    hits = cut(phrase_matches(docs, words, counts, terms, window), "matches")
    places = hits.groupBy("doc_id").agg(F.count_distinct("pos").alias("n_hit"))
    items = (
        hits.where("item_id IS NOT NULL").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = places.join(items, "doc_id", "left")
    none = F.array().cast("array<string>")
    return (
        counted.where("n_words IS NOT NULL").select("doc_id", "n_words").join(found, "doc_id", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )
