"""Quality of documents by Naive Bayes support vectors.

A text becomes indicators of its n-grams: runs of four bytes, words, and runs of three word shapes
(case, kind of first and last character, length, whether the word repeats the one before).  Each is
scaled by the logarithm of how much more often it stands in texts of one class, and a linear hinge-loss
model is fitted on the scaled indicators; its margin is scaled to a probability.  All of it learns from
a bounded sample of labelled rows: about `count_rows` give the counts, about `fit_rows` of them the model.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.linear import balanced, hinge, logistic, probability
from tidemark.llm.tables import held_out, in_arrow, sample, texts
from tidemark.plans.lineage import cut

BUCKETS = 1 << 16
COUNT_ROWS, FIT_ROWS = 24_000, 8_000
# A group of texts has at most this many rows and, but for a single longer text, this many bytes.
GROUP_ROWS, GROUP_BYTES = 128, 1 << 20
STRETCH = 1 << 20


class Model(NamedTuple):
    ratio: np.ndarray  # the log-count ratio of each bucket
    weight: np.ndarray
    bias: float
    scale: np.ndarray


def _kind(c: np.ndarray) -> np.ndarray:
    """0 lower-case letter, 1 upper-case letter, 2 digit, 3 other ASCII, 4 beyond ASCII."""
    out = np.full(len(c), 3, np.int64)
    out[(c >= 0x61) & (c <= 0x7A)] = 0
    out[(c >= 0x41) & (c <= 0x5A)] = 1
    out[(c >= 0x30) & (c <= 0x39)] = 2
    out[c >= 0x80] = 4
    return out


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (W.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(48)).astype(np.int64)


def features(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and the buckets that each text has, every pair once, sorted."""
    found = W.words(rows, W.VISIBLE, False)
    data, offsets = W.bytes_of(rows)
    seen = np.zeros(len(rows) * BUCKETS, bool)
    for low in range(0, len(data) - 3, STRETCH):
        # Stretches of a long text overlap by what a run of four bytes needs.
        wide = data[low : low + STRETCH + 3].astype(np.uint64)
        runs = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
        text = np.repeat(np.arange(len(rows)), np.diff(np.clip(offsets, low, low + len(wide))))
        inside = text[:-3] == text[3:]
        seen[(text[:-3] * BUCKETS + _bucket(runs, 1))[inside]] = True
    if len(found.start):
        h, text = W.word_hashes(found), found.doc()
        seen[text * BUCKETS + _bucket(h, 2)] = True
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        size = np.minimum(np.log2(found.end - found.start).astype(np.int64), 5)
        upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
        loud = (upper[found.end] - upper[found.start]) * 2 > found.end - found.start
        shape = (((_kind(data[found.start]) * 5 + _kind(data[found.end - 1])) * 6 + size) * 2 + loud) * 2 + again
        if len(h) >= 3:
            runs = (shape[:-2] * 1024 + shape[1:-1]) * 1024 + shape[2:]
            same = text[:-2] == text[2:]
            seen[(text[:-2] * BUCKETS + _bucket(runs.astype(np.uint64), 3))[same]] = True
    flat = np.flatnonzero(seen)
    return flat // BUCKETS, flat % BUCKETS


def groups(rows: pa.Array):
    """Ranges of rows that `features` can take together."""
    for a, b in W.slices(rows, GROUP_BYTES):
        for k in range(a, b, GROUP_ROWS):
            yield k, min(b, k + GROUP_ROWS)


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """How many texts of either class have each bucket, and how many texts there are."""
    rows = labelled.select("text", "label")

    def run(batches):
        counts, total = np.zeros((2, BUCKETS + 1), np.int64), 0
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            for a, b in groups(batch["text"]):
                text, bucket = features(batch["text"].slice(a, b - a))
                for k in (0, 1):
                    counts[k, :-1] += np.bincount(bucket[label[a:b][text] == k], minlength=BUCKETS)
                    counts[k, -1] += int((label[a:b] == k).sum())
            total += batch.num_rows
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "n0", "n1"])

    summed = rows.mapInArrow(run, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    if len(summed):
        out[:, summed["bucket"].to_numpy()] = summed[["n0", "n1"]].to_numpy().T
    return out[0, :-1], out[1, :-1], int(out[0, -1]), int(out[1, -1])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from `doc_id, text, label` (0 or 1), a bounded table; without both classes it knows only their share."""
    n0, n1, rows0, rows1 = class_counts(labelled)
    share = (rows1 + 1) / (rows0 + rows1 + 2)
    if not rows0 or not rows1:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, np.array([0.0, float(np.log(share / (1 - share)))]))
    ratio = np.log((n1 + 1) / (n1 + 1).sum()) - np.log((n0 + 1) / (n0 + 1).sum())

    def pack(batch: pa.RecordBatch):
        for a, b in groups(batch["text"]):
            text, bucket = features(batch["text"].slice(a, b - a))
            edge = np.searchsorted(text, np.arange(b - a + 1)).tolist()
            raw = bucket.astype("<u2").tobytes()
            yield {"label": batch["label"].slice(a, b - a), "buckets": pa.array([raw[2 * x : 2 * y] for x, y in zip(edge, edge[1:], strict=False)], pa.binary())}

    chosen = sample(labelled, "doc_id", fit_rows, F.lit(rows0 + rows1), "fit")
    packed = in_arrow(chosen.select("text", "label"), pack, "label int, buckets binary").toArrow()
    rows = []
    for raw in packed["buckets"].to_pylist():
        at = np.frombuffer(raw, "<u2").astype(np.int64)
        value = ratio[at]
        rows.append((at, value / max(1e-9, float(np.sqrt(value @ value)))))
    label = packed["label"].to_numpy()
    y = np.where(label > 0, 1.0, -1.0)
    w = hinge(rows, y, BUCKETS, balanced(y))
    margin = np.array([float(value @ w[at]) for at, value in rows]) + w[-1]
    return Model(ratio, w[:-1], float(w[-1]), logistic(margin[:, None], (y > 0).astype(float)))


def score(df: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every row of `doc_id, text`: the probability of label 1."""
    product, square = model.ratio * model.weight, model.ratio * model.ratio

    def rows(batch: pa.RecordBatch):
        for a, b in groups(batch["text"]):
            text, bucket = features(batch["text"].slice(a, b - a))
            total = np.bincount(text, product[bucket], b - a)
            norm = np.sqrt(np.bincount(text, square[bucket], b - a))
            margin = total / np.maximum(norm, 1e-9) + model.bias
            yield {"doc_id": batch["doc_id"].slice(a, b - a), "score": probability(margin * model.scale[0] + model.scale[1])}

    return in_arrow(df, rows, "doc_id bigint, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """`doc_id, text, label` of about `rows` of the rows that may be learned from; the largest label of an id counts.

    Both sides are sampled before they meet, so that few texts are shuffled however many there are.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("label IN (0, 1)").where(~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = F.lit(known.count())
    return sample(docs, "doc_id", rows, total).join(sample(known, "doc_id", rows, total), "doc_id")


def quality(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0,
    count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS,
    doc_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every document row; null texts are scored as empty ones."""
    docs = texts(documents, doc_col, text_col)
    model = fit(cut(labelled_sample(docs, labels, label_col, folds, fold, count_rows), "labelled"), fit_rows)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        F.when(F.col("score") >= F.lit(threshold), 1).otherwise(0).alias("predicted"),
    )
