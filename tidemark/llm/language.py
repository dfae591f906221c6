"""Language of documents in two steps: first its family, then the language within the family.

A text is the square roots of its counts of byte trigrams, letters lower-cased and everything else a
space, scaled to length one.  The family is chosen by one-versus-rest linear support vector machines, the
language by one machine for each two languages of the family, learned from the rows of those two only: each
machine has a vote, and equal votes are told apart by the sum of margins.  A family of one language needs no
second step.  They learn from a bounded sample of each language's rows: `fit_rows` a language, fewer if all
would be more than ROWS rows or FIT_BYTES bytes as packed, but always some FEWEST rows; no language is left out.

Null and empty texts, and texts without a letter, are `und` with score 0.  Rows without an id are predicted and
never learned from; rows that repeat an id are predicted each.  An empty table gives no rows, and without any
known language every text is `und`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.linear import balanced, hinge, probability
from tidemark.llm.tables import held_out, in_arrow, texts

# Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "pl", "cs", "sk"),
    "indic": ("hi", "mr", "ne", "bn", "as", "gu", "pa"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk"),
    "malayic": ("id", "ms", "jv", "su"),
}
BUCKETS = 1 << 14
FIT_ROWS = 1_200
ROWS = 24_000
FEWEST = 8
FIT_BYTES = 256 << 20
GROUP_ROWS, GROUP_BYTES = 256, 1 << 20
STRETCH = 2 << 20
SHARP = 4.0

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


class Step(NamedTuple):
    names: list[str]
    weight: np.ndarray  # a column for each name
    bias: np.ndarray


class Duels(NamedTuple):
    names: list[str]
    pairs: np.ndarray  # two places in names for each machine, the first one is for margins above 0
    weight: np.ndarray  # a column for each machine
    bias: np.ndarray


def counts(rows: pa.Array) -> np.ndarray:
    """A row of scaled trigram counts for each text."""
    data, offsets = W.bytes_of(rows)
    total = np.zeros(len(rows) * BUCKETS)
    for low in range(0, len(data) - 2, STRETCH):
        # Stretches of a long text overlap by what a run of three bytes needs.
        c = _FOLD[data[low : low + STRETCH + 2]].astype(np.uint32)
        runs = c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)
        bucket = (runs * np.uint32(2654435761)) >> np.uint32(18)
        text = np.repeat(np.arange(len(rows)), np.diff(np.clip(offsets, low, low + len(c))))
        # Runs of spaces tell nothing about a language.
        use = (text[:-2] == text[2:]) & ((c[:-2] != 0x20) | (c[1:-1] != 0x20)) & ((c[1:-1] != 0x20) | (c[2:] != 0x20))
        total += np.bincount((text[:-2] * BUCKETS + bucket)[use], minlength=len(total))
    out = np.sqrt(total).reshape(len(rows), BUCKETS).astype(np.float32)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def groups(rows: pa.Array):
    for a, b in W.slices(rows, GROUP_BYTES):
        for k in range(a, b, GROUP_ROWS):
            yield k, min(b, k + GROUP_ROWS)


def family_of(language: str) -> str:
    return next((family for family, members in FAMILIES.items() if language in members), language)


def _one_versus_rest(rows, names: list[str], wanted: list[str]) -> Step:
    weight, bias = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    found = np.array(wanted)
    if len(names) > 1:
        for k, name in enumerate(names):
            y = np.where(found == name, 1.0, -1.0)
            w = hinge(rows, y, BUCKETS, balanced(y, 4.0))
            weight[:, k], bias[k] = w[:-1], w[-1]
    return Step(names, weight.astype(np.float32), bias)


def _one_versus_one(rows, names: list[str], wanted: list[str]) -> Duels:
    pairs = np.array([(a, b) for a in range(len(names)) for b in range(a + 1, len(names))], np.int64).reshape(-1, 2)
    weight, bias = np.zeros((BUCKETS, len(pairs)), np.float32), np.zeros(len(pairs))
    found = np.array(wanted)
    for k, (a, b) in enumerate(pairs.tolist()):
        own = np.flatnonzero((found == names[a]) | (found == names[b]))
        y = np.where(found[own] == names[a], 1.0, -1.0)
        w = hinge([rows[i] for i in own.tolist()], y, BUCKETS, balanced(y, 4.0))
        weight[:, k], bias[k] = w[:-1], w[-1]
    return Duels(names, pairs, weight, bias)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Step, dict[str, Duels]]:
    """Both steps from `doc_id, text, lang`; rows without a language or a letter teach nothing."""
    known = docs.where("lang IS NOT NULL").where(F.col("text").rlike("\\p{L}"))
    # A row takes up to six bytes for each of its trigrams, or for each bucket.
    size = F.sum(F.least(F.octet_length("text"), F.lit(BUCKETS)).cast("bigint") * 6)
    totals = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), size.alias("size")).orderBy(F.desc("n"), "lang").collect()
    if not totals:
        return Step([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)), {}
    each, room = min(fit_rows, ROWS // len(totals)), FIT_BYTES / len(totals)
    wanted = {row["lang"]: max(FEWEST / row["n"], min(each / row["n"], room / row["size"])) for row in totals}
    shares = F.create_map(*[F.lit(x) for lang, share in wanted.items() for x in (lang, min(1.0, share))])
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share)

    def pack(batch: pa.RecordBatch):
        for a, b in groups(batch["text"]):
            x = counts(batch["text"].slice(a, b - a))
            at = [np.flatnonzero(row) for row in x]
            yield {
                "lang": batch["lang"].slice(a, b - a),
                "places": pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()),
                "counts": pa.array([row[i].astype("<f4").tobytes() for row, i in zip(x, at, strict=True)], pa.binary()),
            }

    packed = in_arrow(chosen.select("text", "lang"), pack, "lang string, places binary, counts binary").toArrow()
    rows = [
        (np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(value, "<f4").astype(np.float64))
        for at, value in zip(packed["places"].to_pylist(), packed["counts"].to_pylist(), strict=True)
    ]
    languages = packed["lang"].to_pylist()
    families = [family_of(x) for x in languages]
    first = _one_versus_rest(rows, sorted(set(families)), families)
    second = {}
    for family in first.names:
        own = [i for i, f in enumerate(families) if f == family]
        names = sorted({languages[i] for i in own})
        second[family] = _one_versus_one([rows[i] for i in own], names, [languages[i] for i in own])
    return first, second


def _choose(step: Step, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best name of each row and its share of the names' probabilities."""
    if len(step.names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    p = probability((x @ step.weight + step.bias) * SHARP)
    best = p.argmax(1)
    return best, p[np.arange(len(x)), best] / p.sum(1)


def _vote(duels: Duels, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of each row with most votes, and its mean probability against the others."""
    if len(duels.names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    margin = (x @ duels.weight + duels.bias).astype(np.float64)
    n = len(duels.names)
    votes, sums, sure = np.zeros((len(x), n)), np.zeros((len(x), n)), np.zeros((len(x), n))
    for (a, b), m in zip(duels.pairs.tolist(), margin.T, strict=True):
        votes[:, a] += m >= 0
        votes[:, b] += m < 0
        sums[:, a] += m
        sums[:, b] -= m
        p = probability(m * SHARP)
        sure[:, a] += p
        sure[:, b] += 1 - p
    best = np.where(votes == votes.max(1, keepdims=True), sums, -np.inf).argmax(1)
    return best, sure[np.arange(len(x)), best] / (n - 1)


def predict(docs: DataFrame, model: tuple[Step, dict[str, Duels]]) -> DataFrame:
    """`doc_id, lang_pred, score` of every row of `doc_id, text`."""
    first, second = model

    def rows(batch: pa.RecordBatch):
        for a, b in groups(batch["text"]):
            x = counts(batch["text"].slice(a, b - a))
            name, score = np.full(b - a, "und", object), np.zeros(b - a)
            if first.names:
                family, sure = _choose(first, x)
                for k, own in enumerate(first.names):
                    here = np.flatnonzero(family == k)
                    if len(here):
                        best, part = _vote(second[own], x[here])
                        name[here] = np.array(second[own].names, object)[best]
                        score[here] = sure[here] * part
            letters = batch["letters"].slice(a, b - a).to_numpy(zero_copy_only=False)
            name[~letters], score[~letters] = "und", 0.0
            yield {"doc_id": batch["doc_id"].slice(a, b - a), "lang_pred": pa.array(name, pa.string()), "score": score}

    return in_arrow(docs.withColumn("letters", F.col("text").rlike("\\p{L}")), rows, "doc_id bigint, lang_pred string, score double")


def languages(
    documents: DataFrame, folds: int = 3, fold: int = 1, fit_rows: int = FIT_ROWS,
    doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row; `und` with score 0 where a text has no letter."""
    taught = documents.select(
        F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(~held_out(F.col(doc_col).cast("bigint"), folds, fold))
    model = fit(taught, fit_rows)
    return predict(texts(documents, doc_col, text_col), model).select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score"
    )
