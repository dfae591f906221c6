"""A training corpus from `documents`, stage by stage; every stage is written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return
the columns of `docs`; `n_chars` follows the text where a stage changes it.  Rows without an id pass every stage
that decides by id, and rows that repeat an id share its fate.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark
from tidemark.llm import lines, pieces, simhash, toxicity
from tidemark.llm.decontaminate import contamination
from tidemark.llm.queries import vocabulary
from tidemark.plans.lineage import cut

# Executors may not have this folder on their path: functions travel with the tasks.
cloudpickle.register_pickle_by_value(tidemark)

MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity operator rejects."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def _without_lines(docs: DataFrame, spare_copies: bool) -> DataFrame:
    """`docs` without repeated lines but for their first occurrences, and `_doc`, null where nothing is removed."""
    found = lines.removals(lines.texts(docs), None, spare_copies)
    gone = found.where(F.size("removed") > 0).select(F.col("doc_id").alias("_doc"), "removed", (F.size("removed") == F.col("n_lines")).alias("_all"))
    met = docs.join(gone, F.col("doc_id") == F.col("_doc"), "left")
    text = F.when(F.col("_doc").isNotNull(), lines.without_lines(F.col("text"), F.col("removed"))).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_doc").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return met.withColumns(changed)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines, but for their first occurrences, in documents that are no copies line by line."""
    return _without_lines(docs, True).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest id, and no line twice.

    A copy that the stage before spared stays clear of its first document's fingerprint if that one lost
    lines; so lines are compared once more, and a document that has none of its own is gone.
    """
    left = cut(_without(docs, simhash.near_duplicates(docs).where("doc_id <> component_id")), "near-kept")
    return _without_lines(left, False).where("NOT coalesce(_all, false)").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages."""
    return _without(docs, contamination(docs, _table(spark, sf_dir, "benchmark")).where("contaminated"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, ids, n_tokens, same`: every document encoded, and whether decoding gives it back."""
    return pieces.encode(docs, vocabulary(MODEL).read_bytes())


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", line_dedup),
    ("simhash", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", sentence_pieces),
]

# No SQL states the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
