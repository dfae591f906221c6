"""The queries of this subpackage over the given tables, and SQL where it can state their results."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.audit_sql import DIVERGENCE_SQL, SECRETS_SQL, SPELLING_SQL
from tidemark.llm.decontaminate import contamination
from tidemark.llm.divergence import divergence
from tidemark.llm.language import languages
from tidemark.llm.lines import dedup_lines
from tidemark.llm.pieces import round_trip
from tidemark.llm.quality import quality
from tidemark.llm.secrets import secret_digest
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.spans import repeats_digest
from tidemark.llm.spelling import corpus_words, spelling_groups
from tidemark.llm.token_counts import token_counts
from tidemark.llm.topk import scaled, top_k
from tidemark.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> Path:
    """A vocabulary file on the driver; its content, never its place, goes to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name))


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").read_text())
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(512))


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model").read_bytes())


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "words", "misspelled", "stems")


# Fixed value: the words that contamination is judged by, of texts with A-Z lowered.
WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL["op2_decontamination"] = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, w[p : p + least(13, len(w)) - 1] AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
windows AS (SELECT doc_id, s.size, unnest(range(1, len(w) - s.size + 2)) AS p, w FROM d, (SELECT DISTINCT size FROM wanted) s
  WHERE len(w) >= s.size),
found AS (SELECT windows.doc_id, windows.p, wanted.size, wanted.item_id FROM windows JOIN wanted
  ON wanted.size = windows.size AND wanted.words = windows.w[windows.p : windows.p + windows.size - 1]),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM found) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_table(spark, sf_dir, "documents"))


@_query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % F.lit(50) == F.lit(0)).drop("looked_up")


SQL["op6_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents"), max_share=None)
    return found.select(
        "doc_id", "n_lines", "n_repeated", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "first_docs"
    )


SQL["op3_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
later AS (SELECT doc_id, p FROM windows JOIN (SELECT words, min(doc_id) AS source FROM windows GROUP BY 1) USING (words) WHERE doc_id > source),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS place FROM later),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words FROM (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@_query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


SQL["op11_secrets"] = SECRETS_SQL


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(corpus_words(_table(spark, sf_dir, "documents")))


SQL["op12_spelling"] = SPELLING_SQL


@_query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


SQL["op13_divergence"] = DIVERGENCE_SQL
