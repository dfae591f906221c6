"""Topics over documents, with the source as topic, and cleaning of their texts."""

from pyspark.sql import functions as F

from registry.base import every, query, r6, table
from tidemark.functions import text as tx
from tidemark.functions.stopwords import ENGLISH
from tidemark.operators import clean, topics

# Documents hold no links, so both engines append the same ones.
LINKED_SQL = """linked AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' see [the page](http://a.example/x) or http://b.example/y?z=1'
  WHEN doc_id % 3 = 1 THEN E'\\r\\n[a](b)[c](d) https://c.example/end' ELSE '' END AS text FROM documents)"""
CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '\[(.*?)\]\(.*?\)', '\1', 'g'),
  'http\S+', '', 'g'))"""


def linked(spark, d):
    tail = (
        F.when(F.col("doc_id") % 3 == 0, F.lit(" see [the page](http://a.example/x) or http://b.example/y?z=1"))
        .when(F.col("doc_id") % 3 == 1, F.lit("\r\n[a](b)[c](d) https://c.example/end"))
        .otherwise(F.lit(""))
    )
    return table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def documents(spark, d):
    """Documents as posts, with the source number as topic."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.replace("source", F.lit("src"), F.lit("")).cast("bigint").alias("topic"), "lang", "text"
    )


DOCS_SQL = "docs AS (SELECT doc_id AS id, CAST(replace(source, 'src', '') AS BIGINT) AS topic, lang, text FROM documents)"


@query("clean_text", f"WITH {LINKED_SQL} SELECT doc_id, {CLEAN_SQL} AS text FROM linked")
def clean_text(spark, d):
    return linked(spark, d).select("doc_id", tx.clean_text("text").alias("text"))


@query(
    "filter_nonempty",
    f"""WITH only_links AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, 'http://only.example/' || doc_id FROM documents)
    SELECT doc_id, text FROM (SELECT doc_id, {CLEAN_SQL} AS text FROM only_links) WHERE length(text) > 0""",
)
def filter_nonempty(spark, d):
    # Beside every document a bare link, which cleaning empties.
    docs = table(spark, d, "documents").select("doc_id", "text")
    raw = docs.unionAll(docs.select("doc_id", F.concat(F.lit("http://only.example/"), F.col("doc_id").cast("string"))))
    return clean.filter_nonempty(raw.select("doc_id", tx.clean_text("text").alias("text")))


@query(
    "normalise_subject",
    "SELECT doc_id, replace('subject' || doc_id, 'subject', '') AS subject_id FROM documents",
)
def normalise_subject(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.normalise_subject(F.concat(F.lit("subject"), F.col("doc_id").cast("string"))).alias("subject_id")
    )


@query(
    "chunk_from_path",
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'data/Chunk' || (doc_id % 11) || '/' || source || '.zip'
      WHEN 1 THEN 'data/chunk_' || source WHEN 2 THEN 'data/' || source || '-CHUNK' || doc_id ELSE url_free END AS path
      FROM (SELECT *, 'data/' || lang AS url_free FROM documents))
    SELECT doc_id, coalesce(nullif(regexp_extract(path, '(?i)chunk(\\d+)', 1), ''), 'Unknown') AS chunk FROM p""",
)
def chunk_from_path(spark, d):
    path = F.expr(
        """CASE doc_id % 4 WHEN 0 THEN concat('data/Chunk', doc_id % 11, '/', source, '.zip')
        WHEN 1 THEN concat('data/chunk_', source) WHEN 2 THEN concat('data/', source, '-CHUNK', doc_id)
        ELSE concat('data/', lang) END"""
    )
    return table(spark, d, "documents").select("doc_id", tx.chunk_from_path(path).alias("chunk"))


@query(
    "word_count",
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INTEGER) AS words FROM documents",
)
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count("text").alias("words"))


@query(
    "preview_text",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shortened,
    left(text, 100) || '...' AS dotted FROM documents""",
)
def preview_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.preview("text").alias("shortened"), tx.preview("text", always_dots=True).alias("dotted")
    )


@query(
    "label_left_join",
    """SELECT d.doc_id AS subject_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def label_left_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("subject_id"), "lang")
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "subject_id")
    return clean.label_left_join(docs, labels)


STOPS = ", ".join(f"'{w}'" for w in ENGLISH)
TERMS_SQL = f"""WITH {DOCS_SQL}, terms AS (SELECT id, topic, lang, term FROM (
  SELECT id, topic, lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs)
  WHERE term NOT IN ({STOPS})),
counts AS MATERIALIZED (SELECT topic, term, count(*) AS n FROM terms GROUP BY 1, 2),
totals AS MATERIALIZED (SELECT *, CAST(sum(n) OVER (PARTITION BY topic) AS BIGINT) AS topic_total,
  CAST(sum(n) OVER (PARTITION BY term) AS BIGINT) AS term_total FROM counts),
scores AS MATERIALIZED (SELECT *, (n / topic_total) * ln((SELECT count(*) FROM docs) / term_total) AS score FROM totals),
ranked AS MATERIALIZED (SELECT topic, term, score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, term) AS rank FROM scores)
"""


@query("tokenize", TERMS_SQL + "SELECT id, term, count(*) AS n FROM terms GROUP BY 1, 2")
def tokenize(spark, d):
    return topics.tokenize(documents(spark, d)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("topic_term_counts", TERMS_SQL + "SELECT topic, term, n, topic_total, term_total FROM totals")
def topic_term_counts(spark, d):
    return topics.topic_term_counts(documents(spark, d))


@query("topic_term_counts_in_slices", TERMS_SQL + "SELECT topic, term, n, topic_total, term_total FROM totals")
def topic_term_counts_in_slices(spark, d):
    """As `topic_term_counts`, with every topic and frequent term joined in slices as if it were hot."""
    return topics.topic_term_counts(documents(spark, d), min_rows=1)


@query("ctfidf", TERMS_SQL + "SELECT topic, term, n, round(score, 6) AS score FROM scores")
def ctfidf(spark, d):
    return topics.ctfidf(documents(spark, d)).select("topic", "term", "n", r6("score"))


def scored(spark, d):
    return topics.ctfidf(documents(spark, d)).withColumn("score", F.round("score", 12))


@query("topic_keywords", TERMS_SQL + "SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def topic_keywords(spark, d):
    return topics.topic_keywords(scored(spark, d)).select("topic", "rank", "term", r6("score"))


INFO_SQL = TERMS_SQL + """, info AS (SELECT topic, any_value(c) AS count, list(term ORDER BY rank) AS representation FROM ranked
  JOIN (SELECT topic, count(*) AS c FROM docs GROUP BY 1) USING (topic) WHERE rank <= 10 GROUP BY topic),
named AS (SELECT *, concat_ws('_', topic, representation[1], representation[2], representation[3]) AS name FROM info)
"""


@query("topic_info", INFO_SQL + "SELECT topic, count, name, array_to_string(representation, ' ') AS words, name AS custom_name FROM named")
def topic_info(spark, d):
    return topics.topic_info(documents(spark, d)).select(
        "topic", "count", "name", F.array_join("representation", " ").alias("words"), "custom_name"
    )


@query("topic_words", INFO_SQL + "SELECT topic, array_to_string(representation[1:3], ' ') AS words FROM named")
def topic_words(spark, d):
    return topics.topic_info(documents(spark, d)).select("topic", tx.topic_words("name").alias("words"))


@query(
    "topic_info_by_language",
    f"""WITH {DOCS_SQL}, terms AS (SELECT lang, topic, term FROM (
      SELECT lang, topic, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs)
      WHERE term NOT IN ({STOPS})),
    counts AS (SELECT lang, topic, term, count(*) AS n FROM terms GROUP BY ALL),
    totals AS (SELECT *, sum(n) OVER (PARTITION BY lang, topic) AS wt, sum(n) OVER (PARTITION BY lang, term) AS tt FROM counts),
    scores AS (SELECT t.*, (n / wt) * ln(p / tt) AS score FROM totals t JOIN (SELECT lang, count(*) AS p FROM docs GROUP BY 1) USING (lang))
    SELECT lang, topic, term, n, round(score, 6) AS score FROM scores""",
)
def topic_info_by_language(spark, d):
    return topics.ctfidf(documents(spark, d), by=["lang"]).select("lang", "topic", "term", "n", r6("score"))


@query("topic_sizes", f"WITH {DOCS_SQL} SELECT topic, count(*) AS count FROM docs GROUP BY 1 ORDER BY 2 DESC, 1")
def topic_sizes(spark, d):
    return topics.topic_sizes(documents(spark, d))


def points(spark, d):
    """Vectors as points of the scatter plot; label 0 plays the noise topic."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        every("embedding", 2, 0).alias("x"),
        every("embedding", 2, 1).alias("y"),
        (F.col("label") - 1).cast("bigint").alias("topic"),
    )


POINTS_SQL = """doubles AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
points AS (SELECT vec_id AS id, list_sum(list_filter(v, lambda x, i: i % 2 = 1)) AS x, list_sum(list_filter(v, lambda x, i: i % 2 = 0)) AS y,
  CAST(label - 1 AS BIGINT) AS topic FROM doubles)"""


@query(
    "topic_centroids",
    f"WITH {POINTS_SQL} SELECT topic, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM points WHERE topic <> -1 GROUP BY 1",
)
def topic_centroids(spark, d):
    return topics.topic_centroids(points(spark, d)).select("topic", r6("x"), r6("y"))


LABEL_INFO_SQL = ", info AS (SELECT topic, topic || '_n' || count(*) AS name FROM points GROUP BY 1)"


def label_info(p):
    return (
        p.groupBy("topic")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("topic", F.concat(F.col("topic").cast("string"), F.lit("_n"), F.col("n").cast("string")).alias("name"))
    )


@query(
    "topic_label_lookup",
    f"""WITH {POINTS_SQL}{LABEL_INFO_SQL} SELECT id, topic, coalesce(topic || ': ' || name, CAST(topic AS VARCHAR)) AS topic_label
    FROM points LEFT JOIN info USING (topic) WHERE topic <> -1""",
)
def topic_label_lookup(spark, d):
    p = points(spark, d)
    return topics.topic_label_lookup(p, label_info(p)).select("id", "topic", "topic_label")


@query(
    "topic_label_truth",
    f"""WITH {POINTS_SQL}, truth AS (SELECT topic, 'truth ' || topic AS gt_label, avg(x * x) AS gt_score FROM points GROUP BY 1)
    SELECT id, topic, topic || ': ' || gt_label || ' (' || format('{{:.2f}}', gt_score) || ')' AS topic_label
    FROM points JOIN truth USING (topic) WHERE topic <> -1""",
)
def topic_label_truth(spark, d):
    p = points(spark, d)
    truth = p.groupBy("topic").agg(F.avg(F.col("x") * F.col("x")).alias("gt_score")).select(
        "topic", F.concat(F.lit("truth "), F.col("topic").cast("string")).alias("gt_label"), "gt_score"
    )
    return topics.topic_label_lookup(p, label_info(p), truth).select("id", "topic", "topic_label")


PART = 2000


@query(
    "user_topic_text",
    f"""WITH filled AS (SELECT *, floor(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART}) AS f FROM conversations),
    placed AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS part FROM filled)
    SELECT conv_id AS subject_id, part, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_texts FROM placed GROUP BY 1, 2""",
)
def user_topic_text(spark, d):
    posts = table(spark, d, "conversations").select(F.col("conv_id").alias("subject_id"), "turn", "text")
    return topics.user_topic_text(posts, ["turn"], max_chars=PART)
