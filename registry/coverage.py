"""Coverage between even and odd vectors of each label."""

from pyspark.sql import functions as F

from registry.base import posts, query, r6, table
from registry.narratives import REPORTS_SQL, topic_lists, trajectory_reports
from tidemark.operators import coverage, infer, reports
from tidemark.plans.lineage import cut

# Fixture vectors are nearly random; at the usual thresholds nothing would match.
THRESHOLD = 0.25

SIDES_SQL = """WITH v AS (SELECT label AS key, vec_id AS item, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
full_v AS (SELECT * FROM v WHERE item % 2 = 0), sample_v AS (SELECT * FROM v WHERE item % 2 = 1),
sims AS MATERIALIZED (SELECT f.key, f.item AS i, s.item AS j, list_cosine_similarity(f.vec, s.vec) AS cos
  FROM full_v f JOIN sample_v s ON f.key = s.key),
rmax AS MATERIALIZED (SELECT key, i, max(cos) AS m, arg_min(j, (-cos, j)) AS j FROM sims GROUP BY 1, 2),
cmax AS MATERIALIZED (SELECT key, j, max(cos) AS m, arg_min(i, (-cos, i)) AS i FROM sims GROUP BY 1, 2)
"""


def sides(spark, d):
    v = table(spark, d, "embeddings").select(
        F.col("label").alias("key"), F.col("vec_id").alias("item"), F.col("embedding").alias("vector")
    )
    return v.where("item % 2 = 0"), v.where("item % 2 = 1")


@query(
    "cosine_maxima",
    SIDES_SQL + """SELECT key, 'full' AS side, i AS item, round(m, 6) AS cosine, j AS partner FROM rmax
    UNION ALL SELECT key, 'sample', j, round(m, 6), i FROM cmax""",
)
def cosine_maxima(spark, d):
    return coverage.cosine_maxima(*sides(spark, d), block=64).select("key", "side", "item", r6("cosine"), "partner")


BEST = f"""SELECT key, i AS full_item, j AS sample_item, round(m, 6) AS cosine, m >= {THRESHOLD} AS matched FROM rmax"""


@query("best_match", SIDES_SQL + BEST)
def best_match(spark, d):
    return coverage.best_match(*sides(spark, d), THRESHOLD).select(
        "key", "full_item", "sample_item", r6("cosine"), "matched"
    )


@query("matched_only", SIDES_SQL + BEST + f" WHERE m >= {THRESHOLD}")
def matched_only(spark, d):
    return coverage.matched_only(best_match(spark, d))


METRICS = """, p AS (SELECT *, tp_sample / n_sample AS precision, tp_full / n_full AS recall FROM c)
SELECT key, threshold, tp_full, tp_sample, n_full, n_sample, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p"""

COLUMNS = ["key", "threshold", "tp_full", "tp_sample", "n_full", "n_sample"]


@query(
    "coverage_metrics",
    SIDES_SQL + f""", c AS (SELECT r.key, CAST({THRESHOLD} AS DOUBLE) AS threshold, tp_full, n_full, tp_sample, n_sample FROM
      (SELECT key, count(*) FILTER (m >= {THRESHOLD}) AS tp_full, count(*) AS n_full FROM rmax GROUP BY 1) r JOIN
      (SELECT key, count(*) FILTER (m >= {THRESHOLD}) AS tp_sample, count(*) AS n_sample FROM cmax GROUP BY 1) s
      ON r.key = s.key)""" + METRICS,
)
def coverage_metrics(spark, d):
    out = coverage.coverage_metrics(coverage.cosine_maxima(*sides(spark, d)), THRESHOLD)
    return out.select(*COLUMNS, r6("precision"), r6("recall"), r6("f1"))


@query(
    "coverage_sensitivity",
    SIDES_SQL + """, t AS (SELECT i * 0.05::DOUBLE AS threshold FROM range(21) r(i)),
    c AS (SELECT r.key, r.threshold, tp_full, n_full, tp_sample, n_sample FROM
      (SELECT key, threshold, count(*) FILTER (m >= threshold) AS tp_full, count(*) AS n_full FROM rmax, t GROUP BY 1, 2) r JOIN
      (SELECT key, threshold, count(*) FILTER (m >= threshold) AS tp_sample, count(*) AS n_sample FROM cmax, t GROUP BY 1, 2) s
      ON r.key = s.key AND r.threshold = s.threshold)"""
    + METRICS.replace("SELECT key, threshold,", "SELECT key, round(threshold, 6) AS threshold,"),
)
def coverage_sensitivity(spark, d):
    out = coverage.coverage_sensitivity(coverage.cosine_maxima(*sides(spark, d)))
    return out.select(
        "key", r6("threshold"), *COLUMNS[2:], r6("precision"), r6("recall"), r6("f1")
    )


@query(
    "topic_ground_truth",
    """WITH v AS (SELECT vec_id % 2 AS odd, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
        generate_subscripts(embedding, 1) AS dim FROM embeddings),
    c AS (SELECT odd, label, list(m ORDER BY dim) AS vec FROM (
        SELECT odd, label, dim, round(avg(x), 9) AS m FROM v GROUP BY ALL) GROUP BY ALL),
    topics AS (SELECT label - 1 AS topic, vec FROM c WHERE odd = 0),
    truths AS (SELECT label AS item, 'label ' || label AS label, vec FROM c WHERE odd = 1),
    s AS (SELECT topic, item, label, list_cosine_similarity(t.vec, g.vec) AS cos FROM topics t, truths g)
    SELECT CAST(topic AS BIGINT) AS topic, CASE WHEN topic = -1 THEN 'Outliers' ELSE arg_min(label, (-cos, item)) END AS gt_label,
      round(CASE WHEN topic = -1 THEN 0 ELSE max(cos) END, 6) AS gt_score FROM s GROUP BY topic""",
)
def topic_ground_truth(spark, d):
    # Label 0 plays the noise topic; the centroid of the odd vectors of each label is the truth.
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("odd"), "label", F.posexplode("embedding"))
    means = v.groupBy("odd", "label", "pos").agg(F.round(F.avg(F.col("col").cast("double")), 9).alias("m"))
    # One vector has as many entries as the embedding has dimensions.
    c = means.groupBy("odd", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("vector")
    )
    topics = c.where("odd = 0").select((F.col("label") - 1).alias("topic"), "vector")
    truths = c.where("odd = 1").select(
        F.col("label").alias("item"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), "vector"
    )
    return coverage.topic_ground_truth(topics, truths).select("topic", "gt_label", r6("gt_score"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def make_letter_counts():
    """Stands in for an encoder: how often each letter occurs."""
    import numpy as np

    letters = "abcdefghijklmnopqrstuvwxyz"

    def encode(texts):
        return np.array([[t.count(c) + t.count(c.upper()) for c in letters] for t in texts], dtype=np.float64)

    return encode


def encoded(side):
    # Stored, since the vectors are read several times and a real encoder is costly.
    return cut(infer.batch_infer(side, make_letter_counts, out="vector", batch_size=64), "encoded")


COUNTS_SQL = "[" + ", ".join(
    f"CAST(2 * length(text) - length(replace(text, '{c}', '')) - length(replace(text, '{c.upper()}', '')) AS DOUBLE)" for c in LETTERS
) + "]"


@query(
    "text_coverage",
    REPORTS_SQL + f""", f AS (SELECT subject_id AS key, id AS item, text, {COUNTS_SQL} AS vec FROM posts),
    s AS (SELECT subject_id AS key, trajectory_summary AS text, {COUNTS_SQL.replace("text", "trajectory_summary")} AS vec FROM trajectory)
    SELECT f.key, f.item AS full_item, f.text AS full_text, s.text AS sample_text,
      CASE WHEN length(s.text) > 100 THEN left(s.text, 100) || '...' ELSE s.text END AS sample_preview,
      round(list_cosine_similarity(f.vec, s.vec), 6) AS cosine, list_cosine_similarity(f.vec, s.vec) >= 0.5 AS covered FROM f JOIN s ON f.key = s.key""",
)
def text_coverage(spark, d):
    """Every post against its user's narrative, from texts to matches."""
    full, sample = coverage.text_sides(posts(spark, d), trajectory_reports(spark, d), "trajectory_summary")
    full, sample = encoded(full), encoded(sample)
    matches = coverage.best_match(full, sample, 0.5)
    return coverage.matched_texts(matches, full, sample).select(
        "key", "full_item", "full_text", "sample_text", "sample_preview", r6("cosine"), F.col("matched").alias("covered")
    )


@query(
    "topic_coverage",
    f"""WITH kinds(event_type, place) AS (VALUES ('purchase', 0), ('signup', 1), ('view', 2), ('click', 3), ('error', 4)),
    f AS (SELECT DISTINCT user_id AS key, 'about ' || event_type AS text FROM events JOIN kinds USING (event_type)),
    s AS (SELECT DISTINCT user_id AS key, 'a story of ' || event_type AS text FROM events JOIN kinds USING (event_type)),
    fv AS (SELECT key, text, {COUNTS_SQL} AS vec FROM f), sv AS (SELECT key, text, {COUNTS_SQL} AS vec FROM s),
    sims AS (SELECT fv.key, fv.text AS i, sv.text AS j, list_cosine_similarity(fv.vec, sv.vec) AS c FROM fv JOIN sv ON fv.key = sv.key),
    r AS (SELECT key, count(*) FILTER (m >= 0.75) AS tp_full, count(*) AS n_full FROM (SELECT key, i, max(c) AS m FROM sims GROUP BY 1, 2) GROUP BY 1),
    p AS (SELECT key, count(*) FILTER (m >= 0.75) AS tp_sample, count(*) AS n_sample FROM (SELECT key, j, max(c) AS m FROM sims GROUP BY 1, 2) GROUP BY 1)
    SELECT key, tp_full, tp_sample, n_full, n_sample, round(tp_full / n_full, 6) AS recall, round(tp_sample / n_sample, 6) AS precision FROM r JOIN p USING (key)""",
)
def topic_coverage(spark, d):
    """Topics of the posts against topics of a narrative, from lists to metrics."""
    flat = reports.flatten_topics(topic_lists(spark, d)).withColumn("source", F.lit("posts"))
    kind = F.split_part("topic", F.lit(" "), F.lit(2))
    narrated = (
        flat.withColumn("topic", F.concat(F.lit("a story of "), kind))
        .withColumn("source", F.lit("narrative_base"))
    )
    full, sample = coverage.topic_sides(flat.unionByName(narrated))
    maxima = coverage.cosine_maxima(encoded(full), encoded(sample))
    return coverage.coverage_metrics(maxima, 0.75).select(
        "key", "tp_full", "tp_sample", "n_full", "n_sample", r6("recall"), r6("precision")
    )
