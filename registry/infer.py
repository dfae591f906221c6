"""Model surfaces with simple stand-ins, prompts, vectors and clusters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry.base import POSTS_SQL, every, posts, query, r6, table
from registry.judge import VERDICTS_SQL, verdicts
from registry.narratives import REPORTS_SQL, base_reports, phase_narratives, trajectory_reports
from registry.segments import segments_sql, series
from registry.topics import STOPS
from tidemark.operators import clusters, density, factors, infer, judge, prompts, reports, risk, segments, spectral, topics
from tidemark.plans import nearest
from tidemark.plans.lineage import cut, scratch_path

P = f"WITH {POSTS_SQL} "


@query(
    "softmax_argmax",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    l AS (SELECT vec_id, list_sum(list_filter(v, lambda x, i: i % 3 = 1)) AS a, list_sum(list_filter(v, lambda x, i: i % 3 = 2)) AS b,
      list_sum(list_filter(v, lambda x, i: i % 3 = 0)) AS c FROM e)
    SELECT vec_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS predicted_label,
    round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS prob_not, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS prob_moderate,
    round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS prob_severe FROM l""",
)
def softmax_argmax(spark, d):
    # Every entry counts: the sum of each third one is a logit.
    logits = table(spark, d, "embeddings").select("vec_id", F.array(*[every("embedding", 3, k) for k in range(3)]).alias("logits"))
    return infer.with_probabilities(logits).select(
        "vec_id", "predicted_label", r6("prob_not"), r6("prob_moderate"), r6("prob_severe")
    )


def make_stub_classifier():
    """Stands in for a classifier: logits from the length and the vowels of a text."""
    import numpy as np

    def predict(texts):
        return np.array([[len(t) % 7, sum(t.count(v) for v in "aeiou") % 5, 2.0] for t in texts], dtype=np.float64)

    return predict


INFER_SQL = """WITH l AS (SELECT doc_id, length(text) % 7 AS a, (length(text) - length(regexp_replace(text, '[aeiou]', '', 'g'))) % 5 AS b, 2 AS c FROM documents)
    SELECT doc_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS predicted_label,
    round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS prob_not, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS prob_moderate,
    round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS prob_severe FROM l"""


@query("batch_infer", INFER_SQL)
def batch_infer(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return infer.classify(docs, make_stub_classifier, batch_size=64).select(
        "doc_id", "predicted_label", r6("prob_not"), r6("prob_moderate"), r6("prob_severe")
    )


@query("infer_once", INFER_SQL)
def infer_once(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return infer.with_probabilities(infer.infer_once(docs, make_stub_classifier)).select(
        "doc_id", "predicted_label", r6("prob_not"), r6("prob_moderate"), r6("prob_severe")
    )


def make_echo():
    """Stands in for a language model: answers in capitals and fails on every text with a "Z"."""

    def complete(prompt):
        if "z" in prompt:
            raise ValueError("no answer")
        return prompt.upper()

    return complete


@query(
    "complete_prompts",
    """SELECT event_id AS id, CASE WHEN event_type LIKE '%v%' THEN NULL ELSE upper(event_type || ' ' || props) END AS response,
    CASE WHEN event_type LIKE '%v%' THEN 'ValueError: no answer' END AS error FROM events""",
)
def complete_prompts(spark, d):
    # "view" events carry the letter that makes the stand-in fail.
    work = posts(spark, d).select("id", F.replace("text", F.lit("v"), F.lit("z")).alias("prompt"))
    return infer.complete_prompts(work, make_echo).select("id", "response", "error")


@query(
    "complete_with_ledger",
    """SELECT event_id AS id, CASE WHEN event_type LIKE '%v%' THEN NULL ELSE upper(event_type || ' ' || props) END AS response,
    CASE WHEN event_type LIKE '%v%' THEN 'ValueError: no answer' END AS error FROM events""",
)
def complete_with_ledger(spark, d):
    work = posts(spark, d).select("id", F.replace("text", F.lit("v"), F.lit("z")).alias("prompt"))
    ledger, options = scratch_path(spark, "ledger"), {"attempts": 2, "wait": 0.0}
    # A run over some prompts, and another over all, which calls only what has no answer yet.
    infer.complete_with_ledger(work.where("id % 2 = 0"), make_echo, ledger, **options)
    return infer.complete_with_ledger(work, make_echo, ledger, **options).select("id", "response", "error")


PART = 1500
LINES_SQL = P + f""", lines AS (SELECT *, '[' || strftime(date, '%Y-%m-%d %H:%M:%S') || '] ' || text AS line FROM posts),
filled AS (SELECT *, floor(coalesce(sum(length(line) + 1) OVER (PARTITION BY subject_id ORDER BY date, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART}) AS f FROM lines),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY subject_id ORDER BY f) - 1 AS part FROM filled)
"""


@query(
    "prompt_table",
    LINES_SQL + """SELECT subject_id, part, count(*) AS n_posts, 'Posts:' || chr(10) || string_agg(line, chr(10) ORDER BY date, id) || chr(10) || 'End.' AS prompt
    FROM placed GROUP BY 1, 2""",
)
def prompt_table(spark, d):
    return prompts.base_prompts(posts(spark, d), "Posts:\n{posts}\nEnd.", max_chars=PART)


@query(
    "prompt_table_phases",
    segments_sql(4) + """, pp AS (SELECT p.subject_id, g.seg_no AS phase_num, p.date, p.id,
      '[' || strftime(p.date, '%Y-%m-%d %H:%M:%S') || '] ' || p.text AS line FROM posts p JOIN seg g
      ON p.subject_id = g.subject_id AND p.date BETWEEN CAST(g.start_date AS TIMESTAMP) AND CAST(g.end_date AS TIMESTAMP)),
    blocks AS (SELECT subject_id, phase_num, count(*) AS n_posts, string_agg(line, chr(10) ORDER BY date, id) AS posts FROM pp GROUP BY 1, 2),
    days AS (SELECT subject_id, string_agg(day || '=' || format('{:.4f}', daily_risk), ', ' ORDER BY day) AS scores FROM scored GROUP BY 1)
    SELECT g.subject_id, g.seg_no AS phase_num, CAST(0 AS BIGINT) AS part, coalesce(n_posts, 0) AS n_posts,
      seg_no || ' ' || g.start_date || ' ' || g.end_date || ' ' || format('{:.2f}', end_val - start_val) || chr(10) || scores || chr(10) || coalesce(posts, '') AS prompt
    FROM seg g JOIN days USING (subject_id) LEFT JOIN blocks b ON b.subject_id = g.subject_id AND b.phase_num = g.seg_no""",
)
def prompt_table_phases(spark, d):
    segs = cut(segments.segments(series(spark, d), k=4), "segments")
    return prompts.phase_prompts(
        segments.phase_posts(posts(spark, d), segs),
        risk.daily_risk(posts(spark, d)),
        segments.phase_breaks(segs),
        "{phase} {start} {end} {delta}\n{scores}\n{posts}",
    )


@query(
    "prompt_table_summary",
    segments_sql(4) + """SELECT subject_id, 'Phases: ' || string_agg('Phase ' || seg_no || ' of user ' || subject_id || '.', chr(10) || chr(10) ORDER BY seg_no) AS prompt
    FROM seg GROUP BY 1""",
)
def prompt_table_summary(spark, d):
    return prompts.summary_prompts(phase_narratives(spark, d), "Phases: {phases}")


@query(
    "prompt_table_judge",
    REPORTS_SQL + """SELECT subject_id, m AS a, 'A: ' || CASE m WHEN 'base' THEN base_analysis ELSE r END || chr(10) ||
      'B: ' || CASE m WHEN 'base' THEN r ELSE base_analysis END AS prompt FROM (SELECT subject_id, base_analysis,
      trajectory_summary || chr(10) || blocks AS r, CASE WHEN ascii(right(md5(subject_id || ':0'), 1)) % 2 = 0 THEN 'base' ELSE 'trajectory' END AS m
      FROM base JOIN trajectory USING (subject_id))""",
)
def prompt_table_judge(spark, d):
    both = reports.merge_reports(
        base_reports(spark, d), reports.report_text_assembly(trajectory_reports(spark, d))
    )
    return prompts.judge_prompts(judge.ab_assignment(both), "A: {report_a}\nB: {report_b}").select(
        "subject_id", F.col("mapping.A").alias("a"), "prompt"
    )


@query(
    "prompt_table_topics",
    REPORTS_SQL + f""", fl AS (SELECT *, floor(coalesce(sum(length(text) + 1) OVER (PARTITION BY subject_id ORDER BY date, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART}) AS f FROM posts),
    pl AS (SELECT *, dense_rank() OVER (PARTITION BY subject_id ORDER BY f) - 1 AS part FROM fl)
    SELECT subject_id, 'posts' AS source, part, 'T: ' || string_agg(text, chr(10) ORDER BY date, id) AS prompt FROM pl GROUP BY 1, 3
    UNION ALL SELECT subject_id, 'narrative_base', 0, 'T: ' || base_analysis FROM base JOIN trajectory USING (subject_id)
    UNION ALL SELECT subject_id, 'narrative_traj', 0, 'T: ' || trajectory_summary FROM trajectory""",
)
def prompt_table_topics(spark, d):
    both = reports.merge_reports(base_reports(spark, d), trajectory_reports(spark, d))
    return prompts.topic_prompts(posts(spark, d), both, "T: {text}", max_chars=PART)


@query(
    "prompt_corpus_summary",
    VERDICTS_SQL + """, docs AS (SELECT subject_id, '{"user": ' || subject_id || ', "preferred": "' || preferred || '"}' AS doc
      FROM verdict_rows WHERE place IN (1, 2)), placed AS (SELECT *, floor(coalesce(sum(length(doc) + 2) OVER (ORDER BY subject_id, doc
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000) AS filled FROM docs),
    numbered AS (SELECT *, dense_rank() OVER (ORDER BY filled) - 1 AS part FROM placed)
    SELECT part, count(*) AS n_verdicts, 'V: [' || string_agg(doc, ', ' ORDER BY subject_id) || ']' AS prompt FROM numbered GROUP BY 1""",
)
def prompt_corpus_summary(spark, d):
    document = F.concat(
        F.lit('{"user": '), F.col("subject_id").cast("string"), F.lit(', "preferred": "'), "result.Preferred_Report", F.lit('"}')
    )
    docs = verdicts(spark, d).select("subject_id", document.alias("document"))
    # Every user twice: verdicts of one user stay apart.
    return prompts.corpus_summary_prompts(docs.unionAll(docs), "V: {verdicts}", max_chars=2000)


def document_vectors(spark, d):
    return factors.factor_text(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


SIGNS = ", ".join(f"({k}, {pow(factors.STEP, k + 1, factors.PRIME)})" for k in range(factors.SPREAD))


@query(
    "embed_text",
    f"""WITH bytes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
      CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
    found AS (SELECT doc_id AS id, term, count(*) AS tf FROM (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents)
      WHERE term NOT IN ({STOPS}) GROUP BY ALL),
    names AS (SELECT term, hex(encode(term)) AS hx FROM (SELECT DISTINCT term FROM found)),
    placed AS (SELECT term, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda k:
      CAST('0x' || substr(hx, k, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % {factors.PLACES} AS place FROM names, bytes),
    counts AS (SELECT id, place, sum(tf) AS tf FROM found JOIN placed USING (term) GROUP BY ALL),
    weights AS (SELECT place, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS w FROM counts GROUP BY 1),
    signed AS (SELECT id, k, CAST(tf AS DOUBLE) * w AS x, (place * m + k) % {factors.PRIME} AS h
      FROM counts JOIN weights USING (place), (VALUES {SIGNS}) s(k, m)),
    sums AS (SELECT id, CAST(k * 64 + h % 64 AS BIGINT) AS place, sum(CASE WHEN (h // 64) % 2 = 0 THEN x ELSE -x END) AS v FROM signed GROUP BY ALL),
    norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM sums GROUP BY 1)
    SELECT id, place, round(CAST(CAST(v / norm AS FLOAT) AS DOUBLE), 5) AS entry FROM sums JOIN norms USING (id)
    WHERE norm > 0 AND round(CAST(CAST(v / norm AS FLOAT) AS DOUBLE), 5) <> 0""",
)
def embed_text(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    # The entries that are not zero.
    entries = factors.project_text(docs).select("id", F.posexplode("vector").alias("place", "entry"))
    return entries.select("id", F.col("place").cast("bigint").alias("place"), F.round(F.col("entry").cast("double"), 5).alias("entry")).where("entry <> 0")


@query("factor_text")
def factor_text(spark, d):
    return document_vectors(spark, d)


@query("reduce_dims")
def reduce_dims(spark, d):
    # Stored first: fitting and projecting each read the vectors.
    return clusters.reduce_dims(cut(document_vectors(spark, d), "vectors"), k=5).select("id", "coords")


def plane(spark, d):
    """The vectors of the tables as points of a plane, with the corpus they belong to."""
    at = F.array(every("embedding", 2, 0), every("embedding", 2, 1))
    return table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), at.alias("coords"))


@query(
    "nearest_neighbours",
    """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    pts AS (SELECT label, vec_id, list_sum(list_filter(v, lambda x, i: i % 2 = 1)) AS x, list_sum(list_filter(v, lambda x, i: i % 2 = 0)) AS y FROM e),
    d AS (SELECT a.label, a.vec_id AS point, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
      FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, point ORDER BY distance) AS rank FROM d)
    SELECT label, point, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 7""",
)
def nearest_neighbours(spark, d):
    points = plane(spark, d).select("label", F.col("id").alias("point"), F.lit(1).alias("weight"), "coords")
    place = Window.partitionBy("label", "point").orderBy("distance")
    found = nearest.nearest(points, 7, ["label"]).withColumn("rank", F.row_number().over(place))
    return found.select("label", "point", "rank", r6("distance"))


@query("varying_density_cluster")
def varying_density_cluster(spark, d):
    """Clusters of each label's points; see the tests for the same from all pairs."""
    return density.varying_density_cluster(plane(spark, d), by=["label"], min_cluster_size=8, min_samples=5, neighbours=15).select(
        "label", "id", "topic", r6("strength")
    )


@query("neighbour_places")
def neighbour_places(spark, d):
    """The vectors of the tables on a plane that keeps neighbours."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return spectral.neighbour_places(vectors, k=2)


@query("document_density_topics")
def document_density_topics(spark, d):
    """Texts to factors to places that keep neighbours to clusters of varying density."""
    vectors = cut(document_vectors(spark, d), "vectors")
    fewer = cut(clusters.reduce_dims(vectors, k=8).select("id", "coords"), "coords")
    places = cut(spectral.neighbour_places(fewer, k=5, column="coords", out="places"), "places")
    return density.varying_density_cluster(places, coords="places").select("id", "topic", "strength")


WIDTH, DENSE, SMALLEST = 0.375, 2, 4


@query(
    "density_cluster",
    f"""WITH RECURSIVE e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    pts AS (SELECT label, vec_id AS id, CAST(floor(list_sum(list_filter(v, lambda x, i: i % 2 = 1)) / {WIDTH}) AS INTEGER) AS cx,
      CAST(floor(list_sum(list_filter(v, lambda x, i: i % 2 = 0)) / {WIDTH}) AS INTEGER) AS cy FROM e),
    dense AS (SELECT label, cx, cy, count(*) AS n FROM pts GROUP BY ALL HAVING count(*) >= {DENSE}),
    reach(label, cx, cy, rx, ry) AS (SELECT label, cx, cy, cx, cy FROM dense
      UNION SELECT r.label, r.cx, r.cy, e.cx, e.cy FROM reach r JOIN dense e
      ON e.label = r.label AND abs(e.cx - r.rx) + abs(e.cy - r.ry) = 1),
    roots AS (SELECT label, cx, cy, min([rx, ry]) AS root FROM reach GROUP BY 1, 2, 3),
    sizes AS (SELECT label, root, sum(n) AS size, max(n) AS top FROM roots JOIN dense USING (label, cx, cy) GROUP BY 1, 2 HAVING sum(n) >= {SMALLEST}),
    named AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, root) - 1 AS topic FROM sizes),
    cells AS (SELECT label, cx, cy, topic, n / top AS strength FROM roots JOIN dense USING (label, cx, cy) JOIN named USING (label, root))
    SELECT label, id, CAST(coalesce(topic, -1) AS BIGINT) AS topic, round(coalesce(strength, 0), 6) AS strength
    FROM pts LEFT JOIN cells USING (label, cx, cy)""",
)
def density_cluster(spark, d):
    return clusters.density_cluster(
        plane(spark, d), by=["label"], width=WIDTH, min_points=DENSE, min_cluster_size=SMALLEST
    ).select("label", "id", "topic", r6("strength"))


@query("document_clusters")
def document_clusters(spark, d):
    """The whole chain: text to vector to coordinates to clusters."""
    coords = clusters.reduce_dims(cut(document_vectors(spark, d), "vectors"), k=5).select("id", "coords")
    return clusters.density_cluster(cut(coords, "coords"))


@query("document_topics")
def document_topics(spark, d):
    """The topic chain as one result: texts to clusters to keywords and names, and rows for the plot.

    A row per document: its topic, the topic's name and keywords, and its place on two axes.
    """
    vectors = cut(document_vectors(spark, d), "vectors")
    clustered = clusters.density_cluster(cut(clusters.reduce_dims(vectors, k=5).select("id", "coords"), "coords"), min_cluster_size=4)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    # The clusters are stored, the texts are not: they are read for their terms only, once.
    posts_ = texts.join(cut(clustered, "clustered"), "id")
    info = cut(topics.topic_info(posts_), "info")
    flat = clusters.reduce_dims(vectors, k=2).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    named = topics.topic_label_lookup(posts_.select("id", "topic").join(flat, "id"), info)
    return named.join(info.select("topic", "count", F.array_join("representation", " ").alias("words")), "topic").select(
        "id", "topic", "topic_label", "count", "words", "x", "y"
    )
