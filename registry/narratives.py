"""Reports derived from events: a sentence per user and per phase stands for each narrative."""

from pyspark.sql import functions as F

from registry.base import posts, query
from registry.segments import segments_sql, series
from tidemark.operators import reports, segments
from tidemark.schema import TOPIC_LISTS

TEXT = "string"


def base_reports(spark, d):
    n = posts(spark, d).groupBy("subject_id").agg(F.count(F.lit(1)).cast(TEXT).alias("n"))
    sentence = F.concat(F.lit("User "), F.col("subject_id").cast(TEXT), F.lit(" wrote "), F.col("n"), F.lit(" posts."))
    return n.select("subject_id", sentence.alias("base_analysis"))


def phase_narratives(spark, d):
    sentence = F.concat(
        F.lit("Phase "), F.col("phase_num").cast(TEXT), F.lit(" of user "), F.col("subject_id").cast(TEXT), F.lit(".")
    )
    return segments.phase_breaks(segments.segments(series(spark, d), k=4)).withColumn("narrative", sentence)


def trajectory_reports(spark, d):
    arrays = reports.phase_array(phase_narratives(spark, d))
    summary = F.concat(
        F.lit("User "), F.col("subject_id").cast(TEXT), F.lit(" over "), F.size("phases").cast(TEXT), F.lit(" phases.")
    )
    return arrays.withColumn("trajectory_summary", summary)


REPORTS_SQL = segments_sql(4) + """, base AS (
  SELECT subject_id, 'User ' || subject_id || ' wrote ' || count(*) || ' posts.' AS base_analysis FROM posts GROUP BY 1),
trajectory AS (SELECT subject_id, 'User ' || subject_id || ' over ' || count(*) || ' phases.' AS trajectory_summary,
  string_agg(chr(10) || chr(10) || 'Phase ' || seg_no || ': ' || start_date || ' to ' || end_date || ' (Delta: ' ||
    format('{:.2f}', end_val - start_val) || ')' || chr(10) || 'Phase ' || seg_no || ' of user ' || subject_id || '.', '' ORDER BY seg_no) AS blocks
  FROM seg GROUP BY 1)
"""


@query(
    "report_text_assembly",
    REPORTS_SQL + "SELECT subject_id, trajectory_summary || chr(10) || blocks AS report FROM trajectory",
)
def report_text_assembly(spark, d):
    return reports.report_text_assembly(trajectory_reports(spark, d)).select("subject_id", "report")


@query(
    "merge_reports",
    REPORTS_SQL + "SELECT subject_id, base_analysis, trajectory_summary FROM base JOIN trajectory USING (subject_id)",
)
def merge_reports(spark, d):
    merged = reports.merge_reports(base_reports(spark, d), trajectory_reports(spark, d))
    return merged.select("subject_id", "base_analysis", "trajectory_summary")


def topic_lists(spark, d):
    """Per user a list of the kinds of event for each valence."""
    kinds = {"positive": ("purchase", "signup"), "neutral": ("view", "click"), "negative": ("error",)}
    lists = [
        F.array_compact(
            F.array(*[F.max(F.when(F.col("event_type") == k, F.concat(F.lit("about "), "event_type"))) for k in names])
        ).alias(f"{valence}topics")
        for valence, names in kinds.items()
    ]
    events = posts(spark, d).select("subject_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("event_type"))
    return events.groupBy("subject_id").agg(*lists)


TOPICS_SQL = """WITH kinds(event_type, valence, place) AS (VALUES ('purchase', 'positive', 0), ('signup', 'positive', 1),
  ('view', 'neutral', 2), ('click', 'neutral', 3), ('error', 'negative', 4)),
flat AS (SELECT DISTINCT user_id AS subject_id, valence, place, 'about ' || event_type AS topic FROM events JOIN kinds USING (event_type)) """


@query(
    "flatten_topics",
    TOPICS_SQL + """SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY place) - 1 AS INTEGER) AS position,
    valence, topic FROM flat""",
)
def flatten_topics(spark, d):
    return reports.flatten_topics(topic_lists(spark, d))


@query(
    "parse_llm_json",
    TOPICS_SQL + """SELECT subject_id, CASE WHEN subject_id % 3 <> 0 THEN count(*) FILTER (valence = 'positive') END AS positive,
    CASE WHEN subject_id % 3 <> 0 THEN count(*) FILTER (valence = 'neutral') END AS neutral, subject_id % 3 = 0 AS failed
    FROM flat GROUP BY 1""",
)
def parse_llm_json(spark, d):
    good = F.to_json(F.struct("positivetopics", "neutraltopics", "negativetopics"))
    # Every third user's reply is not JSON, in one of two ways.
    reply = (
        F.when(F.col("subject_id") % 6 == 0, F.concat(F.lit("Here you are: "), good))
        .when(F.col("subject_id") % 3 == 0, F.left(good, F.length(good) - 5))
        .otherwise(good)
    )
    replies = topic_lists(spark, d).select("subject_id", reply.alias("reply"))
    parsed = reports.parse_llm_json(replies, TOPIC_LISTS)
    return parsed.select(
        "subject_id",
        F.when(F.col("parsed").isNotNull(), F.size("parsed.positivetopics")).cast("bigint").alias("positive"),
        F.when(F.col("parsed").isNotNull(), F.size("parsed.neutraltopics")).cast("bigint").alias("neutral"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    "parse_reply_json",
    TOPICS_SQL + """SELECT subject_id, CASE WHEN subject_id % 6 <> 3 THEN count(*) FILTER (valence = 'positive') END AS positive,
    CASE WHEN subject_id % 6 <> 3 THEN count(*) FILTER (valence = 'neutral') END AS neutral,
    CASE WHEN subject_id % 6 = 3 THEN 'no object in the reply' END AS error FROM flat GROUP BY 1""",
)
def parse_reply_json(spark, d):
    good = F.to_json(F.struct("positivetopics", "neutraltopics", "negativetopics"))
    kind = F.col("subject_id") % 6
    # Replies with prose, fences and other braces around the object; one kind is cut off.
    reply = (
        F.when(kind == 0, F.concat(F.lit("Here you are: "), good, F.lit(" I hope that helps {really}.")))
        .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 3, F.left(good, F.length(good) - 5))
        .when(kind == 4, F.concat(F.lit('Given {text} and "so" on: '), good))
        .when(kind == 5, F.concat(F.lit("An open { brace.\n```\n"), good, F.lit("```\nDone.")))
        .otherwise(good)
    )
    parsed = reports.parse_reply_json(topic_lists(spark, d).select("subject_id", reply.alias("reply")), TOPIC_LISTS)
    sizes = [F.when(F.col("parsed").isNotNull(), F.size(f"parsed.{n}topics")).cast("bigint").alias(n) for n in ("positive", "neutral")]
    return parsed.select("subject_id", *sizes, "error")
