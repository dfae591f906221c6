"""Dataset statistics over events read as posts."""

from pyspark.sql import functions as F

from registry.base import POSTS_SQL, posts, query, r6
from tidemark.functions import dates, scores, text
from tidemark.operators import clean, risk, stats

P = f"WITH {POSTS_SQL} "


@query("raw_risk", P + "SELECT id, round(2 * prob_severe + prob_moderate, 6) AS raw_risk FROM posts")
def raw_risk(spark, d):
    return posts(spark, d).select("id", F.round(scores.raw_risk(), 6).alias("raw_risk"))


@query("month_bucket", P + "SELECT id, strftime(date, '%Y-%m-01') AS month_date FROM posts")
def month_bucket(spark, d):
    return posts(spark, d).select("id", dates.month_bucket(F.col("date")).alias("month_date"))


@query(
    "weekday_label",
    P + """SELECT id, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
    ['Dom','Lun','Mar','Mer','Gio','Ven','Sab'][dayofweek(date) + 1] AS day_name FROM posts""",
)
def weekday_label(spark, d):
    day = F.dayofweek("date")
    return posts(spark, d).select("id", day.alias("day_of_week"), dates.weekday_label(day).alias("day_name"))


@query("text_length", P + "SELECT id, CAST(length(text) AS INTEGER) AS n FROM posts")
def text_length(spark, d):
    return posts(spark, d).select("id", text.text_length("text").alias("n"))


@query(
    "filter_user",
    P + """SELECT id, subject_id, date, text FROM posts
    WHERE subject_id = (SELECT min(subject_id) FROM posts)""",
)
def filter_user(spark, d):
    p = posts(spark, d)
    first = p.agg(F.min("subject_id")).scalar()
    return clean.filter_user(p, first).select("id", "subject_id", "date", "text")


@query(
    "user_metrics",
    P + """SELECT count(DISTINCT subject_id) AS num_users, count(*) AS total_posts,
    round(count(*) / count(DISTINCT subject_id), 6) AS avg_posts_user FROM posts""",
)
def user_metrics(spark, d):
    return stats.user_metrics(posts(spark, d)).select("num_users", "total_posts", r6("avg_posts_user"))


@query(
    "depression_averages",
    P + "SELECT round(avg(prob_severe), 6) AS avg_severe, round(avg(prob_moderate), 6) AS avg_moderate FROM posts",
)
def depression_averages(spark, d):
    return stats.depression_averages(posts(spark, d)).select(r6("avg_severe"), r6("avg_moderate"))


@query(
    "non_depressed_estimate",
    P + """SELECT round(avg(prob_severe), 6) AS avg_severe, round(avg(prob_moderate), 6) AS avg_moderate,
    round(1 - (avg(prob_severe) + avg(prob_moderate)), 6) AS avg_none FROM posts""",
)
def non_depressed_estimate(spark, d):
    return stats.non_depressed_estimate(posts(spark, d)).select(
        r6("avg_severe"), r6("avg_moderate"), r6("avg_none")
    )


@query(
    "posts_over_time",
    P + "SELECT strftime(date, '%Y-%m-01') AS month_date, count(*) AS posts FROM posts GROUP BY 1 ORDER BY 1",
)
def posts_over_time(spark, d):
    return stats.posts_over_time(posts(spark, d))


@query(
    "top_active_users",
    P + """SELECT subject_id, count(*) AS post_count FROM posts GROUP BY 1
    ORDER BY post_count DESC, subject_id LIMIT 10""",
)
def top_active_users(spark, d):
    return stats.top_active_users(posts(spark, d))


@query(
    "weekday_activity",
    P + """SELECT CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week, count(*) AS posts,
    ['Dom','Lun','Mar','Mer','Gio','Ven','Sab'][dayofweek(date) + 1] AS day_name
    FROM posts GROUP BY dayofweek(date) ORDER BY 1""",
)
def weekday_activity(spark, d):
    return stats.weekday_activity(posts(spark, d))


@query(
    "post_length_stats",
    P + """SELECT round(avg(length(text)), 6) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length,
    CAST(max(length(text)) AS INTEGER) AS max_length FROM posts""",
)
def post_length_stats(spark, d):
    return stats.post_length_stats(posts(spark, d)).select(r6("avg_length"), "min_length", "max_length")


@query(
    "activity_risk",
    P + """SELECT subject_id, count(*) AS post_count, round(avg(prob_severe), 6) AS avg_severe
    FROM posts GROUP BY 1 ORDER BY avg(prob_severe) DESC, post_count DESC, subject_id LIMIT 20""",
)
def activity_risk(spark, d):
    return stats.activity_risk(posts(spark, d)).select("subject_id", "post_count", r6("avg_severe"))


@query(
    "score_histogram",
    P + """, s AS (SELECT 'severe' AS score, prob_severe AS p FROM posts
    UNION ALL SELECT 'moderate', prob_moderate FROM posts)
    SELECT score, CAST(least(floor(p * 20), 19) AS INTEGER) AS bin,
    CAST(least(floor(p * 20), 19) AS INTEGER) / 20.0 AS bin_start, count(*) AS posts FROM s GROUP BY ALL""",
)
def score_histogram(spark, d):
    return stats.score_histogram(posts(spark, d))


@query("subject_ids", "SELECT DISTINCT user_id AS subject_id FROM events ORDER BY 1")
def subject_ids(spark, d):
    return stats.subject_ids(posts(spark, d))


@query(
    "coerce_date",
    """SELECT event_id AS id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'not a date'
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS date FROM events""",
)
def coerce_date(spark, d):
    # Error events stand for rows with a broken date.
    written = F.when(F.col("text").startswith("error"), F.lit("not a date")).otherwise(
        F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    )
    typed = clean.typed_posts(posts(spark, d).withColumn("date", written))
    return typed.select("id", F.col("date").cast("timestamp_ntz").alias("date"))


@query(
    "daily_risk",
    P + """SELECT subject_id, CAST(date AS DATE) AS day, round(avg(2 * prob_severe + prob_moderate), 6) AS daily_risk
    FROM posts GROUP BY 1, 2""",
)
def daily_risk(spark, d):
    return risk.daily_risk(posts(spark, d)).select("subject_id", "day", r6("daily_risk"))


@query("daily_counts", P + "SELECT subject_id, CAST(date AS DATE) AS day, count(*) AS posts FROM posts GROUP BY 1, 2")
def daily_counts(spark, d):
    return risk.daily_counts(posts(spark, d))


for _name, _order, _cols in [
    ("recent_posts", "date", "id, date, text, round(prob_severe, 6) AS prob_severe, round(prob_moderate, 6) AS prob_moderate"),
    ("top_severe_posts", "prob_severe", "id, date, text, round(prob_severe, 6) AS prob_severe"),
    ("top_moderate_posts", "prob_moderate", "id, date, text, round(prob_moderate, 6) AS prob_moderate"),
]:

    def _top(spark, d, op=getattr(risk, _name)):
        out = op(posts(spark, d))
        return out.select(*[r6(c) if c.startswith("prob_") else F.col(c) for c in out.columns])

    query(
        _name,
        P + f"""SELECT subject_id, CAST(rank AS INTEGER) AS rank, {_cols} FROM (SELECT *, row_number() OVER
        (PARTITION BY subject_id ORDER BY {_order} DESC, id) AS rank FROM posts)
        WHERE rank <= {10 if _name == "recent_posts" else 5}""",
    )(_top)
