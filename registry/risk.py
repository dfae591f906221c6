"""Decayed risk, smoothing, headers and rankings."""

from pyspark.sql import functions as F

from registry.base import POSTS_SQL, posts, query, r6
from tidemark.operators import risk, rollup

# The decay stated as a weighted sum over all earlier days, not as the operator computes it.
SERIES_SQL = f"""WITH {POSTS_SQL}, daily AS MATERIALIZED (
  SELECT subject_id, CAST(date AS DATE) AS day, avg(2 * prob_severe + prob_moderate) AS v,
         row_number() OVER (PARTITION BY subject_id ORDER BY CAST(date AS DATE)) AS i
  FROM posts GROUP BY 1, 2),
scored AS MATERIALIZED (
  SELECT t.subject_id, t.day, t.i, any_value(t.v) AS daily_risk,
         sum((1 - pow(0.5, 1.0 / 15)) * pow(pow(0.5, 1.0 / 15), t.i - j.i) * j.v) AS ema
  FROM daily t JOIN daily j ON t.subject_id = j.subject_id AND j.i <= t.i GROUP BY ALL),
series AS MATERIALIZED (
  SELECT *, avg(ema) OVER (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ema_smooth
  FROM scored)
"""


@query("risk_ema", SERIES_SQL + "SELECT subject_id, day, round(daily_risk, 6) AS daily_risk, round(ema, 6) AS ema FROM series")
def risk_ema(spark, d):
    return risk.risk_ema(risk.daily_risk(posts(spark, d))).select("subject_id", "day", r6("daily_risk"), r6("ema"))


@query(
    "risk_smoothed",
    SERIES_SQL + "SELECT subject_id, day, round(ema, 6) AS ema, round(ema_smooth, 6) AS ema_smooth FROM series",
)
def risk_smoothed(spark, d):
    return risk.risk_series(posts(spark, d)).select("subject_id", "day", r6("ema"), r6("ema_smooth"))


@query(
    "user_header",
    SERIES_SQL + """, r AS (SELECT subject_id, avg(ema_smooth) AS mean_risk, max(ema_smooth) AS peak_risk,
      arg_max(ema_smooth, day) AS current_risk FROM series GROUP BY 1),
    a AS (SELECT subject_id, count(*) AS posts, CAST(min(date) AS DATE) AS first_day, CAST(max(date) AS DATE) AS last_day
      FROM posts GROUP BY 1)
    SELECT a.*, round(mean_risk, 6) AS mean_risk, round(peak_risk, 6) AS peak_risk,
      round(current_risk, 6) AS current_risk, round(current_risk - mean_risk, 6) AS risk_delta
    FROM a JOIN r USING (subject_id)""",
)
def user_header(spark, d):
    return risk.user_header(posts(spark, d)).select(
        "subject_id", "posts", "first_day", "last_day",
        r6("mean_risk"), r6("peak_risk"), r6("current_risk"), r6("risk_delta"),
    )


@query(
    "risk_rankings",
    SERIES_SQL + """SELECT subject_id, round(arg_max(ema, day), 6) AS current_risk, round(avg(ema), 6) AS avg_risk,
      round(max(ema), 6) AS peak_risk FROM series GROUP BY 1 ORDER BY arg_max(ema, day) DESC, subject_id LIMIT 20""",
)
def risk_rankings(spark, d):
    return risk.risk_rankings(posts(spark, d)).select("subject_id", r6("current_risk"), r6("avg_risk"), r6("peak_risk"))


@query(
    "daily_rollup",
    f"""WITH {POSTS_SQL} SELECT subject_id, CAST(date AS DATE) AS day, count(*) AS posts, count(*) AS n_severe,
      round(sum(prob_severe), 6) AS sum_severe, count(*) AS n_moderate, round(sum(prob_moderate), 6) AS sum_moderate,
      count(*) AS n_risk, round(sum(2 * prob_severe + prob_moderate), 6) AS sum_risk, count(*) AS n_texts,
      CAST(sum(length(text)) AS BIGINT) AS sum_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars
    FROM posts GROUP BY 1, 2""",
)
def daily_rollup(spark, d):
    out = rollup.daily_rollup(posts(spark, d))
    return out.select(*[r6(c) if c in ("sum_severe", "sum_moderate", "sum_risk") else F.col(c) for c in out.columns])


# The dashboard's tables in one long form: table, row key, and two numbers.
@query(
    "global_statistics",
    SERIES_SQL + """SELECT 'user_metrics' AS tab, '' AS item, CAST(count(DISTINCT subject_id) AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS b FROM posts
    UNION ALL SELECT 'depression_averages', '', round(avg(prob_severe), 6), round(1 - avg(prob_severe) - avg(prob_moderate), 6) FROM posts
    UNION ALL SELECT 'posts_over_time', strftime(date, '%Y-%m-01'), count(*), 0 FROM posts GROUP BY 2
    UNION ALL SELECT 'weekday_activity', ['Dom','Lun','Mar','Mer','Gio','Ven','Sab'][dayofweek(date) + 1], count(*), 0 FROM posts GROUP BY 2
    UNION ALL SELECT 'post_length_stats', '', round(avg(length(text)), 6), max(length(text)) FROM posts
    UNION ALL SELECT * FROM (SELECT 'top_active_users', CAST(subject_id AS VARCHAR), count(*), 0 FROM posts GROUP BY subject_id ORDER BY count(*) DESC, subject_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'activity_risk', CAST(subject_id AS VARCHAR), count(*), round(avg(prob_severe), 6) FROM posts GROUP BY subject_id
      ORDER BY avg(prob_severe) DESC, count(*) DESC, subject_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'risk_rankings', CAST(subject_id AS VARCHAR), round(arg_max(ema, day), 6), round(max(ema), 6) FROM series GROUP BY subject_id
      ORDER BY arg_max(ema, day) DESC, subject_id LIMIT 20)""",
)
def global_statistics(spark, d):
    tables = rollup.global_statistics(posts(spark, d))
    shape = {
        "user_metrics": (F.lit(""), "num_users", "total_posts"),
        "depression_averages": (F.lit(""), "avg_severe", "avg_none"),
        "posts_over_time": (F.col("month_date"), "posts", None),
        "weekday_activity": (F.col("day_name"), "posts", None),
        "post_length_stats": (F.lit(""), "avg_length", "max_length"),
        "top_active_users": (F.col("subject_id").cast("string"), "post_count", None),
        "activity_risk": (F.col("subject_id").cast("string"), "post_count", "avg_severe"),
        "risk_rankings": (F.col("subject_id").cast("string"), "current_risk", "peak_risk"),
    }
    long = None
    for name, (item, a, b) in shape.items():
        number = F.lit(0.0) if b is None else F.round(F.col(b).cast("double"), 6)
        part = tables[name].select(
            F.lit(name).alias("tab"), item.alias("item"), F.round(F.col(a).cast("double"), 6).alias("a"), number.alias("b")
        )
        long = part if long is None else long.unionByName(part)
    return long
