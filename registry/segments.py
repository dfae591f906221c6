"""Segments and phases of the smoothed risk series."""

from pyspark.sql import functions as F

from registry.base import posts, query, r6
from registry.risk import SERIES_SQL
from tidemark.functions.scores import point_line_distance
from tidemark.operators import risk, segments
from tidemark.plans.lineage import cut


def series(spark, d):
    return risk.risk_series(posts(spark, d)).withColumn("ema_smooth", F.round("ema_smooth", 9))


def segments_sql(k: int) -> str:
    """Rounds as CTEs: nearest breakpoints around every row, then the farthest row becomes one."""
    ctes = [
        """b0 AS MATERIALIZED (SELECT subject_id, day, i, round(ema_smooth, 9) AS y,
        CAST(date_diff('day', min(day) OVER u, day) AS DOUBLE) AS x,
        (i = 1 OR i = max(i) OVER u) AS bp FROM series WINDOW u AS (PARTITION BY subject_id))"""
    ]
    for r in range(1, k):
        ctes.append(f"""e{r} AS MATERIALIZED (SELECT *,
          last_value(CASE WHEN bp THEN x END IGNORE NULLS) OVER p AS x1, last_value(CASE WHEN bp THEN y END IGNORE NULLS) OVER p AS y1,
          first_value(CASE WHEN bp THEN x END IGNORE NULLS) OVER f AS x2, first_value(CASE WHEN bp THEN y END IGNORE NULLS) OVER f AS y2
          FROM b{r - 1}
          WINDOW p AS (PARTITION BY subject_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 f AS (PARTITION BY subject_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""")
        ctes.append(f"""d{r} AS MATERIALIZED (SELECT *, CASE WHEN NOT bp THEN
          abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / sqrt((y2 - y1) * (y2 - y1) + (x2 - x1) * (x2 - x1)) END AS dist
          FROM e{r})""")
        ctes.append(f"""b{r} AS MATERIALIZED (SELECT subject_id, day, i, y, x, bp OR (coalesce(dist, 0) > 0 AND
          row_number() OVER (PARTITION BY subject_id ORDER BY coalesce(dist, -1) DESC, i) = 1) AS bp FROM d{r})""")
    ctes.append(f"""seg AS MATERIALIZED (SELECT subject_id, seg_no, start_date, end_date, start_val, end_val FROM (
        SELECT subject_id, CAST(row_number() OVER w AS INTEGER) AS seg_no, day AS start_date, lead(day) OVER w AS end_date,
          y AS start_val, lead(y) OVER w AS end_val FROM b{k - 1} WHERE bp
        WINDOW w AS (PARTITION BY subject_id ORDER BY i)) WHERE end_date IS NOT NULL)""")
    return SERIES_SQL + ", " + ", ".join(ctes) + " "


SEG = "SELECT subject_id, seg_no, start_date, end_date, round(start_val, 6) AS start_val, round(end_val, 6) AS end_val FROM seg"


def rounded(segs):
    return segs.select("subject_id", "seg_no", "start_date", "end_date", r6("start_val"), r6("end_val"))


@query("segments", segments_sql(10) + SEG)
def all_segments(spark, d):
    return rounded(segments.segments(series(spark, d), k=10))


@query("segments_k4", segments_sql(4) + SEG)
def segments_k4(spark, d):
    return rounded(segments.segments(series(spark, d), k=4))


@query("breakpoints", segments_sql(4) + "SELECT subject_id, seg_no, end_date AS day, round(end_val, 6) AS score FROM seg")
def breakpoints(spark, d):
    return segments.breakpoints(segments.segments(series(spark, d), k=4)).select("subject_id", "seg_no", "day", r6("score"))


@query(
    "segment_trend",
    segments_sql(4) + """SELECT subject_id, start_date AS day, round(start_val, 6) AS score FROM seg
    UNION SELECT subject_id, end_date, round(end_val, 6) FROM seg""",
)
def segment_trend(spark, d):
    return segments.segment_trend(segments.segments(series(spark, d), k=4)).select("subject_id", "day", r6("score"))


@query(
    "phase_breaks",
    segments_sql(4) + """SELECT subject_id, seg_no AS phase_num, start_date, end_date,
    round(end_val - start_val, 6) AS delta FROM seg""",
)
def phase_breaks(spark, d):
    return segments.phase_breaks(segments.segments(series(spark, d), k=4)).select(
        "subject_id", "phase_num", "start_date", "end_date", r6("delta")
    )


@query(
    "series_by_segment",
    segments_sql(4) + """SELECT s.subject_id, s.day, g.seg_no, round(s.ema_smooth, 6) AS ema_smooth
    FROM series s JOIN seg g ON s.subject_id = g.subject_id AND s.day BETWEEN g.start_date AND g.end_date""",
)
def series_by_segment(spark, d):
    segs = segments.segments(series(spark, d), k=4)
    return segments.series_by_segment(risk.risk_series(posts(spark, d)), segs).select(
        "subject_id", "day", "seg_no", r6("ema_smooth")
    )


PHASE_POSTS = """SELECT p.subject_id, p.id, p.date, p.text, g.seg_no AS phase_num, g.start_date, g.end_date,
    round(g.end_val - g.start_val, 6) AS delta
    FROM posts p JOIN seg g ON p.subject_id = g.subject_id AND """


def _phase_posts(spark, d, **kw):
    segs = cut(segments.segments(series(spark, d), k=4), "segments")
    return segments.phase_posts(posts(spark, d), segs, **kw).select(
        "subject_id", "id", "date", "text", "phase_num", "start_date", "end_date", r6("delta")
    )


@query(
    "phase_posts",
    segments_sql(4) + PHASE_POSTS + "p.date >= CAST(g.start_date AS TIMESTAMP) AND p.date <= CAST(g.end_date AS TIMESTAMP)",
)
def phase_posts(spark, d):
    return _phase_posts(spark, d)


@query(
    "phase_posts_whole_days",
    segments_sql(4) + PHASE_POSTS + "CAST(p.date AS DATE) BETWEEN g.start_date AND g.end_date",
)
def phase_posts_whole_days(spark, d):
    return _phase_posts(spark, d, end_of_day=True)


@query(
    "days_since_start",
    SERIES_SQL + "SELECT subject_id, day, CAST(date_diff('day', min(day) OVER (PARTITION BY subject_id), day) AS INTEGER) AS x FROM series",
)
def days_since_start(spark, d):
    return segments.days_since_start(risk.daily_risk(posts(spark, d))).select("subject_id", "day", "x")


@query(
    "point_line_distance",
    SERIES_SQL + """, ends AS (SELECT subject_id, max(x) AS x2, arg_min(y, x) AS y1, arg_max(y, x) AS y2 FROM (
        SELECT subject_id, CAST(i AS DOUBLE) AS x, daily_risk AS y FROM series) GROUP BY 1)
    SELECT s.subject_id, s.day, round(CASE WHEN x2 = 1 AND y1 = y2 THEN 0 ELSE
        abs((y2 - y1) * i - (x2 - 1) * daily_risk + x2 * y1 - y2 * 1.0) / sqrt(pow(y2 - y1, 2) + pow(x2 - 1, 2)) END, 6) AS distance
    FROM series s JOIN ends e USING (subject_id)""",
)
def distance(spark, d):
    from pyspark.sql import Window

    user = Window.partitionBy("subject_id")
    s = (
        risk.daily_risk(posts(spark, d))
        .withColumn("x", F.row_number().over(user.orderBy("day")).cast("double"))
        .withColumn("x2", F.max("x").over(user))
        .withColumn("y1", F.min_by("daily_risk", "x").over(user))
        .withColumn("y2", F.max_by("daily_risk", "x").over(user))
    )
    far = point_line_distance(F.col("x"), F.col("daily_risk"), F.lit(1.0), F.col("y1"), F.col("x2"), F.col("y2"))
    return s.select("subject_id", "day", F.round(far, 6).alias("distance"))
