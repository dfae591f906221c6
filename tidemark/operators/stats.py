"""Dataset-wide statistics. Every aggregate combines map-side before it shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scores, text


def user_metrics(posts: DataFrame) -> DataFrame:
    """Distinct users, posts, and posts per user; zeros for an empty table."""
    # Counting per user first keeps the distinct step on one row per user and partition.
    return metrics_of_users(posts.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")), "n")


def metrics_of_users(per_user: DataFrame, posts: str) -> DataFrame:
    """The same from one row per user with its number of posts; zeros for none."""
    return per_user.agg(
        F.count("subject_id").alias("num_users"),
        F.coalesce(F.sum(posts), F.lit(0)).cast("bigint").alias("total_posts"),
    ).withColumn(
        "avg_posts_user",
        F.coalesce(F.try_divide(F.col("total_posts").cast("double"), F.col("num_users")), F.lit(0.0)),
    )


def depression_averages(posts: DataFrame) -> DataFrame:
    return posts.agg(F.avg("prob_severe").alias("avg_severe"), F.avg("prob_moderate").alias("avg_moderate"))


def non_depressed_estimate(posts: DataFrame) -> DataFrame:
    return depression_averages(posts).withColumn(
        "avg_none", scores.non_depressed_estimate(F.col("avg_severe"), F.col("avg_moderate"))
    )


def posts_over_time(posts: DataFrame) -> DataFrame:
    """Posts per month, in month order; posts without a date form a null month."""
    return (
        posts.groupBy(dates.month_bucket(F.col("date")).alias("month_date"))
        .agg(F.count(F.lit(1)).alias("posts"))
        .orderBy("month_date")
    )


def top_active_users(posts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        posts.groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("post_count"))
        .orderBy(F.desc("post_count"), "subject_id")
        .limit(limit)
    )


def weekday_activity(posts: DataFrame) -> DataFrame:
    """Posts per weekday, 1 = Sunday; posts without a date form a null weekday."""
    return (
        posts.groupBy(F.dayofweek("date").alias("day_of_week"))
        .agg(F.count(F.lit(1)).alias("posts"))
        .withColumn("day_name", dates.weekday_label(F.col("day_of_week")))
        .orderBy("day_of_week")
    )


def post_length_stats(posts: DataFrame) -> DataFrame:
    n = text.text_length("text")
    return posts.agg(F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def activity_risk(posts: DataFrame, limit: int = 20) -> DataFrame:
    """Users by mean severe score, then by number of posts."""
    return (
        posts.groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("post_count"), F.avg("prob_severe").alias("avg_severe"))
        .orderBy(F.desc("avg_severe"), F.desc("post_count"), "subject_id")
        .limit(limit)
    )


def score_histogram(posts: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of severe and moderate scores in fixed-width bins over [0, 1]; 1.0 joins the last bin."""
    score = F.explode(
        F.array(
            F.struct(F.lit("severe").alias("score"), F.col("prob_severe").alias("p")),
            F.struct(F.lit("moderate").alias("score"), F.col("prob_moderate").alias("p")),
        )
    )
    return (
        posts.select(score.alias("s"))
        .select("s.score", "s.p")
        .where(F.col("p").isNotNull())
        .groupBy("score", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("posts"))
        .select("score", "bin", (F.col("bin") / F.lit(float(bins))).alias("bin_start"), "posts")
    )


def subject_ids(posts: DataFrame) -> DataFrame:
    return posts.select("subject_id").distinct().orderBy("subject_id")
