"""One pass over posts to a table of users and days, and the dashboard tables that follow from it.

The rollup has one row per user and active day and holds counts and sums only, so every table below
is exact and none reads the posts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scores
from tidemark.operators import risk, stats
from tidemark.plans.lineage import cut


def daily_rollup(posts: DataFrame) -> DataFrame:
    """Counts and sums per user and day; posts without a date form a null day."""
    n_chars, raw = F.length("text"), scores.raw_risk()
    return posts.groupBy("subject_id", F.to_date("date").alias("day")).agg(
        F.count(F.lit(1)).alias("posts"),
        F.count("prob_severe").alias("n_severe"),
        F.sum("prob_severe").alias("sum_severe"),
        F.count("prob_moderate").alias("n_moderate"),
        F.sum("prob_moderate").alias("sum_moderate"),
        F.count(raw).alias("n_risk"),
        F.sum(raw).alias("sum_risk"),
        F.count(n_chars).alias("n_texts"),
        F.sum(n_chars.cast("bigint")).alias("sum_chars"),
        F.min(n_chars).alias("min_chars"),
        F.max(n_chars).alias("max_chars"),
    )


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.sum(total), F.sum(n))


def daily_risk(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("day").isNotNull()).select(
        "subject_id", "day", F.try_divide("sum_risk", "n_risk").alias("daily_risk")
    )


def global_statistics(posts: DataFrame, half_life: float = 15) -> dict[str, DataFrame]:
    """All dataset-wide tables from one scan of the posts; the rollup is written once.

    The score histogram needs the single scores and has its own operator.
    """
    days = cut(daily_rollup(posts), "rollup")
    users = days.groupBy("subject_id").agg(
        F.sum("posts").alias("post_count"), _mean("sum_severe", "n_severe").alias("avg_severe")
    )
    averages = days.agg(
        _mean("sum_severe", "n_severe").alias("avg_severe"), _mean("sum_moderate", "n_moderate").alias("avg_moderate")
    )
    return {
        "user_metrics": stats.metrics_of_users(users, "post_count"),
        "depression_averages": averages.withColumn(
            "avg_none", scores.non_depressed_estimate(F.col("avg_severe"), F.col("avg_moderate"))
        ),
        "posts_over_time": days.groupBy(dates.month_bucket(F.col("day")).alias("month_date"))
        .agg(F.sum("posts").alias("posts"))
        .orderBy("month_date"),
        "top_active_users": users.select("subject_id", "post_count")
        .orderBy(F.desc("post_count"), "subject_id")
        .limit(10),
        "weekday_activity": days.groupBy(F.dayofweek("day").alias("day_of_week"))
        .agg(F.sum("posts").alias("posts"))
        .withColumn("day_name", dates.weekday_label(F.col("day_of_week")))
        .orderBy("day_of_week"),
        "post_length_stats": days.agg(
            _mean("sum_chars", "n_texts").alias("avg_length"),
            F.min("min_chars").alias("min_length"),
            F.max("max_chars").alias("max_length"),
        ),
        "activity_risk": users.orderBy(F.desc("avg_severe"), F.desc("post_count"), "subject_id").limit(20),
        "risk_rankings": risk.rank_users(risk.risk_ema(daily_risk(days), half_life)),
    }
