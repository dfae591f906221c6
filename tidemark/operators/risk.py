"""Daily risk, exponential decay, smoothing, rankings and per-user post lists.

Only the daily aggregate reads posts, and it combines map-side.  Everything after it holds one row
per user and active day, so a user's series is bounded by the calendar however much they post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import raw_risk


def daily_risk(posts: DataFrame) -> DataFrame:
    """Mean raw risk per user and day; posts without a date have no day."""
    return (
        posts.where(F.col("date").isNotNull())
        .groupBy("subject_id", F.to_date("date").alias("day"))
        .agg(F.avg(raw_risk()).alias("daily_risk"))
    )


def daily_counts(posts: DataFrame) -> DataFrame:
    return (
        posts.where(F.col("date").isNotNull())
        .groupBy("subject_id", F.to_date("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("posts"))
    )


def risk_ema(daily: DataFrame, half_life: float = 15, value: str = "daily_risk") -> DataFrame:
    """`ema`: s = a * previous + (1 - a) * value over observed days, starting from 0.

    The recursion is the prefix sum (1 - a) * a^i * sum(v_j * a^-j).  Powers would overflow on long
    series, so positions restart every 512 half-lives; the last score of the block before is added
    back, and anything older weighs less than 2^-512.  From the first null value on the score is null.
    """
    v = F.col(value).cast("double")
    by_day = Window.partitionBy("subject_id").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.max(v.isNull()).over(so_far)
    if half_life <= 0:
        # A decay factor of 1 never takes up a value: the start of 0 stays.
        return daily.withColumn("ema", F.when(~broken, F.lit(0.0)))

    a = 0.5 ** (1.0 / half_life)
    block = max(1, int(512 * half_life))
    in_block = Window.partitionBy("subject_id", "_blk").orderBy("day")
    # Same order as by_day; naming the block first lets the sort of in_block serve both windows.
    earlier = (
        Window.partitionBy("subject_id").orderBy("_blk", "day").rowsBetween(Window.unboundedPreceding, -1)
    )
    decay = F.lit(a)
    position = F.row_number().over(by_day) - 1
    place = F.col("_l")
    summed = F.sum(v * F.pow(decay, -place)).over(
        in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    block_end = F.last(F.when(place == block - 1, F.col("_loc")), ignorenulls=True).over(earlier)
    carried = F.pow(decay, place + 1) * F.coalesce(block_end, F.lit(0.0))
    return (
        daily.select("*", broken.alias("_broken"), position.alias("_i"))
        .select("*", F.floor(F.col("_i") / F.lit(block)).alias("_blk"), (F.col("_i") % F.lit(block)).alias("_l"))
        .select("*", (F.lit(1.0 - a) * F.pow(decay, place) * summed).alias("_loc"))
        .select(*daily.columns, F.when(~F.col("_broken"), F.col("_loc") + carried).alias("ema"))
    )


def risk_smoothed(scored: DataFrame, window: int = 7) -> DataFrame:
    """`ema_smooth`: centred mean over `window` rows, shorter at both ends."""
    half = window // 2
    centred = Window.partitionBy("subject_id").orderBy("day").rowsBetween(-half, window - 1 - half)
    return scored.withColumn("ema_smooth", F.avg("ema").over(centred))


def risk_series(posts: DataFrame, half_life: float = 15, smoothing: bool = True) -> DataFrame:
    """Posts to (subject_id, day, daily_risk, ema[, ema_smooth])."""
    scored = risk_ema(daily_risk(posts), half_life)
    return risk_smoothed(scored) if smoothing else scored


def user_header(posts: DataFrame, half_life: float = 15) -> DataFrame:
    """Per user: posts, first and last day, mean, peak and current smoothed risk, current minus mean.

    Posts without a date count as posts; they are a series of their own that no risk is read from.
    """
    series = F.struct("subject_id", F.col("date").isNull().alias("undated")).alias("subject_id")
    days = posts.groupBy(series, F.to_date("date").alias("day")).agg(
        F.avg(raw_risk()).alias("daily_risk"),
        F.count(F.lit(1)).alias("posts"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    dated = F.when(~F.col("subject_id.undated"), F.col("ema_smooth"))
    zero = F.lit(0.0)
    return (
        risk_smoothed(risk_ema(days, half_life))
        .groupBy(F.col("subject_id.subject_id").alias("subject_id"))
        .agg(
            F.sum("posts").alias("posts"),
            F.to_date(F.min("first")).alias("first_day"),
            F.to_date(F.max("last")).alias("last_day"),
            F.coalesce(F.avg(dated), zero).alias("mean_risk"),
            F.coalesce(F.max(dated), zero).alias("peak_risk"),
            F.coalesce(F.max_by(dated, "day"), zero).alias("current_risk"),
        )
        .withColumn("risk_delta", F.col("current_risk") - F.col("mean_risk"))
    )


def rank_users(scored: DataFrame, limit: int = 20) -> DataFrame:
    """Users by the latest `ema` of their series, with its mean and peak."""
    return (
        scored.groupBy("subject_id")
        .agg(
            F.max_by("ema", "day").alias("current_risk"),
            F.avg("ema").alias("avg_risk"),
            F.max("ema").alias("peak_risk"),
        )
        .orderBy(F.desc_nulls_last("current_risk"), "subject_id")
        .limit(limit)
    )


def risk_rankings(posts: DataFrame, half_life: float = 15, limit: int = 20) -> DataFrame:
    """Users by their latest unsmoothed decayed risk."""
    return rank_users(risk_series(posts, half_life, smoothing=False), limit)


def _top_per_user(posts: DataFrame, n: int, *order: Column) -> DataFrame:
    # The filter on row_number lets Spark keep n rows per user in each map task before the shuffle.
    ranked = Window.partitionBy("subject_id").orderBy(*order)
    return posts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def recent_posts(posts: DataFrame, n: int = 10) -> DataFrame:
    return _top_per_user(posts, n, F.desc_nulls_last("date"), F.col("id")).select(
        "subject_id", "rank", "id", "date", "text", "prob_severe", "prob_moderate"
    )


def top_severe_posts(posts: DataFrame, n: int = 5) -> DataFrame:
    return _top_per_user(posts, n, F.desc_nulls_last("prob_severe"), F.col("id")).select(
        "subject_id", "rank", "id", "date", "prob_severe", "text"
    )


def top_moderate_posts(posts: DataFrame, n: int = 5) -> DataFrame:
    return _top_per_user(posts, n, F.desc_nulls_last("prob_moderate"), F.col("id")).select(
        "subject_id", "rank", "id", "date", "prob_moderate", "text"
    )
