"""Top-down piecewise-linear segments of each user's series, and what hangs off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import point_line_distance
from tidemark.plans.skew import equi_join


def days_since_start(series: DataFrame) -> DataFrame:
    """`x`: days since the user's first day."""
    return series.withColumn(
        "x", F.datediff("day", F.min("day").over(Window.partitionBy("subject_id")))
    )


def segments(series: DataFrame, k: int = 10, value: str = "ema_smooth") -> DataFrame:
    """Up to `k` segments per user: (subject_id, seg_no, start_date, end_date, start_val, end_val).

    Each of k - 1 rounds marks one more breakpoint per user: the point farthest from the line of
    the segment it lies in, the earliest one on ties, none if every distance is 0.  A row carries
    the ends of its segment, so a round is one window over the user and needs no shuffle or sort.
    """
    user = Window.partitionBy("subject_id")
    point = F.struct("i", "x", "y")
    rows = (
        series.select(
            "subject_id",
            "day",
            F.col(value).cast("double").alias("y"),
            F.datediff("day", F.min("day").over(user)).cast("double").alias("x"),
            F.row_number().over(user.orderBy("day")).alias("i"),
        )
        .select("*", F.min_by(point, "i").over(user).alias("s"), F.max_by(point, "i").over(user).alias("e"))
        .where(F.col("s.i") < F.col("e.i"))
        .withColumn("is_break", F.col("i").isin(F.col("s.i"), F.col("e.i")))
    )
    i, s, e, best = F.col("i"), F.col("s"), F.col("e"), F.col("best")
    inside = (s["i"] < i) & (i < e["i"])
    distance = F.when(inside, point_line_distance(F.col("x"), F.col("y"), s["x"], s["y"], e["x"], e["y"]))
    farthest = F.max(F.struct(distance.alias("d"), (-i).alias("neg"), "x", "y")).over(user)
    m = -best["neg"]
    hit = F.coalesce((best["d"] > 0) & (s["i"] < m) & (m < e["i"]), F.lit(False))
    split = F.struct(m.alias("i"), best["x"].alias("x"), best["y"].alias("y"))
    for _ in range(k - 1):
        rows = rows.select("*", farthest.alias("best")).select(
            "subject_id",
            "day",
            "y",
            "x",
            "i",
            F.when(hit & (i >= m), split).otherwise(s).alias("s"),
            F.when(hit & (i <= m), split).otherwise(e).alias("e"),
            (F.col("is_break") | (hit & (i == m))).alias("is_break"),
        )
    breaks = rows.where("is_break").select("subject_id", "day", "y", "i")
    order = user.orderBy("i")
    return (
        breaks.withColumn("seg_no", F.row_number().over(order))
        .withColumn("end_date", F.lead("day").over(order))
        .withColumn("end_val", F.lead("y").over(order))
        .where(F.col("end_date").isNotNull())
        .select(
            "subject_id",
            "seg_no",
            F.col("day").alias("start_date"),
            "end_date",
            F.col("y").alias("start_val"),
            "end_val",
        )
    )


def breakpoints(segs: DataFrame) -> DataFrame:
    """The end of every segment."""
    return segs.select("subject_id", "seg_no", F.col("end_date").alias("day"), F.col("end_val").alias("score"))


def segment_trend(segs: DataFrame) -> DataFrame:
    """Points of the piecewise line, shared ends once: the first start, then every end."""
    start = F.struct(F.col("start_date").alias("day"), F.col("start_val").alias("score"))
    end = F.struct(F.col("end_date").alias("day"), F.col("end_val").alias("score"))
    points = F.when(F.col("seg_no") == 1, F.array(start, end)).otherwise(F.array(end))
    return segs.select("subject_id", F.explode(points).alias("p")).select("subject_id", "p.day", "p.score")


def phase_breaks(segs: DataFrame) -> DataFrame:
    """Phases with the change of the score over each."""
    return segs.select(
        "subject_id",
        F.col("seg_no").alias("phase_num"),
        "start_date",
        "end_date",
        (F.col("end_val") - F.col("start_val")).alias("delta"),
    )


def series_by_segment(series: DataFrame, segs: DataFrame) -> DataFrame:
    """Daily rows with their segment; a shared breakpoint day belongs to both segments."""
    # A user has few segments: they meet each day as one list, and only the day's own one or two become rows.
    lists = segs.groupBy("subject_id").agg(F.collect_list(F.struct("seg_no", "start_date", "end_date")).alias("_segs"))
    own = F.filter("_segs", lambda s: F.col("day").between(s["start_date"], s["end_date"]))
    return (
        series.join(lists, "subject_id")
        .withColumn("seg_no", F.explode(F.transform(own, lambda s: s["seg_no"])))
        .drop("_segs")
    )


def phase_posts(posts: DataFrame, segs: DataFrame, *, end_of_day: bool = False) -> DataFrame:
    """One row per post and phase it falls in: `posts` columns plus phase_num, phase bounds and delta.

    A phase runs from midnight of its start to midnight of its end, so posts later on the end day
    belong to the next phase, or to none after the last.  `end_of_day=True` compares days instead.
    Pass stored segments (`plans.lineage.cut`): with their size known, few of them are broadcast and the
    posts are not shuffled.  Rows stay flat; order them by (subject_id, phase_num, date, id), or assemble texts in bounded
    parts with `plans.ordered.text_parts`.
    """
    phases = phase_breaks(segs)
    if end_of_day:
        inside = F.to_date("date").between(F.col("start_date"), F.col("end_date"))
    else:
        kind = dict(posts.dtypes)["date"]
        inside = F.col("date").between(F.col("start_date").cast(kind), F.col("end_date").cast(kind))
    dated = posts.where(F.col("date").isNotNull())
    return equi_join(dated, phases, ["subject_id"], condition=inside)
