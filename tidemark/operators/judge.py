"""A/B verdicts between the base and the trajectory report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import criterion_label, two_decimals

# Criteria of the per-user table, in display order.
CRITERIA = [
    "Trajectory_Coverage",
    "Temporal_Coherence",
    "Change_Point_Sensitivity",
    "Segment_Level_Specificity",
    "Overall_Preference",
]


def ab_assignment(reports: DataFrame, seed: int = 0) -> DataFrame:
    """Blind, reproducible assignment: which report is shown as A and which as B."""
    digest = F.md5(F.concat_ws(":", F.col("subject_id").cast("string"), F.lit(str(seed))))
    base_first = F.ascii(F.right(digest, F.lit(1))) % 2 == 0
    mapping = F.when(
        base_first, F.struct(F.lit("base").alias("A"), F.lit("trajectory").alias("B"))
    ).otherwise(F.struct(F.lit("trajectory").alias("A"), F.lit("base").alias("B")))
    return reports.withColumn("mapping", mapping)


def _sides(verdicts: DataFrame) -> DataFrame:
    """Scores of both reports and the winner, with A and B resolved.

    The two ids are resolved independently: a report named under neither letter counts as B.
    """
    base = F.when(F.col("mapping.A") == "base", F.lit("A")).otherwise(F.lit("B"))
    trajectory = F.when(F.col("mapping.A") == "trajectory", F.lit("A")).otherwise(F.lit("B"))

    def scores(side: Column) -> Column:
        return F.when(side == "A", F.col("result.Report_A")).otherwise(F.col("result.Report_B"))

    preferred = F.col("result.Preferred_Report")
    return verdicts.select(
        "*",
        scores(base).alias("base_scores"),
        scores(trajectory).alias("trajectory_scores"),
        F.when(preferred == base, F.lit("Base"))
        .when(preferred == trajectory, F.lit("Trajectory"))
        .otherwise(F.lit("Tie"))
        .alias("winner"),
    )


def judge_criteria_means(verdicts: DataFrame) -> DataFrame:
    """Mean score per criterion named in the base report; a score missing on the other side counts 0."""
    return (
        _sides(verdicts)
        .select(F.explode("base_scores").alias("criterion", "base"), "trajectory_scores")
        .groupBy("criterion")
        .agg(
            F.avg(F.coalesce("base", F.lit(0.0))).alias("avg_base"),
            F.avg(F.coalesce(F.try_element_at("trajectory_scores", F.col("criterion")), F.lit(0.0))).alias(
                "avg_trajectory"
            ),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            criterion_label("criterion").alias("criterion"),
            "avg_base",
            "avg_trajectory",
            two_decimals("avg_base").alias("base_text"),
            two_decimals("avg_trajectory").alias("trajectory_text"),
            "n",
        )
    )


def judge_preferences(verdicts: DataFrame) -> DataFrame:
    """Wins of each report, ties, and the number of verdicts."""
    return _sides(verdicts).agg(
        F.count_if(F.col("winner") == "Base").alias("base"),
        F.count_if(F.col("winner") == "Trajectory").alias("trajectory"),
        F.count_if(F.col("winner") == "Tie").alias("tie"),
        F.count(F.lit(1)).alias("total_evals"),
    )


def judge_user_table(verdicts: DataFrame, criteria: list[str] | None = None) -> DataFrame:
    """Per user and criterion: both scores (0 if missing), the justification, and the winner."""
    names = F.array(*[F.lit(c) for c in (CRITERIA if criteria is None else criteria)])
    zero = F.lit(0.0)
    return (
        _sides(verdicts)
        .select("*", F.posexplode(names).alias("position", "name"))
        .select(
            "subject_id",
            F.when(F.col("winner") == "Tie", F.col("winner"))
            .otherwise(F.concat(F.lit("Narrative "), F.col("winner")))
            .alias("winner"),
            "position",
            criterion_label("name").alias("criterion"),
            F.coalesce(F.try_element_at("base_scores", F.col("name")), zero).alias("score_base"),
            F.coalesce(F.try_element_at("trajectory_scores", F.col("name")), zero).alias("score_trajectory"),
            F.coalesce(
                F.try_element_at("result.Criterion_Justifications", F.col("name")), F.lit("")
            ).alias("justification"),
        )
    )
