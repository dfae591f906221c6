"""JSON files that hold one user's topics, reports or verdict each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema

# File name patterns.
VERDICT_FILE = r"eval_(.+)\.json$"
TOPIC_FILE = r"([^/]+)_(posts|narrative_base|narrative_traj)_topics\.json$"
REPORT_FILE = r"([^/]+)\.json$"


def _from_name(pattern: str, group: int = 1) -> Column:
    # The path comes URI-encoded; a plus sign stands for itself in it.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(path, pattern, group)


def _read(spark: SparkSession, path: str, struct, multi_line: bool) -> DataFrame:
    return spark.read.schema(struct).option("multiLine", str(multi_line).lower()).json(path)


def read_eval_json(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Verdicts with the user from the file name; files without scores of both reports and both letters are left out.

    That leaves out damaged files, empty objects and a summary file that happens to match the name pattern.
    """
    return (
        _read(spark, path, schema.VERDICT, multi_line)
        .select(_from_name(VERDICT_FILE).alias("subject_id"), "result", "mapping")
        .where(
            (F.size("result.Report_A") > 0) & (F.size("result.Report_B") > 0)
            & F.col("mapping.A").isNotNull() & F.col("mapping.B").isNotNull()
        )
    )


def read_topic_json(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Topic lists per user and source: subject_id, source, and the three lists."""
    return _read(spark, path, schema.TOPIC_LISTS, multi_line).select(
        _from_name(TOPIC_FILE).alias("subject_id"),
        _from_name(TOPIC_FILE, 2).alias("source"),
        "positivetopics",
        "neutraltopics",
        "negativetopics",
    )


def read_base_reports(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    return (
        _read(spark, path, schema.BASE_REPORT, multi_line)
        .select(_from_name(REPORT_FILE).alias("subject_id"), "base_analysis")
        .where(F.col("base_analysis").isNotNull())
    )


def read_trajectory_reports(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    return (
        _read(spark, path, schema.TRAJECTORY_REPORT, multi_line)
        .select(_from_name(REPORT_FILE).alias("subject_id"), "phases", "trajectory_summary")
        .where(F.col("phases").isNotNull() | F.col("trajectory_summary").isNotNull())
    )
