"""Cleaning raw posts, joining labels, typing and filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scores, text
from tidemark.schema import PROBABILITIES


def filter_nonempty(posts: DataFrame, column: str = "text") -> DataFrame:
    return posts.where(F.length(column) > 0)


def clean_posts(raw: DataFrame) -> DataFrame:
    """Cleaned title and text; rows whose cleaned text is empty are dropped."""
    return filter_nonempty(
        raw.select(
            "subject_id",
            "chunk",
            "date",
            "info",
            text.clean_text("title").alias("title"),
            text.clean_text("text").alias("text"),
        )
    )


def filter_user(posts: DataFrame, subject_id: object) -> DataFrame:
    """Posts of one user; the predicate reaches the file scan."""
    return posts.where(F.col("subject_id") == (subject_id if isinstance(subject_id, Column) else F.lit(subject_id)))


def label_left_join(
    posts: DataFrame,
    labels: DataFrame,
    *,
    on: str = "subject_id",
) -> DataFrame:
    """Posts with their subject's label; unlabelled posts stay, duplicate labels fan out.

    Adaptive execution broadcasts labels of small size and splits a hot subject otherwise.
    """
    return posts.join(labels, on, "left")


def rejected_dates(raw: DataFrame, column: str = "date", formats: Sequence[str] = dates.DATE_FORMATS) -> DataFrame:
    """One row: `dates`, how many texts there are, and `rejected`, how many of them are not read as a date."""
    given = F.col(column).isNotNull()
    return raw.agg(
        F.count_if(given).alias("dates"),
        F.count_if(given & dates.coerce_date(F.col(column), formats).isNull()).alias("rejected"),
    )


def typed_posts(
    posts: DataFrame, *, numeric_subject: bool = True, date_formats: Sequence[str] = dates.DATE_FORMATS
) -> DataFrame:
    """Typed columns from text ones: dates and ids coerced, unreadable and NaN scores to null.

    `numeric_subject=False` keeps ids as text, for data whose ids are not numbers.
    """
    out = posts
    kinds = dict(posts.dtypes)
    if kinds.get("subject_id") == "string":
        bare = text.normalise_subject("subject_id")
        out = out.withColumn("subject_id", bare.try_cast("bigint") if numeric_subject else bare)
    if kinds.get("date") == "string":
        out = out.withColumn("date", dates.coerce_date(F.col("date"), date_formats))
    for name in PROBABILITIES:
        if name in kinds:
            out = out.withColumn(name, scores.nan_to_null(F.col(name).try_cast("double")))
    return out
