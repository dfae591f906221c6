"""Delimited files in and out, and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.dates import DATE_FORMATS
from tidemark.operators.clean import typed_posts
from tidemark.schema import LABELS, POST_COLUMNS
from tidemark.sources.ids import with_ids
from tidemark.sources.records import read_csv

# Quotes inside a field are doubled, as CSV writers other than Spark's do by default.
CSV = {"header": "true", "quote": '"', "escape": '"'}


def read_labels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless `subjectN <tab> label` lines to (subject_id, label)."""
    raw = spark.read.schema(LABELS).option("sep", "\t").csv(path)
    return raw.select(text.normalise_subject("subject").alias("subject_id"), "label")


def load_posts_csv(
    spark: SparkSession, path: str, *, multi_line: bool = True, numeric_subject: bool = True,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Classified posts from CSV, with our column names and types, and an `id` where the files have none.

    Fields may hold line breaks; a file is read in parts by many tasks all the same.  `multi_line=False` spares a pass
    over files known to have none.  Unknown columns keep their stripped names.
    """
    raw = read_csv(spark, path, CSV) if multi_line else spark.read.options(**CSV).csv(path)
    stripped = [name.strip() for name in raw.columns]
    posts = raw.toDF(*[POST_COLUMNS.get(name, name) for name in stripped])
    missing = {"subject_id", "date", "text"} - set(posts.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)} in {path}")
    if "predicted_label" in posts.columns:
        posts = posts.withColumn("predicted_label", F.col("predicted_label").try_cast("int"))
    posts = posts if "id" in posts.columns else with_ids(posts)
    return typed_posts(posts, numeric_subject=numeric_subject, date_formats=date_formats)


def export_sorted(posts: DataFrame, path: str, *, ties: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write posts as CSV in the order of numeric subject and date, then `ties`.

    The sort is range-partitioned: part files are in order.  A row hash comes last, so that a hot
    subject or even a hot subject and date spreads over several files.
    """
    order = [F.col("subject_id").try_cast("bigint"), F.col("date"), *ties, F.xxhash64(*posts.columns)]
    posts.orderBy(*order).write.mode(mode).options(**CSV).csv(path)


def write_results(df: DataFrame, path: str, by: Sequence[str] = ("subject_id",), mode: str = "overwrite") -> None:
    """Write one Parquet table for all users, clustered by `by`.

    Range partitions keep a user's rows together, so reading one user touches few row groups; the row
    hash lets a user too large for one file spread over neighbouring ones.
    """
    order = [*by, F.xxhash64(*df.columns)]
    df.repartitionByRange(*order).sortWithinPartitions(*by).write.mode(mode).parquet(path)
