"""The registry and the views of the given tables that feed the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without `sql` only its rows are checked."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classified posts."""
    severe = F.col("value") / (F.col("value") + F.lit(50.0))
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("subject_id"),
            F.col("ts").alias("date"),
            F.concat_ws(" ", "event_type", "props").alias("text"),
            severe.alias("prob_severe"),
        )
        .withColumn("prob_moderate", (F.lit(1.0) - F.col("prob_severe")) * F.lit(0.5))
        .withColumn("prob_not", F.lit(1.0) - F.col("prob_severe") - F.col("prob_moderate"))
    )


POSTS_SQL = """posts AS (
  SELECT event_id AS id, user_id AS subject_id, ts AS date, concat_ws(' ', event_type, props) AS text,
         value / (value + 50.0) AS prob_severe, (1.0 - value / (value + 50.0)) * 0.5 AS prob_moderate
  FROM events)"""


def r6(name: str, source: str | None = None):
    """A double rounded for comparison."""
    return F.round(F.col(source or name), 6).alias(name)


def every(column: str, step: int, first: int):
    """The sum of each `step`th entry of an array from the one at `first`."""
    some = F.filter(F.col(column), lambda _, i: i % F.lit(step) == F.lit(first))
    return F.aggregate(some, F.lit(0.0), lambda total, x: total + x.cast("double"))
