"""Verdicts derived from events: all events of a user give the scores of both reports."""

from pyspark.sql import functions as F

from registry.base import posts, query, r6, table
from tidemark.operators import judge
from tidemark.operators.judge import CRITERIA


def verdicts(spark, d):
    name = F.array(*[F.lit(c) for c in CRITERIA])
    score = F.struct(
        F.element_at(name, (F.col("class") % 5 + 1).cast("int")).alias("key"),
        (F.pmod(F.sum("event_id"), F.lit(5)) + 1).cast("double").alias("value"),
    )
    scores = (
        # Every event counts: its id's last digit tells the side and the criterion.
        table(spark, d, "events")
        .groupBy(F.col("user_id").alias("subject_id"), F.pmod("event_id", F.lit(10)).alias("class"))
        .agg(score.alias("score"))
        # At most five entries on each side.
        .groupBy("subject_id")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("class") < 5, F.col("score"))))).alias("a"),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("class") >= 5, F.col("score"))))).alias("b"),
        )
    )

    def total(side):
        return F.aggregate(F.map_values(side), F.lit(0.0), lambda acc, v: acc + v)

    reason = F.map_from_arrays(
        F.map_keys("a"), F.transform(F.map_keys("a"), lambda k: F.concat(F.lit("about "), k))
    )
    even = F.col("subject_id") % 2 == 0
    return scores.select(
        "subject_id",
        F.struct(
            F.col("a").alias("Report_A"),
            F.col("b").alias("Report_B"),
            F.when(total("a") > total("b"), F.lit("A")).when(total("a") < total("b"), F.lit("B")).otherwise(F.lit("Tie")).alias(
                "Preferred_Report"
            ),
            reason.alias("Criterion_Justifications"),
            F.lit("because").alias("Rationale"),
        ).alias("result"),
        F.struct(
            F.when(even, F.lit("base")).otherwise(F.lit("trajectory")).alias("A"),
            F.when(even, F.lit("trajectory")).otherwise(F.lit("base")).alias("B"),
        ).alias("mapping"),
    )


NAMES = ", ".join(f"'{c}'" for c in CRITERIA)
VERDICTS_SQL = f"""WITH first AS (SELECT user_id AS subject_id, event_id % 10 + 1 AS rank,
    CAST(sum(event_id) AS BIGINT) % 5 + 1 AS score FROM events GROUP BY 1, 2),
  totals AS (SELECT subject_id, coalesce(sum(score) FILTER (rank <= 5), 0) AS ta, coalesce(sum(score) FILTER (rank > 5), 0) AS tb
    FROM first GROUP BY 1),
  verdict_rows AS MATERIALIZED (SELECT t.subject_id, c.i AS place, [{NAMES}][c.i] AS criterion,
    CAST(a.score AS DOUBLE) AS score_a, CAST(b.score AS DOUBLE) AS score_b,
    CASE WHEN ta > tb THEN 'A' WHEN ta < tb THEN 'B' ELSE 'Tie' END AS preferred,
    CASE WHEN t.subject_id % 2 = 0 THEN 'base' ELSE 'trajectory' END AS a,
    CASE WHEN ta = tb THEN 'Tie' WHEN (ta > tb) = (t.subject_id % 2 = 0) THEN 'Base' ELSE 'Trajectory' END AS winner,
    CASE WHEN t.subject_id % 2 = 0 THEN CAST(a.score AS DOUBLE) ELSE CAST(b.score AS DOUBLE) END AS base,
    CASE WHEN t.subject_id % 2 = 0 THEN CAST(b.score AS DOUBLE) ELSE CAST(a.score AS DOUBLE) END AS trajectory
  FROM totals t CROSS JOIN range(1, 6) c(i)
  LEFT JOIN first a ON a.subject_id = t.subject_id AND a.rank = c.i
  LEFT JOIN first b ON b.subject_id = t.subject_id AND b.rank = c.i + 5)
"""


@query(
    "judge_criteria_means",
    VERDICTS_SQL + """SELECT replace(criterion, '_', ' ') AS criterion, round(avg(base), 6) AS avg_base,
    round(avg(coalesce(trajectory, 0)), 6) AS avg_trajectory, count(*) AS n FROM verdict_rows WHERE base IS NOT NULL GROUP BY 1""",
)
def judge_criteria_means(spark, d):
    return judge.judge_criteria_means(verdicts(spark, d)).select("criterion", r6("avg_base"), r6("avg_trajectory"), "n")


@query(
    "criterion_label",
    VERDICTS_SQL + "SELECT subject_id, replace(criterion, '_', ' ') AS criterion FROM verdict_rows WHERE score_a IS NOT NULL",
)
def criterion_label(spark, d):
    from tidemark.functions.text import criterion_label

    names = verdicts(spark, d).select("subject_id", F.explode(F.map_keys("result.Report_A")).alias("name"))
    return names.select("subject_id", criterion_label("name").alias("criterion"))


@query(
    "judge_preferences",
    VERDICTS_SQL + """SELECT count(*) FILTER (winner = 'Base') AS base, count(*) FILTER (winner = 'Trajectory') AS trajectory,
    count(*) FILTER (winner = 'Tie') AS tie, count(*) AS total_evals FROM verdict_rows WHERE place = 1""",
)
def judge_preferences(spark, d):
    return judge.judge_preferences(verdicts(spark, d))


@query(
    "judge_user_table",
    VERDICTS_SQL + """SELECT subject_id, CASE winner WHEN 'Tie' THEN 'Tie' ELSE 'Narrative ' || winner END AS winner,
    replace(criterion, '_', ' ') AS criterion, coalesce(base, 0) AS score_base, coalesce(trajectory, 0) AS score_trajectory,
    CASE WHEN score_a IS NULL THEN '' ELSE 'about ' || criterion END AS justification FROM verdict_rows""",
)
def judge_user_table(spark, d):
    return judge.judge_user_table(verdicts(spark, d)).drop("position")


@query(
    "ab_assignment",
    """SELECT DISTINCT user_id AS subject_id, CASE WHEN ascii(right(md5(user_id || ':7'), 1)) % 2 = 0
    THEN 'base' ELSE 'trajectory' END AS a FROM events""",
)
def ab_assignment(spark, d):
    users = posts(spark, d).select("subject_id").distinct()
    return judge.ab_assignment(users, seed=7).select("subject_id", F.col("mapping.A").alias("a"))
