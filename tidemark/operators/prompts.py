"""Prompt tables: one row per piece of work for a language model.

Templates are parameters with named fields; the defaults state the task briefly in our own words.
Posts are never cut or elided: a block longer than `max_chars` continues in further parts, each its
own prompt, and ordinary users have the single part 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import two_decimals
from tidemark.operators.judge import CRITERIA
from tidemark.plans.ordered import text_parts

MAX_CHARS = 400_000

BASE = (
    "Below are all posts of one person in time order, each with its time.\n\n{posts}\n\n"
    "Write one continuous account, without headings or lists, of how the person's mood develops from the "
    "first post to the last, and say which posts sound depressed and when that is strongest."
)
PHASE = (
    "Below are the posts of phase {phase} of one person, each with its time.\n\n{posts}\n\n"
    "Mean score per day: {scores}\nChange of the score over the phase: {delta}\n\n"
    "Use the numbers only as background. In one paragraph of at most 100 words, headed "
    "'Phase {phase} (from {start} to {end}):', describe how the mood develops within this phase alone."
)
SUMMARY = (
    "Below are descriptions of the successive phases of one person.\n\n{phases}\n\n"
    "In one paragraph of at most 200 words and without dates, describe the path across all phases: what "
    "recurs, what changes, and where the direction turns."
)
JUDGE = (
    "Compare two reports about the same person and rate each from 1 (poor) to 5 (excellent) on: {criteria}.\n\n"
    "Report A:\n{report_a}\n\nReport B:\n{report_b}\n\n"
    "Answer in JSON with the keys Report_A and Report_B (a score per criterion), Preferred_Report (A, B or "
    "Tie), Criterion_Justifications (two sentences per criterion) and Rationale."
)
TOPICS = (
    "Text:\n{text}\n\nList 10 to 20 specific topics of this text as phrases of 6 to 15 words, keeping concrete "
    "details. Sort each into one of three lists by its mood and answer in JSON with the keys positivetopics, "
    "neutraltopics and negativetopics."
)
CORPUS = (
    "Below are evaluations of paired reports as JSON.\n\n{verdicts}\n\n"
    "For each criterion write one sentence that sums up how the two kinds of report compare over all "
    "evaluations, without numbers. Answer in JSON under the key Criterion_Justifications."
)
MERGE = (
    "Below are several summaries, each of one part of the evaluations of paired reports.\n\n{summaries}\n\n"
    "Merge them: for each criterion one sentence that holds over all parts, without numbers. Answer in JSON "
    "under the key Criterion_Justifications."
)


def fill(template: str, **values: Column) -> Column:
    """The template with its named fields replaced by columns; field-like text in values is left alone."""
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            pieces.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*pieces)


def _lines(posts: DataFrame) -> DataFrame:
    time = F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("undated"))
    return posts.withColumn("_line", F.concat(F.lit("["), time, F.lit("] "), F.coalesce("text", F.lit(""))))


def base_prompts(
    posts: DataFrame, template: str = BASE, *, order: Sequence[str] = ("date", "id"), max_chars: int = MAX_CHARS
) -> DataFrame:
    """(subject_id, part, n_posts, prompt) over all posts of each user."""
    blocks = text_parts(_lines(posts), ["subject_id"], order, "_line", max_chars=max_chars)
    return blocks.select(
        "subject_id", "part", F.col("n_texts").alias("n_posts"), fill(template, posts=F.col("text")).alias("prompt")
    )


def phase_prompts(
    phase_posts: DataFrame,
    daily: DataFrame,
    phases: DataFrame,
    template: str = PHASE,
    *,
    order: Sequence[str] = ("date", "id"),
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """(subject_id, phase_num, part, n_posts, prompt); a phase without posts has a prompt too.

    `phase_posts`, `phases` come from `operators.segments`, `daily` is the daily risk of the user.
    """
    blocks = text_parts(
        _lines(phase_posts), ["subject_id", "phase_num"], order, "_line", max_chars=max_chars
    )
    # A user has one score per active day.
    scores = daily.groupBy("subject_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("day", "daily_risk"))),
                lambda r: F.concat(r["day"].cast("string"), F.lit("="), F.format_string("%.4f", r["daily_risk"])),
            ),
            ", ",
        ).alias("scores")
    )
    prompt = fill(
        template,
        posts=F.col("text"),
        scores=F.col("scores"),
        phase=F.col("phase_num"),
        delta=two_decimals("delta"),
        start=F.col("start_date"),
        end=F.col("end_date"),
    )
    per_phase = phases.join(scores, "subject_id", "left")
    return per_phase.join(blocks, ["subject_id", "phase_num"], "left").select(
        "subject_id",
        "phase_num",
        F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        F.coalesce("n_texts", F.lit(0).cast("bigint")).alias("n_posts"),
        prompt.alias("prompt"),
    )


def summary_prompts(phases: DataFrame, template: str = SUMMARY) -> DataFrame:
    """(subject_id, prompt) over the narratives of a user's phases, in order."""
    # A user has at most k phases.
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("phase_num", "narrative"))), lambda p: p["narrative"]), "\n\n"
    )
    return phases.groupBy("subject_id").agg(text.alias("_text")).select(
        "subject_id", fill(template, phases=F.col("_text")).alias("prompt")
    )


def judge_prompts(reports: DataFrame, template: str = JUDGE, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """(subject_id, mapping, prompt) from base_analysis, report and the mapping of `ab_assignment`."""
    base_first = F.col("mapping.A") == "base"
    return reports.select(
        "subject_id",
        "mapping",
        fill(
            template,
            criteria=F.lit(", ".join(criteria)),
            report_a=F.when(base_first, F.col("base_analysis")).otherwise(F.col("report")),
            report_b=F.when(base_first, F.col("report")).otherwise(F.col("base_analysis")),
        ).alias("prompt"),
    )


def topic_prompts(
    posts: DataFrame,
    reports: DataFrame | None = None,
    template: str = TOPICS,
    *,
    order: Sequence[str] = ("date", "id"),
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """(subject_id, source, part, prompt) for the posts and, where given, both narratives of a user."""
    from_posts = text_parts(posts, ["subject_id"], order, max_chars=max_chars).select(
        "subject_id", F.lit("posts").alias("source"), "part", "text"
    )
    texts = from_posts
    if reports is not None:
        sources = F.array(
            F.struct(F.lit("narrative_base").alias("source"), F.col("base_analysis").alias("text")),
            F.struct(F.lit("narrative_traj").alias("source"), F.col("trajectory_summary").alias("text")),
        )
        narratives = reports.select("subject_id", F.explode(sources).alias("s")).select(
            "subject_id", "s.source", F.lit(0).cast("bigint").alias("part"), "s.text"
        )
        texts = from_posts.unionByName(narratives)
    return texts.where(F.length("text") > 0).select(
        "subject_id", "source", "part", fill(template, text=F.col("text")).alias("prompt")
    )


def corpus_summary_prompts(
    verdicts: DataFrame, template: str = CORPUS, *, document: str = "document", max_chars: int = 100_000
) -> DataFrame:
    """(part, n_verdicts, prompt) over all verdicts in user order, as JSON lists of about `max_chars` characters.

    No verdict is cut or left out, also of users with several or with equal ones.  The answers to several
    parts go into `corpus_merge_prompts`.
    """
    counted = verdicts.groupBy("subject_id", F.col(document).alias("document")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    parts = text_parts(each, [], ["subject_id", "document", "copy"], "document", max_chars=max_chars, separator=", ")
    listed = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    return parts.select("part", F.col("n_texts").alias("n_verdicts"), fill(template, verdicts=listed).alias("prompt"))


def corpus_merge_prompts(
    answers: DataFrame, template: str = MERGE, *, answer: str = "response", max_chars: int = 100_000
) -> DataFrame:
    """(part, n_answers, prompt) that merge the answers to the parts of a corpus summary, in part order.

    A single row unless the answers themselves exceed `max_chars`; then merge its answers again.
    """
    placed = answers.select(F.col("part").alias("place"), F.col(answer).alias("_answer"))
    parts = text_parts(placed, [], ["place"], "_answer", max_chars=max_chars, separator="\n\n")
    return parts.select("part", F.col("n_texts").alias("n_answers"), fill(template, summaries=F.col("text")).alias("prompt"))
