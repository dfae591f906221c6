"""Topic sizes, keywords by class-based TF-IDF, labels and texts.

`by` names the columns that separate corpora, such as the user; leave it empty for one corpus.
Texts are tokenised row by row and counted map-side, so a topic is never concatenated and a hot
topic reaches the shuffle as at most one row per term and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.stopwords import ENGLISH
from tidemark.plans.lineage import cut
from tidemark.plans.ordered import text_parts
from tidemark.plans.skew import MIN_ROWS, hot_keys, salted_join


def tokenize(
    posts: DataFrame, keep: Sequence[str] = ("id", "topic"), stop_words: list[str] | None = None
) -> DataFrame:
    """One row per term occurrence: `keep` and `term`."""
    stops = ENGLISH if stop_words is None else stop_words
    # Stop words are left out of the rows, not of the arrays, which would keep this out of generated code.
    found = posts.select(*keep, F.explode(tx.terms("text", [])).alias("term"))
    return found.where(~F.col("term").isin(list(stops))) if stops else found


def topic_sizes(posts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        posts.groupBy(*by, "topic")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(*by, F.desc("count"), "topic")
    )


def topic_term_counts(
    posts: DataFrame, by: Sequence[str] = (), stop_words: list[str] | None = None, *, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Per corpus, topic and term: `n`, the topic's total `topic_total` and the term's `term_total`.

    Topics and terms of more than `min_rows` rows may be joined in slices.
    """
    by = list(by)
    terms = tokenize(posts, [*by, "topic"], stop_words)
    for name in terms.columns:
        terms = terms.where(F.col(name).isNotNull())
    # Stored: totals and hot keys are counted from the counts, and texts are read and tokenised once.
    counts = cut(terms.groupBy(*by, "topic", "term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    topic_key = [*by, "topic"]
    # A topic may hold a third of all terms, and a term may be in every one of very many topics, so both
    # totals are joined back in slices.
    topic_totals = counts.groupBy(*topic_key).agg(F.sum("n").alias("topic_total"))
    hot = hot_keys(counts, topic_key, min_rows=min_rows)
    totalled = salted_join(counts, topic_totals, topic_key, spread=["term"], hot=hot)
    term_key = [*by, "term"]
    term_totals = counts.groupBy(*term_key).agg(F.sum("n").alias("term_total"))
    hot = hot_keys(counts, term_key, min_rows=min_rows)
    return salted_join(totalled, term_totals, term_key, spread=["topic"], hot=hot).select(
        *by, "topic", "term", "n", "topic_total", "term_total"
    )


def ctfidf(posts: DataFrame, by: Sequence[str] = (), stop_words: list[str] | None = None) -> DataFrame:
    """`score`: share of the term in its topic times ln(posts of the corpus / occurrences of the term)."""
    by = list(by)
    counts = topic_term_counts(posts, by, stop_words)
    if by:
        sizes = posts.groupBy(*by).agg(F.count(F.lit(1)).alias("_posts"))
        counts, n_posts = counts.join(sizes, by), F.col("_posts")
    else:
        n_posts = posts.agg(F.count(F.lit(1))).scalar()
    score = (F.col("n") / F.col("topic_total")) * F.ln(n_posts / F.col("term_total"))
    return counts.select(*by, "topic", "term", "n", score.alias("score"))


def topic_keywords(scores: DataFrame, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The best `n` terms of each topic by score, then alphabetically; fewer if it has fewer."""
    # The filter on row_number keeps n terms per topic in each map task before the shuffle.
    best = Window.partitionBy(*by, "topic").orderBy(F.desc("score"), "term")
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select(*by, "topic", "rank", "term", "score")
    )


def topic_info(
    posts: DataFrame, by: Sequence[str] = (), n: int = 10, stop_words: list[str] | None = None
) -> DataFrame:
    """Per topic: posts, keywords in order, and the name `topic_w1_w2_w3`; noise is a topic too."""
    by = list(by)
    words = (
        topic_keywords(ctfidf(posts, by, stop_words), by, n)
        .groupBy(*by, "topic")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]).alias("words"))
    )
    name = F.array_join(
        F.concat(F.array(F.col("topic").cast("string")), F.slice("representation", 1, 3)), "_"
    )
    return (
        posts.groupBy(*by, "topic")
        .agg(F.count(F.lit(1)).alias("count"))
        .join(words, [*by, "topic"], "left")
        .withColumn("representation", F.coalesce("words", F.array().cast("array<string>")))
        .select(*by, "topic", "count", name.alias("name"), "representation", name.alias("custom_name"))
    )


def topic_label_lookup(
    points: DataFrame, info: DataFrame, truth: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Points of real topics with a label: "id: truth (score)", else "id: name", else the id."""
    by = list(by)
    topic = F.col("topic").cast("string")
    if truth is None:
        labels = info.select(*by, "topic", F.concat(topic, F.lit(": "), F.col("name")).alias("_label"))
    else:
        labels = truth.select(
            *by,
            "topic",
            F.concat(topic, F.lit(": "), F.col("gt_label"), F.lit(" ("), tx.two_decimals("gt_score"), F.lit(")")).alias(
                "_label"
            ),
        )
    real = points.where(F.col("topic") != -1)
    return (
        real.join(labels, [*by, "topic"], "left")
        .withColumn("topic_label", F.coalesce("_label", topic))
        .drop("_label")
    )


def topic_centroids(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean x and y of each real topic."""
    return points.where(F.col("topic") != -1).groupBy(*by, "topic").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y")
    )


def cluster_points(points: DataFrame, text: Column | str = "text") -> DataFrame:
    """Rows for the scatter plot: position, topic and text, and a shortened `preview` beside the text."""
    return points.withColumn("preview", tx.preview(text, always_dots=True))


def user_topic_text(
    posts: DataFrame, order: Sequence[str] = ("date", "id"), *, max_chars: int = 10_000_000
) -> DataFrame:
    """All posts of a user joined by line breaks, in order: one row, or several parts for a huge user."""
    return text_parts(posts, ["subject_id"], order, max_chars=max_chars)
