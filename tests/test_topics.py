import math
import re

from pyspark.sql import functions as F

from registry import infer
from tidemark.functions.stopwords import ENGLISH
from tidemark.operators import topics
from tidemark.plans.lineage import cut


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, topic bigint, text string")


def test_tokens_are_lower_case_words_of_two_or_more(spark):
    df = frame(spark, [(1, 0, "The Café, a b c x1 under_score 42 I'm ÉTÉ")])
    got = [r.term for r in topics.tokenize(df).collect()]
    assert got == ["café", "x1", "under_score", "42", "été"]
    assert [r.term for r in topics.tokenize(frame(spark, [(1, 0, "the cat")]), stop_words=["cat"]).collect()] == ["the"]


def test_terms_are_counted_in_generated_code(spark):
    texts = ["The cat and the DOG, the cat", "the and of", "", None, "é_1 Éé a 42 \U00010400\U00010400 x", "cat\tcat\ncat"]
    df = frame(spark, [(i, i % 2, t) for i, t in enumerate(texts)]).repartition(3)
    for stops in (None, [], ["cat"]):
        found = topics.tokenize(df, stop_words=stops)
        want = [(i, i % 2, w) for i, t in enumerate(texts) for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in (ENGLISH if stops is None else stops)]
        assert sorted(map(tuple, found.collect())) == sorted(want)
    counted = topics.tokenize(df).groupBy("topic", "term").count()
    counted.collect()
    # The generator takes no part in generated code if it calls a function for each term.
    assert re.search(r"\*\(\d+\) Generate explode", counted._jdf.queryExecution().executedPlan().toString())


def test_document_topics_stores_no_texts(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(infer, "cut", lambda df, name="cut": stored.append(df.columns) or cut(df, name))
    rows = infer.document_topics(spark, "/root/testdata/sf0.001").count()
    assert stored and not any("text" in columns for columns in stored)
    assert rows <= spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_scores_and_negative_weights(spark):
    df = frame(spark, [(1, 0, "cat cat dog"), (2, 0, "cat"), (3, -1, "dog bird")])
    got = {(r.topic, r.term): r.score for r in topics.ctfidf(df).collect()}
    assert math.isclose(got[0, "cat"], 3 / 4 * math.log(3 / 3), abs_tol=1e-12)
    assert math.isclose(got[0, "dog"], 1 / 4 * math.log(3 / 2))
    assert math.isclose(got[-1, "bird"], 1 / 2 * math.log(3 / 1))
    frequent = topics.ctfidf(frame(spark, [(1, 0, "cat cat cat cat")])).first()
    assert frequent.score < 0


def test_topic_info_with_few_terms_and_noise(spark):
    df = frame(spark, [(1, 0, "cat cat dog"), (2, 0, "cat fish"), (3, -1, "bird"), (4, 1, "a")])
    got = {r.topic: r for r in topics.topic_info(df).collect()}
    assert got[-1].name == "-1_bird" and got[-1]["count"] == 1
    assert got[0].representation == ["fish", "dog", "cat"] or len(got[0].representation) == 3
    assert got[0].name == "0_" + "_".join(got[0].representation)
    assert got[1].representation == [] and got[1].name == "1" and got[1]["count"] == 1


def test_keywords_are_the_best_ten_with_alphabetical_ties(spark):
    words = [f"w{i:02d}" for i in range(15)]
    df = frame(spark, [(1, 0, " ".join(words)), (2, 1, "other")])
    got = topics.topic_keywords(topics.ctfidf(df)).where("topic = 0").orderBy("rank").collect()
    assert [r.term for r in got] == words[:10]


def test_corpora_are_separate(spark):
    df = spark.createDataFrame(
        [(1, 7, 0, "cat dog"), (2, 7, 0, "cat"), (3, 8, 0, "cat")], "id bigint, subject_id bigint, topic bigint, text string"
    )
    got = {(r.subject_id, r.term): r.score for r in topics.ctfidf(df, by=["subject_id"]).collect()}
    assert math.isclose(got[7, "cat"], 2 / 3 * math.log(2 / 2), abs_tol=1e-12)
    assert math.isclose(got[7, "dog"], 1 / 3 * math.log(2))
    assert got[8, "cat"] == 0.0
    sizes = topics.topic_sizes(df, by=["subject_id"]).collect()
    assert [(r.subject_id, r["count"]) for r in sizes] == [(7, 2), (8, 1)]


def test_labels_fall_back_to_name_and_number(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, -1), (2, 1.0, 3.0, 0), (3, 3.0, 5.0, 0), (4, 9.0, 9.0, 2)], "id int, x double, y double, topic bigint")
    info = spark.createDataFrame([(0, "0_a_b")], "topic bigint, name string")
    got = {r.id: r.topic_label for r in topics.topic_label_lookup(points, info).collect()}
    assert got == {2: "0: 0_a_b", 3: "0: 0_a_b", 4: "2"}
    truth = spark.createDataFrame([(0, "animals", 0.125)], "topic bigint, gt_label string, gt_score double")
    got = {r.id: r.topic_label for r in topics.topic_label_lookup(points, info, truth).collect()}
    assert got == {2: "0: animals (0.12)", 3: "0: animals (0.12)", 4: "2"}
    centre = topics.topic_centroids(points).where("topic = 0").first()
    assert (centre.x, centre.y) == (2.0, 4.0)


def test_plot_preview_always_has_dots(spark):
    df = spark.createDataFrame([("x" * 150,), ("short",)], "text string")
    got = [tuple(r) for r in topics.cluster_points(df).orderBy(F.desc(F.length("text"))).collect()]
    assert got == [("x" * 150, "x" * 100 + "..."), ("short", "short...")]


def test_user_text_is_one_part_for_ordinary_users(spark, posts):
    p = posts([(2, 1, "2020-01-02", 0.1, 0.1, "second"), (1, 1, "2020-01-01", 0.1, 0.1, "first"), (3, 1, "none", 0.1, 0.1, "undated")])
    got = topics.user_topic_text(p).collect()
    assert [(r.part, r.text) for r in got] == [(0, "undated\nfirst\nsecond")]
