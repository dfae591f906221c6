"""Skew-safe building blocks, and the shape of the physical plans."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import clean, risk, stats, topics
from tidemark.plans.lineage import cut, scratch_path
from tidemark.plans.ordered import running_total, text_parts
from tidemark.plans.skew import hot_keys, salted_join

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=4000):
    """A third of the rows has key 1, some have none."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k")
    )


def test_hot_keys_are_few_and_salted(spark):
    hot = hot_keys(skewed(spark), ["k"], share=0.1, min_rows=10).collect()
    assert [r.k for r in hot] == [1] and hot[0]["_salts"] == 4
    assert hot_keys(skewed(spark), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    big = skewed(spark)
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n"), (99, "z")], "k bigint, v string")
    hot = hot_keys(big, ["k"], share=0.05, min_rows=5)
    got = salted_join(big, small, ["k"], spread=["id"], how=how, hot=hot)
    want = big.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_join_spreads_the_hot_key(spark):
    big = skewed(spark)
    hot = hot_keys(big, ["k"], share=0.02, min_rows=5)
    salts = big.where("k = 1").join(hot, "k").select(F.pmod(F.xxhash64("id"), F.col("_salts"))).distinct().count()
    assert salts >= 10


def test_salted_join_with_a_range(spark):
    big = skewed(spark)
    small = spark.createDataFrame([(1, 0, 90), (1, 60, 120), (4, 0, 50)], "k bigint, lo int, hi int")
    inside = F.col("id").between(F.col("lo"), F.col("hi"))
    hot = hot_keys(big, ["k"], share=0.05, min_rows=5)
    got = salted_join(big, small, ["k"], spread=["id"], condition=inside, hot=hot)
    want = big.join(small, "k").where(inside).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_total_equals_a_window(spark):
    df = skewed(spark).withColumn("w", F.col("id") % 11)
    before = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "id", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"))
    got = running_total(df.repartition(7), ["k"], ["id"], F.col("w"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_text_parts_keep_every_text_in_order(spark):
    rows = [(1, i, None if i < 5 else dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i // 3), f"text{i} " * (i % 9)) for i in range(200)]
    rows += [(2, 0, None, None), (None, 1, None, "nobody")]
    df = spark.createDataFrame(rows, "subject_id bigint, id bigint, date timestamp, text string")
    parts = text_parts(df.repartition(5), ["subject_id"], ["date", "id"], max_chars=500).collect()
    mine = sorted((r for r in parts if r.subject_id == 1), key=lambda r: r.part)
    assert "\n".join(r.text for r in mine) == "\n".join(r[3] for r in rows[:200])
    assert len(mine) > 5 and all(len(r.text) < 500 + 80 for r in mine)
    assert sum(r.n_texts for r in parts) == len(rows)
    assert {r.text for r in parts if r.subject_id is None} == {"nobody"}


def test_parts_are_numbered_without_gaps(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate((25, 1, 1, 40, 2))] + [(2, 0, "y")]
    parts = text_parts(spark.createDataFrame(rows, "k int, i int, text string"), ["k"], ["i"], max_chars=10)
    assert sorted((r.k, r.part, r.n_texts) for r in parts.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 0, 1)]
    whole = text_parts(spark.createDataFrame(rows, "k int, i int, text string"), [], ["k", "i"], max_chars=10)
    assert sorted((r.part, r.n_texts) for r in whole.collect()) == [(0, 1), (1, 2), (2, 1), (3, 2)]


def test_cut_reads_back_the_same_rows(spark):
    df = skewed(spark, 100)
    back = cut(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_segments_shuffle_twice(spark):
    p = plan(entry.queries()["segments"](spark, SF_DIR))
    assert p.count("Exchange hashpartitioning") == 2  # user and day, then user
    assert p.count("Sort [") <= 5


def test_top_lists_do_not_sort_everything(spark, posts):
    p = posts([(1, 1, "2020-01-01", 0.1, 0.1, "a")])
    for df in (stats.top_active_users(p), stats.activity_risk(p), risk.risk_rankings(p)):
        assert "TakeOrderedAndProject" in plan(df)
    assert "WindowGroupLimit" in plan(risk.recent_posts(p))
    assert plan(risk.recent_posts(p)).index("Final") < plan(risk.recent_posts(p)).index("Exchange") < plan(
        risk.recent_posts(p)
    ).index("Partial")


def test_small_labels_are_broadcast_by_size(spark):
    df = entry.queries()["label_left_join"](spark, SF_DIR)
    df.collect()
    assert "BroadcastHashJoin" in plan(df)


def test_filters_and_columns_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumnRenamed("doc_id", "subject_id")
    p = docs.transform(lambda x: clean.filter_user(x, 3)).select("lang")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_terms_are_read_once(spark):
    df = entry.queries()["topic_term_counts"](spark, SF_DIR)
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("FileScan") == 1


def test_user_header_reads_posts_once(spark):
    df = entry.queries()["user_header"](spark, SF_DIR)
    assert plan(df).count("FileScan") == 1 and "Join" not in plan(df)


def test_one_term_in_very_many_topics(spark):
    rows = spark.range(20_000).select("id", F.col("id").alias("topic"), F.concat(F.lit("common w"), F.col("id") % 50).alias("text"))
    got = topics.topic_term_counts(rows, min_rows=100).where("term = 'common'")
    assert got.agg(F.count(F.lit(1)), F.min("term_total"), F.max("term_total")).first()[:] == (20_000, 20_000, 20_000)


def test_no_pairwise_nested_loops(spark):
    for name in ("coverage_metrics", "topic_info", "series_by_segment"):
        p = plan(entry.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
