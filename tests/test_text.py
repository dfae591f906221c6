import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, scores, text, vectors


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr("v").alias("x")).first().x


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("a\r\n\nb", "a b"),
        ("see [the page](http://x.example/a) now", "see the page now"),
        ("read http://x.example/a?b=1", "read"),
        ("[a](b)[c](d)", "ac"),
        ("http://only.example", ""),
        ("  spaced  ", "spaced"),
        ("\tkeeps tabs\t", "\tkeeps tabs\t"),
        ("[outer [inner](u) x](v)", "outer [inner x](v)"),
        ("secure https://x.example/q end", "secure  end"),
    ],
)
def test_cleaning(spark, raw, clean):
    assert one(spark, raw, text.clean_text) == clean


@pytest.mark.parametrize(
    "path,chunk",
    [("data/chunk12.zip", "12"), ("data/CHUNK 3.zip", "Unknown"), ("data/Chunk7-b.zip", "7"), ("data/a.zip", "Unknown"), ("chunky/chunk5", "5")],
)
def test_chunk(spark, path, chunk):
    assert one(spark, path, text.chunk_from_path) == chunk


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \t\n x y  \r\n", text.strip) == "x y"


def test_words_are_unicode(spark):
    assert one(spark, "Città über_all naïve 3 x-y", text.word_count) == 6


def test_preview(spark):
    assert one(spark, "x" * 100, text.preview) == "x" * 100
    assert one(spark, "x" * 101, text.preview) == "x" * 100 + "..."


@pytest.mark.parametrize("value,shown", [(0.125, "0.12"), (2.675, "2.67"), (-0.001, "-0.00"), (1234.5, "1234.50"), (3.0, "3.00")])
def test_two_decimals(spark, value, shown):
    assert one(spark, value, text.two_decimals, "double") == shown == f"{value:.2f}"


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-30",), ("soon",), ("2020-02-03 04:05:06",), (None,)], "d string")
    got = [r.x for r in df.select(dates.coerce_date(F.col("d")).cast("string").alias("x")).collect()]
    assert got == [None, None, "2020-02-03 04:05:06", None]
    week = spark.range(1, 9).select(dates.weekday_label(F.col("id").cast("int")).alias("x")).collect()
    assert [r.x for r in week] == ["Dom", "Lun", "Mar", "Mer", "Gio", "Ven", "Sab", None]


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([0.0, 1.0, 2.0],)], "l array<double>")
    rows = df.select(scores.softmax(F.col("l")).alias("p"), scores.argmax(F.col("l")).alias("a")).collect()
    assert rows[0].p == [0.5, 0.5, 0.0] and rows[0].a == 0
    assert sum(rows[1].p) == pytest.approx(1.0) and rows[1].a == 2


def test_distance(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 0.0, 2.0, 0.0), (1.0, 2.0, 3.0, 3.0, 3.0, 3.0)], "a double, b double, c double, d double, e double, f double")
    got = [r.x for r in df.select(scores.point_line_distance(*[F.col(c) for c in "abcdef"]).alias("x")).collect()]
    assert got == [2.0, 0.0]


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.x for r in df.select(vectors.l2_normalise(F.col("v")).alias("x")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("name,words", [("3_cat_dog_bird", "cat dog bird"), ("-1_cat", "cat"), ("0_under_score_x", "under score x"), ("plain", "plain")])
def test_words_of_a_topic_name(spark, name, words):
    assert one(spark, name, text.topic_words) == words
