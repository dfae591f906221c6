import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import risk, rollup, stats
from tidemark.operators.clean import typed_posts

DAY0 = dt.date(2000, 1, 1)


def series(spark, values, subject=1, step=1):
    return spark.createDataFrame(
        [(subject, DAY0 + dt.timedelta(days=i * step), v) for i, v in enumerate(values)],
        "subject_id bigint, day date, daily_risk double",
    )


def recursion(values, half_life):
    a = 1.0 if half_life <= 0 else 0.5 ** (1.0 / half_life)
    out, prev = [], 0.0
    for v in values:
        prev = a * prev + (1 - a) * v
        out.append(prev)
    return out


def ema(spark, values, half_life, **kw):
    return [r.ema for r in risk.risk_ema(series(spark, values, **kw), half_life).orderBy("day").collect()]


@pytest.mark.parametrize("half_life,n", [(1, 2500), (2, 1500), (15, 400), (60, 300), (0.5, 700), (0.01, 20)])
def test_decay_equals_recursion(spark, half_life, n):
    values = [((i * 7919) % 101) / 50.0 for i in range(n)]
    for got, want in zip(ema(spark, values, half_life), recursion(values, half_life)):
        assert math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("half_life", [0, -3])
def test_no_half_life_gives_zeros(spark, half_life):
    assert ema(spark, [1.0, 2.0, 0.5], half_life) == [0.0, 0.0, 0.0]


def test_gaps_between_days_are_not_filled(spark):
    assert ema(spark, [1.0, 2.0, 3.0], 15, step=90) == pytest.approx(recursion([1.0, 2.0, 3.0], 15))


def test_null_day_ends_the_series(spark):
    assert ema(spark, [1.0, None, 2.0], 15)[1:] == [None, None]
    smoothed = risk.risk_smoothed(risk.risk_ema(series(spark, [1.0, None, 2.0]), 15)).orderBy("day").collect()
    first = recursion([1.0], 15)[0]
    assert [r.ema_smooth for r in smoothed] == pytest.approx([first] * 3)


def test_smoothing_shortens_at_both_ends(spark):
    values = [float(i) for i in range(10)]
    scored = series(spark, values).withColumnRenamed("daily_risk", "ema")
    got = [r.ema_smooth for r in risk.risk_smoothed(scored).orderBy("day").collect()]
    want = [sum(values[max(0, i - 3): i + 4]) / len(values[max(0, i - 3): i + 4]) for i in range(10)]
    assert got == pytest.approx(want)


def test_undated_and_unscored_posts(spark, posts):
    p = typed_posts(
        posts([
            (1, 1, "2020-01-01 10:00:00", 0.5, 0.2, "a"),
            (2, 1, "2020-01-01 11:00:00", float("nan"), 0.2, "b"),
            (3, 1, "not a date", 0.9, 0.1, "c"),
            (4, 2, "2020-01-05 00:00:00", None, None, "d"),
        ])
    )
    daily = {(r.subject_id, str(r.day)): r.daily_risk for r in risk.daily_risk(p).collect()}
    assert daily == {(1, "2020-01-01"): pytest.approx(1.2), (2, "2020-01-05"): None}
    months = {r.month_date: r.posts for r in stats.posts_over_time(p).collect()}
    assert months == {"2020-01-01": 3, None: 1}
    assert {r.day_of_week: r.posts for r in stats.weekday_activity(p).collect()}[None] == 1
    assert stats.depression_averages(p).first().avg_severe == pytest.approx(0.7)
    header = {r.subject_id: r for r in risk.user_header(p).collect()}
    assert header[1].posts == 3 and header[2].current_risk == 0.0


def test_rankings_put_unknown_risk_last(spark, posts):
    p = posts([
        (1, 1, "2020-01-01", None, None, "a"),
        (2, 2, "2020-01-01", 0.1, 0.1, "a"),
        (3, 3, "2020-01-01", 0.9, 0.1, "a"),
        (4, 4, "2020-01-01", 0.9, 0.1, "a"),
        (5, 5, "never", 0.9, 0.1, "a"),
    ])
    assert [r.subject_id for r in risk.risk_rankings(p).collect()] == [3, 4, 2, 1]


def test_rollup_tables_equal_the_direct_ones(spark, posts):
    p = posts([
        (i, i % 4, f"2020-0{1 + i % 3}-{1 + i % 27:02d} 12:00:00" if i % 9 else "?", (i % 10) / 10, (i % 7) / 20, "x" * i)
        for i in range(60)
    ])
    tables = rollup.global_statistics(p, half_life=3)
    for name, direct in {
        "posts_over_time": stats.posts_over_time(p),
        "top_active_users": stats.top_active_users(p),
        "weekday_activity": stats.weekday_activity(p),
        "post_length_stats": stats.post_length_stats(p),
        "activity_risk": stats.activity_risk(p),
        "user_metrics": stats.user_metrics(p),
        "depression_averages": stats.non_depressed_estimate(p),
        "risk_rankings": risk.risk_rankings(p, half_life=3),
    }.items():
        got, want = tables[name].collect(), direct.collect()
        assert len(got) == len(want), name
        for g, w in zip(got, want):
            for a, b in zip(g, w):
                assert a == pytest.approx(b) if isinstance(b, float) else a == b, name


def test_top_posts_per_user(spark, posts):
    p = posts([(i, i % 2, f"2020-01-01 00:{i:02d}:00", (i * 37 % 50) / 50, 0.1, str(i)) for i in range(50)])
    recent = risk.recent_posts(p, 3).orderBy("subject_id", "rank").collect()
    assert [r.id for r in recent] == [48, 46, 44, 49, 47, 45]
    severe = risk.top_severe_posts(p, 2).where(F.col("subject_id") == 0).orderBy("rank").collect()
    best = sorted(((i * 37 % 50) / 50, -i) for i in range(0, 50, 2))[::-1][:2]
    assert [(r.prob_severe, -r.id) for r in severe] == best


def test_histogram_counts_every_score(spark, posts):
    p = posts([(1, 1, "2020-01-01", 1.0, 0.0, "a"), (2, 1, "2020-01-01", 0.049, None, "a")])
    got = {(r.score, r.bin): r.posts for r in stats.score_histogram(p, bins=20).collect()}
    assert got == {("severe", 19): 1, ("severe", 0): 1, ("moderate", 0): 1}


def test_no_posts_give_zeros_everywhere(spark, posts):
    empty = posts([])
    direct = tuple(stats.user_metrics(empty).first())
    assert direct == (0, 0, 0.0) == tuple(rollup.global_statistics(empty)["user_metrics"].first())
