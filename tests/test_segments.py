import datetime as dt
import random

import pytest

from tidemark.operators import segments

DAY0 = dt.date(2020, 1, 1)


def direct_split(x, y, k):
    """Breakpoint positions by plain search, for comparison."""

    def dist(i, a, b):
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = (dy * dy + dx * dx) ** 0.5
        return abs(dy * x[i] - dx * y[i] + x[b] * y[a] - y[b] * x[a]) / length if length else 0.0

    n = len(x)
    if n < 2:
        return []
    marks = [0, n - 1]
    for _ in range(k - 1):
        best = (0.0, None)
        for a, b in zip(marks, marks[1:]):
            for i in range(a + 1, b):
                if dist(i, a, b) > best[0]:
                    best = (dist(i, a, b), i)
        if best[1] is None:
            break
        marks = sorted([*marks, best[1]])
    return marks


def frame(spark, by_user):
    rows = [(u, DAY0 + dt.timedelta(days=d), v) for u, points in by_user.items() for d, v in points]
    return spark.createDataFrame(rows, "subject_id bigint, day date, ema_smooth double")


def breaks(segs):
    out = {}
    for r in segs.orderBy("subject_id", "seg_no").collect():
        marks = out.setdefault(r.subject_id, [(r.start_date - DAY0).days])
        assert marks[-1] == (r.start_date - DAY0).days
        assert r.seg_no == len(marks)
        marks.append((r.end_date - DAY0).days)
    return out


@pytest.mark.parametrize("k", [1, 2, 10, 20])
def test_equals_direct_split(spark, k):
    rnd = random.Random(k)
    by_user = {}
    for u in range(30):
        day, points = 0, []
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 40, 90])):
            day += rnd.choice([1, 1, 1, 2, 7, 30])
            points.append((day, rnd.choice([0.0, 0.5, 1.0]) if u % 3 == 0 else rnd.random()))
        by_user[u] = points
    got = breaks(segments.segments(frame(spark, by_user), k=k))
    for u, points in by_user.items():
        first = points[0][0]
        want = direct_split([float(d - first) for d, _ in points], [v for _, v in points], k)
        assert got.get(u, []) == [points[i][0] for i in want], u


def test_collinear_series_is_one_segment(spark):
    got = breaks(segments.segments(frame(spark, {1: [(d, float(d)) for d in range(8)], 2: [(d, 1.0) for d in range(5)]}), k=5))
    assert got == {1: [0, 7], 2: [0, 4]}


def test_earliest_point_wins_ties(spark):
    points = [(0, 0.0), (1, 1.0), (2, 0.0), (3, 1.0), (4, 0.0)]
    assert breaks(segments.segments(frame(spark, {1: points}), k=2)) == {1: [0, 1, 4]}


def test_short_series(spark):
    got = breaks(segments.segments(frame(spark, {1: [(0, 1.0)], 2: [(0, 1.0), (3, 2.0)], 3: [(0, 0.0), (1, 5.0), (2, 0.0)]}), k=10))
    assert got == {2: [0, 3], 3: [0, 1, 2]}


def phases(spark):
    return spark.createDataFrame(
        [
            (1, 1, dt.date(2020, 1, 1), dt.date(2020, 1, 3), 0.0, 1.0),
            (1, 2, dt.date(2020, 1, 3), dt.date(2020, 1, 6), 1.0, 0.5),
        ],
        "subject_id bigint, seg_no int, start_date date, end_date date, start_val double, end_val double",
    )


@pytest.mark.parametrize(
    "end_of_day,expected",
    [
        (False, {(1, 1), (2, 1), (2, 2), (3, 2), (4, 2)}),
        (True, {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 2), (5, 2)}),
    ],
)
def test_posts_around_phase_ends(spark, posts, end_of_day, expected):
    p = posts([
        (1, 1, "2020-01-01 08:00:00", 0.1, 0.1, "first"),
        (2, 1, "2020-01-03 00:00:00", 0.1, 0.1, "midnight of the shared day"),
        (3, 1, "2020-01-03 09:00:00", 0.1, 0.1, "later that day"),
        (4, 1, "2020-01-06 00:00:00", 0.1, 0.1, "midnight of the last day"),
        (5, 1, "2020-01-06 10:00:00", 0.1, 0.1, "later on the last day"),
        (6, 2, "2020-01-02 10:00:00", 0.1, 0.1, "another user"),
        (7, 1, "unknown", 0.1, 0.1, "undated"),
    ])
    got = segments.phase_posts(p, phases(spark), end_of_day=end_of_day).collect()
    assert {(r.id, r.phase_num) for r in got} == expected
    assert len(got) == len(expected)


def test_trend_and_breakpoints(spark):
    segs = phases(spark)
    trend = [(str(r.day), r.score) for r in segments.segment_trend(segs).orderBy("day").collect()]
    assert trend == [("2020-01-01", 0.0), ("2020-01-03", 1.0), ("2020-01-06", 0.5)]
    assert [r.score for r in segments.breakpoints(segs).orderBy("seg_no").collect()] == [1.0, 0.5]
    assert [r.delta for r in segments.phase_breaks(segs).orderBy("phase_num").collect()] == [1.0, -0.5]


def test_shared_days_belong_to_both_segments(spark):
    series = frame(spark, {1: [(d, 0.0) for d in range(6)]})
    got = segments.series_by_segment(series, phases(spark)).collect()
    assert sorted(((r.day - DAY0).days, r.seg_no) for r in got) == [(0, 1), (1, 1), (2, 1), (2, 2), (3, 2), (4, 2), (5, 2)]
