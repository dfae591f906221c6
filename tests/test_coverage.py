import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage


def frame(spark, rows):
    return spark.createDataFrame(rows, "key bigint, item bigint, vector array<float>")


def brute(full, sample):
    """Best cosine and lowest partner by a whole matrix, per key."""
    out = {}
    for key in {r[0] for r in full} & {r[0] for r in sample}:
        f = sorted(r[1:] for r in full if r[0] == key)
        s = sorted(r[1:] for r in sample if r[0] == key)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        cos = unit(np.array([v for _, v in f], float)) @ unit(np.array([v for _, v in s], float)).T
        out[key] = ([i for i, _ in f], [j for j, _ in s], cos)
    return out


@pytest.fixture(scope="module")
def sides():
    rnd = np.random.default_rng(1)
    pool = rnd.normal(size=(40, 6)).astype("float32")
    # Key 0 holds a third of the rows, mostly copies of one vector; key 9 has one empty side.
    full = [(0, i, pool[0 if i % 4 else i % 40].tolist()) for i in range(100)]
    full += [(1 + i % 5, 1000 + i, pool[rnd.integers(40)].tolist()) for i in range(150)]
    full += [(9, 5000, pool[3].tolist())]
    sample = [(0, i, pool[(i * 3) % 40].tolist()) for i in range(60)]
    sample += [(1 + i % 5, 1000 + i, pool[rnd.integers(40)].tolist()) for i in range(40)]
    sample += [(8, 5000, pool[3].tolist())]
    return full, sample


@pytest.mark.parametrize("block", [4, 1024])
def test_best_match_equals_the_matrix(spark, sides, block):
    full, sample = sides
    got = coverage.best_match(frame(spark, full), frame(spark, sample), 0.5, block=block).collect()
    by_item = {(r.key, r.full_item): r for r in got}
    assert len(got) == len(by_item) == len(full) - 1
    for key, (items, partners, cos) in brute(full, sample).items():
        for row, i in enumerate(items):
            r = by_item[key, i]
            assert r.cosine == pytest.approx(cos[row].max(), abs=1e-9)
            near = [p for p, c in zip(partners, cos[row]) if c > cos[row].max() - 1e-9]
            assert r.sample_item == min(near)
            assert r.matched == (r.cosine >= 0.5)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.75, 1.0])
def test_metrics_equal_the_matrix(spark, sides, threshold):
    full, sample = sides
    maxima = coverage.cosine_maxima(frame(spark, full), frame(spark, sample), block=8)
    got = {r.key: r for r in coverage.coverage_metrics(maxima, threshold).collect()}
    want = brute(full, sample)
    assert set(got) == set(want)
    for key, (items, partners, cos) in want.items():
        r = got[key]
        # Equal vectors may land a last bit below 1.
        if threshold < 1:
            assert r.tp_full == (cos.max(axis=1) >= threshold).sum()
            assert r.tp_sample == (cos.max(axis=0) >= threshold).sum()
        assert (r.n_full, r.n_sample) == (len(items), len(partners))
        assert r.recall == pytest.approx(r.tp_full / r.n_full)
        assert 0 <= r.precision <= 1 and 0 <= r.f1 <= 1


def test_sensitivity_falls_with_the_threshold(spark, sides):
    full, sample = sides
    maxima = coverage.cosine_maxima(frame(spark, full), frame(spark, sample))
    rows = coverage.coverage_sensitivity(maxima).orderBy("key", "threshold").collect()
    direct = {r.key: r for r in coverage.coverage_metrics(maxima, 0.25).collect()}
    for key in direct:
        mine = [r for r in rows if r.key == key]
        assert len(mine) == 21
        assert all(a.recall >= b.recall and a.precision >= b.precision for a, b in zip(mine, mine[1:]))
        assert mine[5].f1 == pytest.approx(direct[key].f1)


def test_first_of_equal_samples_wins(spark):
    v = [1.0, 0.0]
    got = coverage.best_match(frame(spark, [(1, 1, v)]), frame(spark, [(1, 7, v), (1, 3, v), (1, 5, [0.0, 1.0])])).first()
    assert got.sample_item == 3 and got.matched


def test_zero_vector_matches_nothing(spark):
    got = coverage.best_match(frame(spark, [(1, 1, [0.0, 0.0])]), frame(spark, [(1, 7, [1.0, 0.0])]), 0.1).first()
    assert got.cosine == 0.0 and not got.matched


def test_one_narrative_gives_all_or_nothing_precision(spark):
    full = frame(spark, [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])])
    maxima = coverage.cosine_maxima(full, frame(spark, [(1, 1, [1.0, 0.1])]))
    assert coverage.coverage_metrics(maxima, 0.5).first().precision == 1.0
    assert coverage.coverage_metrics(maxima, 0.999).first().precision == 0.0


def test_noise_topic_is_an_outlier(spark):
    topics = spark.createDataFrame([(-1, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.0, 1.0])], "topic bigint, vector array<float>")
    truths = spark.createDataFrame([(0, "east", [1.0, 0.0]), (1, "north", [0.0, 2.0])], "item int, label string, vector array<float>")
    got = {r.topic: (r.gt_label, round(r.gt_score, 3)) for r in coverage.topic_ground_truth(topics, truths).collect()}
    assert got == {-1: ("Outliers", 0.0), 0: ("east", 0.995), 1: ("north", 1.0)}


def test_truths_stay_within_their_user(spark):
    topics = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0])], "subject_id bigint, topic bigint, vector array<float>")
    truths = spark.createDataFrame(
        [(1, 0, "one", [0.5, 0.5]), (2, 0, "two", [1.0, 0.0])], "subject_id bigint, item int, label string, vector array<float>"
    )
    got = coverage.topic_ground_truth(topics, truths, keys=["subject_id"]).orderBy("subject_id").collect()
    assert [r.gt_label for r in got] == ["one", "two"]


def test_strips_of_a_block_do_not_matter(spark, sides, monkeypatch):
    full, sample = (frame(spark, s) for s in sides)
    whole = sorted(map(tuple, coverage.best_match(full, sample).collect()))
    monkeypatch.setattr(coverage, "STRIP", 7)
    assert sorted(map(tuple, coverage.best_match(full, sample).collect())) == whole


def clustered(seed, n, items=0):
    """Vectors in tight groups of directions, some equal, some zero, some far from all."""
    rnd = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(16, 8))
    rows = [(0, items + i, (centres[i % 16] + 0.03 * rnd.normal(size=8)).tolist()) for i in range(n)]
    rows += [(0, items + n + i, rows[i][2]) for i in range(20)]
    rows += [(0, items + n + 20, [0.0] * 8), (0, items + n + 21, (-centres[3]).tolist()), (0, items + n + 22, (2 * np.array(rows[5][2])).tolist())]
    return rows + [(1, i, rnd.normal(size=8).tolist()) for i in range(30)]


def test_blocks_too_far_apart_are_left_out(spark, monkeypatch):
    full, sample = clustered(1, 400), clustered(2, 300, 10_000)
    sides = frame(spark, full), frame(spark, sample)
    whole = sorted(map(tuple, coverage.cosine_maxima(*sides).collect()))
    monkeypatch.setattr(coverage, "CELL", 6)
    pairs = coverage.block_pairs(*sides, block=16)
    assert sorted(map(tuple, coverage.cosine_maxima(*sides, block=16).collect())) == whole
    products = pairs.where("key = 0").agg(F.sum(F.size("full") * F.size("sample"))).first()[0]
    assert products < 0.35 * 401 * 301
    # In no direction more than another, hardly a pair can be left out, and the result is the same.
    rnd = np.random.default_rng(3)
    even = [frame(spark, [(0, i, rnd.normal(size=8).tolist()) for i in range(n)]) for n in (150, 90)]
    direct = sorted(map(tuple, coverage.cosine_maxima(*even).collect()))
    assert sorted(map(tuple, coverage.cosine_maxima(*even, block=16).collect())) == direct


def test_pairs_are_not_emitted(spark, sides):
    full, sample = sides
    maxima = coverage.cosine_maxima(frame(spark, full), frame(spark, sample), block=8)
    distinct = lambda rows: len({(r[0], tuple(r[2])) for r in rows if r[0] < 8})
    assert maxima.count() == distinct(full) + distinct(sample)
    assert maxima.where(F.col("side") == "full").agg(F.sum("copies")).first()[0] == len(full) - 1


@pytest.mark.parametrize("bad", [[1.0, 0.0], [1.0, float("nan"), 0.0, 0.0], [1.0, None, 0.0, 0.0]])
def test_odd_vectors_raise(spark, bad):
    full = frame(spark, [(1, 1, [1.0, 0.0, 0.0, 0.0]), (1, 2, bad)])
    sample = frame(spark, [(1, 3, [1.0, 1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="different lengths|not finite|infinite"):
        coverage.cosine_maxima(full, sample).collect()


def test_narratives_may_be_lists(spark, posts):
    p = posts([(1, 1, "2020-01-01", 0.1, 0.1, "a")])
    listed = spark.createDataFrame([(1, ["one", "", "two"]), (2, None)], "subject_id bigint, base_analysis array<string>")
    _, sample = coverage.text_sides(p, listed)
    assert sorted(map(tuple, sample.collect())) == [(1, 0, "one"), (1, 2, "two")]
    single = spark.createDataFrame([(1, "one"), (2, ""), (3, None)], "subject_id bigint, base_analysis string")
    assert [tuple(r) for r in coverage.text_sides(p, single)[1].collect()] == [(1, 0, "one")]
