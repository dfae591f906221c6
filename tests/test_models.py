"""Clusters, vectors, model surfaces and prompts."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, factors, infer, judge, prompts
from tidemark.plans.lineage import scratch_path


def blobs(seed=3, small=0):
    rnd = np.random.default_rng(seed)
    centres = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = [(0, *(np.array(c) + rnd.normal(scale=0.4, size=2))) for i, c in enumerate(centres) for _ in range(120 - 20 * i)]
    rows += [(0, *(np.array((10.0, 10.0)) + rnd.normal(scale=0.1, size=2))) for _ in range(small)]
    rows += [(0, float(x), float(y)) for x, y in [(5, 5), (-7, 3), (15, -6), (4, -8)]]
    return [(k, i, [float(x), float(y)]) for i, (k, x, y) in enumerate(rows)]


def cluster(spark, rows, **kw):
    df = spark.createDataFrame(rows, "subject_id bigint, id bigint, coords array<double>")
    options = {"width": 0.8, "min_points": 3, "min_cluster_size": 35, "by": ["subject_id"], **kw}
    return {r.id: r for r in clusters.density_cluster(df, **options).collect()}


def test_three_blobs_and_noise(spark):
    got = cluster(spark, blobs())
    assert len(got) == 304
    for first, n, topic in ((0, 120, 0), (120, 100, 1), (220, 80, 2)):
        found = [got[i].topic for i in range(first, first + n)]
        assert set(found) <= {topic, -1} and found.count(topic) > 0.85 * n
    assert all(got[i].topic == -1 and got[i].strength == 0.0 for i in range(300, 304))
    assert all(0 < r.strength <= 1 for r in got.values() if r.topic >= 0)


def test_small_cluster_is_noise(spark):
    rows = blobs(small=20)
    got = cluster(spark, rows)
    assert {got[i].topic for i in range(300, 320)} == {-1}
    assert {got[i].topic for i in range(300, 320)} != {cluster(spark, rows, min_cluster_size=10)[300].topic}


def test_clusters_do_not_depend_on_row_order_or_ids(spark):
    rows = blobs()
    before = cluster(spark, rows)
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    renamed = [(k, 1000 - i, c) for k, i, c in shuffled]
    after = cluster(spark, renamed)
    assert {i: r.topic for i, r in before.items()} == {1000 - i: r.topic for i, r in after.items()}


def test_users_are_clustered_apart(spark):
    rows = blobs()
    other = [(1, 5000 + i, [x + 0.1, y]) for _, i, (x, y) in rows[:120]]
    got = cluster(spark, rows + other)
    assert {got[5000 + i].topic for i in range(120)} <= {0, -1}
    assert {i: got[i].topic for i in range(304)} == {i: r.topic for i, r in cluster(spark, rows).items()}


def test_width_fits_each_user_by_default(spark):
    rows = blobs()
    # The second user's points are the same shape at a hundredth of the scale.
    tiny = [(1, 5000 + i, [x / 100, y / 100]) for _, i, (x, y) in rows]
    got = cluster(spark, rows + tiny, width=None, min_points=2)
    for first, n, topic in ((0, 120, 0), (120, 100, 1), (220, 80, 2)):
        found = [got[i].topic for i in range(first, first + n)]
        assert found.count(topic) > 0.85 * n
    assert [got[i].topic for i in range(304)] == [got[5000 + i].topic for i in range(304)]
    alone = cluster(spark, rows, width=None, min_points=2, by=[])
    assert {i: r.topic for i, r in alone.items()} == {i: got[i].topic for i in range(304)}


def test_long_chain_is_one_cluster(spark):
    # A spiral of cells: many steps from end to end.
    path, x, y, step = [], 0, 0, 1
    for turn in range(10):
        for _ in range(2 * step):
            x, y = (x + (1, 0, -1, 0)[turn % 4], y + (0, 1, 0, -1)[turn % 4])
            path.append((x, y))
        step += 1
    rows = [(0, i, [px + 0.5, py + 0.5]) for i, (px, py) in enumerate(path)]
    got = cluster(spark, rows, width=1.0, min_points=1, min_cluster_size=2)
    assert {r.topic for r in got.values()} == {0}


def test_earlier_rounds_are_deleted(spark):
    rows = [(0, i, [i + 0.5, 0.5]) for i in range(40)]
    points = spark.createDataFrame(rows, "label bigint, id bigint, coords array<double>")
    base = scratch_path(spark, "x").rsplit("/", 1)[0]
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = clusters.density_cluster(points, width=1.0, min_points=1, min_cluster_size=2)
    assert out.where("topic = 0").count() == 40
    left = [name.split("-")[0] for name in set(os.listdir(base)) - before]
    assert left.count("hooked") == 1


def test_empty_and_null_points(spark):
    for width in (0.8, None):
        got = cluster(spark, [(0, 1, None), (0, 2, [1.0, 1.0]), (3, 4, None)], width=width)
        assert {r.topic for r in got.values()} == {-1} and len(got) == 3


def test_components_by_brute_force(spark):
    rnd = random.Random(11)
    rows = [(k, 1000 * k + i, [rnd.random() * 9, rnd.random() * 9, rnd.random() * 2]) for k in range(2) for i in range(160)]
    got = cluster(spark, rows, width=1.0, min_points=2, min_cluster_size=3)
    for k in range(2):
        mine = {i: tuple(math.floor(v) for v in c) for kk, i, c in rows if kk == k}
        count = {}
        for c in mine.values():
            count[c] = count.get(c, 0) + 1
        dense, label = {c for c, n in count.items() if n >= 2}, {}
        for c in sorted(dense):
            todo = [c] if c not in label else []
            while todo:
                v = todo.pop()
                if v in label:
                    continue
                label[v] = c
                for axis in range(3):
                    for s in (-1, 1):
                        w = v[:axis] + (v[axis] + s,) + v[axis + 1:]
                        if w in dense:
                            todo.append(w)
        size = {}
        for c, root in label.items():
            size[root] = size.get(root, 0) + count[c]
        order = sorted((r for r in size if size[r] >= 3), key=lambda r: (-size[r], r))
        for i, c in mine.items():
            want = order.index(label[c]) if label.get(c) in order else -1
            assert got[i].topic == want


def test_projected_vectors_keep_products(spark):
    rng = random.Random(5)
    words = [f"term{i}" for i in range(6000)]
    bags = [[words[rng.randrange(200 * i, 200 * i + 200)] for _ in range(300)] for i in range(24)]
    bags += [[*bags[i][:150], *(rng.choice(words[5000:]) for _ in range(150))] for i in range(6)]
    df = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bags)] + [(100, "a I ?"), (101, None), (102, " ".join(reversed(bags[0])))], "id bigint, text string")
    got = {r.id: np.array(r.vector) for r in factors.project_text(df).collect()}
    assert not got[100].any() and not got[101].any() and (got[102] == got[0]).all()
    n, counts = 33, [dict(Counter(b)) for b in bags]
    df_ = Counter(t for c in counts for t in c) + Counter(set(bags[0]))
    exact = [{t: c * math.log((n + 1) / (df_[t] + 1)) for t, c in bag.items()} for bag in counts]
    size = [math.sqrt(sum(v * v for v in e.values())) for e in exact]
    off = []
    for i in range(30):
        assert np.isclose(np.linalg.norm(got[i]), 1.0, atol=1e-5)
        for j in range(i):
            want = sum(v * exact[j].get(t, 0.0) for t, v in exact[i].items()) / (size[i] * size[j])
            off.append(got[i] @ got[j] - want)
    # Texts without a word in common have products near 0.
    assert max(map(abs, off)) < 0.25 and np.mean(np.square(off)) < 0.07**2


def dense_rows(texts, places):
    found = [[zlib.crc32(w.encode()) % places for w in (t or "").split()] for t in texts]
    counts, rows = np.zeros(places), np.zeros((len(texts), places))
    for own in found:
        for p in set(own):
            counts[p] += 1
    for i, own in enumerate(found):
        for p in own:
            rows[i, p] += 1
    rows *= np.log((len(texts) + 1) / (counts + 1))
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


@pytest.mark.parametrize("fan_in, entries", [(64, 1 << 16), (2, 50)])
def test_factors_are_the_best_ones(spark, monkeypatch, fan_in, entries):
    monkeypatch.setattr(factors, "FAN_IN", fan_in)
    monkeypatch.setattr(factors, "ENTRIES", entries)
    rng = random.Random(1)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[(i % 4) * 8 :][:20]) for _ in range(rng.randrange(60))) for i in range(200)] + [None, "a I ?"]
    texts += [texts[5]] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(9)
    got = {r.id: np.array(r.vector, np.float64) for r in factors.factor_text(df, rank=10, oversample=34, places=1 << 12, unit=False).collect()}
    u, s, _ = np.linalg.svd(dense_rows([t if t != "a I ?" else "" for t in texts], 1 << 12), full_matrices=False)
    best = u[:, :10] * s[:10]
    found = np.array([got[i] for i in range(len(texts))])
    assert np.abs(found @ found.T - best @ best.T).max() < 1e-6
    assert all((got[i] == got[5]).all() for i in range(202, 502)) and not got[200].any()


def test_places_are_sorted_as_numbers(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (0, 1, 2, 50, 700)] + [None, "the of", "cat the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").select("id", factors.places_of("text", 1 << 9).alias("places"))
    want = [sorted(zlib.crc32(w.encode()) % (1 << 9) for w in (t or "").split() if w not in ("the", "of")) for t in texts]
    assert [r.places for r in df.orderBy("id").collect()] == want
    # With a function for each comparison, sorting takes longer than finding the terms.
    assert "array_sort" not in df._jdf.queryExecution().executedPlan().toString()


def test_factors_of_little(spark):
    df = spark.createDataFrame([(1, "cats chase mice"), (2, "cats chase mice"), (3, "stocks fell"), (4, None)], "id bigint, text string")
    got = {r.id: np.array(r.vector) for r in factors.factor_text(df, places=1 << 10).collect()}
    assert len(got[1]) == 64 and (got[1] == got[2]).all() and abs(got[1] @ got[3]) < 1e-6 and not got[4].any()
    assert np.isclose(np.linalg.norm(got[3]), 1.0, atol=1e-6)
    assert factors.factor_text(df.where("id < 0"), places=1 << 10).collect() == []


def test_components_explain_most_variance(spark):
    rnd = np.random.default_rng(0)
    basis = np.linalg.qr(rnd.normal(size=(12, 3)))[0]
    data = rnd.normal(size=(200, 3)) @ np.diag([5, 2, 1]) @ basis.T + rnd.normal(scale=0.01, size=(200, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id int, vector array<double>")
    a = np.array([r.coords for r in clusters.reduce_dims(df, k=3).orderBy("id").collect()])
    b = np.array([r.coords for r in clusters.reduce_dims(df.repartition(5), k=3).orderBy("id").collect()])
    assert np.allclose(a, b, atol=1e-6)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert a.var(axis=0).sum() / unit.var(axis=0).sum() > 0.99


@pytest.fixture()
def make_lengths():
    # Defined inside a function, so that workers get it by value.
    def make():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts], dtype=np.float64)

    return make


def test_classify(spark, make_lengths):
    df = spark.createDataFrame([(1, ""), (2, "xyz"), (3, "x")], "id int, text string")
    got = {r.id: r for r in infer.classify(df, make_lengths, batch_size=2).collect()}
    assert [got[i].predicted_label for i in (1, 2, 3)] == [1, 0, 0]
    assert got[2].prob_not == pytest.approx(math.exp(3) / (math.exp(3) + math.e + 1))
    swapped = infer.classify(df, make_lengths, classes=["prob_severe", "prob_not", "prob_moderate"])
    assert swapped.where("id = 2").first().prob_severe == pytest.approx(got[2].prob_not)


def test_embed_is_unit_length(spark, make_lengths):
    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert np.isclose(np.linalg.norm(infer.embed(df, make_lengths).first().vector), 1.0, atol=1e-6)


def test_equal_texts_are_inferred_once(spark, tmp_path):
    calls = str(tmp_path)

    def make():
        def predict(texts):
            with open(f"{calls}/{os.getpid()}", "a") as f:
                f.write(f"{len(texts)} {max(len(t.encode()) for t in texts)} {sum(len(t.encode()) for t in texts)}\n")
            return np.array([[len(t), 1.0] for t in texts])

        return predict

    texts = ["copied text"] * 300 + [f"text {'x' * (i % 90)} {i}" for i in range(200)] + ["", None, "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    got = {r.id: r.logits for r in infer.infer_once(df, make, batch_size=16, batch_bytes=1000).collect()}
    assert got == {i: None if t is None else [float(len(t)), 1.0] for i, t in enumerate(texts)}
    batches = [tuple(map(int, line.split())) for name in os.listdir(calls) for line in open(f"{calls}/{name}")]
    assert sum(n for n, _, _ in batches) == 203
    assert all(n <= 16 and (n == 1 or n * longest <= 1000) for n, longest, _ in batches)
    # Little is lost to padding.
    assert sum(n * longest for n, longest, _ in batches) < 1.3 * sum(total for *_, total in batches)


def test_a_run_that_ends_goes_on_where_it_was(spark, tmp_path):
    calls, broken = str(tmp_path / "calls"), str(tmp_path / "broken")
    os.makedirs(calls)

    def make():
        def complete(p):
            with open(f"{calls}/{p}", "a") as f:
                f.write("x")
            if p == "p17" and os.path.exists(broken):
                raise SystemExit("the worker is gone")
            if p.startswith("bad"):
                raise RuntimeError("no")
            return p[::-1]

        return complete

    rows = [(i, f"p{i}") for i in range(40)] + [(50, "p3"), (51, "bad"), (52, None)]
    df = spark.createDataFrame(rows, "id int, prompt string")
    options = {"attempts": 2, "wait": 0.0, "wave": 5, "parallelism": 1}
    open(broken, "w").close()
    with pytest.raises(Exception):
        infer.complete_with_ledger(df, make, str(tmp_path / "ledger"), **options)
    known = {r.response[::-1] for r in infer._ledger(spark, str(tmp_path / "ledger")).where("response IS NOT NULL").collect()}
    assert known and "p17" not in known
    os.remove(broken)
    times = lambda p: os.path.getsize(f"{calls}/{p}") if os.path.exists(f"{calls}/{p}") else 0
    before = {p: times(p) for p in known}
    got = {r.id: (r.response, r.error) for r in infer.complete_with_ledger(df, make, str(tmp_path / "ledger"), **options).collect()}
    assert all(got[i] == (p[::-1], None) for i, p in rows[:41]) and got[51] == (None, "RuntimeError: no") and got[52] == (None, None)
    # What was committed is not called again; only the broken wave is.
    assert {p: times(p) for p in known} == before and set(before.values()) == {1}
    assert sum(times(f"p{i}") > 1 for i in range(40)) <= 15 and times("p3") <= 2
    again = infer.complete_with_ledger(df, make, str(tmp_path / "ledger"), **options)
    assert again.count() == len(rows) and {p: times(p) for p in known} == before


def test_calls_are_no_more_than_allowed(spark, tmp_path):
    import time

    def make():
        return lambda p: p

    df = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id int, prompt string")
    started = time.time()
    assert infer.complete_with_ledger(df, make, str(tmp_path / "ledger"), parallelism=2, per_second=6.0).where("response = prompt").count() == 12
    assert time.time() - started > 1.4


def test_failed_completions_keep_their_row(spark):
    def make():
        def complete(p):
            if "bad" in p:
                raise RuntimeError("no")
            return p[::-1]

        return complete

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "")], "id int, prompt string")
    got = {r.id: (r.response, r.error) for r in infer.complete_prompts(df, make, parallelism=2).collect()}
    assert got == {1: ("cba", None), 2: (None, "RuntimeError: no"), 3: ("", None)}


def test_templates_do_not_reread_values(spark):
    df = spark.createDataFrame([("{b} %s $1", "y")], "a string, b string")
    assert df.select(prompts.fill("{a}-{b} {{json}}", a=F.col("a"), b=F.col("b")).alias("x")).first().x == "{b} %s $1-y {json}"


def test_base_prompts_hold_all_posts(spark, posts):
    p = posts([(i, 1, f"2020-01-01 00:{i:02d}:00", 0.1, 0.1, f"post number {i}") for i in range(60)])
    whole = prompts.base_prompts(p).collect()
    assert len(whole) == 1 and whole[0].n_posts == 60
    assert all(f"[2020-01-01 00:{i:02d}:00] post number {i}\n" in whole[0].prompt for i in range(60))
    parts = prompts.base_prompts(p, "{posts}", max_chars=300).orderBy("part").collect()
    assert len(parts) > 5 and "\n".join(r.prompt for r in parts).count("post number") == 60


def test_judge_prompts_hide_the_origin(spark):
    df = spark.createDataFrame([(i, "base text", "trajectory text") for i in range(20)], "subject_id int, base_analysis string, report string")
    rows = prompts.judge_prompts(judge.ab_assignment(df)).collect()
    for r in rows:
        a = r.prompt.index("base text") < r.prompt.index("trajectory text")
        assert a == (r.mapping.A == "base")
    assert {r.mapping.A for r in rows} == {"base", "trajectory"}


@pytest.mark.parametrize("n,length,limit", [(3, 10, 100), (300, 10, 100), (5, 1000, 100), (50, 1, 100)])
def test_corpus_prompts_hold_every_verdict(spark, n, length, limit):
    # Two verdicts of every user, the last user's being equal.
    docs = [(i, f"{i:03d}{k * (i < n - 1)}" + "x" * length) for i in range(n) for k in (1, 2)]
    df = spark.createDataFrame(docs, "subject_id int, document string").repartition(4)
    got = prompts.corpus_summary_prompts(df, "{verdicts}", max_chars=limit).orderBy("part").collect()
    assert [r.part for r in got] == list(range(len(got))) and sum(r.n_verdicts for r in got) == 2 * n
    assert ", ".join(r.prompt[1:-1] for r in got) == ", ".join(d for _, d in docs)
    answers = spark.createDataFrame([(r.part, f"answer {r.part}") for r in got], "part bigint, response string")
    merged = prompts.corpus_merge_prompts(answers, "{summaries}").collect()
    assert [r.prompt for r in merged] == ["\n\n".join(f"answer {i}" for i in range(len(got)))]


def test_topic_prompts_skip_empty_narratives(spark, posts):
    reports = spark.createDataFrame([(1, "base", ""), (2, None, "traj")], "subject_id bigint, base_analysis string, trajectory_summary string")
    got = prompts.topic_prompts(posts([(1, 1, "2020-01-01", 0.1, 0.1, "a")]), reports, "{text}").collect()
    assert sorted((r.subject_id, r.source, r.prompt) for r in got) == [(1, "narrative_base", "base"), (1, "posts", "a"), (2, "narrative_traj", "traj")]
