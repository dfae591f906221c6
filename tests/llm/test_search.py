"""Benchmark matches and top-k search against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, topk

from .conftest import WORDS, sentence, table

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(8)
    out = [(i, sentence(rng, rng.randrange(13, 40))) for i in range(6)]
    out += [(10, "One two"), (11, "one"), (12, ""), (13, None), (14, "!!"), (None, "no id here at all")]
    text = dict(r for r in rows if r[0] is not None)
    out += [(20, " ".join(text[8].split()[:25])), (21, " ".join(text[9].split()[3:20])), (22, " ".join(text[8].split()[:25])), (22, "one more text of item 22")]
    out += [(23, "same " * 14), (24, " ".join(reversed(text[400].split()[:30])))]
    return out


def hits(rows, items, window=13):
    wanted = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if w else ():
            wanted.setdefault(n, {}).setdefault(tuple(w[j : j + n]), set()).add(i)
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n, texts in wanted.items():
            for j in range(len(w) - n + 1) if i is not None else ():
                if tuple(w[j : j + n]) in texts:
                    hit.update(range(j, j + n))
                    found |= texts[tuple(w[j : j + n])]
        yield i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None)), bool(hit) and 20 * len(hit) >= len(w)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], "item_id bigint, text string, doc_id int, term string, pos int")


def planted(rows, items):
    rng = random.Random(9)
    out = list(rows)
    for k in range(12):
        text = (items[k % 6][1]).split()
        cut = text[k % 5 :]
        out.append((500 + k, f"{sentence(rng, 30)} {' '.join(cut).upper() if k % 2 else ', '.join(cut)} {sentence(rng, 20 * k)}"))
    return out


def test_contamination(spark, rows, items):
    some = planted(rows, items)
    got = decontaminate.contamination(table(spark, some), benchmark(spark, items))
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect())
    want = Counter(hits(some, items))
    assert found == want
    assert sum(w[4] for w in want) > 8


def test_contamination_without_a_list_of_terms(spark, rows, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "LISTED", 3)
    some = planted(rows[:10], items)
    got = decontaminate.contamination(table(spark, some), benchmark(spark, items))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()) == Counter(hits(some, items))


def test_contamination_of_nothing(spark, docs, rows, no_docs, items):
    assert decontaminate.contamination(no_docs, benchmark(spark, items)).collect() == []
    clean = decontaminate.contamination(docs, benchmark(spark, [])).collect()
    assert len(clean) == len(rows) and not any(r["n_hit"] or r["contaminated"] or r["items"] for r in clean)


def test_proximity(spark, rows):
    phrases = [(1, f"{WORDS[0]} {WORDS[9]}"), (2, f"{WORDS[3]} {WORDS[4]} {WORDS[5]}"), (3, "absent word")]
    some = [r for r in {i: (i, t) for i, t in rows if i is not None}.values() if len(r[1] or "") < 5000]
    got = {tuple(r) for r in decontaminate.proximity_matches(table(spark, some), phrases_table(spark, phrases), 6).collect()}
    count = Counter(w for _, t in some for w in words(t))
    signed = decontaminate.benchmark_words(phrases_table(spark, phrases)).select("item_id", "pos", "term").collect()
    term = {(r["item_id"], r["pos"]): r["term"] for r in signed}
    want = set()
    for p, text in phrases:
        w = words(text)
        if any(not count[x] for x in w):
            continue
        rarest = min(range(len(w)), key=lambda k: (count[w[k]], term[p, k]))
        for i, t in some:
            own = words(t)
            for at, x in enumerate(own):
                if x == w[rarest] and set(w) <= set(own[max(0, at - 6) : at + 7]):
                    want.add((p, i, at))
    assert got == want and want


def phrases_table(spark, phrases):
    return spark.createDataFrame(phrases, "item_id bigint, text string")


def vectors(spark, n, size, seed, spread=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-spread, spread + 1, size) / 7], 1) for i in range(n)]
    rows += [(min(5, n - 1), rows[min(5, n - 1)][1], 2), (n, None, 1), (n + 1, [None] + [0.1] * (size - 1), 1), (n + 2, [float("nan")] * size, 1)]
    rows += [(n + 3, [float("inf")] * size, 1), (None, [0.1] * size, 1), (n + 50 - n % 50, [0.0] * size, 1)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, block int")


def best(rows, k, is_query):
    good = [
        (i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))
        for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()
    ]
    out = {}
    for q, x in good:
        if is_query(q):
            scores = sorted(((-int(x @ y), i) for i, y in good if i != q))[:k]
            out.setdefault(q, []).append([(i, -s) for s, i in scores])
    return out


@pytest.mark.parametrize("block, n, size", [(8, 150, 6), (4096, 150, 6), (16, 60, 2), (5, 3, 4)])
def test_top_k(spark, block, n, size):
    rows, df = vectors(spark, n, size, block)
    from pyspark.sql import functions as F

    got = topk.top_k(topk.scaled(df), F.col("vec_id") % 50 == 0, 5, block, 2).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = best(rows, 5, lambda q: q % 50 == 0)
    assert set(found) == set(want)
    assert all(found[q] == want[q][0] for q in want)


def test_search_stops_early():
    rng = np.random.default_rng(1)
    matrix = np.floor(256 * rng.random((4000, 4))).astype(np.float32)
    matrix[:10] += 400
    order = np.argsort(matrix, axis=0, kind="stable").T
    rows, scores, looked = topk.threshold_search(matrix, order, np.arange(4000), np.array([3, 1, 2, 5]), 7, 5)
    want = sorted(((-int(matrix[i] @ np.array([3, 1, 2, 5])), i) for i in range(4000) if i != 7))[:5]
    assert [(-s, r) for r, s in zip(rows, scores, strict=True)] == want
    assert looked < 1000


def test_top_k_of_nothing(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(topk.scaled(empty), F.col("vec_id") == 0).collect() == []


def test_top_k_of_odd_vectors(spark):
    kind = "vec_id bigint, embedding array<double>"
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], kind)
    with pytest.raises(Exception, match="different lengths"):
        topk.top_k(topk.scaled(ragged), F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="too large"):
        topk.scaled(spark.createDataFrame([(0, [1e300])], kind)).collect()
    big = 2.0**30
    vectors = spark.createDataFrame([(0, [big, -big]), (1, [-big, -big]), (2, [big / 2, big]), (3, [0.5, 0.25])], kind)
    with pytest.raises(Exception, match="too (large|big)"):
        topk.top_k(topk.scaled(vectors.where("vec_id < 2").withColumn("embedding", F.transform("embedding", lambda x: x * 64))), F.col("vec_id") == 0).collect()
    small = vectors.withColumn("embedding", F.transform("embedding", lambda x: x / 256))
    got = [(r.vec_id, r.score) for r in topk.top_k(topk.scaled(small), F.col("vec_id") == 0).orderBy("rank").collect()]
    exact = [(1, 0), (3, 2**30 * 0 - 2**30 * 0), (2, 2**60 // 2 - 2**60)]
    assert got == sorted(exact, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("met", [1, 3])
def test_top_k_sends_no_pairs_through_the_driver(spark, monkeypatch, met):
    monkeypatch.setattr(topk, "WAVES", 0)
    monkeypatch.setattr(topk, "MET", met)
    rows, df = vectors(spark, 400, 6, 3)
    got = topk.top_k(topk.scaled(df), F.col("vec_id") % 5 == 0, 5, 16, 8)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = best(rows, 5, lambda q: q % 5 == 0)
    del want[5], found[5]  # an id that comes twice
    assert found == {q: some[0] for q, some in want.items()}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_starts_from_what_is_held():
    rng = np.random.default_rng(2)
    matrix = np.floor(256 * rng.random((4000, 4))).astype(np.float32)
    order, query = np.argsort(matrix, axis=0, kind="stable").T, np.array([3, -1, 0, 5])
    rows, scores, looked = topk.threshold_search(matrix, order, np.arange(4000), query, 7, 5)
    again, same, fewer = topk.threshold_search(matrix, order, np.arange(4000), query, 7, 5, int(scores[-1]))
    assert again.tolist() == rows.tolist() and same.tolist() == scores.tolist() and fewer == looked
    assert topk.threshold_search(matrix, order, np.arange(4000), query, 7, 5, 1 << 40)[2] < looked
