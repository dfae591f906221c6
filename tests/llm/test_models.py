"""Held-out accuracy of the learned operators, their parts against plain programs, and odd rows."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, linear, quality, toxicity

from .conftest import WORDS

SF_DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("label", F.lit("no label"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def share(rows, right):
    return sum(map(right, rows)) / len(rows)


@given
def test_quality_held_out(documents, labels):
    got = quality.quality(documents, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 40 and share(out, lambda r: r["predicted"] == r["quality"]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


@given
def test_labels_of_held_out_rows_change_nothing(documents, labels):
    some = documents.where("doc_id % 3 = 0")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.quality(some, labels).orderBy("doc_id").collect() == quality.quality(some, flipped).orderBy("doc_id").collect()


@given
def test_language_held_out(documents):
    got = language.languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert len(out) > 200 and share(out, lambda r: r["lang_pred"] == r["lang"]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


@given
def test_toxicity_held_out(documents, labels):
    got = toxicity.toxicity(documents, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    # Few toxic rows to learn from here: none may be found wrongly, and most are found.
    assert not any(r["predicted"] and not r["toxic"] for r in out)
    assert share([r for r in out if r["toxic"]], lambda r: r["predicted"] == 1) > 0.7


def test_odd_rows(spark, docs, rows, no_docs, labels):
    taught = spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i, _ in rows if i is not None] + [(0, 1, 1), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for some in (taught, no_labels(spark)):
        for operator in (quality.quality, toxicity.toxicity):
            got = operator(docs, some).collect()
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
            assert all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
            assert operator(no_docs, some).collect() == []


def test_language_of_odd_rows(spark, docs, rows, no_docs):
    got = language.languages(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {300, 301, 302, 306, None}
    assert {r["lang_pred"] for r in got} == {"und", "en"}
    assert language.languages(no_docs).collect() == []
    untaught = language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


def test_families_come_first():
    step = language.Step(["x", "y"], np.zeros((language.BUCKETS, 2), np.float32), np.array([1.0, -1.0]))
    best, sure = language._choose(step, np.zeros((3, language.BUCKETS), np.float32))
    assert best.tolist() == [0, 0, 0] and (sure > 0.9).all()
    assert language.family_of("de") == language.family_of("en") == "germanic" and language.family_of("qq") == "qq"


def test_languages_of_a_family_meet_in_pairs():
    rng = np.random.default_rng(3)
    names = ["da", "no", "sv"]
    x = np.zeros((90, language.BUCKETS), np.float32)
    x[:, :12] = rng.normal(size=(90, 12))
    # The middle one lies between the others: no line tells it from both at once.
    wanted = [names[i % 3] for i in range(90)]
    x[:, 0] += np.array([-6.0, 0.0, 6.0], np.float32)[np.arange(90) % 3]
    rows = [(np.arange(12), r[:12].astype(float)) for r in x]
    duels = language._one_versus_one(rows, names, wanted)
    assert duels.pairs.tolist() == [[0, 1], [0, 2], [1, 2]] and duels.weight.shape[1] == 3
    best, sure = language._vote(duels, x)
    assert share(range(90), lambda i: names[best[i]] == wanted[i]) > 0.95 and ((sure > 0) & (sure <= 1)).all()
    # Each machine is the one that the rows of its two languages alone give.
    two = [i for i in range(90) if wanted[i] != "no"]
    y = np.array([1.0 if wanted[i] == "da" else -1.0 for i in two])
    w = linear.hinge([rows[i] for i in two], y, language.BUCKETS, linear.balanced(y, 4.0))
    assert np.allclose(duels.weight[:, 1], w[:-1], atol=1e-6) and np.isclose(duels.bias[1], w[-1])


def test_equal_votes_go_by_margins():
    # A circle: each name beats one other, the second by most.
    duels = language.Duels(["a", "b", "c"], np.array([[0, 1], [0, 2], [1, 2]]), np.zeros((language.BUCKETS, 3), np.float32), np.array([1.0, -2.0, 3.0]))
    best, _ = language._vote(duels, np.zeros((2, language.BUCKETS), np.float32))
    assert best.tolist() == [1, 1]


def test_hinge_loss_reaches_its_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 1] + 0.3 * rng.normal(size=120) > 0.2, 1.0, -1.0)
    cost = np.full(120, 0.5)
    w = linear.hinge([(np.arange(5), row) for row in x], y, 5, cost, 2000)

    def loss(v):
        return 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (x @ v[:5] + v[5]))

    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=6)) + 1e-3 for _ in range(300))


def test_indicators_of_a_text():
    texts = pa.array(["Ab ab ab", "", None, "abcd", "aaaaaaaa", "x y"])
    text, bucket = quality.features(texts)
    assert len(set(zip(text, bucket, strict=True))) == len(text)
    count = np.bincount(text, minlength=6).tolist()
    # Runs of four bytes, words, runs of three shapes: 'Ab ab ab' has 4 different runs and 2 words.
    assert count[0] == 4 + 2 + 1 and count[1] == count[2] == 0 and count[3] == 1 + 1 and count[4] == 1 + 1 and count[5] == 2
    for i in range(6):
        _, alone = quality.features(texts.slice(i, 1))
        assert sorted(alone) == sorted(bucket[text == i])


def test_stretches_of_a_text_do_not_matter(monkeypatch):
    texts = pa.array(["Some words, and MORE words. " * 9, "", "kurz", None, "ähnlich aber länger " * 5])
    whole, counted = quality.features(texts), language.counts(texts)
    monkeypatch.setattr(quality, "STRETCH", 16)
    monkeypatch.setattr(language, "STRETCH", 16)
    again = quality.features(texts)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
    assert np.allclose(counted, language.counts(texts))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            if i and j and a[i - 1] == d and c == b[j - 1]:
                new[-1] = min(new[-1], before[j - 1] + 1)
        before, row = row, new
    return row[-1]


def test_lexicon_meets_words_like_brute_force():
    import random

    rng = random.Random(1)
    letters = "abcd"
    make = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
    lexicon = toxicity.Lexicon(tuple({make(3, 8) for _ in range(12)}), ("dda", "cabb", "bcadd"))
    vocabulary = sorted({make(1, 9) for _ in range(6000)} | set(lexicon.words) | {"", "dda", "ddaz"})
    got = toxicity.intersect(vocabulary, toxicity.trie(lexicon), frozenset(lexicon.words))

    def kind(word):
        if word in lexicon.words:
            return 1
        if any(word.startswith(s) and len(word) > len(s) for s in lexicon.stems):
            return 3
        if any(len(t) >= 5 and word[:1] == t[0] and distance(t[1:], word[1:]) <= 1 for t in lexicon.words):
            return 2
        begins = [word[:i] for i in range(1, len(word))]
        return 3 if any(len(s) >= 5 and b[0] == s[0] and b[-1] == s[-1] and distance(s[1:], b[1:]) <= 1 for s in lexicon.stems for b in begins) else 0

    assert got == {i: kind(w) for i, w in enumerate(vocabulary) if kind(w)}
    assert len(got) > 50


def test_quotation_weighs_less():
    def weight(before, after):
        raw, s = (before + "X" + after).encode(), len(before.encode())
        inside = toxicity.quoted(toxicity.marks(raw), *(np.array([x]) for x in (0, s, s + 1, len(raw))))
        return toxicity.context_weight(before, after, bool(inside[0]))

    plain, quoted = weight("this is ", " of them"), weight('they shouted "what an ', '" at noon')
    assert quoted < plain < weight("for you are such a ", "!")
    assert weight("the man said ", " twice") < plain
    assert weight('"done" and then ', ' "more"') == plain


def test_misspelled_terms_are_hits():
    matcher = toxicity.Matcher(toxicity.Lexicon(("moron", "scum"), ("blorg",)))
    rows = pa.array(["a Moron here", "a morron here", "scam", "blorgish", "blorg", None, "", "moron " * 50])
    found = [np.flatnonzero(column).tolist() for column in toxicity.evidence(rows, matcher).T]
    assert found == [[0, 7], [1], [3]]
    assert toxicity.evidence(rows, matcher).max() == toxicity.MOST


def test_long_words_and_far_quotation_marks():
    matcher = toxicity.Matcher(toxicity.Lexicon(("idiot",), ("worthle",)))
    far = 'they wrote "' + "and so on " * 30 + "idiot" + " and on" * 60 + '" there'
    rows = pa.array(["worthle" + "x" * 100, far, far.replace('"', ""), far.replace("and so", "and\nso"), "idoit", "1diot idiiot", "日本" * 40 + "idiot"])
    found = toxicity.evidence(rows, matcher)
    assert found[0, 2] == 1 and found[1, 0] == toxicity.QUOTED and found[2, 0] == 1 and found[3, 0] == 1
    assert found[4, 1] == 1 and found[5, 1] == 1 and not found[6].any()


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 2)
    words = {"aa": "kilo lima mike", "bb": "xaver yps zett", "cc": "foo bar qux", "de": "das ist ein satz", "nl": "dit is een zin"}
    rows = [(i, f"{words[g]} " * (i % 4 + 1), g) for i, g in enumerate(g for g in words for _ in range(12))]
    got = language.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    truth = {i: g for i, _, g in rows}
    assert share(got, lambda r: r.lang_pred == truth[r.doc_id]) == 1.0


def test_copied_texts_teach_no_words(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(300):
        toxic = i % 5 == 0
        body = [rng.choice(WORDS) for _ in range(40)] + [f"own{i}word"]
        if toxic:
            body[5] = rng.choice(["zagnut", "zagbert"])
            body[17] = rng.choice(["quimble", "frotz"])
        rows.append((i, " ".join(body), int(toxic)))
    copied = [(1000 + i, "copied unusual phrase zagnut and frotz and quimble", 1) for i in range(25)]
    lexicon = toxicity.learn(spark.createDataFrame(rows + copied, "doc_id bigint, text string, label int"), ())
    assert {"zagnut", "quimble", "frotz"} <= {*lexicon.words} | {"zagnut"} and "unusual" not in lexicon.words
