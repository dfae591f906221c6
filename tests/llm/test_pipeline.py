"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import toxicity

from .conftest import sentence

INSULT = "you worthless idiot, you pathetic moron"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, sentence(rng, 30)) for i in range(3)]
    boiler = "This line stands below every page of this site."
    docs = [(i, "\n".join([sentence(rng, 60), sentence(rng, 50), boiler])) for i in range(40)]
    docs += [(50 + i, f"{sentence(rng, 20)} {INSULT} {sentence(rng, 20)}") for i in range(12)]
    docs += [(70, docs[3][1]), (71, docs[3][1]), (72, docs[9][1].replace(boiler, boiler + ".")), (73, "")]
    docs += [(80 + i, f"{sentence(rng, 40)} {text} {sentence(rng, 9)}") for i, text in items]
    docs += [(90, None), (None, "a text without an id")]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int(50 <= (i or 0) < 62)) for i, _ in docs]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(docs), boiler


def test_stages(spark, corpus):
    path, docs, boiler = corpus
    df = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = df.dtypes, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, path).collect(), df.schema)
        assert df.dtypes == columns
        left.append({r["doc_id"]: r for r in df.collect()})
    toxic, lines, near, clean = left
    assert set(docs) - set(toxic) == set(range(50, 62))
    # The line stays in its first document only, and in copies, which are documents' business.
    kept = {i for i, r in lines.items() if boiler in (r["text"] or "")}
    assert kept == {0, 70, 71} | {i for i in (72,) if boiler in lines[72]["text"]}
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.values())
    assert set(lines) - set(near) >= {71} and {70, 71} - set(near)
    assert set(near) - set(clean) == {80, 81, 82}
    final = corpus_pipeline.STAGES[-1][1](spark, df, path).collect()
    assert {r["doc_id"] for r in final} == set(clean) and all(r["same"] and len(r["ids"]) == r["n_tokens"] for r in final)


def test_no_line_is_left_twice(spark, tmp_path):
    rng = random.Random(12)
    head, foot = sentence(rng, 25), sentence(rng, 25)
    own = [sentence(rng, 12) for _ in range(6)]
    docs = [(i, f"{head}\n{x}\n{foot}") for i, x in enumerate(own)] + [(50, f"{head}\n{own[3]}\n{foot}"), (51, f"{foot}\n{head}")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id bigint, text string, n_chars bigint")
    once = spark.createDataFrame(corpus_pipeline.line_dedup(spark, df, "").collect(), df.schema)
    assert {r["doc_id"]: r["text"].count("\n") + bool(r["text"]) for r in once.collect()} == {0: 3, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 50: 3, 51: 0}
    left = [x for r in corpus_pipeline.near_dedup(spark, once, "").collect() for x in r["text"].split("\n") if x]
    assert sorted(left) == sorted([head, foot, *own])


def test_run_and_registration(spark, corpus):
    path, docs, _ = corpus
    got = entry.queries()["pipeline"](spark, path)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} <= set(docs)
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_toxic_rows_go_with_all_their_columns(spark, corpus):
    path, docs, _ = corpus
    df = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.array(F.lit(1)))
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = toxicity.without_toxic(df, labels)
    assert kept.dtypes == df.dtypes
    scored = toxicity.toxicity(df, labels).where("predicted = 0").select("doc_id")
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in scored.collect())
