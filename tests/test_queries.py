"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from registry import QUERIES
from check_queries import TABLES, _plain_row, rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


# Queries whose last plan unzips, multiplies blocks, projects texts, cuts records or calls a model; no other may leave the JVM.
PYTHON = {
    "ingest_zip_xml", "batch_infer", "complete_prompts", "cosine_maxima", "best_match", "matched_only", "coverage_metrics",
    "coverage_sensitivity", "topic_ground_truth", "text_coverage", "topic_coverage", "embed_text", "factor_text", "nearest_neighbours", "infer_once",
    "load_posts_csv", "recent_posts_of_csv", "prompts_of_csv", "user_text_of_csv",
}
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert (name in PYTHON) == any(node in plan for node in PYTHON_NODES)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = rows(df.columns, [tuple(_plain_row(r)) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
