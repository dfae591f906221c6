import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        builder(
            "tests",
            **{
                "spark.sql.shuffle.partitions": "4",
                "spark.ui.enabled": "false",
                "spark.driver.memory": "6g",
                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-tests-"),
            },
        )
        .master("local[8]")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def posts(spark):
    """Builds classified posts from (id, subject, date text, severe, moderate, text)."""

    def make(rows):
        df = spark.createDataFrame(
            rows, "id bigint, subject_id bigint, date string, prob_severe double, prob_moderate double, text string"
        )
        return df.selectExpr(
            "id", "subject_id", "try_to_timestamp(date) AS date", "prob_severe", "prob_moderate", "text"
        )

    return make
