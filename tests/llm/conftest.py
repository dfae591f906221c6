"""Small tables with everything that may go wrong in them."""

import random

import pytest

WORDS = [a + b for a in ("ba", "co", "di", "fe", "gu", "ha", "kö", "lé") for b in ("n", "st", "r", "ll", "th", "m", "nd", "x")]
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, term bigint, print string, line int, "
    "side string, place double, item array<int>, packed string, label string, score string, `class` int, r int, node int"
)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def messy_rows():
    """(doc_id, text) with copies, near copies, shared passages and lines, nulls, blanks, repeats and a long text."""
    rng = random.Random(5)
    passage, boiler = sentence(rng, 70), "All rights reserved by the owners of this page."
    rows = []
    for i in range(30):
        body = [sentence(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            body.append(boiler if i % 2 else boiler.replace("page", "pages"))
        if i % 7 == 1:
            body.insert(0, sentence(rng, 9) + "\t" + passage + "  " + sentence(rng, 5))
        rows.append((i, "\n".join(body)))
    rows += [(100 + i, rows[i][1]) for i in (2, 3, 3, 8)]
    rows += [(200 + i, rows[i][1] + " again") for i in (4, 12, 16)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "One"), (304, "One two"), (305, "\x00 😀 日本語 ▁x"), (306, "12 34!"), (307, boiler)]
    rows += [(None, rows[5][1]), (None, "nobody's text"), (None, None)]
    rows += [rows[6], rows[6], rows[20]]
    rows.append((400, " ".join(rng.choice(WORDS) for _ in range(30_000)) + " " + "x" * 5000 + "\n" + passage))
    rows.append((401, "same " * 300))
    return rows


def table(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), 1, "p", 2, "x", 0.5, [1], "z", "l", "s", 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
