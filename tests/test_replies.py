"""Objects in replies of language models."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import reports

KIND = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.ArrayType(T.IntegerType()))])


def scanned(text):
    """Outermost balanced objects, a character after the other."""
    out, depth, quoted, escaped, low = [], 0, False, False, 0
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            low, depth = (i if not depth else low), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[low : i + 1])
    return out


def test_objects_by_hand(spark):
    good = json.dumps({"a": 'x}{ "q" \\ é 😀', "n": [1, 2]}, ensure_ascii=False)
    texts = ["", "none", "}{", "{", good, good * 3, f"é {{x}} {good} {{", '{"a": {"b": {}}} "{"', '{"a": "\\\\"} {"b": "\\""}', '"quoted {" }']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.o for r in df.select("id", reports.json_objects(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(len(texts))] == [scanned(t) for t in texts]


def test_replies_with_prose_around_the_object(spark):
    good = '{"a": "b{}c", "n": [1]}'
    replies = {
        "plain": (good, "b{}c", None),
        "prose": (f"Sure! {good} Anything else?", "b{}c", None),
        "other": (f"For {{x}} and {{\"z\": 1}} I say {good}", "b{}c", None),
        "fence": (f"I open {{ here\n```json\n{good}\n```\nend", "b{}c", None),
        "first": (f"{good} {{\"a\": \"later\"}}", "b{}c", None),
        "cut": (good[:-2], None, "no object in the reply"),
        "wrong": ("{z}", None, "no object of the expected kind"),
        "types": ('{"n": "many"} {"a": 5, "n": [2]}', "5", None),
        "empty": ("", None, "no object in the reply"),
        "null": (None, None, "no object in the reply"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in replies.items()], "k string, reply string")
    got = {r.k: (r.parsed and r.parsed.a, r.error) for r in reports.parse_reply_json(df, KIND).collect()}
    assert got == {k: v[1:] for k, v in replies.items()}
