import json

import pytest

from tidemark.operators import judge, reports
from tidemark.schema import TOPIC_LISTS, TRAJECTORY_REPORT
from tidemark.sources.reports import (
    read_base_reports,
    read_eval_json,
    read_topic_json,
    read_trajectory_reports,
)


def verdict(a, b, preferred, first="base", **more):
    other = "trajectory" if first == "base" else "base"
    return {
        "result": {"Report_A": a, "Report_B": b, "Preferred_Report": preferred, "Rationale": "r", **more},
        "mapping": {"A": first, "B": other},
    }


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("evaluations")
    put = lambda name, value: (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=4))
    put("eval_1.json", verdict({"Temporal_Coherence": 4, "Overall_Preference": 2}, {"Temporal_Coherence": 3}, "A",
                               Criterion_Justifications={"Temporal_Coherence": "clear"}))
    put("eval_2.json", verdict({"Temporal_Coherence": 5}, {"Temporal_Coherence": 1, "Overall_Preference": 1}, "A", first="trajectory"))
    put("eval_3.json", verdict({"Temporal_Coherence": 2}, {"Temporal_Coherence": 2}, "Tie"))
    put("eval_summary_cache.json", {"Criterion_Justifications": {"Temporal_Coherence": "all"}})
    put("eval_4.json", '{"result": {"Report_A": {')
    put("eval_5.json", {"result": {"Report_A": {}}})
    return str(folder)


@pytest.fixture(scope="module")
def verdicts(spark, files):
    return read_eval_json(spark, f"{files}/eval_*.json")


def test_only_whole_verdicts_are_read(verdicts):
    assert sorted(r.subject_id for r in verdicts.collect()) == ["1", "2", "3"]


def test_preferences_follow_the_mapping(verdicts):
    assert judge.judge_preferences(verdicts).first().asDict() == {"base": 1, "trajectory": 1, "tie": 1, "total_evals": 3}


def test_means_over_the_base_criteria(verdicts):
    got = {r.criterion: r for r in judge.judge_criteria_means(verdicts).collect()}
    assert got["Temporal Coherence"].avg_base == pytest.approx((4 + 1 + 2) / 3)
    assert got["Temporal Coherence"].avg_trajectory == pytest.approx((3 + 5 + 2) / 3)
    assert got["Temporal Coherence"].trajectory_text == "3.33"
    # Named by the base report of two users; neither trajectory report scored it.
    assert (got["Overall Preference"].avg_base, got["Overall Preference"].avg_trajectory) == (1.5, 0.0)


def test_user_table(verdicts):
    rows = judge.judge_user_table(verdicts).where("subject_id = '1'").orderBy("position").collect()
    assert [r.criterion for r in rows] == [c.replace("_", " ") for c in judge.CRITERIA]
    assert rows[0].winner == "Narrative Base" and rows[0].score_base == 0.0
    assert (rows[1].score_base, rows[1].score_trajectory, rows[1].justification) == (4.0, 3.0, "clear")


def test_assignment_is_reproducible_and_mixed(spark):
    users = spark.range(400).withColumnRenamed("id", "subject_id")
    first = [r.mapping.A for r in judge.ab_assignment(users, 1).orderBy("subject_id").collect()]
    assert first == [r.mapping.A for r in judge.ab_assignment(users.repartition(3), 1).orderBy("subject_id").collect()]
    assert 140 < first.count("base") < 260
    assert first != [r.mapping.A for r in judge.ab_assignment(users, 2).orderBy("subject_id").collect()]
    assert all(r.mapping.A != r.mapping.B for r in judge.ab_assignment(users, 1).collect())


def test_report_text(spark):
    rows = [
        ("1", ([(1, "2020-01-01", "2020-01-05", "Calm.", -0.125), (2, "2020-01-05", None, None, None)], "In short.")),
        ("2", ([], "Nothing else.")),
        ("3", (None, None)),
    ]
    df = spark.createDataFrame([(s, *r) for s, r in rows], "subject_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRAJECTORY_REPORT))
    got = {r.subject_id: r.report for r in reports.report_text_assembly(df).collect()}
    assert got["1"] == (
        "In short.\n\n\nPhase 1: 2020-01-01 to 2020-01-05 (Delta: -0.12)\nCalm."
        "\n\nPhase 2: 2020-01-05 to  (Delta: 0.00)\n"
    )
    assert got["2"] == "Nothing else.\n" and got["3"] == "\n"


def test_flatten_keeps_list_order(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None, ["c"])], "subject_id int, " + ", ".join(f"{f.name} array<string>" for f in TOPIC_LISTS))
    got = [(r.position, r.valence, r.topic) for r in reports.flatten_topics(df).collect()]
    assert got == [(0, "positive", "a"), (1, "positive", "b"), (2, "negative", "c")]


def test_replies_that_are_not_json(spark):
    df = spark.createDataFrame(
        [(1, '{"positivetopics": ["a"], "neutraltopics": [], "negativetopics": []}'), (2, "Sure!"), (3, None), (4, '{"positivetopics": [')],
        "id int, reply string",
    )
    got = {r.id: r for r in reports.parse_llm_json(df, TOPIC_LISTS).collect()}
    assert got[1].parsed.positivetopics == ["a"] and got[1].error is None
    assert all(got[i].parsed is None and got[i].error for i in (2, 3, 4))


def test_report_files(spark, tmp_path):
    for name, value in {
        "base/7.json": {"base_analysis": "Once."},
        "base/8.json": {"base_analysis": "Twice."},
        "trajectory/7.json": {"phases": [{"phase_num": 1, "start_date": "2020-01-01", "end_date": "2020-02-01", "narrative": "n", "delta": 0.5}], "trajectory_summary": "s"},
        "topics/7_posts_topics.json": {"positivetopics": ["p"], "neutraltopics": [], "negativetopics": []},
        "topics/7_narrative_base_topics.json": {"positivetopics": [], "neutraltopics": ["q"], "negativetopics": []},
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(value, indent=4))
    base = read_base_reports(spark, f"{tmp_path}/base/*.json")
    merged = reports.merge_reports(base, read_trajectory_reports(spark, f"{tmp_path}/trajectory/*.json")).collect()
    assert [(r.subject_id, r.base_analysis, r.trajectory_summary, r.phases[0].delta) for r in merged] == [("7", "Once.", "s", 0.5)]
    got = reports.flatten_topics(read_topic_json(spark, f"{tmp_path}/topics/*.json")).collect()
    assert sorted((r.subject_id, r.source, r.topic) for r in got) == [("7", "narrative_base", "q"), ("7", "posts", "p")]
