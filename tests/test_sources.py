import csv
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import coerce_date
from tidemark.operators import clean, prompts, risk
from tidemark.sources import archives, records, reports, tables


def writing(date="2020-01-01", title="t", info="i", text="x"):
    parts = [f"<{k}>{v}</{k}>" for k, v in (("DATE", date), ("TITLE", title), ("INFO", info), ("TEXT", text)) if v is not None]
    return f"<WRITING>{''.join(parts)}</WRITING>"


def member(subject, *writings):
    return f"<INDIVIDUAL><ID>{subject}</ID>{''.join(writings)}</INDIVIDUAL>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")

    def put(name, files):
        with zipfile.ZipFile(d / name, "w") as z:
            for n, content in files.items():
                z.writestr(n, content)

    put("Chunk3.zip", {
        "a.xml": member(" subject11 ", writing(text=" line one\nsee [x](http://y)\t"), writing(title="", text="")),
        "b.xml": "<INDIVIDUAL><ID>subject12</ID><WRITING>",
        "c.xml": member("subject13", writing(title=None), writing(text="kept out with its member")),
        "d.xml": "<INDIVIDUAL>" + writing() + "</INDIVIDUAL>",
        "e.xml": member("subject14"),
        "notes.txt": "no",
        "z.xml": member("subject15", writing(text="after the bad ones")),
    })
    put("chunk-x.zip", {"a.xml": member("subject21", writing(text="no digits"))})
    put("other.zip", {
        "latin.xml": ('<?xml version="1.0" encoding="ISO-8859-1"?>' + member("subject31", writing(text="caf\xe9 &amp; co"))).encode("latin-1")
    })
    (d / "chunk9.zip").write_bytes(b"this is not an archive")
    return str(d)


def test_archives(spark, folder):
    members = archives.read_members(spark, f"{folder}/*.zip")
    got = {(r.subject_id, r.text): r for r in archives.raw_posts(members).collect()}
    assert set(got) == {
        ("11", "line one\nsee [x](http://y)"),
        ("11", ""),
        ("15", "after the bad ones"),
        ("21", "no digits"),
        ("31", "café & co"),
    }
    assert got["11", ""].title == "" and got["11", ""].chunk == "3"
    assert got["21", "no digits"].chunk == "Unknown" and got["31", "café & co"].chunk == "Unknown"
    rejected = {(r.path.rsplit("/", 1)[1], r.member) for r in archives.rejected_members(members).collect()}
    assert rejected == {("Chunk3.zip", "b.xml"), ("Chunk3.zip", "c.xml"), ("Chunk3.zip", "d.xml"), ("chunk9.zip", None)}


def test_preparation_chain(spark, folder, tmp_path):
    labels = tmp_path / "labels.txt"
    labels.write_text("subject11\t1\nsubject15\t0\nsubject15\t2\nsubject99\t1\n")
    posts = clean.clean_posts(archives.ingest_zip_xml(spark, f"{folder}/*.zip"))
    joined = clean.label_left_join(posts, tables.read_labels_tsv(spark, str(labels)))
    got = sorted((r.subject_id, r.text, r.label) for r in joined.collect())
    # The empty post is gone, the duplicate label fans out, unlabelled users stay.
    assert [g[:2] for g in got] == [
        ("11", "line one see x"), ("15", "after the bad ones"), ("15", "after the bad ones"), ("21", "no digits"), ("31", "café & co"),
    ]
    assert [g[2] for g in got] == ["1", "0", "2", None, None]


def test_csv_with_quotes_line_breaks_and_padded_header(spark, tmp_path):
    rows = [
        ["2714", "1", "2020-01-02 03:04:05", 'He said "no", then\nleft', "0.5", ""],
        ["x9", "2", "yesterday", "", "nan", "0.25"],
    ]
    with open(tmp_path / "posts.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow([" Subject ID", "Chunk", "Date ", "Text", "Prob_Severe_Depressed", " Prob_Moderate_Depressed "])
        w.writerows(rows)
    df = tables.load_posts_csv(spark, str(tmp_path / "posts.csv"))
    assert dict(df.dtypes)["subject_id"] == "bigint" and dict(df.dtypes)["date"] == "timestamp"
    a, b = df.orderBy(F.desc("subject_id")).collect()
    assert (a.subject_id, a.text, a.prob_severe, a.prob_moderate) == (2714, 'He said "no", then\nleft', 0.5, None)
    assert str(a.date) == "2020-01-02 03:04:05"
    assert (b.subject_id, b.date, b.prob_severe, b.prob_moderate) == (None, None, None, 0.25)


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Subject ID,Text\n1,x\n")
    with pytest.raises(ValueError, match="date"):
        tables.load_posts_csv(spark, str(tmp_path / "a.csv"))


def test_export_is_in_numeric_order(spark, tmp_path):
    rows = [(s, f"2020-01-{d:02d}", f'post "{s}", {d}\nmore') for s in ("10", "2", "x", "1") for d in (3, 1, 2)]
    df = spark.createDataFrame(rows, "subject_id string, date string, text string").repartition(4)
    out = str(tmp_path / "out")
    tables.export_sorted(df, out)
    lines = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            lines += list(csv.reader(f))[1:]
    assert lines == [list(r) for r in sorted(rows, key=lambda r: (int(r[0]) if r[0].isdigit() else -1, r[1]))]


def test_results_of_one_user_sit_together(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 40).alias("subject_id"), "id").repartition(8)
    out = str(tmp_path / "out")
    tables.write_results(df, out)
    back = spark.read.parquet(out)
    assert back.count() == 2000
    files = back.groupBy("subject_id").agg(F.count_distinct(F.col("_metadata.file_path")).alias("n"))
    assert files.agg(F.max("n")).first()[0] <= 2


def test_loaded_posts_have_ids(spark, tmp_path):
    rows = [["7", "2020-01-02 03:04:05", "same"]] * 3 + [["7", "2020-01-02 03:04:05", "other"], ["", "", ""]]
    with open(tmp_path / "posts.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([["Subject ID", "Date", "Text"], *rows])
    df = tables.load_posts_csv(spark, str(tmp_path / "posts.csv"))
    first, again = (sorted((r.id, r.text or "") for r in df.repartition(n).collect()) for n in (1, 4))
    assert first == again and len({i for i, _ in first}) == 5
    posts = df.selectExpr("*", "0.5D AS prob_severe", "0.1D AS prob_moderate")
    assert risk.recent_posts(posts, 10).where("subject_id = 7").count() == 4
    assert prompts.base_prompts(posts).where("subject_id = 7").first().n_posts == 4


def test_many_spellings_of_dates(spark):
    given = ["2020-01-02 03:04:05", "2020-01-02T03:04", "2020/01/02", "1/2/2020", "1/2/2020 3:04", "2 Jan 2020", "Jan 2, 2020", "20200102", " 2020-01-02 "]
    df = spark.createDataFrame([(g,) for g in given] + [("soon",), (None,), ("13/45/2020",)], "date string")
    days = [str(r.day) for r in df.limit(len(given)).select(F.to_date(coerce_date(F.col("date"))).alias("day")).collect()]
    assert days == ["2020-01-02"] * len(given)
    assert tuple(clean.rejected_dates(df).first()) == (len(given) + 2, 2)


def test_verdicts_need_scores_and_letters(spark, tmp_path):
    whole = '{"result": {"Report_A": {"c": 1}, "Report_B": {"c": 2}, "Preferred_Report": "B"}, "mapping": {"A": "base", "B": "trajectory"}}'
    files = {
        "eval_u 4.json": whole, "eval_a+b.json": whole, "eval_1.json": "{}", "eval_2.json": '{"result": {}, "mapping": {}}',
        "eval_3.json": whole.replace('"A": "base", ', ""), "eval_4.json": whole[:30], "eval_5.json": "",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    got = reports.read_eval_json(spark, str(tmp_path / "eval_*.json"))
    assert sorted(r.subject_id for r in got.collect()) == ["a+b", "u 4"]


@pytest.mark.parametrize("size", ["64", "700", "100000"])
def test_csv_in_parts_is_read_as_a_whole(spark, tmp_path, size):
    import random

    rng = random.Random(int(size))
    pieces = ["plain", 'a "quoted" word', "line\nbreak", "two\n\nbreaks\n", "comma, here", "", " padded ", '"', '""', "x" * 300, "é\n日本", "\n", '","', "cr\r\nlf"]
    for name, ending in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=ending)
            w.writerow(["id", " Text", 'odd "name"'])
            for i in range(150):
                w.writerow([i, rng.choice(pieces) + rng.choice(pieces), rng.choice(pieces)])
            if name == "a":
                w.writerow([999, "very long " + "line\n" * 400, "end"])
                f.write("\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = records.read_csv(spark, str(tmp_path), tables.CSV)
        assert got.columns == ["id", " Text", 'odd "name"']
        parts = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        rows = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > {"64": 50, "700": 5, "100000": 0}[size]
    whole = spark.read.options(**tables.CSV).option("multiLine", "true").csv(str(tmp_path))
    assert rows == sorted(map(tuple, whole.collect()), key=str)
    assert len(rows) == 301
