"""Files written from the given tables and read back."""

from pyspark.sql import functions as F

from registry.base import POSTS_SQL, posts, query, r6, table
from registry.files import write_archives, write_files
from registry.judge import VERDICTS_SQL, verdicts
from registry.narratives import base_reports, trajectory_reports
from registry.risk import SERIES_SQL
from registry.segments import segments_sql
from tidemark.operators import prompts, risk, topics
from tidemark.operators.reports import flatten_topics, merge_reports
from tidemark.plans.lineage import scratch_path
from tidemark.plans.ordered import running_total
from tidemark.sources import archives, reports, tables

P = f"WITH {POSTS_SQL} "


@query(
    "ingest_zip_xml",
    r"""SELECT CAST(conv_id AS VARCHAR) AS subject_id, CAST(turn // 4 AS VARCHAR) AS chunk,
    'day ' || turn AS date, role AS title, '' AS info, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations""",
)
def ingest_zip_xml(spark, d):
    rows = table(spark, d, "conversations").select(
        # An archive holds a few turns of a few conversations, whatever the table's size.
        F.expr("concat('Chunk', turn div 4, '-', conv_id div 50, '.zip')").alias("archive"),
        F.concat(F.lit("subject"), F.col("conv_id").cast("string")).alias("subject"),
        "turn",
        F.concat(F.lit("day "), F.col("turn").cast("string")).alias("date"),
        F.col("role").alias("title"),
        F.lit("").alias("info"),
        "text",
    )
    folder = scratch_path(spark, "archives")
    write_archives(rows, folder)
    return archives.ingest_zip_xml(spark, f"{folder}/*.zip").drop("id")


@query("read_labels_tsv", "SELECT CAST(doc_id AS VARCHAR) AS subject_id, CAST(quality AS VARCHAR) AS label FROM labels")
def read_labels_tsv(spark, d):
    path = scratch_path(spark, "labels")
    line = F.concat(F.lit("subject"), F.col("doc_id").cast("string"), F.lit("\t"), F.col("quality").cast("string"))
    table(spark, d, "labels").select(line).write.text(path)
    return tables.read_labels_tsv(spark, path)


# Quotes, a comma and a line break in every text; error events have a broken date.
CSV_TEXT_SQL = """text || ', "quoted"' || chr(10) || 'line'"""


def csv_posts(spark, d):
    text = F.concat("text", F.lit(', "quoted"\nline'))
    date = F.when(F.col("text").startswith("error"), F.lit("soon")).otherwise(
        F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    )
    return posts(spark, d).withColumn("text", text).withColumn("date", date)


@query(
    "load_posts_csv",
    P + f"""SELECT subject_id, CAST(id AS VARCHAR) AS chunk, CASE WHEN text NOT LIKE 'error%' THEN
    date_trunc('second', date) END AS date, {CSV_TEXT_SQL} AS text, round(prob_severe, 6) AS prob_severe,
    round(prob_moderate, 6) AS prob_moderate FROM posts""",
)
def load_posts_csv(spark, d):
    path = scratch_path(spark, "posts")
    csv_posts(spark, d).select(
        F.col("subject_id").alias(" Subject ID"),
        F.col("id").alias("Chunk "),
        F.col("date").alias(" Date "),
        F.col("text").alias("Text"),
        F.col("prob_severe").alias("Prob_Severe_Depressed"),
        F.col("prob_moderate").alias("Prob_Moderate_Depressed"),
    ).write.options(**tables.CSV).csv(path)
    loaded = tables.load_posts_csv(spark, path)
    return loaded.select(
        "subject_id", "chunk", F.col("date").cast("timestamp_ntz").alias("date"), "text", r6("prob_severe"), r6("prob_moderate")
    )


# Posts written without ids, every tenth one twice, and loaded again.
COPIES_SQL = P + """, twice AS (SELECT subject_id, date_trunc('second', date) AS date, text, prob_severe, prob_moderate FROM posts
  UNION ALL SELECT subject_id, date_trunc('second', date), text, prob_severe, prob_moderate FROM posts WHERE id % 10 = 0),
lines AS (SELECT *, '[' || strftime(date, '%Y-%m-%d %H:%M:%S') || '] ' || text AS line FROM twice)
"""


def without_ids(spark, d):
    path = scratch_path(spark, "no-ids")
    plain = posts(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    plain.unionAll(plain.where("id % 10 = 0")).select(
        F.col("subject_id").alias("Subject ID"),
        F.col("date").alias("Date"),
        F.col("text").alias("Text"),
        F.col("prob_severe").alias("Prob_Severe_Depressed"),
        F.col("prob_moderate").alias("Prob_Moderate_Depressed"),
    ).write.options(**tables.CSV).csv(path)
    return tables.load_posts_csv(spark, path)


@query(
    "recent_posts_of_csv",
    COPIES_SQL + """SELECT subject_id, date, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY date DESC) AS place
      FROM twice) WHERE place <= 5 GROUP BY 1, 2""",
)
def recent_posts_of_csv(spark, d):
    recent = risk.recent_posts(without_ids(spark, d), 5)
    return recent.groupBy("subject_id", F.col("date").cast("timestamp_ntz").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prompts_of_csv",
    COPIES_SQL + """SELECT subject_id, count(*) AS n_posts, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS n_chars,
      CAST(count(DISTINCT line) AS BIGINT) AS n_lines FROM lines GROUP BY 1""",
)
def prompts_of_csv(spark, d):
    whole = prompts.base_prompts(without_ids(spark, d), "{posts}", max_chars=10_000_000)
    return whole.select(
        "subject_id", "n_posts", F.length("prompt").cast("bigint").alias("n_chars"),
        F.size(F.array_distinct(F.split("prompt", "\n", -1))).cast("bigint").alias("n_lines"),
    )


@query(
    "user_text_of_csv",
    COPIES_SQL + "SELECT subject_id, count(*) AS n_texts, CAST(sum(length(text) + 1) - 1 AS BIGINT) AS n_chars FROM twice GROUP BY 1",
)
def user_text_of_csv(spark, d):
    whole = topics.user_topic_text(without_ids(spark, d))
    return whole.select("subject_id", "n_texts", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "export_sorted",
    P + f"""SELECT CAST(subject_id AS VARCHAR) AS subject_id, CAST(id AS VARCHAR) AS id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date,
    {CSV_TEXT_SQL} AS text, CAST(row_number() OVER (ORDER BY subject_id, strftime(date, '%Y-%m-%d %H:%M:%S'), id) AS BIGINT) - 1 AS line FROM posts""",
)
def export_sorted(spark, d):
    path = scratch_path(spark, "sorted")
    rows = (
        posts(spark, d)
        .withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("text", F.concat("text", F.lit(', "quoted"\nline')))
    )
    tables.export_sorted(rows.select("subject_id", "id", "date", "text"), path, ties=["id"])
    back = (
        spark.read.options(**tables.CSV)
        .option("multiLine", "true")
        .csv(path)
        .select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))
    )
    # Lines of the part files in name order, to show that the files are one sorted whole.
    lines = running_total(back.select("file", "place"), [], ["file", "place"], F.lit(1), "line")
    return back.join(lines, ["file", "place"]).drop("file", "place")


@query(
    "read_eval_json",
    VERDICTS_SQL + """SELECT CAST(subject_id AS VARCHAR) AS subject_id, preferred, a AS mapping_a,
      CAST(count(*) AS BIGINT) AS scores_a, round(sum(score_a), 6) AS total_a FROM verdict_rows WHERE score_a IS NOT NULL GROUP BY 1, 2, 3""",
)
def read_eval_json(spark, d):
    folder = scratch_path(spark, "evaluations")
    files = verdicts(spark, d).select(
        F.concat(F.lit("eval_"), F.col("subject_id").cast("string"), F.lit(".json")).alias("name"),
        F.to_json(F.struct("result", "mapping"), {"pretty": "true"}).alias("content"),
    )
    write_files(files, folder)
    # A summary file with the same name pattern and no verdict, which the reader leaves out.
    summary = files.groupBy().agg(
        F.lit("eval_summary_cache.json").alias("name"),
        F.concat(F.lit('{"Criterion_Justifications": {"n": "'), F.count(F.lit(1)).cast("string"), F.lit('"}}')).alias("content"),
    )
    write_files(summary, folder)
    # Damaged and empty files, and empty objects, which it leaves out too.
    others = files.select(
        F.regexp_replace("name", "eval_", "eval_no").alias("name"),
        F.element_at(
            F.array(F.lit("{}"), F.lit('{"result": {}, "mapping": {}}'), F.lit('{"result": {"Report_A"'), F.lit("")),
            (F.pmod(F.xxhash64("name"), F.lit(4)) + 1).cast("int"),
        ).alias("content"),
    )
    write_files(others, folder)
    back = reports.read_eval_json(spark, f"{folder}/eval_*.json")
    scores = F.map_values("result.Report_A")
    return back.select(
        "subject_id",
        F.col("result.Preferred_Report").alias("preferred"),
        F.col("mapping.A").alias("mapping_a"),
        F.size(scores).cast("bigint").alias("scores_a"),
        F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + v).alias("total_a"),
    )


@query(
    "read_topic_json",
    """WITH t AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative'
      ELSE 'neutral' END AS valence, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT CAST(user_id AS VARCHAR) AS subject_id, 'posts' AS source, valence, valence || ' topic ' || n AS topic FROM t""",
)
def read_topic_json(spark, d):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), F.lit("positive")).when(
        F.col("event_type") == "error", F.lit("negative")
    ).otherwise(F.lit("neutral"))
    counts = table(spark, d, "events").groupBy("user_id").agg(
        *[F.count_if(kind == v).alias(v) for v in ("positive", "neutral", "negative")]
    )
    lists = [
        F.when(F.col(v) > 0, F.array(F.concat(F.lit(f"{v} topic "), F.col(v).cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias(f"{v}topics")
        for v in ("positive", "neutral", "negative")
    ]
    files = counts.select(
        F.concat(F.col("user_id").cast("string"), F.lit("_posts_topics.json")).alias("name"),
        F.to_json(F.struct(*lists), {"pretty": "true"}).alias("content"),
    )
    folder = scratch_path(spark, "topics")
    write_files(files, folder)
    back = reports.read_topic_json(spark, f"{folder}/*_topics.json")
    return flatten_topics(back).select("subject_id", "source", "valence", "topic")


@query(
    "read_report_json",
    segments_sql(4) + """, base AS (SELECT subject_id, 'User ' || subject_id || ' wrote ' || count(*) || ' posts.' AS base_analysis
      FROM posts GROUP BY 1)
    SELECT CAST(s.subject_id AS VARCHAR) AS subject_id, base_analysis, 'User ' || s.subject_id || ' over ' || count(*) || ' phases.' AS trajectory_summary,
      CAST(count(*) AS INTEGER) AS n_phases, string_agg('Phase ' || seg_no || ' of user ' || s.subject_id || '.', ' ' ORDER BY seg_no) AS narratives,
      round(sum(round(end_val - start_val, 9)), 6) AS total_delta
    FROM seg s JOIN base USING (subject_id) GROUP BY 1, 2, s.subject_id""",
)
def read_report_json(spark, d):
    name = F.concat(F.col("subject_id").cast("string"), F.lit(".json")).alias("name")
    folder = scratch_path(spark, "reports")
    base = base_reports(spark, d).select(name, F.to_json(F.struct("base_analysis")).alias("content"))
    trajectory = trajectory_reports(spark, d).select(
        name, F.to_json(F.struct("phases", "trajectory_summary"), {"pretty": "true"}).alias("content")
    )
    write_files(base, f"{folder}/base")
    write_files(trajectory, f"{folder}/trajectory")
    merged = merge_reports(
        reports.read_base_reports(spark, f"{folder}/base/*.json"),
        reports.read_trajectory_reports(spark, f"{folder}/trajectory/*.json"),
    )
    deltas = F.aggregate("phases", F.lit(0.0), lambda acc, p: acc + F.round(p["delta"], 9))
    return merged.select(
        "subject_id",
        "base_analysis",
        "trajectory_summary",
        F.size("phases").alias("n_phases"),
        F.array_join(F.transform("phases", lambda p: p["narrative"]), " ").alias("narratives"),
        F.round(deltas, 6).alias("total_delta"),
    )


@query(
    "write_results",
    SERIES_SQL + "SELECT subject_id, day, round(ema, 6) AS ema, round(ema_smooth, 6) AS ema_smooth FROM series",
)
def write_results(spark, d):
    path = scratch_path(spark, "series")
    tables.write_results(risk.risk_series(posts(spark, d)), path, by=("subject_id", "day"))
    return spark.read.parquet(path).select("subject_id", "day", r6("ema"), r6("ema_smooth"))
