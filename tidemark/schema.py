"""Canonical schemas and the one place where file column names are mapped to ours."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_POSTS = T.StructType([
    T.StructField("subject_id", T.StringType()),
    T.StructField("chunk", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("info", T.StringType()),
    T.StructField("text", T.StringType()),
])

# Header names of the classified-posts files and our column names.
POST_COLUMNS = {
    "Subject ID": "subject_id",
    "SubjectID": "subject_id",
    "Chunk": "chunk",
    "Date": "date",
    "Info": "info",
    "Title": "title",
    "Text": "text",
    "Label": "label_user",
    "Label_User": "label_user",
    "Classification": "label_user",
    "Predicted_Label": "predicted_label",
    "Prob_Not_Depressed": "prob_not",
    "Prob_Moderate_Depressed": "prob_moderate",
    "Prob_Severe_Depressed": "prob_severe",
}

PROBABILITIES = ["prob_not", "prob_moderate", "prob_severe"]

WRITING = T.StructType([
    T.StructField("DATE", T.StringType()),
    T.StructField("TITLE", T.StringType()),
    T.StructField("INFO", T.StringType()),
    T.StructField("TEXT", T.StringType()),
])

ARCHIVE_MEMBER = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("WRITING", T.ArrayType(WRITING)),
    T.StructField("_corrupt", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("label", T.StringType()),
])

SCORES = T.MapType(T.StringType(), T.DoubleType())

VERDICT = T.StructType([
    T.StructField("result", T.StructType([
        T.StructField("Report_A", SCORES),
        T.StructField("Report_B", SCORES),
        T.StructField("Preferred_Report", T.StringType()),
        T.StructField("Criterion_Justifications", T.MapType(T.StringType(), T.StringType())),
        T.StructField("Rationale", T.StringType()),
    ])),
    T.StructField("mapping", T.StructType([
        T.StructField("A", T.StringType()),
        T.StructField("B", T.StringType()),
    ])),
])

TOPIC_LISTS = T.StructType([
    T.StructField("positivetopics", T.ArrayType(T.StringType())),
    T.StructField("neutraltopics", T.ArrayType(T.StringType())),
    T.StructField("negativetopics", T.ArrayType(T.StringType())),
])

PHASE = T.StructType([
    T.StructField("phase_num", T.IntegerType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("narrative", T.StringType()),
    T.StructField("delta", T.DoubleType()),
])

BASE_REPORT = T.StructType([T.StructField("base_analysis", T.StringType())])

TRAJECTORY_REPORT = T.StructType([
    T.StructField("phases", T.ArrayType(PHASE)),
    T.StructField("trajectory_summary", T.StringType()),
])
