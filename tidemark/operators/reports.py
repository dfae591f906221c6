"""Narrative reports and model replies as structured rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import two_decimals


def merge_reports(base: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Both reports of a user in one row, for users that have both; one row per user on each side."""
    return base.join(trajectory, "subject_id")


def report_text_assembly(reports: DataFrame) -> DataFrame:
    """`report`: the summary followed by every phase as a titled block, in the order given."""
    blocks = F.transform(
        F.coalesce("phases", F.array().cast(reports.schema["phases"].dataType)),
        lambda p: F.concat(
            F.lit("\n\nPhase "),
            p["phase_num"].cast("string"),
            F.lit(": "),
            F.coalesce(p["start_date"], F.lit("")),
            F.lit(" to "),
            F.coalesce(p["end_date"], F.lit("")),
            F.lit(" (Delta: "),
            two_decimals(F.coalesce(p["delta"], F.lit(0.0))),
            F.lit(")\n"),
            F.coalesce(p["narrative"], F.lit("")),
        ),
    )
    text = F.concat(F.coalesce("trajectory_summary", F.lit("")), F.lit("\n"), F.array_join(blocks, ""))
    return reports.withColumn("report", text)


def phase_array(phases: DataFrame) -> DataFrame:
    """Phase rows with narratives to one ordered array per user; a user has at most k phases."""
    item = F.struct(
        F.col("phase_num").cast("int").alias("phase_num"),
        F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date"),
        "narrative",
        "delta",
    )
    return phases.groupBy("subject_id").agg(F.array_sort(F.collect_list(item)).alias("phases"))


def flatten_topics(topics: DataFrame) -> DataFrame:
    """Topic lists to one row per topic: position in positive ++ neutral ++ negative, and valence."""

    def tagged(valence: str):
        values = F.coalesce(F.col(f"{valence}topics"), F.array().cast("array<string>"))
        return F.transform(values, lambda t: F.struct(F.lit(valence).alias("valence"), t.alias("topic")))

    keep = [c for c in topics.columns if c not in ("positivetopics", "neutraltopics", "negativetopics")]
    everything = F.concat(tagged("positive"), tagged("neutral"), tagged("negative"))
    return topics.select(*keep, F.posexplode(everything).alias("position", "t")).select(
        *keep, "position", "t.valence", "t.topic"
    )


def parse_llm_json(replies: DataFrame, struct: T.StructType, column: str = "reply") -> DataFrame:
    """`parsed`: the reply as `struct`, null with an `error` when it is not such JSON."""
    with_raw = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(column, with_raw, {"mode": "PERMISSIVE"})
    good = F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull()
    fields = F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in struct.fields])
    return (
        replies.withColumn("_p", parsed)
        .withColumn("parsed", F.when(good, fields))
        .withColumn("error", F.when(~good, F.lit("reply is not the expected JSON")))
        .drop("_p")
    )


# Fixed value: a fenced block of a reply, with or without a language.
FENCE = "```[A-Za-z]*\\s*([\\s\\S]*?)```"


def json_objects(text: Column) -> Column:
    """Every outermost balanced `{...}` of a text, in order; braces and quotes inside JSON strings do not count.

    A brace that is never closed hides what follows it.
    """
    none = F.array().cast("array<struct<low:int,high:int>>")
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("low"), none.alias("found")
    )

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + F.lit(1)
        opens = ~s["quoted"] & (c == "{")
        closes = ~s["quoted"] & (c == "}") & (s["depth"] > 0)
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        # Outside of an object a quotation mark is prose.
        marks = (c == '"') & ~s["escaped"] & (s["depth"] > 0)
        low = F.when(opens & (s["depth"] == 0), at).otherwise(s["low"])
        ends = closes & (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when(marks, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), at.alias("at"), low.alias("low"),
            F.when(ends, F.concat(s["found"], F.array(F.struct(low.alias("low"), at.alias("high"))))).otherwise(s["found"]).alias("found"),
        )

    spans = F.aggregate(F.split(text, ""), start, step, lambda s: s["found"])
    return F.transform(spans, lambda p: F.substring(text, p["low"], p["high"] - p["low"] + F.lit(1)))


def parse_reply_json(replies: DataFrame, struct: T.StructType, column: str = "reply") -> DataFrame:
    """`parsed`: the first object of a reply that is JSON of `struct`, whatever prose or fences are around it.

    Fenced blocks come first, then the whole reply.  Without such an object `parsed` is null and `error` tells whether
    there was no object or none of the expected kind.
    """
    reply = F.coalesce(F.col(column), F.lit(""))
    fenced = F.flatten(F.transform(F.regexp_extract_all(reply, F.lit(FENCE), F.lit(1)), json_objects))
    with_raw = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])

    def read(text: Column) -> Column:
        return F.from_json(text, with_raw, {"mode": "PERMISSIVE"})

    # A field at least: any other object in braces is not what was asked for.
    def fits(text: Column) -> Column:
        some = F.array_contains(F.array(*[read(text)[f.name].isNotNull() for f in struct.fields]), True)
        return read(text)["_corrupt_record"].isNull() & some

    found = replies.withColumn("_all", F.concat(fenced, json_objects(reply)))
    found = found.withColumn("_text", F.try_element_at(F.filter("_all", fits), F.lit(1)))
    fields = F.struct(*[read(F.col("_text"))[f.name].alias(f.name) for f in struct.fields])
    error = F.when(F.size("_all") == 0, "no object in the reply").otherwise("no object of the expected kind")
    return (
        found.withColumn("parsed", F.when(F.col("_text").isNotNull(), fields))
        .withColumn("error", F.when(F.col("_text").isNull(), error))
        .drop("_all", "_text")
    )
