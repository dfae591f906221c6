"""Applying a model or a text completion to a column, in batches on the executors.

No model ships with the library: callers pass a factory, run once per worker process, that returns
the function to apply.  Write the result to a table; models are too costly to rerun by accident.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scores
from tidemark.functions.vectors import l2_normalise
from tidemark.plans.lineage import cut


def batch_infer(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    column: str = "text",
    out: str = "logits",
    batch_size: int = 16,
) -> DataFrame:
    """`out`: one row of numbers per text, predicted in batches of `batch_size`."""
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(out, predict(F.col(column)))


def classify(
    posts: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    classes: Sequence[str] = ("prob_not", "prob_moderate", "prob_severe"),
    batch_size: int = 16,
) -> DataFrame:
    """Predicted label and one probability column per class, named in the order of the logits."""
    scored = batch_infer(posts, make_predict, out="_logits", batch_size=batch_size)
    return with_probabilities(scored, "_logits", classes).drop("_logits")


def with_probabilities(
    df: DataFrame, logits: str = "logits", classes: Sequence[str] = ("prob_not", "prob_moderate", "prob_severe")
) -> DataFrame:
    """Softmax probabilities and the 0-based label of an array of logits."""
    probabilities = df.withColumn("_p", scores.softmax(F.col(logits)))
    return probabilities.select(
        *df.columns,
        scores.argmax(F.col(logits)).alias("predicted_label"),
        *[F.col("_p")[i].alias(name) for i, name in enumerate(classes)],
    )


def embed(
    df: DataFrame,
    make_encode: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    column: str = "text",
    batch_size: int = 16,
) -> DataFrame:
    """`vector`: unit-length embedding of a text by the given encoder."""
    encoded = batch_infer(df, make_encode, column=column, out="_raw", batch_size=batch_size)
    return encoded.withColumn("vector", l2_normalise(F.col("_raw")).cast("array<float>")).drop("_raw")


def complete_prompts(
    prompts: DataFrame,
    make_complete: Callable[[], Callable[[str], str]],
    *,
    column: str = "prompt",
    out: str = "response",
    parallelism: int | None = None,
) -> DataFrame:
    """`out` and `error`: the completion of each prompt, or the error text of a failed call.

    `parallelism` bounds the calls in flight by the number of partitions.
    """
    schema = T.StructType([
        *prompts.schema.fields,
        T.StructField(out, T.StringType()),
        T.StructField("error", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_complete()

        def one(prompt):
            try:
                return complete(prompt), None
            except Exception as e:  # one failed call must not fail the others
                return None, f"{type(e).__name__}: {e}"

        for batch in batches:
            done = [one(p) for p in batch[column]]
            batch[out] = pd.Series([d[0] for d in done], index=batch.index, dtype=object)
            batch["error"] = pd.Series([d[1] for d in done], index=batch.index, dtype=object)
            yield batch

    source = prompts if parallelism is None else prompts.repartition(parallelism)
    return source.mapInPandas(run, schema)


def infer_once(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    column: str = "text",
    out: str = "logits",
    batch_size: int = 64,
    batch_bytes: int = 1 << 18,
) -> DataFrame:
    """`out` as `batch_infer` gives it, but equal texts are inferred once and batches hold texts of like length.

    A batch has at most `batch_size` texts and, but for a longer single text, `batch_bytes` bytes counted at the length of
    its longest text, as models pad to it.  Null texts are not inferred and have a null `out`.
    """
    key = F.sha2(F.col(column), 256)
    texts = df.where(F.col(column).isNotNull()).select(key.alias("hash"), F.col(column).alias("text")).groupBy("hash").agg(F.first("text").alias("text"))
    # Sorted by length in each task; hashes deal long and short texts evenly.
    dealt = texts.repartition("hash").withColumn("size", F.octet_length("text")).sortWithinPartitions("size", "hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict, held = make_predict(), []

        def told():
            answers = np.asarray(predict(np.array([t for _, t, _ in held], dtype=object)), dtype=np.float64)
            found = pd.DataFrame({"hash": [h for h, _, _ in held], "answer": [row.tolist() for row in answers.reshape(len(held), -1)]})
            held.clear()
            return found

        for batch in batches:
            for row in zip(batch["hash"], batch["text"], batch["size"]):
                # The next one is the longest so far.
                if held and (len(held) == batch_size or (len(held) + 1) * row[2] > batch_bytes):
                    yield told()
                held.append(row)
        if held:
            yield told()

    answers = dealt.mapInPandas(run, "hash string, answer array<double>").select(F.col("hash").alias("_hash"), F.col("answer").alias(out))
    # Copies of one text may be most rows; the join has one row for each text on the other side.
    return df.withColumn("_hash", key).join(answers, "_hash", "left").drop("_hash")


LEDGER = "hash string, response string, error string, attempts int"


def _ledger(spark, path: str) -> DataFrame:
    """What a ledger holds; nothing before its first wave is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if known else spark.createDataFrame([], LEDGER)


def complete_with_ledger(
    prompts: DataFrame,
    make_complete: Callable[[], Callable[[str], str]],
    ledger: str,
    *,
    column: str = "prompt",
    out: str = "response",
    attempts: int = 3,
    wait: float = 1.0,
    wave: int = 10_000,
    parallelism: int = 8,
    per_second: float | None = None,
) -> DataFrame:
    """`out` and `error` as `complete_prompts` gives them, from a table of answers that is kept and added to.

    Only prompts without an answer in `ledger` (a path that all executors reach) are called, equal ones once.  They go in
    waves of about `wave`; a wave's answers are committed together, so a run that ends in the middle and is started
    again repeats no earlier wave.  A failed call is tried `attempts` times, waiting `wait` seconds and then twice as
    long each time; what failed in the end is tried again by the next run.  Calls in flight are at most `parallelism`,
    and together no more than `per_second`.  A null prompt is not called and has neither answer nor error.
    """
    spark = prompts.sparkSession
    key = F.sha2(F.col(column), 256)
    # The share of each task in what may be called each second.
    gap = parallelism / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        complete, free = make_complete(), 0.0

        def one(prompt):
            nonlocal free
            for tried in range(1, attempts + 1):
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + gap
                try:
                    return complete(prompt), None, tried
                except Exception as e:  # one failed call must not fail the others
                    error = f"{type(e).__name__}: {e}"
                if tried < attempts:
                    time.sleep(wait * 2 ** (tried - 1))
            return None, error, attempts

        for batch in batches:
            done = [one(p) for p in batch["prompt"]]
            yield pd.DataFrame({
                "hash": batch["hash"], "response": pd.Series([d[0] for d in done], dtype=object, index=batch.index),
                "error": pd.Series([d[1] for d in done], dtype=object, index=batch.index), "attempts": pd.Series([d[2] for d in done], dtype="int32", index=batch.index),
            })

    wanted = prompts.where(F.col(column).isNotNull()).select(key.alias("hash"), F.col(column).alias("prompt")).groupBy("hash").agg(F.first("prompt").alias("prompt"))
    answered = _ledger(spark, ledger).where("response IS NOT NULL").select("hash")
    # Stored: while answers come in, what is left to ask must stay as it is.
    left = cut(wanted.join(answered, "hash", "left_anti"), "open-prompts")
    waves = max(1, -(-left.count() // wave))
    number = F.pmod(F.xxhash64("hash"), F.lit(waves))
    for i in range(waves):
        some = left.where(number == i)
        if not some.isEmpty():
            some.repartition(parallelism).mapInPandas(run, LEDGER).write.mode("append").parquet(ledger)
    # The answer, or else the latest error; a prompt may have failed in several runs.
    told = _ledger(spark, ledger).groupBy("hash").agg(F.max("response").alias(out), F.max_by("error", "attempts").alias("error"))
    told = told.withColumn("error", F.when(F.col(out).isNull(), F.col("error")))
    return prompts.withColumn("_hash", key).join(told.withColumnRenamed("hash", "_hash"), "_hash", "left").drop("_hash")
