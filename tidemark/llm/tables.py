"""What the operators of this subpackage share: inputs, Arrow tasks, learned rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only `doc_id` and `text` (null as empty), whatever else and under whatever names `df` holds."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def in_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """`df` through a function from a batch to dicts of columns; each dict becomes a batch."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in rows(batch):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[n] for n in names)], names
                    )

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row may not be learned from; a row without an id never is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == F.lit(fold), F.lit(True))


def sample(df: DataFrame, id_col: str, rows: int, total: Column, salt: str = "sample") -> DataFrame:
    """About `rows` of the `total` rows, always the same ones: those with the smallest hash of the id.

    A sample of a sample needs a salt of its own.
    """
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.greatest(total, F.lit(1)).cast("double"))
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share)
