"""CSV records whose fields may hold line breaks, read by many tasks from parts of a file.

A line break ends a record where the number of quotation marks before it is even.  So one pass counts the marks of each
part of a file, their running parity says whether a part starts inside a field, and a second pass cuts every part
into records by itself.  Only what crosses the end of a part is put together afterwards: at most two pieces a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL, INSIDE, FIRST = range(5)


class _Part:
    """Records of one part of a file, from its lines in order."""

    def __init__(self, file: str, block: int, odd: bool):
        self.file, self.block = file, block
        self.odd, self.first = odd, block == 0
        # Lines of a record that has not ended, and what they will be when it does.
        self.held: list[str] = []
        self.kind = HEAD if odd else WHOLE

    def add(self, lines: pa.Array) -> list[tuple[int, pa.Array]]:
        marks = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        after = (int(self.odd) + np.cumsum(marks)) % 2 == 1
        ends = np.flatnonzero(~after)
        out = []
        if len(ends):
            size = np.diff(ends, prepend=-1)
            size[0] += len(self.held)
            if size[0] > 1 or self.kind != WHOLE or self.first:
                text = "\n".join([*self.held, *lines.slice(0, int(ends[0]) + 1).to_pylist()])
                out.append((FIRST if self.first and self.kind == WHOLE else self.kind, pa.array([text], pa.string())))
                self.first, size[0] = False, 0
            out.append((WHOLE, lines.take(pa.array(ends[size == 1]))))
            several = np.flatnonzero(size > 1)
            texts = ["\n".join(lines.slice(int(ends[i - 1]) + 1, int(size[i])).to_pylist()) for i in several.tolist()]
            out.append((WHOLE, pa.array(texts, pa.string())))
            self.held, self.kind = [], WHOLE
        rest = int(ends[-1]) + 1 if len(ends) else 0
        self.held += lines.slice(rest).to_pylist()
        if len(lines):
            self.odd = bool(after[-1])
        return out

    def end(self) -> list[tuple[int, pa.Array]]:
        if not self.held:
            return []
        kind = INSIDE if self.kind == HEAD else TAIL
        return [(kind, pa.array(["\n".join(self.held)], pa.string()))]


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = None

    def told(found):
        for kind, texts in found:
            if len(texts):
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.file] * n, pa.string()), pa.array([part.block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), texts.cast(pa.string())],
                    ["file", "block", "kind", "record"],
                )

    for batch in batches:
        files, blocks = batch["file"], batch["block"].to_numpy()
        if not batch.num_rows:
            continue
        names = pc.dictionary_encode(files)
        change = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(names.indices.to_numpy()) != 0)) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            file, block = files[low].as_py(), int(blocks[low])
            if part is None or (part.file, part.block) != (file, block):
                if part is not None:
                    yield from told(part.end())
                part = _Part(file, block, bool(batch["odd"][low].as_py()))
            yield from told(part.add(batch["value"].slice(low, high - low)))
    if part is not None:
        yield from told(part.end())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """`record`: every record of the files at `path` but their first ones, the headers, as written; blank ones left out.

    A header must not be longer than a part.  A quotation mark inside a field is doubled.  A task holds the records
    that are cut off at the ends of its parts, and a record of any length where it is put together.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counts = lines.groupBy("file", "block").agg((F.sum(F.regexp_count("value", F.lit('"'))) % 2).alias("marks"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # One number for each part of a file: small beside the file, and joined without moving its lines.
    met = lines.join(F.broadcast(starts), ["file", "block"])
    pieces = met.select("file", "block", "value", "odd").mapInArrow(_cut_up, "file string, block bigint, kind int, record string")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    broken = pieces.where(F.col("kind").isin(HEAD, TAIL, INSIDE)).withColumn("n", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    mended = broken.groupBy("file", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]), "\n").alias("record")
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("record").unionByName(mended.select("record"))
    # Where records end in carriage return and line feed, so do the lines in their fields.
    plain = F.when(F.col("record").endswith("\r"), F.regexp_replace("record", "\r(\n|$)", "$1")).otherwise(F.col("record"))
    return whole.select(plain.alias("record")).where("record <> ''")


def read_csv(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The rows of CSV files with headers, all fields as strings, as a reader of whole files gives them."""
    columns = spark.read.options(**options).option("multiLine", "true").csv(path).columns
    names = ", ".join(f"c{i} string" for i in range(len(columns)))
    fields = csv_records(spark, path).select(F.from_csv("record", F.lit(names), options).alias("r"))
    return fields.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(columns)])
