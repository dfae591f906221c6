"""ZIP archives of per-user XML files to raw posts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.schema import ARCHIVE_MEMBER
from tidemark.sources.ids import with_ids

_BATCH_CHARS = 8_000_000


def _decode(data: bytes) -> str:
    declared = re.match(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", data)
    try:
        return data.decode(declared.group(1).decode("ascii") if declared else "utf-8-sig")
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "replace")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per XML member; an unreadable archive or member gives a row without text."""
    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch["path"], batch["content"]):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
                names = [n for n in archive.namelist() if n.endswith(".xml")]
            except zipfile.BadZipFile:
                rows.append((path, None, None))
                continue
            for name in names:
                try:
                    xml = _decode(archive.read(name))
                except Exception:  # damaged member: recorded as rejected, the others go on
                    xml = None
                rows.append((path, name, xml))
                size += len(xml or "")
                if size >= _BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=["path", "member", "xml"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "member", "xml"])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Every XML member of the archives: path, member, parsed document, and whether it is usable.

    Archives are spread over tasks by Spark; only the unzipping is Python, the XML is parsed in the JVM.
    A member is usable if it parses, has an ID, and each WRITING has all four elements.
    """
    doc = F.from_xml("xml", ARCHIVE_MEMBER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    writing_ok = F.forall(
        F.coalesce("doc.WRITING", F.array()),
        lambda w: w["DATE"].isNotNull() & w["TITLE"].isNotNull() & w["INFO"].isNotNull() & w["TEXT"].isNotNull(),
    )
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", "content")
        .mapInPandas(_unzip, "path string, member string, xml string")
        .withColumn("doc", doc)
        .withColumn("usable", F.coalesce(F.col("doc.ID").isNotNull() & writing_ok, F.lit(False)))
        .select("path", "member", "doc", "usable")
    )


def raw_posts(members: DataFrame) -> DataFrame:
    """One raw post per WRITING of the usable members; markup inside an element stays in its text as written."""
    return (
        members.where("usable")
        .select("path", "doc.ID", F.explode("doc.WRITING").alias("w"))
        .select(
            text.normalise_subject(text.strip("ID")).alias("subject_id"),
            text.chunk_from_path("path").alias("chunk"),
            *[text.strip(f"w.{name}").alias(name.lower()) for name in ("DATE", "TITLE", "INFO", "TEXT")],
        )
    )


def rejected_members(members: DataFrame) -> DataFrame:
    """Archives and members that gave no posts because they could not be read."""
    return members.where("NOT usable").select("path", "member")


def ingest_zip_xml(spark: SparkSession, path: str) -> DataFrame:
    """The raw posts of the archives, with ids."""
    return with_ids(raw_posts(read_members(spark, path)))
