"""Writing fixture files from the given tables, for the queries that read files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame


def _put(folder: str, name: str, data: bytes) -> None:
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def write_files(df: DataFrame, folder: str) -> int:
    """Write each row's `content` to the file `name` in tasks; returns how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                _put(folder, name, content.encode())
            yield batch[["name"]]

    return df.select("name", "content").mapInPandas(run, "name string").count()


def write_archives(df: DataFrame, folder: str) -> int:
    """Rows (archive, subject, turn, date, title, info, text) as ZIPs with one XML per subject.

    An archive also gets a damaged member, which readers must skip.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for subject, writings in rows.sort_values("turn").groupby("subject"):
                parts = [
                    "<WRITING>"
                    + "".join(f"<{t.upper()}> {escape(str(w[t]))}\n</{t.upper()}>" for t in ("title", "date", "info", "text"))
                    + "</WRITING>"
                    for w in writings.to_dict("records")
                ]
                z.writestr(f"{subject}.xml", f"<INDIVIDUAL><ID> {subject} </ID>{''.join(parts)}</INDIVIDUAL>")
            z.writestr("damaged.xml", "<INDIVIDUAL><ID>subject9999999</ID><WRITING>")
            z.writestr("notes.txt", "not a post")
        name = rows["archive"].iloc[0]
        _put(folder, name, buffer.getvalue())
        return pd.DataFrame({"archive": [name]})

    return df.groupBy("archive").applyInPandas(run, "archive string").count()
