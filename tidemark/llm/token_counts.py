"""Token counts of whole texts by a byte-level tokenizer, without keeping any token.

Texts are dealt into blocks of about equal bytes; a long text is split at single spaces between two
letters, where no pre-token of a byte-level vocabulary (`" ?\\p{L}+"` and the like) can reach across.
Within a block the library encodes each distinct pre-token once, in one batch, and only the lengths stay.

Null and empty texts have 0 tokens.  A text that holds one of the vocabulary's special strings goes
whole to the library, which decides how to take it.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import texts

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCK = 1 << 20
REMEMBERED = 200_000
_SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def split_safely(text: str, size: int = BLOCK) -> list[str]:
    """Pieces of about `size` characters that join to `text` and whose token counts add up to its own."""
    pieces, start = [], 0
    while len(text) - start > size:
        at = _SAFE.search(text, start + size)
        if at is None:
            break
        pieces.append(text[start : at.start()])
        start = at.start()
    pieces.append(text[start:])
    return pieces


def blocks(rows: list[str], size: int = BLOCK):
    """Lists of (row, piece) of about `size` characters each."""
    block, filled = [], 0
    for i, text in enumerate(rows):
        for piece in split_safely(text, size):
            block.append((i, piece))
            filled += len(piece)
            if filled >= size:
                yield block
                block, filled = [], 0
    if block:
        yield block


def counter(spec: str):
    """A function from texts to their numbers of tokens."""
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
    find = regex.compile(PRE_TOKEN).findall
    known: dict[str, int] = {}

    def count(rows: list[str]) -> list[int]:
        out = [0] * len(rows)
        plain = list(rows)
        for i, text in enumerate(rows):
            if any(s in text for s in special):
                out[i] = len(library.encode(text, add_special_tokens=False).ids)
                plain[i] = ""
        for block in blocks(plain):
            found = [find(piece) for _, piece in block]
            new = list(set().union(*found) - known.keys())
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set().union(*found))
            for at in range(0, len(new), 5000):
                part = new[at : at + 5000]
                encoded = library.encode_batch(part, add_special_tokens=False)
                known.update(zip(part, (len(e.ids) for e in encoded), strict=True))
            for (i, _), pre_tokens in zip(block, found, strict=True):
                out[i] += sum(map(known.__getitem__, pre_tokens))
        return out

    return count


def token_counts(df: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_bytes, n_tokens` of every row; `spec` is the JSON text of a byte-level vocabulary.

    Repeated rows stay repeated rows; a null id stays null.
    """
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())
    ])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(spec)
        for batch in batches:
            n = pa.array(count(batch["text"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], n], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return rows.mapInArrow(run, schema)


