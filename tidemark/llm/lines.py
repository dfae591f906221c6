"""Repeated lines, exact or with a few edits, removed but for their first occurrences.

Lines are the stretches between line feeds without white space at their ends.  Two lines are linked if
they are equal or at most `allowed(shorter)` edits apart: 0 below 10 characters, 1 below 20, else 2.
The join cuts a line of t allowed edits into t + 1 segments of nearly equal length; a longer or equally
long line within t edits holds one of them at nearly the same place.  So each line puts its segments
into an index, under length, segment number and content, and asks it for its own substrings of the
lengths and places where a match is possible.  Lines that share an entry are compared by banded
bit-parallel edit distance, in blocks where an entry is crowded; a task returns a spanning forest of
its links.  Equal lines are one line all along.

A class of linked lines keeps its first occurrence, by document id and line number, whatever the share of repeated
lines in a document.  A caller may set `max_share` to leave documents alone in which they are more than that share
of the characters.  `spare_copies` leaves only documents whose lines, one by one, are those of an earlier document.  Empty lines, null texts and rows without an id are never touched; rows that repeat an
id count as one document's.  Lines are told apart by a 64-bit hash of theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.filters import id_filter, in_filter
from tidemark.llm.graph import components, unite
from tidemark.llm.tables import in_arrow, texts
from tidemark.plans.lineage import cut

SHORT, LONG = 10, 20
MOST = 2
CROWD = 512
SLICE = 2 << 20
BLANK = "\t\n\x0b\x0c\r "


def allowed(size):
    """Edits that a line of `size` characters may have."""
    return (np.asarray(size) >= SHORT).astype(np.int64) + (np.asarray(size) >= LONG)


def lines_of(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts, and text number, line number, start and end of each line that is not empty."""
    rows = texts_.to_pylist()
    chars = np.frombuffer("\n".join(rows).encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(chars == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(chars)]])
    first = np.cumsum([0, *(r.count("\n") + 1 for r in rows)])
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    number = np.arange(len(start)) - first[:-1][doc]
    # The first and the last character of each line that is not blank.
    filled = np.flatnonzero((chars != 0x20) & ((chars < 9) | (chars > 13)))
    if not len(filled):
        none = np.zeros(0, np.int64)
        return chars, none, none, none, none
    after = np.searchsorted(filled, start)
    s = filled[np.minimum(after, len(filled) - 1)]
    e = filled[np.maximum(np.searchsorted(filled, end) - 1, 0)] + 1
    some = (after < len(filled)) & (s < end)
    return chars, doc[some], number[some], s[some], e[some]


class _Hashes:
    """Hashes of any stretch of a row of characters."""

    def __init__(self, chars: np.ndarray):
        n = len(chars)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * W.powers(W._BASE, n), out=self.total[1:])
        self.back = W.powers(np.uint64(pow(int(W._BASE), -1, 1 << 64)), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def segments(size: np.ndarray, edits: int):
    """For each segment of lines of `size` characters: its number, starts and lengths; later ones are longer."""
    short = size // (edits + 1)
    longer = size % (edits + 1)
    at = np.zeros(len(size), np.int64)
    for i in range(edits + 1):
        length = short + (i >= edits + 1 - longer)
        yield i, at, length
        at = at + length


def entries(size: np.ndarray):
    """Line numbers, lengths of the indexed lines, segment numbers, starts and ends of every stretch to look for.

    For each line, its own segments and, for each shorter length within reach, the substrings that can
    be a segment of such a line: with d characters more, and segment i of t + 1 (from 0), a shift from
    the segment's own place lies between -i and i and between d - (t - i) and d + (t - i).
    """
    for more in range(MOST + 1):
        other = size - more
        for edits in range(1, MOST + 1):
            rows = np.flatnonzero((allowed(other) == edits) & (edits >= more))
            for i, at, length in segments(other[rows], edits):
                for shift in range(max(-i, more - (edits - i)), min(i, more + (edits - i)) + 1):
                    start = at + shift
                    ok = (start >= 0) & (start + length <= size[rows])
                    yield rows[ok], other[rows][ok], i, start[ok], (start + length)[ok]


def keys(docs: DataFrame) -> DataFrame:
    """`key, line`: everything that lines of `doc_id, text` put into the index or ask of it."""

    def rows(batch: pa.RecordBatch):
        batch = batch.filter(batch["doc_id"].is_valid())
        for a, b in W.slices(batch["text"], SLICE) if batch.num_rows else ():
            chars, _, _, s, e = lines_of(batch["text"].slice(a, b - a))
            h = _Hashes(chars)
            line, first = np.unique(h.of(s, e), return_index=True)
            s, size = s[first], (e - s)[first]
            found = [
                (W.mix(h.of(s[r] + x, s[r] + y) ^ (other.astype(np.uint64) * np.uint64(8) + np.uint64(i))), line[r])
                for r, other, i, x, y in entries(size)
            ]
            if found:
                yield {c: W.signed(np.concatenate(x)) for c, x in zip(("key", "line"), zip(*found, strict=True), strict=True)}

    return in_arrow(docs, rows, "key bigint, line bigint")


def shared_keys(found: DataFrame) -> DataFrame:
    """The rows of `key, line` whose key has more than one line, every row once."""

    def run(batches):
        held, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, line = batch["key"].to_numpy(), batch["line"].to_numpy()
            if held is not None:
                key, line = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], line])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
            if held is not None:
                new[0] = True
            key, line = key[new], line[new]
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            last_kept = keep[-1] or (told and len(key) == 1)
            if told:
                keep[0] = False  # said with the batch before
            held, told = (key[-1], line[-1]), bool(last_kept)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(line[keep])], ["key", "line"])

    # Sorted, so that a task holds one batch and no key's rows together, however many there are.
    return found.repartition("key").sortWithinPartitions("key", "line").mapInArrow(run, "key bigint, line bigint")


def occurrences(docs: DataFrame, only: np.ndarray) -> DataFrame:
    """`doc_id, number, line, size, content` of every line that is not empty; content where the line's hash passes the filter."""

    def rows(batch: pa.RecordBatch):
        batch = batch.filter(batch["doc_id"].is_valid())
        for a, b in W.slices(batch["text"], SLICE) if batch.num_rows else ():
            chars, doc, number, s, e = lines_of(batch["text"].slice(a, b - a))
            line = _Hashes(chars).of(s, e).view(np.int64)
            raw, content = chars.tobytes(), np.full(len(line), None, object)
            for i in np.flatnonzero(in_filter(only, line)).tolist():
                content[i] = raw[4 * s[i] : 4 * e[i]].decode("utf-32-le")
            yield {
                "doc_id": batch["doc_id"].slice(a, b - a).take(pa.array(doc)), "number": number.astype(np.int32),
                "line": line, "size": (e - s).astype(np.int32), "content": pa.array(content, pa.string()),
            }

    return in_arrow(docs, rows, "doc_id bigint, number int, line bigint, size int, content string")


def within(a: str, b: str, edits: int) -> bool:
    """Whether two texts are at most `edits` insertions, deletions and substitutions apart.

    Bit d of a row's word e tells whether the place d - edits after the row's own in `b` is reached
    with e edits; so a word has only 2 * edits + 1 bits, whatever the length.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    x, y = len(a), len(b)
    while x > low and y > low and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    a, b = a[low:x], b[low:y]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    # Row 0: place j of b costs j insertions.
    rows = [((1 << (e + 1)) - 1) << edits & full for e in range(edits + 1)]
    for i, c in enumerate(a):
        same = 0
        for d in range(width):
            j = i + d - edits
            if 0 <= j < len(b) and b[j] == c:
                same |= 1 << d
        new = []
        for e in range(edits + 1):
            # From row i to i + 1 a diagonal step keeps the bit, a deletion moves it one down.
            word = rows[e] & same
            if e:
                word |= rows[e - 1] | rows[e - 1] >> 1 | (new[e - 1] << 1 & full)
            new.append(word)
        rows = new
        if not rows[-1]:
            return False
    d = len(b) - len(a) + edits
    return bool(rows[-1] >> d & 1)


def _links_among(contents: list[str], side: list[int] | None) -> np.ndarray:
    """For each place the smallest place it is linked to; with sides only across them."""
    n = len(contents)
    labels, size = np.arange(n), np.array([len(c) for c in contents])
    if n > 16:
        bag = np.stack([np.bincount(np.frombuffer(c.encode("utf-32-le"), np.uint32) & 31, minlength=32) for c in contents])
    for i in range(n - 1):
        some = range(i + 1, n)
        if n > 16:
            # An edit changes the counts of two characters at most.
            far = np.abs(size[i + 1 :] - size[i]) > MOST
            near = np.flatnonzero(~far & (labels[i + 1 :] != labels[i]))
            some = (near[np.abs(bag[i + 1 :][near] - bag[i]).sum(1) <= 2 * MOST] + i + 1).tolist()
        for j in some:
            if labels[i] != labels[j] and (side is None or side[i] != side[j]):
                shorter = min(len(contents[i]), len(contents[j]))
                if within(contents[i], contents[j], (shorter >= SHORT) + (shorter >= LONG)):
                    unite(labels, np.array([i]), np.array([j]))
    return labels


def _compare(batches):
    """Links of each group of `key, x, y` in rows sorted by them, one group at a time."""
    held = None

    def groups(table: pa.Table, last: bool):
        """Whole groups of a table, and what may go on in the next batch."""
        at = [table[c].to_numpy() for c in ("key", "x", "y")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in at])
        edges = [*np.flatnonzero(new).tolist(), table.num_rows]
        return list(zip(edges[:-1], edges[1:], strict=True))[: None if last else -1], edges[-1 if last else -2]

    def links(table: pa.Table, ranges):
        u, v = [], []
        names, x, y, side = (table[c].to_numpy() for c in ("line", "x", "y", "side"))
        contents = table["content"].to_pylist()
        for a, b in ranges:
            across = x[a] != y[a]
            if b - a > 1:
                labels = _links_among(contents[a:b], side[a:b].tolist() if across else None)
                node = np.flatnonzero(labels != np.arange(b - a))
                u += names[a:b][node].tolist()
                v += names[a:b][labels[node]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            ranges, end = groups(table, False)
            yield links(table, ranges)
            held = table.slice(end)
    if held is not None and held.num_rows:
        yield links(held, groups(held, True)[0])


def line_links(shared: DataFrame, contents: DataFrame) -> DataFrame:
    """`u, v`: links between different lines of `key, line` that share a key, enough to connect whatever is linked.

    `contents` has the `line, content` of all of them.
    """
    # Entries with the same lines need one comparison only.
    sets = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(1), "line")).alias("mixed")
    )
    once = cut(sets.groupBy("n", "total", "mixed").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    member = shared.join(once, "key").withColumn("blocks", F.ceil(F.col("n") / F.lit(CROWD)).cast("int"))
    # A crowded entry is dealt into blocks of lines, and every two blocks meet in a group of their own.
    block = F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")
    paired = (
        member.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "line", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    met = paired.join(contents, "line").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return met.mapInArrow(_compare, "u bigint, v bigint").distinct()


def classed_lines(docs: DataFrame) -> DataFrame:
    """`doc_id, number, size, class`: every line that is not empty and the smallest hash it is linked to."""
    shared = cut(shared_keys(keys(docs)), "shared-keys")
    found = cut(occurrences(docs, id_filter(shared.select(F.col("line").alias("doc_id")))), "occurrences")
    # Distinct first: a line that many documents have is one row before it is shuffled.
    contents = found.where("content IS NOT NULL").select("line", "content").distinct()
    contents = cut(contents.join(shared.select("line").distinct(), "line"), "line-texts")
    roots = components(line_links(shared, contents)).withColumnRenamed("node", "line")
    return cut(
        found.drop("content").join(roots, "line", "left").select("doc_id", "number", "size", F.coalesce("root", "line").alias("class")), "classes"
    )


def repeated_lines(classed: DataFrame) -> DataFrame:
    """`doc_id, number, size, first_doc`: lines whose class has an earlier occurrence, and where its first one is."""
    first = cut(
        classed.groupBy("class").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("class", F.col("first.doc_id").alias("first_doc"), F.col("first.number").alias("first_number")), "first-lines"
    )
    return classed.join(first, "class").where("doc_id <> first_doc OR number <> first_number").select("doc_id", "number", "size", "first_doc")


def removals(docs: DataFrame, max_share: float | None = None, spare_copies: bool = False) -> DataFrame:
    """`doc_id, n_lines, n_repeated, removed, first_docs`: per document, the line numbers to remove and their first documents."""
    classed = classed_lines(docs)
    repeated = cut(repeated_lines(classed), "repeated-lines")
    whole = classed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("size").alias("size"),
        F.sum(F.xxhash64("number", "class").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(1), "number", "class")).alias("mixed"),
    )
    own = F.lit(True)
    if max_share is not None:
        own = F.col("repeated_size") <= F.lit(max_share) * F.col("size")
    if spare_copies:
        whole = cut(whole, "line-sets")
        same = ["n_lines", "total", "mixed"]
        first = cut(
            whole.groupBy(*same).agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high")).where("source < high").drop("high"),
            "first-line-sets",
        )
        copied = whole.join(first, same).where("doc_id > source").select("doc_id", F.lit(True).alias("copied"))
        whole = whole.join(copied, "doc_id", "left")
        own = own & F.col("copied").isNull()
    per_doc = repeated.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_repeated"), F.sum("size").alias("repeated_size"),
        F.array_sort(F.collect_set("number")).alias("numbers"), F.array_sort(F.collect_set("first_doc")).alias("first"),
    )
    gone = own & F.col("numbers").isNotNull()
    return whole.join(per_doc, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.when(gone, F.col("numbers")).otherwise(F.array().cast("array<int>")).alias("removed"),
        F.when(gone, F.col("first")).otherwise(F.array().cast("array<bigint>")).alias("first_docs"),
    )


def without_lines(text, removed):
    """The text without the numbered lines; the others keep their line feeds and white space."""
    gone = F.map_from_arrays(removed, F.transform(removed, lambda _: F.lit(True)))
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.map_contains_key(gone, i))
    return F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(text)


def dedup_lines(
    documents: DataFrame, max_share: float | None = None, doc_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id, text, n_lines, n_repeated, n_removed, first_docs` of every document row, repeated lines gone."""
    docs = texts(documents, doc_col, text_col)
    gone = removals(docs, max_share)
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return docs.join(gone, "doc_id", "left").select(
        "doc_id", without_lines(F.col("text"), removed).alias("text"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_repeated")],
        F.size(removed).cast("bigint").alias("n_removed"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )
