"""Encoding into sentence pieces and decoding back: Unigram Viterbi over a double-array trie.

Pieces and their scores come from a SentencePiece model file.  A text is escaped (space to the marker
U+2581, one marker in front if the model asks for it) and cut before each run of markers, where no piece
reaches across; each distinct cut is then segmented once per batch, all of them together, by walking
the trie as numpy arrays.  The best path has the largest sum of scores; of equal ones the path whose
last pieces begin earliest wins.  A character without a piece costs the smallest score minus 10 and
becomes its UTF-8 bytes, or the unknown piece if the model has no byte pieces.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import words as W
from tidemark.llm.tables import in_arrow, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Longer cuts are walked one by one; the others together with those of similar length.
TOGETHER = 256
# A whole word holds this many pieces of path state at most before a batch is divided.
CELLS = 1 << 22


class Pieces(NamedTuple):
    """A vocabulary: its trie over UTF-8 bytes, and what each id decodes to."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # of each trie state: the piece that ends there, or -1
    score: np.ndarray
    floor: float
    byte_id: np.ndarray  # of each byte: its piece, or -1
    unknown: int
    prefix: bool
    cuts: bool  # whether no piece reaches across a marker after another character
    out_first: np.ndarray
    out_bytes: np.ndarray


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays; state s goes by byte c to t = base[s] + c + 1 if check[t] == s."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in zip(keys, values, strict=True):
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][c]
        ends[at] = value
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0], check[0], value[0] = True, 0, ends[0]
    todo, free, roomy = [(0, 0)], 1, 1
    for node, state in todo:
        if not children[node]:
            continue
        labels = np.array(sorted(children[node]), np.int64) + 1
        while taken[free]:
            free += 1
        began = at = max(0, (free if len(labels) == 1 else roomy) - int(labels[0]))
        while len(labels) > 1 or taken[at + labels[0]]:
            # The first place, in stretches, from which all labels are free.
            crowded = taken[at + labels[0] : at + labels[0] + 1024].copy()
            for c in labels[1:].tolist():
                crowded |= taken[at + c : at + c + 1024]
            first = int(np.argmin(crowded))
            at += first if not crowded[first] else 1024
            if not crowded[first]:
                break
            if at + 2048 > len(taken):
                grown = len(taken)
                taken = np.concatenate([taken, np.zeros(grown, bool)])
                base, check, value = (np.concatenate([x, np.full(grown, y, np.int32)]) for x, y in ((base, 0), (check, -1), (value, -1)))
        if len(labels) > 1 and at - began > 256:
            roomy = at  # what lies before is too crowded to try again
        base[state] = at
        taken[at + labels], check[at + labels] = True, state
        for c in labels.tolist():
            child = children[node][c - 1]
            value[at + c] = ends[child]
            todo.append((child, at + c))
    full = int(np.flatnonzero(taken)[-1]) + 258
    # States without children lead past the end of all states, where nothing checks.
    leaf = np.ones(full, bool)
    leaf[check[:full][check[:full] >= 0]] = False
    base = np.where(leaf, full - 257, base[:full]).astype(np.int32)
    return base, check[:full], value[:full]


def load(model: bytes) -> Pieces:
    """The vocabulary of a SentencePiece model given as the bytes of its file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    byte = [sp.is_byte(i) for i in range(n)]
    plain = [i for i in range(n) if not special[i] and not byte[i]]
    score = np.array([sp.get_score(i) for i in range(n)])
    byte_id = np.full(256, -1, np.int32)
    out = []
    for i in range(n):
        if byte[i]:
            byte_id[int(text[i][1:-1], 16)] = i
            out.append(bytes([int(text[i][1:-1], 16)]))
        elif sp.is_unknown(i):
            out.append(" ⁇ ".encode())
        else:
            out.append(b"" if special[i] else text[i].replace(MARK, " ").encode())
    base, check, value = double_array([text[i].encode() for i in plain], plain)
    cuts = not any(MARK in text[i].lstrip(MARK) for i in plain)
    prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
    return Pieces(
        base, check, value, score, float(score[plain].min()) - UNKNOWN_PENALTY, byte_id, sp.unk_id(), prefix, cuts,
        np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.frombuffer(b"".join(out), np.uint8),
    )


def _char_size(first: np.ndarray) -> np.ndarray:
    return np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))


def _segment(p: Pieces, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their owners for the rows of `text`, each `size` bytes long and padded to one width."""
    n, width = text.shape
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    came = np.zeros((n, width + 1), np.int32)
    by = np.full((n, width + 1), -2, np.int32)
    for i in range(width):
        rows = np.flatnonzero((best[:, i] > -np.inf) & (size > i))
        if not len(rows):
            continue
        whole = _char_size(text[rows, i])
        alone = np.zeros(len(rows), bool)
        live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for j in range(i, width):
            live_rows = rows[live]
            to = p.base[state].astype(np.int64) + text[live_rows, j] + 1
            ok = (p.check[to] == state) & (size[live_rows] > j)
            live, state = live[ok], to[ok]
            if not len(live):
                break
            piece = p.value[state]
            at = np.flatnonzero(piece >= 0)
            if len(at):
                end_rows, piece = rows[live[at]], piece[at]
                alone[live[at]] |= whole[live[at]] == j + 1 - i
                total = best[end_rows, i] + p.score[piece]
                better = total > best[end_rows, j + 1]
                end_rows = end_rows[better]
                best[end_rows, j + 1], came[end_rows, j + 1], by[end_rows, j + 1] = total[better], i, piece[better]
        left = np.flatnonzero(~alone)
        if len(left):
            left_rows = rows[left]
            end = np.minimum(i + whole[left], size[left_rows])
            total = best[left_rows, i] + p.floor
            better = total > best[left_rows, end]
            left_rows, end = left_rows[better], end[better]
            best[left_rows, end], came[left_rows, end], by[left_rows, end] = total[better], i, -1
    owners, ids, order = [], [], []
    rows, at = np.flatnonzero(size > 0), size[size > 0].astype(np.int64)
    step = 0
    while len(rows):
        piece, start = by[rows, at], came[rows, at]
        known = piece >= 0
        owners.append(rows[known])
        ids.append(piece[known])
        order.append(np.full(known.sum(), -4 * step, np.int64))
        for k in range(4):
            here = ~known & (at - start > k)
            if not here.any():
                break
            found = p.byte_id[text[rows[here], start[here] + k]]
            if k and p.byte_id[0] < 0:
                continue  # no byte pieces: one unknown piece for the character
            owners.append(rows[here])
            ids.append(np.where(found < 0, p.unknown, found).astype(np.int32))
            order.append(np.full(here.sum(), -4 * step + k, np.int64))
        rows, at = rows[start > 0], start[start > 0]
        step += 1
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    owner, found, placed = np.concatenate(owners), np.concatenate(ids), np.concatenate(order)
    sort = np.lexsort((placed, owner))
    return found[sort], owner[sort]


def _segment_long(p: Pieces, text: bytes) -> np.ndarray:
    """The ids of one long cut, byte by byte."""
    base, check, value, score = p.base.tolist(), p.check.tolist(), p.value.tolist(), p.score.tolist()
    n = len(text)
    best, came, by = [-np.inf] * (n + 1), [0] * (n + 1), [-2] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == -np.inf:
            continue
        c = text[i]
        whole = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        state, alone = 0, False
        for j in range(i, n):
            to = base[state] + text[j] + 1
            if check[to] != state:
                break
            state = to
            piece = value[state]
            if piece >= 0:
                alone |= j + 1 - i == whole
                if here + score[piece] > best[j + 1]:
                    best[j + 1], came[j + 1], by[j + 1] = here + score[piece], i, piece
        if not alone and here + p.floor > best[min(n, i + whole)]:
            end = min(n, i + whole)
            best[end], came[end], by[end] = here + p.floor, i, -1
    out, at = [], n
    while at:
        start = came[at]
        if by[at] >= 0:
            out.append([by[at]])
        elif p.byte_id[0] < 0:
            out.append([p.unknown])
        else:
            out.append(p.byte_id[np.frombuffer(text[start:at], np.uint8)].tolist())
        at = start
    return np.array([i for part in reversed(out) for i in part], np.int32)


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... first[i] + count[i] - 1 for each i, in a row."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)


def encode_batch(p: Pieces, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's ids begin (and a last place for the end), and all ids."""
    data, offsets = W.bytes_of(rows)
    size = np.diff(offsets)
    # One space in front of every text that is not empty, if the model puts a marker there.
    if p.prefix:
        front = (size > 0).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size + front)])
        wide = np.full(begin[-1], 0x20, np.uint8)
        wide[np.arange(len(data)) + np.repeat(np.cumsum(front), size)] = data
        data, offsets = wide, begin
    if not len(data):
        return np.zeros(len(rows) + 1, np.int64), np.zeros(0, np.int32)
    space = data == 0x20
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    if not p.cuts:
        starts[:] = False
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(starts)
    edges = np.concatenate([at, [len(data)]])
    cuts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cuts.dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary
    first, ids = _encode_cuts(p, distinct)
    count = np.diff(first)
    flat = ids[_ragged(first[:-1][which], count[which])]
    ends = np.concatenate([[0], np.cumsum(count[which])])
    return ends[np.searchsorted(at, offsets)], flat


def _encode_cuts(p: Pieces, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each cut, spaces already standing for markers."""
    marked = pc.replace_substring(cuts, pattern=b" ", replacement=MARK.encode())
    data = np.frombuffer(marked.buffers()[2], np.uint8)
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[: len(marked) + 1]
    size = np.diff(offsets)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for high in (8, 12, 16, 24, 32, 64, 128, TOGETHER):
        some = np.flatnonzero((size > low) & (size <= high))
        for k in range(0, len(some), max(1, CELLS // (high + 1))):
            rows = some[k : k + max(1, CELLS // (high + 1))]
            text = np.zeros((len(rows), high), np.uint8)
            text[np.repeat(np.arange(len(rows)), size[rows]), _ragged(np.zeros(len(rows), np.int64), size[rows])] = data[
                _ragged(offsets[rows], size[rows])
            ]
            ids, owner = _segment(p, text, size[rows])
            parts.append((rows[owner], ids))
        low = high
    for i in np.flatnonzero(size > TOGETHER).tolist():
        ids = _segment_long(p, data[offsets[i] : offsets[i + 1]].tobytes())
        parts.append((np.full(len(ids), i, np.int64), ids))
    owner = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
    ids = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])
    return first, ids[np.argsort(owner, kind="stable")]


def decode_batch(p: Pieces, first: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Texts of ids; bytes that are not UTF-8 together become U+FFFD."""
    begin, count = p.out_first[ids], p.out_first[ids + 1] - p.out_first[ids]
    data = p.out_bytes[_ragged(begin, count)]
    ends = np.concatenate([[0], np.cumsum(count)])[first]
    starts = ends[:-1].copy()
    if p.prefix:
        some = np.flatnonzero(ends[1:] > starts)
        starts[some] += data[starts[some]] == 0x20
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends[1:].tolist(), strict=True)], pa.string())


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, ids, n_tokens, same` of every row; null and empty texts have no ids.

    `same` tells whether decoding gives the text back.
    """
    p = load(model)

    def rows(batch: pa.RecordBatch):
        for a, b in W.slices(batch["text"]):
            part = batch["text"].slice(a, b - a)
            first, ids = encode_batch(p, part)
            yield {
                "doc_id": batch["doc_id"].slice(a, b - a), "n_tokens": np.diff(first),
                "same": pc.equal(decode_batch(p, first, ids), part.cast(pa.string())),
                "ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())),
            }

    return in_arrow(texts(df, id_col, text_col), rows, "doc_id bigint, ids array<int>, n_tokens bigint, same boolean")


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`doc_id, text` of every row of ids; a null list is an empty text."""
    p = load(model)
    from pyspark.sql import functions as F

    def rows(batch: pa.RecordBatch):
        ids = batch["ids"]
        count = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        yield {"doc_id": batch["doc_id"], "text": decode_batch(p, np.concatenate([[0], np.cumsum(count)]), flat)}

    chosen = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return in_arrow(chosen, rows, "doc_id bigint, text string")


def round_trip(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_tokens, n_byte_tokens, ids_sha256, same` of every row: its encoding, decoded and compared.

    `ids_sha256` is over the ids as little-endian 32-bit integers; `same` tells whether decoding gave the
    text back (markers U+2581 of the text itself come back as spaces).
    """
    p = load(model)

    def rows(batch: pa.RecordBatch):
        for a, b in W.slices(batch["text"]):
            part = batch["text"].slice(a, b - a)
            first, ids = encode_batch(p, part)
            raw, cum = ids.astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(np.isin(ids, p.byte_id[p.byte_id >= 0]))])
            yield {
                "doc_id": batch["doc_id"].slice(a, b - a), "n_tokens": np.diff(first), "n_byte_tokens": cum[first[1:]] - cum[first[:-1]],
                "ids_sha256": [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)],
                "same": pc.equal(decode_batch(p, first, ids), part.cast(pa.string())),
            }

    schema = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, same boolean"
    return in_arrow(texts(df, id_col, text_col), rows, schema)
