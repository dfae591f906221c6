"""Words of whole texts as numpy arrays of places and hashes, for work inside Arrow tasks.

Both word classes leave every byte from 0x80 up inside a word, so words of UTF-8 bytes are the words
of the characters.  Nothing here depends on how rows are dealt into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes inside words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
# Bytes inside words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[0x20] = VISIBLE[0x09:0x0E] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

STEP = 8 << 20
HASHED = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Words(NamedTuple):
    """Words of some texts: `first[i]:first[i+1]` are text i's words, each `data[start:end]`."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def doc(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def place(self) -> np.ndarray:
        """The position of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))


def slices(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `step` bytes each, so that work arrays stay small; a text is never cut."""
    sizes = np.diff(bytes_of(texts)[1])
    part = (np.cumsum(sizes) - sizes) // step
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1 if len(part) else 0))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the places where texts begin, with a last one for the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, inside: np.ndarray, lower: bool) -> Words:
    """All words of whole texts; null has none."""
    data, offsets = bytes_of(texts)
    if lower:
        data = LOWER[data]
    flag = np.zeros(len(data) + 2, bool)
    flag[1:-1] = inside[data]
    begins, ends = flag[1:-1] & ~flag[:-2], flag[1:-1] & ~flag[2:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = flag[1:-1][edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    ends[edge] = flag[1:-1][edge]
    start = np.flatnonzero(begins)
    return Words(data, np.searchsorted(start, offsets), start, np.flatnonzero(ends) + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all of them."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers(dict):
    """Powers of a base by base, as long as they were ever asked for; functions sent to tasks take none along."""

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first `n` powers of a base, not to be written to."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    n = len(w.start)
    out = np.empty(n, np.uint64)
    ahead = powers(_BASE, HASHED + 1)
    i = 0
    while i < n:
        # The words that end within one step of bytes, or one longer word alone.
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + HASHED, "right")))
        low, high = int(w.start[i]), int(w.end[j - 1])
        size = high - low
        up = ahead if size <= HASHED else powers(_BASE, size + 1)
        total = np.zeros(size + 1, np.uint64)
        # Powers grow along the block; each word's sum is then brought to the same exponents.
        np.cumsum((w.data[low:high].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
        s, e = w.start[i:j] - low, w.end[i:j] - low
        out[i:j] = (total[e] - total[s]) * up[size - s] * _inverse(size) + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def _inverse(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), -n, 1 << 64))


def window_hashes(h: np.ndarray, k: int, base: np.uint64 = _BASE2) -> np.ndarray:
    """A 64-bit hash of each run of `k` values, by place of its first; shorter inputs have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: sums over 1, 2, 4, ... values, put together by the bits of k.
    out, done, block, size = np.zeros(n, np.uint64), 0, h, 1
    while True:
        if k & size:
            out = out * np.uint64(pow(int(base), size, 1 << 64)) + block[done : done + n]
            done += size
        if done == k:
            return mix(out)
        factor = np.uint64(pow(int(base), size, 1 << 64))
        block = block[: len(block) - size] * factor + block[size:]
        size *= 2


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
