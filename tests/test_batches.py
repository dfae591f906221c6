"""What a Python task holds at once does not grow with the batches that Spark hands to it."""

import inspect

import numpy as np
import pyarrow as pa

from tidemark.operators import coverage, factors


def test_batches_of_texts_are_worked_on_in_portions(monkeypatch):
    monkeypatch.setattr(factors, "PORTION", 10)
    lists = pa.array([[1] * 4, [], [2] * 6, [3] * 25, [4], [5] * 9, []])
    assert [(p.start, p.stop) for p in factors._portions(lists)] == [(0, 3), (3, 4), (4, 7)]
    assert [(p.start, p.stop) for p in factors._portions(lists.slice(2, 3))] == [(0, 1), (1, 2), (2, 3)]


def test_products_of_entries_stay_in_the_cache_of_a_core():
    columns = sum(inspect.signature(factors.factor_text).parameters[name].default for name in ("rank", "oversample"))
    assert factors.ENTRIES * columns * 8 <= 2 << 20


def test_maxima_are_told_before_the_batch_ends(monkeypatch):
    monkeypatch.setattr(coverage, "MAXIMA", 50)
    rng = np.random.default_rng(1)
    kind = pa.list_(pa.struct([("item", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64()))]))

    def block(r):
        return [{"item": 100 * r + i, "copies": 1, "vector": rng.normal(size=3).tolist()} for i in range(10)]

    full, sample = ([block(r) for r in range(20)] for _ in "ab")
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 20), pa.array(full, kind), pa.array(sample, kind)], ["key", "full", "sample"])
    out = list(coverage._block_maxima([batch]))
    assert max(b.num_rows for b in out) <= 60 and sum(b.num_rows for b in out) == 400
    monkeypatch.setattr(coverage, "MAXIMA", 1 << 15)
    again = list(coverage._block_maxima([batch]))
    assert len(again) == 2
    rows = [sorted(zip(*(c.to_pylist() for c in pa.Table.from_batches(x).columns))) for x in (out, again)]
    assert rows[0] == rows[1]
