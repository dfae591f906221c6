"""Exact neighbours when many cells share a group, and how often a block travels."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import density
from tidemark.plans import lineage, nearest


def test_halves_are_balanced_and_near():
    rng = np.random.default_rng(3)
    places, n = rng.normal(size=(200, 2)), rng.integers(1, 5, 200)
    group = nearest.halved(places, n, 7)
    held = np.bincount(group, n)
    assert len(held) == 7 and held.max() < 2 * held.min()
    assert len(set(nearest.halved(places, n, 1).tolist())) == 1
    assert sorted(nearest.halved(places[:3], n[:3], 50).tolist()) == [0, 1, 2]
    assert sorted(nearest.halved(np.zeros((4, 2)), np.ones(4, int), 4).tolist()) == [0, 1, 2, 3]


def test_groups_find_the_same_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 8)
    monkeypatch.setattr(nearest, "BLOCK", 4)
    monkeypatch.setattr(nearest, "GROUP_BYTES", 4000)
    rng = np.random.default_rng(5)
    at = {c: rng.normal(size=(n, 3)) for c, n in (("a", 300), ("b", 40), ("c", 1), (None, 3))}
    rows = [(c, i, 1 + i % 2, x.tolist()) for c, xs in at.items() if c for i, x in enumerate(xs)]
    points = spark.createDataFrame(rows, "corpus string, point bigint, weight int, coords array<double>")
    got = nearest.nearest(points, 5, ["corpus"]).collect()
    found = {}
    for r in got:
        assert r["weight"] == 1 + r["other"] % 2
        found.setdefault((r["corpus"], r["point"]), []).append((r["distance"], r["other"]))
    for c, xs in at.items():
        for i in range(len(xs) if c else 0):
            d = sorted((float(np.sqrt(((xs[i] - x) ** 2).sum())), j) for j, x in enumerate(xs) if j != i)[:5]
            mine = sorted(found.get((c, i), []))
            assert [j for _, j in mine] == [j for _, j in d] and np.allclose([x for x, _ in mine], [x for x, _ in d])


def test_a_block_travels_once_for_a_group(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 4)
    rng = np.random.default_rng(6)
    rows = [(0, i, 1, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))]
    points = spark.createDataFrame(rows, "_all int, point bigint, weight bigint, coords array<double>")
    placed = nearest._assigned(points, ["_all"])
    cells = nearest._cells(placed, nearest._pivots(points, ["_all"]), ["_all"]).cache()
    grouped = nearest._grouped(cells, ["_all"], 5, 6)
    assert grouped.select("group").distinct().count() == 6
    meetings = nearest._meetings(cells, ["_all"], 5)
    sent = meetings.join(grouped, ["_all", "cell"]).select("group", "other").distinct().count()
    # Nearly all cells meet in so many dimensions; before, a block went to each of them.
    assert sent <= 6 * cells.count() < meetings.count() / 4
    assert placed.agg(F.count("*")).first()[0] == 400


def test_rounds_leave_no_edges_behind(spark, monkeypatch):
    left, deleted = [], []
    monkeypatch.setattr(density, "WHOLE", 0)
    monkeypatch.setattr(density, "cut", lambda df, name="cut": left.append((name, lineage.cut(df, name))) or left[-1][1])
    monkeypatch.setattr(density, "drop", lambda *tables: deleted.extend(tables) or lineage.drop(*tables))
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=2) + 6 * (i % 3)).tolist()) for i in range(90)]
    points = spark.createDataFrame(rows, "id bigint, coords array<double>")
    density.varying_density_cluster(points, min_cluster_size=12, min_samples=4, neighbours=8).collect()
    # The edges of the graph stay; those of the rounds, and the neighbours, are gone once the next are written.
    kept = [name for name, table in left if not any(table is x for x in deleted)]
    assert len([name for name, _ in left if name == "edges"]) > 2 and kept.count("edges") == 1 and "neighbours" not in kept
