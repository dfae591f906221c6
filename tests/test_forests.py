"""Clusters of varying density of corpora that are too large for one task as they are."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.test_density import clusters_by_hand, frame, same_groups, spread
from tidemark.operators import density
from tidemark.plans import lineage
from tidemark.plans import nearest as near


def _rounds(*_):
    raise AssertionError("rounds of joins")


@pytest.mark.parametrize("seed, least, samples", [(3, 8, 4), (1, 20, 10)])
def test_forests_give_the_same_clusters_without_rounds(spark, monkeypatch, seed, least, samples):
    monkeypatch.setattr(density, "WHOLE", 20)
    monkeypatch.setattr(near, "CELL", 10)
    monkeypatch.setattr(density, "_cores", _rounds)
    x = spread(seed)
    got = density.varying_density_cluster(frame(spark, x), min_cluster_size=least, min_samples=samples, neighbours=len(x) - 1)
    rows = sorted((r.id, r.topic, r.strength) for r in got.collect())
    labels, strength = clusters_by_hand(x, least, samples)
    same_groups(labels, np.array([r[1] for r in rows]))
    assert np.allclose([r[2] for r in rows], strength)


def test_what_is_left_out_closes_cycles(spark, monkeypatch):
    monkeypatch.setattr(density, "WHOLE", 30)
    monkeypatch.setattr(near, "CELL", 10)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    points = spark.createDataFrame([(g, i, 1, p.tolist()) for g in (0, 1) for i, p in enumerate(x * (g + 1))], "g int, point bigint, weight bigint, coords array<double>")
    edges = near.nearest(points, 12, ["g"]).where("point < other").select("g", F.col("point").alias("u"), F.col("other").alias("v"), F.col("distance").alias("w"))
    whole, left = lineage.cut(edges).toPandas(), density._spanning(points, edges, ["g"], 400).toPandas()
    assert len(left) < len(whole) / 3
    for g in (0, 1):
        some, few = whole[whole.g == g], left[left.g == g]
        forest = [t[t_kept].sort_values(["w", "u", "v"]).to_numpy().tolist() for t in (some, few) for t_kept in [density._forest(*(t[c].to_numpy() for c in "uvw"))]]
        assert forest[0] == forest[1] and len(few) == len(few.drop_duplicates())


def test_chains_to_a_core_take_one_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(density, "cut", lambda df, name="cut": written.append(name) or lineage.cut(df, name))
    nodes = spark.createDataFrame([(0, i, 9 if i == 0 else 1) for i in range(25)], "g int, point bigint, weight bigint")
    edges = spark.createDataFrame([(0, i, i + 1, 1.0 + i) for i in range(24)], "g int, u bigint, v bigint, w double")
    members, between = density._cores(nodes, edges, ["g"], 8)
    assert sorted((r.point, r.leaf, r.joined) for r in members.collect()) == [(0, 0, density.SHORTEST)] + [(i, 0, float(i)) for i in range(1, 25)]
    assert written.count("first-edges") == 1 and between.collect() == []


def test_cores_of_points_without_edges():
    none = np.zeros(0)
    leaf, joined, between = density.cores_in_order(np.array([7, 3]), np.array([1, 9]), none.astype(int), none.astype(int), none, 8)
    assert leaf.tolist() == [-1, 3] and np.isnan(joined[0]) and joined[1] == density.SHORTEST and between == []
