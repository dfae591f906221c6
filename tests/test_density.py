"""Neighbours, clusters of varying density and spectral places against plain programs over all pairs."""

import numpy as np
import pytest

from tidemark.operators import density
from tidemark.plans import nearest as near


def spread(seed, sizes=((80, 0.02, (0, 0)), (90, 0.5, (4, 0)), (70, 0.03, (0.6, 0.2))), noise=60):
    """Tight and loose groups, two of them close, and noise."""
    rng = np.random.default_rng(seed)
    groups = [rng.normal(c, s, (n, 2)) for n, s, c in sizes]
    return np.concatenate([*groups, rng.uniform(-2, 7, (noise, 2))])


def frame(spark, x, by=None, start=0):
    rows = [(by or 0, start + i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "corpus int, id bigint, coords array<double>").repartition(3)


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def clusters_by_hand(x, least, samples):
    """Labels and strengths of one corpus from its whole matrix of distances, one edge after the other."""
    n, d = len(x), distances(x)
    core = np.maximum(np.sort(d, axis=1)[:, min(samples, n - 1)], density.SHORTEST)
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    node_of, members, children, born = list(range(n)), {i: [i] for i in range(n)}, {}, {i: 0.0 for i in range(n)}
    for w, i, j in edges:
        a, b = node_of[i], node_of[j]
        if a == b:
            continue
        new = len(members)
        members[new], children[new], born[new] = members[a] + members[b], (a, b), w
        for k in members[new]:
            node_of[k] = new
    # From the top: a cluster splits where both parts are large, else goes on without the small ones.
    root = len(members) - 1
    clusters, parent, appears, left, ended = [root], {root: None}, {root: 0.0}, {}, {}
    todo = [(root, root)]
    while todo:
        node, cluster = todo.pop()
        if node not in children:
            left[node] = (cluster, density.SHORTEST)
            continue
        large = [c for c in children[node] if len(members[c]) >= least]
        for c in children[node]:
            if len(large) == 2:
                clusters.append(c)
                parent[c], appears[c] = cluster, 1 / born[node]
                ended[cluster] = 1 / born[node]
                todo.append((c, c))
            elif c in large:
                todo.append((c, cluster))
            else:
                for p in members[c]:
                    left[p] = (cluster, born[node])
    # A point that joins at the length at which its cluster merges belongs to the cluster; see the module.
    stability = {c: 0.0 for c in clusters}
    for c in clusters:
        inside = set(members[c])
        for p, (own, w) in left.items():
            if p in inside:
                leaves = 1 / w if own == c else ended.get(c, 0)
                if own == c or _under(own, c, parent):
                    stability[c] += leaves - appears[c]
    picked, best = {}, {}
    for c in sorted(clusters):
        below = sum(best[k] for k in clusters if parent[k] == c)
        own = stability[c] if c != root else -np.inf
        picked[c] = own >= below
        best[c] = max(own, below)
    labels, strength = np.full(n, -1), np.zeros(n)
    for p, (own, w) in left.items():
        found, c = None, own
        while c is not None:
            found, c = (c if picked[c] else found), parent[c]
        if found is not None:
            top = ended.get(found) or max(1 / w2 for o, w2 in left.values() if o == found)
            labels[p], strength[p] = found, min(1 / w, top) / top
    return labels, strength


def _under(c, top, parent):
    while c is not None and c != top:
        c = parent[c]
    return c == top


def same_groups(a, b):
    assert ((a == -1) == (b == -1)).all()
    pairs = {(x, y) for x, y in zip(a.tolist(), b.tolist())}
    assert len(pairs) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("seed, least, samples, whole", [(1, 20, 10, 1000), (2, 35, 35, 1000), (3, 8, 4, 1000), (4, 5, 5, 1000), (3, 8, 4, 1)])
def test_clusters_by_hand(spark, monkeypatch, seed, least, samples, whole):
    # A corpus in one task and in rounds of joins.
    monkeypatch.setattr(density, "WHOLE", whole)
    x = spread(seed)
    got = density.varying_density_cluster(frame(spark, x), min_cluster_size=least, min_samples=samples, neighbours=len(x) - 1)
    rows = sorted((r.id, r.topic, r.strength) for r in got.collect())
    labels, strength = clusters_by_hand(x, least, samples)
    assert [r[0] for r in rows] == list(range(len(x))) and labels.max() >= 0
    same_groups(labels, np.array([r[1] for r in rows]))
    assert np.allclose([r[2] for r in rows], strength)
    sizes = np.bincount([r[1] for r in rows if r[1] >= 0])
    assert (np.diff(sizes) <= 0).all()


def test_two_densities_that_one_grid_width_cannot_find(spark):
    from tidemark.operators.clusters import density_cluster

    rng = np.random.default_rng(8)
    tight = [rng.normal((0.4 * i, 0), 0.015, (60, 2)) for i in range(3)]
    x = np.concatenate([*tight, rng.normal((6, 0), 0.9, (150, 2)), rng.normal((6, 9), 0.9, (150, 2))])
    truth = np.repeat([0, 1, 2, 3, 4], [60, 60, 60, 150, 150])
    points = frame(spark, x)

    def agreed(labels):
        # Groups that are one topic mostly, of which no other has much.
        good = 0
        for g in range(5):
            own = labels[truth == g]
            values, n = np.unique(own[own >= 0], return_counts=True)
            if len(n) and n.max() > 0.6 * len(own) and (labels[truth != g] == values[n.argmax()]).sum() < 0.05 * len(own):
                good += 1
        return good

    got = np.array([r.topic for r in density.varying_density_cluster(points, min_cluster_size=25, min_samples=10).orderBy("id").collect()])
    assert agreed(got) == 5
    for width in (0.06, 0.25, 1.0):
        grid = [r.topic for r in density_cluster(points, width=width, min_cluster_size=25).orderBy("id").collect()]
        assert agreed(np.array(grid)) < 5


def test_each_corpus_by_itself_and_odd_rows(spark):
    a, b = spread(5), spread(6, ((60, 0.1, (0, 0)), (60, 0.1, (3, 3))), 10)
    few = np.array([[0.0, 0.0], [1.0, 1.0]])
    rows = frame(spark, a, 1).unionAll(frame(spark, b, 2, 1000)).unionAll(frame(spark, few, 3, 5000))
    odd = spark.createDataFrame([(1, 9000, None), (None, 9001, [0.0, 0.0]), (2, None, [0.0, 0.0])], "corpus int, id bigint, coords array<double>")
    options = {"min_cluster_size": 20, "min_samples": 8, "neighbours": 400}
    got = density.varying_density_cluster(rows.unionAll(odd), by=["corpus"], **options)
    seen = {(r.corpus, r.id): (r.topic, round(r.strength, 9)) for r in got.collect()}
    assert seen[1, 9000] == (-1, 0.0) and len(seen) == len(a) + len(b) + 3 and seen[3, 5000][0] == -1
    alone = density.varying_density_cluster(frame(spark, a), **options)
    assert {(1, r.id): (r.topic, round(r.strength, 9)) for r in alone.collect()}.items() <= seen.items()


def test_copies_are_one_point_with_a_weight(spark):
    x = np.concatenate([np.repeat([[0.0, 0.0]], 50, 0), spread(7)])
    got = {r.id: r.topic for r in density.varying_density_cluster(frame(spark, x), min_cluster_size=30, min_samples=10).collect()}
    assert len({got[i] for i in range(50)}) == 1 and got[0] >= 0
    empty = frame(spark, x).where("id < 0")
    assert density.varying_density_cluster(empty).collect() == []


@pytest.mark.parametrize("cell, block, k", [(768, 1024, 7), (20, 16, 12), (10, 1000, 3)])
def test_nearest_by_hand(spark, monkeypatch, cell, block, k):
    monkeypatch.setattr(near, "CELL", cell)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(cell)
    x = np.concatenate([rng.normal(0, 0.1, (150, 3)), rng.normal(5, 1, (150, 3)), rng.uniform(-9, 9, (40, 3))])
    points = spark.createDataFrame([(i, 1 + i % 3, [float(v) for v in p]) for i, p in enumerate(x)], "point bigint, weight bigint, coords array<double>")
    got = {}
    for r in near.nearest(points.repartition(4), k).collect():
        got.setdefault(r.point, []).append((r.distance, r.other, r.weight))
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        order = np.argsort(d[i])[:k]
        assert [o for _, o, _ in sorted(got[i])] == order.tolist()
        assert all(w == 1 + o % 3 for _, o, w in got[i])
        assert np.allclose([v for v, *_ in sorted(got[i])], d[i][order])


def test_far_blocks_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(near, "CELL", 20)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(20 * i, 0.5, (40, 2)) for i in range(12)])
    points = spark.createDataFrame([(0, i, 1, [float(v) for v in p]) for i, p in enumerate(x)], "g int, point bigint, weight bigint, coords array<double>")
    placed, pivots = near._assigned(points, ["g"]), near._pivots(points, ["g"])
    cells = placed.select("cell").distinct().count()
    assert cells > 12 and near._meetings(placed, pivots, ["g"], 5).count() < cells * cells / 4
