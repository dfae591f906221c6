"""Places that keep neighbours, against PCA and dense eigenvectors."""

import numpy as np
from tidemark.operators import spectral
from tidemark.operators.clusters import reduce_dims


def rolled(n=500, seed=1):
    """A band rolled up in three of ten dimensions, with a little noise."""
    rng = np.random.default_rng(seed)
    t, h = 1.5 * np.pi * (1 + 2 * rng.random(n)), 12 * rng.random(n)
    x = np.zeros((n, 10))
    x[:, 0], x[:, 1], x[:, 2] = t * np.cos(t), h, t * np.sin(t)
    return x + 0.05 * rng.normal(size=x.shape)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, vector array<double>").repartition(3)


def kept(x, y, k=15):
    """The share of each point's nearest neighbours that are still its nearest."""
    def near(z):
        d = ((z[:, None, :] - z[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :k]

    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x).tolist(), near(y).tolist())])


def places(df, **options):
    return np.array([r.coords for r in spectral.neighbour_places(df, **options).orderBy("id").collect()])


def test_neighbours_are_kept_better_than_by_pca(spark):
    # A plane bent through 24 dimensions, more than a few straight ones can hold.
    rng = np.random.default_rng(1)
    x = np.cos(rng.random((500, 2)) * [1, 0.5] @ rng.normal(0, 10, (2, 24)) + rng.uniform(0, 6.28, 24)) + 0.01 * rng.normal(size=(500, 24))
    df = frame(spark, x)
    for k, better in ((2, 0.2), (5, 0.03)):
        pca = np.array([r.coords for r in reduce_dims(df, k=k).orderBy("id").collect()])
        got = places(df, k=k, neighbours=12)
        assert got.shape == (len(x), k) and np.allclose((got**2).mean(0), 1, atol=1e-3)
        assert kept(x, got) > kept(x, pca) + better
    assert (places(df.repartition(7), k=5, neighbours=12) == got).all()


def test_places_are_eigenvectors(spark):
    x = np.concatenate([np.random.default_rng(2).normal(c, 1.0, (60, 3)) for c in (0, 3.0, 6.0)])
    points = spark.createDataFrame([(i, 1, [float(v) for v in p]) for i, p in enumerate(x)], "point bigint, weight bigint, coords array<double>")
    s, degree = np.zeros((len(x), len(x))), np.zeros(len(x))
    for r in spectral.weighted_graph(points, 10).collect():
        s[r.u, r.v], degree[r.u] = r.s, r.degree
    assert np.allclose(s, s.T)
    values, vectors = np.linalg.eigh(s)
    assert abs(values[-1] - 1) < 1e-9
    got = places(frame(spark, x), k=2, neighbours=10)
    for j in range(2):
        want = vectors[:, -2 - j] / np.sqrt(degree)
        want *= np.sign(want[np.abs(want).argmax()]) / np.sqrt((want**2).mean())
        assert np.allclose(got[:, j], want, atol=0.02)


def test_odd_rows(spark):
    x = rolled(80)
    df = frame(spark, x).unionAll(spark.createDataFrame([(900, None), (901, [float(v) for v in x[3]])], "id bigint, vector array<double>"))
    got = {r.id: r.coords for r in spectral.neighbour_places(df, k=3, neighbours=6).collect()}
    assert got[900] is None and got[901] == got[3] and len(got) == 82
    assert spectral.neighbour_places(df.where("id < 0")).collect() == []
    assert [r.coords for r in spectral.neighbour_places(df.where("id = 1"), k=2).collect()] == [[0.0, 0.0]]
