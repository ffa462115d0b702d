"""The threshold walk and the clustering against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reeltally.llm.centroids import Lists, cluster_vectors, with_inertia

SCHEMA = "id long, vec array<long>, cluster string, n int, total double"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 30), st.sampled_from([1, 3, 1000]), st.integers(0, 2**32 - 1))
def test_walk_finds_the_nearest(dims, k, n, span, seed):
    r = np.random.default_rng(seed)
    centroids, x = r.integers(-span, span + 1, (k, dims)), r.integers(-2 * span, 2 * span + 1, (n, dims))
    number, distance = Lists(centroids).nearest(x)
    plain = ((x[:, None] - centroids) ** 2).sum(2)
    assert number.tolist() == plain.argmin(1).tolist() and distance.tolist() == plain.min(1).tolist()


def test_walk_stops_early():
    """Far lists are not walked to their ends: the exact distances taken are few."""
    centroids = np.arange(0, 100_000, 100)[:, None].repeat(4, 1)
    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                taken.append(len(at))
            return super().__getitem__(at)

    lists = Lists(centroids)
    lists.centroids = centroids.view(Counted)
    number, _ = lists.nearest(np.array([[5_010, 4_990, 5_000, 5_049]]))
    assert number.tolist() == [50] and sum(taken) < 6


def test_walk_refuses_to_overflow():
    with pytest.raises(ValueError):
        Lists(np.array([[1 << 40]])).nearest(np.array([[-(1 << 40)]]))


def plain(rows, k, rounds, seed=1):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        own = assigned()
        for i in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(rows, own) if c == i]
            if mine:
                centroids[i] = [sum(col) // len(mine) for col in zip(*mine)]
    return centroids, [(i, c, d) for (i, _), (d, c) in zip(rows, assigned())]


@pytest.mark.parametrize("n", [0, 3, 400])
def test_clusters_by_brute_force(spark, n):
    r = np.random.default_rng(4)
    # A third of all rows are one vector; the last rows repeat ids.
    rows = [(int(i % 390), (r.integers(-9, 10, 5) if i % 3 else np.arange(5)).tolist()) for i in range(n)]
    rows += [(None, [1, 2, 3, 4, 5])] if n else []
    odd = [(900, None), (901, [1, 2, 3]), (902, [1, 2, 3, 4, None]), (903, [])]
    df = spark.createDataFrame([(*x, "x", 1, 0.5) for x in rows + odd], SCHEMA)
    found = cluster_vectors(df.repartition(3), dims=5, clusters=7)
    centroids, want = plain(rows, 7, 3)
    assert found.centroids == centroids
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    out = with_inertia(found).collect()
    assert sorted(((r.id, r.cluster, r.distance) for r in out), key=key) == sorted(want, key=key)
    for row in out:
        assert row.cluster_inertia == sum(d for _, c, d in want if c == row.cluster)
        assert row.inertia == sum(d for _, _, d in want)
        assert row.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[row.cluster])).encode()).hexdigest()
