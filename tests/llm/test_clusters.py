"""Dual-tree Lloyd rounds against plain ones."""

import hashlib
import math

import numpy as np
import pytest

from siftwork.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, components=64):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == components and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        label = [n for _, n in assign()]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, label) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    last = assign()
    total = {n: sum(d for d, m in last if m == n) for n in range(k)}
    sha = lambda n: hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
    return sorted([(i, n, d, total[n], sum(total.values()), sha(n)) for (i, _), (d, n) in zip(kept, last)], key=str)


def listed(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()], key=str)


def vectors(n, groups, spread, seed=1, components=64):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, components))
    return [(i, (middle[rng.integers(groups)] + rng.normal(size=components) * spread).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n,groups,spread", [(300, 5, 0.05), (300, 1, 1.0), (5, 2, 0.1), (1, 1, 0.1)])
def test_equal_to_plain_rounds(spark, n, groups, spread):
    rows = vectors(n, groups, spread)
    assert listed(clusters.clustered(clusters.integers(frame(spark, rows).repartition(3), "vec_id", "embedding"))) == brute(rows)


def test_odd_rows(spark):
    """Nulls, other lengths, non-finite components, repeated and null ids, equal vectors, ties, nothing at all."""
    rows = vectors(60, 3, 0.1)
    odd = list(rows[5][1])
    same = [(100 + i, [0.5] * 64) for i in range(40)]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [None, *odd[1:]]), (204, [float("nan"), *odd[1:]]), (205, [float("inf"), *odd[1:]]), (206, [float("-inf"), *odd[1:]])]
    rows = [*rows, *same, *bad, (5, odd), (5, [0.25] * 64), (None, odd), (None, [-0.0] * 64)]
    assert listed(clusters.clustered(clusters.integers(frame(spark, rows), "vec_id", "embedding"))) == brute(rows)
    for some in ([], bad, [(None, odd)]):
        assert clusters.clustered(clusters.integers(frame(spark, some), "vec_id", "embedding")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clusters.clustered(clusters.integers(frame(spark, [(1, [1e9] * 64)]), "vec_id", "embedding")).count()


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_cover_tree(leaf):
    x = np.array([v for _, v in vectors(400, 6, 0.1, components=8)]) * 1000
    x = np.concatenate([x, x[:50]]).astype(np.int64)
    t = clusters.CoverTree(x, leaf)
    own = x[t.order]
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for (c, a, z, first, end), r in zip(t.nodes.tolist(), t.radius.tolist()):
        far = np.sqrt(((own[a:z] - own[c]) ** 2).sum(axis=1))
        assert a <= c < z and far.max() <= r * (1 + 1e-12)
        if first < end:
            some = t.nodes[first:end]
            assert some[0, 1] == a and some[-1, 2] == z and (some[1:, 1] == some[:-1, 2]).all() and c in some[:, 0]
            between = np.sqrt(((own[some[:, 0]][:, None] - own[some[:, 0]][None]) ** 2).sum(axis=2))
            assert (between[~np.eye(len(some), dtype=bool)] > r / 2 * (1 - 1e-6)).all()
            assert all(q <= r / 2 * (1 + 1e-6) for q in t.radius[first:end])
        else:
            assert z - a <= leaf or far.max() == 0


@pytest.mark.parametrize("spread,k", [(0.02, 8), (0.5, 8), (3.0, 8), (0.1, 60)])
def test_traversal_finds_the_nearest(spread, k):
    rng = np.random.default_rng(7)
    x = (np.array([v for _, v in vectors(900, 10, spread, components=16)]) * 1024).astype(np.int64)
    cents = np.concatenate([x[rng.integers(0, len(x), k - 2)], x[:1], x[:1]])  # with equal centroids
    t = clusters.CoverTree(x)
    own = x[t.order]
    label, whole, exact = clusters.nearest(own, t.nodes, t.radius, cents)
    want = ((own[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (label == want).all() and all((want[a:z] == c).all() for a, z, c in whole)
    if spread < 0.1:  # pairs of nodes are pruned, and whole nodes are decided
        assert exact < len(x) * k / 4 and sum(z - a for a, z, _ in whole) > len(x) / 2


def test_large_components_stay_exact():
    """Sums of squares beyond the precision of doubles."""
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 27), 1 << 27, (200, 64))
    x[100:] = x[:100]
    x[100:, 0] += 1
    cents = x[[0, 100, 5, 105]]
    t = clusters.CoverTree(x)
    label, _, _ = clusters.nearest(x[t.order], t.nodes, t.radius, cents)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in cents] for v in x[t.order]]
    assert label.tolist() == [f.index(min(f)) for f in far]
