"""Clusters by components against the plain merging of whole pools."""

import numpy as np
import pytest

from poolstat.errors import PoolstatError
from poolstat.operators import clustering, components
from poolstat.operators import vectors as V


def plain(d, threshold):
    """Average linkage as it is defined: the first closest pair of the list, the merged cluster behind all others."""
    groups = [[i] for i in range(len(d))]
    far = lambda a, b: np.mean([d[x, y] for x in a for y in b])
    heights = []
    while len(groups) > 1:
        best = min((round(far(groups[i], groups[j]), 12), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if best[0] >= threshold:
            break
        heights.append(best[0])
        _, i, j = best
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return heights, groups


def sets(groups):
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(4))
def test_merging_equals_plain(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(26, 3)) if seed % 2 else np.round(rng.normal(size=(26, 2)), 0) + 0.25  # many ties
    d = clustering.distance_matrix(x)
    for t in (0.001, 0.01, 0.1, 0.4, 0.9, 2.1):  # rounding of equal directions lies under the first
        heights, groups = plain(d, t)
        own, mine = clustering.merged(d, t)
        assert np.allclose(own if len(own) < 2 else sorted(own), sorted(heights)) and sorted(sum(mine, [])) == list(range(26))
        if seed % 2:
            assert sets(mine) == sets(groups)


def test_ties_go_to_the_first_pair():
    """On a line of equal steps the first pair merges first, and the merged cluster goes last."""
    points = np.arange(7.0)
    d = np.abs(points[:, None] - points[None])
    for t in (0.5, 1.5, 2.2, 3.0, 9.0):
        assert sets(clustering.merged(d, t)[1]) == sets(plain(d, t)[1])


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(60)] + [(7, 7)]
    root = {i: i for a, b in links for i in (a, b)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.id, r.component) for r in got) == sorted((i, find(i)) for i in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_large_pools_equal_whole_ones(spark, monkeypatch):
    """Pools over SMALL go by blocks and components; counts, cuts and labels are those of the whole pool's matrix."""
    rng = np.random.default_rng(3)
    rows, whole = [], {}
    for pool, n in (("a", 90), ("b", 12), (None, 60), ("c", 1)):
        centers = rng.normal(size=(max(1, n // 6), 6))
        x = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, 6)) * 0.25
        whole[pool] = clustering.distance_matrix(x)
        rows += [(pool, i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pool string, i long, v array<double>").repartition(5)
    monkeypatch.setattr(clustering, "SMALL", 20)
    monkeypatch.setattr(clustering, "BLOCK", 16)
    t = 0.12
    assert {r.pool: (r.n, r.k) for r in V.distinct_k(df, "pool", "v", t).collect()} == {p: (len(d), len(plain(d, t)[1])) for p, d in whole.items()}
    got = {r.pool: (r.k_low, r.k, r.k_high) for r in V.sensitivity(df, "pool", "v", t, 0.06).collect()}
    assert got == {p: tuple(len(plain(d, c)[1]) for c in (t - 0.06, t, t + 0.06)) for p, d in whole.items()}
    want = {(p, i): min(g) for p, d in whole.items() for g in plain(d, t)[1] for i in g}
    assert {(r.pool, r.i): r.cluster for r in V.clusters(df, "pool", "i", "v", t).collect()} == want
    assert any(len(p) < len(d) for p, d in ((set(want[k] for k in want if k[0] == q), whole[q]) for q in whole))
    monkeypatch.setattr(clustering, "MAX_PART", 3)
    with pytest.raises(PoolstatError, match="hang together"):
        V.distinct_k(df, "pool", "v", 1.5)
    with pytest.raises(Exception, match="zero or non-finite"):
        V.distinct_k(df.union(spark.createDataFrame([("a", 99, [0.0] * 6)], df.schema)), "pool", "v", t).collect()
