"""Every query with SQL equals DuckDB's rows; the generator equals its definition."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from poolstat import catalog
from poolstat.operators.vectors import average_linkage, cluster_count, distance_matrix

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([float(f"{r[i]:.9g}") if isinstance(r[i], (float, int)) or hasattr(r[i], "as_tuple") else r[i] for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_mulberry32(spark):
    def draw(a):
        mask = 0xFFFFFFFF
        a = (a + 0x6D2B79F5) & mask
        t = (a ^ a >> 15) * (a | 1) & mask
        t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
        return ((t ^ t >> 14) & mask) / 4294967296

    for r in catalog.queries()["mulberry32"](spark, SF).limit(500).collect():
        assert r.draw == draw(r.o_orderkey)


def test_clusters():
    x = np.array([[1, 0], [1, 0.01], [0, 1], [0.01, 1]])
    assert len(average_linkage(distance_matrix(x), 0.2)) == 2 and len(average_linkage(distance_matrix(x), 0.0)) == 4
    assert len(average_linkage(distance_matrix(np.ones((30, 4))), 0.2)) == 1 and math.isclose(distance_matrix(np.ones((2, 4)))[0, 1], 0, abs_tol=1e-12)


def test_rarefied_k_equals_plain(spark):
    """The registered query: 1,000 draws of the smallest pool's size, one mulberry32 stream for each pool."""

    def stream(a):
        mask = 0xFFFFFFFF
        while True:
            a = (a + 0x6D2B79F5) & mask
            t = (a ^ a >> 15) * (a | 1) & mask
            t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
            yield ((t ^ t >> 14) & mask) / 4294967296

    pools = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        pools.setdefault(r.label, []).append(r.embedding)
    n = min(map(len, pools.values()))
    got = {r.label: r.mean_k for r in catalog.queries()["rarefied_k"](spark, SF).collect()}
    assert set(got) == set(pools)
    for label in sorted(pools)[:2]:
        d, rng, total = distance_matrix(np.array(pools[label], dtype=float)), stream(20260901), 0
        for _ in range(1000):
            left, picked = list(range(len(d))), []
            for _ in range(n):
                picked.append(left.pop(math.floor(next(rng) * len(left))))
            total += len(average_linkage(d[np.ix_(picked, picked)], 0.85))
        assert got[label] == total / 1000


def test_cluster_count_equals_average_linkage():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for t in (0.0, 0.3, 0.85, 3.0):
            x = rng.normal(size=(n, 6))
            x[n // 2 :] = x[: n - n // 2]  # exact copies
            d = distance_matrix(x)
            assert cluster_count(d, t) == len(average_linkage(d, t))
