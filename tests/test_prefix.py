"""Running sums by ranges, and what is built on them, with many small ranges."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from poolstat.operators import judging, prefix, thresholds
from poolstat.operators.prefix import running
from poolstat.plans import statistics

SF = "/root/testdata/sf0.01"


@pytest.fixture
def ranges(spark):
    """Sixty ranges, none merged."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("by", [["g"], []])
def test_running_equals_plain(spark, ranges, by):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.randrange(9)) for i in range(700)] + [("c", 1, 1)]
    got = running(spark.createDataFrame(rows, "g string, i long, x long").repartition(4), by, ["i"], {"s": F.col("x"), "n": F.lit(1)}, {"next": "x"}).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0] if by else 0, []).append(r)
    if by:
        want = {r: (sum(x[2] for x in g[: k + 1]), k + 1, sum(x[2] for x in g), len(g), g[k + 1][2] if k + 1 < len(g) else None) for g in groups.values() for k, r in enumerate(g)}
        assert {(r.g, r.i, r.x): (r.s, r.n, r.s_all, r.n_all, r.next) for r in got} == want
    else:
        assert sorted(r.n for r in got) == list(range(1, 702)) and {r.s_all for r in got} == {sum(r[2] for r in rows)}
    assert running(spark.createDataFrame([], "g string, i long, x long"), by, ["i"], {"s": F.col("x")}).collect() == []


def test_select_threshold_over_many_ranges(spark, ranges):
    """The registered query and a plain search by group."""
    c = duckdb.connect()
    for t in ("embeddings", "nation", "region", "part", "lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    query, sql = statistics.QUERIES["select_threshold"]
    assert [tuple(r) for r in query(spark, SF).collect()] == c.execute(sql).fetchall()
    rng = random.Random(4)
    rows = [(g, rng.choice(["same", "other"]), round(rng.gauss(0.3 if g else 0.6, 0.2), 2)) for g in (0, 1, None) for _ in range(300)]
    got = {r.g: (round(r.threshold, 9), round(r.balanced_accuracy, 9)) for r in thresholds.select_threshold(spark.createDataFrame(rows, "g int, label string, d double"), "d", "label", "g").collect()}
    for g in (0, 1, None):
        own = [r for r in rows if r[0] == g]
        values = sorted({r[2] for r in own})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        same, other = [r[2] for r in own if r[1] == "same"], [r[2] for r in own if r[1] == "other"]
        acc = [(sum(x < t for x in same) / len(same) + sum(x >= t for x in other) / len(other)) / 2 for t in cuts]
        best, runs = max(acc), []
        for k, a in enumerate(acc):
            if abs(a - best) < 1e-9:
                if runs and runs[-1][1] == k - 1:
                    runs[-1][1] = k
                else:
                    runs.append([k, k])
        a, b = max(runs, key=lambda r: (round(cuts[r[1]] - cuts[r[0]], 12), -r[0]))
        assert got[g] == (round((cuts[a] + cuts[b]) / 2, 9), round(best, 9))


def test_extremes_of_a_large_group(spark, ranges, monkeypatch):
    """One topic with most rows, ranked by ranges: the registered query's SQL, and a plain ranking."""
    monkeypatch.setattr(prefix, "SPLIT_ROWS", 50)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    query, sql = statistics.QUERIES["balanced_accuracy"]
    assert sorted(tuple(r) for r in query(spark, SF).select("topic", "n", "k", "sensitivity", "specificity", "accuracy").collect()) == sorted(c.execute(f"select topic, n, k, sensitivity, specificity, accuracy from ({sql})").fetchall())
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.9 else 1, i, float(rng.randrange(5)), rng.random()) for i in range(400)]
    got = {r.t: r.accuracy for r in judging.balanced_accuracy(spark.createDataFrame(rows, "t int, i int, e double, j double"), ["t"], "e", "j", "i").collect()}
    for t in (0, 1):
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1]))
        k = len(own) // 4
        low, high = {r[1] for r in own[:k]}, {r[1] for r in own[-k:]}
        order = [r[1] for r in sorted(own[:k] + own[-k:], key=lambda r: (r[3], r[1]))]
        assert got[t] == pytest.approx((len(low & set(order[:k])) + len(high & set(order[k:]))) / (2 * k))


def test_interval_equals_plain(spark, ranges):
    """Two groups, few draws: ideas resampled by the generator's stream, their reviews split again and again."""

    def stream(seed):
        a = seed & 0xFFFFFFFF
        while True:
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = (a ^ a >> 15) * (a | 1) & 0xFFFFFFFF
            t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            yield ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    def mean_accuracy(lists, splits, seed):
        u, total = stream(seed), 0.0
        for _ in range(splits):
            a, b = [], []
            for x in lists:
                x = list(x)
                for i in range(len(x) - 1, 0, -1):
                    j = int(next(u) * (i + 1))
                    x[i], x[j] = x[j], x[i]
                h = len(x) // 2
                a.append(sum(x[:h]) / h)
                b.append(sum(x[h:]) / (len(x) - h))
            k = len(lists) // 4
            order = sorted(range(len(a)), key=lambda i: (a[i], i))
            low, high = order[:k], order[-k:]
            guess = sorted(low + high, key=lambda i: b[i])
            guess = sorted(range(2 * k), key=lambda p: (b[(low + high)[p]], (low + high)[p]))
            named = [(low + high)[p] for p in guess]
            total += (len(set(low) & set(named[:k])) + len(set(high) & set(named[k:]))) / (2 * k)
        return total / splits

    rng = random.Random(6)
    rows = [(g, i, [float(rng.randrange(1, 11)) for _ in range(rng.randrange(2, 5))]) for g, n in (("a", 24), ("b", 21)) for i in range(n)]
    got = {r.g: (r.n, r.lower, r.upper) for r in judging.interval(spark.createDataFrame(rows, "g string, idea int, x array<double>").repartition(3), "g", "idea", "x", 9, 3, 2, 0.8).collect()}
    for g in "ab":
        lists = [r[2] for r in rows if r[0] == g]
        u, values = stream(2), []
        for d in range(9):
            picks = [lists[int(next(u) * len(lists))] for _ in lists]
            values.append(mean_accuracy(picks, 3, 2 * 1_000_003 + d + 1))
        values.sort()
        assert got[g] == (len(lists), pytest.approx(values[0]), pytest.approx(values[8]))
