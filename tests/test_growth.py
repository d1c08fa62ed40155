"""Work and memory that grow no faster than the input: what one task, one frame or one call may hold."""

import inspect
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from poolstat.operators import clustering, judging
from poolstat.operators import vectors as V
from poolstat.operators import windows as W
from poolstat.sources.keyed import Keyed
from poolstat.streaming import replays, reservations


def test_step_up_reads_no_frame_to_the_end(spark):
    """A frame up to a group's end is added up anew for every row, so the minimum runs over the reversed order."""
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(40) / 40) for g in "ab" for i in range(300)]
    out = W.benjamini_hochberg(spark.createDataFrame(rows, "g string, i long, p double"), "g", "p", "i")
    assert "currentrow$(), unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    want = {}
    for g in "ab":
        own, least = sorted((p, i) for h, i, p in rows if h == g), 1.0
        for r in range(len(own), 0, -1):
            p, i = own[r - 1]
            least = min(least, p * len(own) / r)
            want[g, i] = round(least, 12)
    assert {(r.g, r.i): round(r.bh, 12) for r in out.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_means_merge_as_the_matrix_does(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 5)) if seed % 2 else np.repeat(rng.normal(size=(30, 5)), 3, axis=0)  # copies
    for t in (0.01, 0.1, 0.4, 0.9, 2.1):
        heights, groups = clustering.merged(clustering.distance_matrix(x), t)
        own, mine = clustering.merge_means(clustering.unit_rows(x), t)
        assert np.allclose(sorted(own), sorted(heights), atol=1e-12)
        assert {frozenset(m) for _, m in mine} == {frozenset(m) for m in groups}


def test_pools_over_ten_thousand(spark):
    """One component of 10,050 vectors, refused before as its square of distances would not fit: four directions, most of them copies."""
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(4) + 0.2, [2600, 2550, 2500, 2400], axis=0)
    rows = [("a", int(i), [float(v) for v in x[i]]) for i in rng.permutation(len(x))]
    df = spark.createDataFrame(rows, "pool string, i long, v array<double>")
    assert [tuple(r) for r in V.distinct_k(df, "pool", "v", 0.5).select("n", "k").collect()] == [(10_050, 4)]
    assert [tuple(r) for r in V.sensitivity(df, "pool", "v", 0.5, 0.4).select("k_low", "k", "k_high").collect()] == [(4, 4, 1)]
    got = {r.i: r.cluster for r in V.clusters(df, "pool", "i", "v", 0.5).collect()}
    assert got == {i: [0, 2600, 5150, 7650][int(x[i].argmax())] for i in range(len(x))}
    assert V.rarefied_k(df, "pool", "v", 40, 0.5, rounds=2, order="i").first()["mean_k"] == 4


def test_rounds_merge_as_often_as_the_means_do():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 40, 300):
        for copies in (1, 3):
            u = clustering.unit_rows(np.repeat(rng.normal(size=(n, 6)), copies, axis=0))
            for t in (0.001, 0.1, 0.4, 0.85, 2.1):
                assert clustering.merges_by_rounds(u, t) == len(clustering.merge_means(u, t)[0])
    ring = np.array([[np.cos(x), np.sin(x)] for x in np.arange(8) * np.pi / 4])  # each has two nearest
    assert clustering.merges_by_rounds(ring, 0.5) is None and clustering.merges_by_rounds(ring, 0.1) == 0


def test_rarefied_pools_are_not_copied_by_draw(spark, monkeypatch):
    """A pool went to every draw of its own, 1,000 copies on disk where it was over a matrix; now to a fixed number of tasks."""
    rng = np.random.default_rng(6)
    x = {g: np.concatenate([rng.normal(size=(40, 5)), np.tile(np.eye(5)[:2], (5, 1))]) for g in "ab"}  # copies; ties only at 1
    df = spark.createDataFrame([(g, i, [float(v) for v in r]) for g in "ab" for i, r in enumerate(x[g])], "pool string, i long, v array<double>")
    monkeypatch.setattr(clustering, "MATRIX", 10)
    out = V.rarefied_k(df, "pool", "v", 30, 0.6, rounds=300, order="i")
    copies = 1 + int(re.search(r"sequence\(0, (\d+)", out._jdf.queryExecution().analyzed().toString())[1])
    assert copies == 32
    got = {r.pool: r.mean_k for r in out.collect()}
    monkeypatch.undo()
    for g in "ab":
        d = clustering.distance_matrix(x[g])
        draws = [V.splice_draw(50, V.mulberry32_draws(20260901, r * 30, 30)) for r in range(300)]
        assert got[g] == sum(V.cluster_count(d[np.ix_(at, at)], 0.6) for at in draws) / 300


def test_a_split_holds_no_reviews(spark):
    """Lists are split by themselves: no task of a group takes its reviews, and the streams are those of the whole group."""
    rng = np.random.default_rng(4)
    lists = [[float(x) / 10 for x in rng.integers(1, 99, int(rng.integers(2, 7)))] for _ in range(24)]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(lists)], "g string, i int, s array<double>").repartition(3)
    out = judging.interval(df, "g", "i", "s", draws=12, splits=3)
    tasks = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandas" in x]
    assert tasks and not any("_x#" in x for x in tasks)
    got = out.first()
    values = []
    for d in range(12):
        own = [lists[int(judging.mulberry32_draws(2, d * 24 + j, 1)[0] * 24)] for j in range(24)]
        seed, at, total = (2 * 1_000_003 + d + 1) & 0xFFFFFFFF, 0, 0.0
        for _ in range(3):
            pair = []
            for x in own:
                mixed = judging._shuffled(x, judging.mulberry32_draws(seed, at, len(x) - 1))
                at, h = at + len(x) - 1, len(x) // 2
                pair.append((sum(mixed[:h]) / h, sum(mixed[h:]) / (len(x) - h)))
            total += judging._accuracy(np.array([p[0] for p in pair]), np.array([p[1] for p in pair]), 6)
        values.append(total / 3)
    values.sort()
    assert (got["n"], round(got["lower"], 12), round(got["upper"], 12)) == (24, round(values[0], 12), round(values[11], 12))


def test_replays_of_one_cell_take_no_sort_each():
    """Every submission sorted all waiting events anew: over a minute for these."""
    events, start = [(t, 0, f"b{t % 40_000}") for t in range(40_000)] + [(t + 5, 1, f"b{t}") for t in range(40_000)], time.process_time()
    rows, left = replays.settle(events, {}, 10**9, 60)
    assert len(rows) == 80_000 and not left and {r[3] for r in rows} == {"held", "replayed"}
    assert time.process_time() - start < 5


class Kept(dict):
    """A map state in memory that tells the longest value it gave."""

    most = 0
    containsKey, removeKey = dict.__contains__, dict.__delitem__  # noqa: N815

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def getValue(self, key):  # noqa: N802
        Kept.most = max(Kept.most, len(str(self[key][0])))
        return self[key]


def test_waiting_events_are_read_by_blocks():
    """A run whose first event comes last: all wait in the store, and are taken a block at a time."""
    state, book, n = reservations.Reservations(None, {}), reservations.Book(None, {}), 5 * reservations.BLOCK + 7
    state.pieces, state.waiting = Kept(), Kept()
    order = [int(k) for k in np.random.default_rng(2).permutation(np.arange(1, n))] + [0, 3, n - 1]  # two repeats
    for k in range(0, len(order), 3000):
        assert not list(e for e in state.turns(book) for e in e if e[0] == book.next)
        state.wait([[s, "ask", f"c{s}", [("a", 1.0)]] for s in order[k : k + 3000]])
    seen = []
    for events in state.turns(book):
        assert len(events) <= reservations.BLOCK + 2
        for e in events:
            if e[0] == book.next:
                book.next += 1
                seen.append(e[0])
    assert seen == list(range(n)) and set(state.pieces) == {(5,)} and Kept.most < 40 * 3000


def test_a_put_makes_its_records_once(spark, tmp_path):
    """The checks of a put and its write share one reading of what comes in."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        made.add(1)
        return f'{{"i":{i}}}'

    rows = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("completed").alias("state"), body("id").alias("body"))
    told = Keyed(spark, f"{tmp_path}/store", 4).put(rows).collect()
    assert len(told) == 60 and {r.outcome for r in told} == {"written"} and made.value == 60


def test_the_interval_query_does_its_whole_job(spark, monkeypatch):
    """The registered construction is 2,000 draws of ideas and 200 splits of each; the query once asked for 24 and 4."""
    asked, own = [], inspect.signature(judging.interval)

    def interval(*args, **named):
        call = own.bind(*args, **named)
        call.apply_defaults()
        asked.append((call.arguments["draws"], call.arguments["splits"]))
        return spark.createDataFrame([("A", 1, 0.0, 0.0)], "topic string, n long, lower double, upper double")

    monkeypatch.setattr(judging, "interval", interval)
    entry.queries()["split_half_interval"](spark, "/root/testdata/sf0.001")
    assert asked == [(2000, 200)]


def test_waves_of_draws_and_mixed_lists(spark, monkeypatch):
    """Lists with and without exact sums, unlike in size, in two groups; draws in waves or all at once give the plain loop's values."""
    rng = np.random.default_rng(11)
    lists = {g: [[float(x) / [1, 4, 10, 1 / 1000][i % 4] for x in rng.integers(1, 99, int(rng.integers(2, 9)))] for i in range(n)] for g, n in (("t", 24), ("u", 31))}
    df = spark.createDataFrame([(g, i, x) for g in lists for i, x in enumerate(lists[g])], "g string, i int, s array<double>")
    whole = {r.g: (r.n, round(r.lower, 12), round(r.upper, 12)) for r in judging.interval(df, "g", "i", "s", draws=7, splits=3).collect()}
    monkeypatch.setattr(judging, "WAVE", 400)
    waves = {r.g: (r.n, round(r.lower, 12), round(r.upper, 12)) for r in judging.interval(df, "g", "i", "s", draws=7, splits=3).collect()}
    assert waves == whole
    for g, rows in lists.items():
        n, values = len(rows), []
        for d in range(7):
            own = [rows[int(u * n)] for u in judging.mulberry32_draws(2, d * n, n)]
            seed, at, total = (2 * 1_000_003 + d + 1) & 0xFFFFFFFF, 0, 0.0
            for _ in range(3):
                pair = []
                for x in own:
                    mixed = judging._shuffled(x, judging.mulberry32_draws(seed, at, len(x) - 1))
                    at, h = at + len(x) - 1, len(x) // 2
                    pair.append((sum(mixed[:h]) / h, sum(mixed[h:]) / (len(x) - h)))
                total += judging._accuracy(np.array([p[0] for p in pair]), np.array([p[1] for p in pair]), n // 4)
            values.append(total / 3)
        assert whole[g] == (n, round(min(values), 12), round(max(values), 12))
    a, b = rng.integers(0, 9, (2, 20, 40)).astype(float)  # many ties
    assert np.allclose(judging._accuracies(a, b, 10), [judging._accuracy(x, y, 10) for x, y in zip(a, b)], atol=0)
