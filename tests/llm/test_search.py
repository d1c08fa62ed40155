"""Ranked search against a plain scoring of every document, and its defined results."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from poolstat.llm import search
from poolstat.llm.common import table

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, term string, n_docs long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    texts = [(i, c) for i, t in docs if (c := Counter(terms(t)))]
    n_docs, n_terms = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = set()
    for item, own in asked.items():
        scores = []
        for i, c in texts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out |= {(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = set(map(tuple, search.search(docs, items).collect()))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == set(c.execute(search.SQL).fetchall())


@pytest.mark.parametrize("whole", [False, True])
def test_small_shards_blocks_ties_and_odd_rows(spark, monkeypatch, whole):
    """Shards of a few documents, terms over the broadcast bound, null and repeated ids, equal scores, long and empty texts."""
    if whole:
        monkeypatch.setattr(search, "MAX_TERMS", 20)
        monkeypatch.setattr(search, "SHARD_DOCS", 7)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 90)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "ÑÑ", "Zz", "zz", "the", "the", "THE", "the"]
    docs = [(rng.choice([None, rng.randrange(60), 2**60 + rng.randrange(99)]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(300)]
    docs += docs[:40] + [(7, None), (None, None), (8, ""), (9, " !! "), (10, "w1 zz " * 20_000)]
    items = [(k % 9, "; ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(12)] + [(None, "zz w3"), (50, None), (51, "absent"), (50, "")]
    got = search.search(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOC).repartition(3), spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, score string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(docs, items)))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, asked).collect() == [] and search.search(one, asked.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in search.search(one, asked).collect()] == [(1, 1, 1)]


def test_wand_finds_the_best_and_skips():
    rng = np.random.default_rng(5)
    for k, above in [(1, 0), (3, 0), (10, 500), (10, 10**9)]:
        lists, total = [], Counter()
        for _ in range(12):
            places = np.flatnonzero(rng.random(3000) < rng.choice([0.01, 0.2, 0.7]))
            own = rng.integers(0, int(rng.choice([3, 100, 2000])), len(places))
            total.update(dict(zip(places.tolist(), own.tolist())))
            lists.append(([*places.tolist(), search.END], own.tolist(), int(own.max())))
        want = sorted(((s, -p) for p, s in total.items() if s > above), reverse=True)[:k]
        assert sorted(search.wand(lists, k, above), reverse=True) == want


def test_one_block_writes_the_index_alone(spark, monkeypatch):
    """Each file that a task writes locally spawns processes of the executor's size."""
    made, own = [], search.written
    monkeypatch.setattr(search, "written", lambda df: made.append(df.columns) or own(df))
    docs, items = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, text string")
    assert len(search.search(docs, items).collect()) == 3 and len(made) == 1 and "places" in made[0]
