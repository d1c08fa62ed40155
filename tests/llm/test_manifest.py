"""The manifest against a plain recursive version, and its defined results."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from poolstat.llm import manifest
from poolstat.llm.common import table

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, n int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    fields = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(rows, at):
    """(siblings, sides) of a node, bottom up."""
    out = []
    for level in rows[:-1]:
        other = at ^ 1
        out.append((level[other] if other < len(level) else None, at & 1))
        at >>= 1
    return out


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in names:
        trees[t].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    own = {t: levels([leaf(r) for r in trees[t]]) for t in names}
    above = levels([own[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            steps = path(own[t], i) + path(above, k)
            touched = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            got = leaf(r, 1) if touched else leaf(r)
            for other, right in steps:
                got = h(got) if other is None else h(other, got) if right else h(got, other)
            root = above[-1][0]
            out.append((r["doc_id"], leaf(r), own[t][-1][0], root, h(*[o for o, _ in steps if o]), got, got == root))
    return out


def same(df, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(plain([r.asDict() for r in rows]), key=key)


def test_documents(spark):
    docs = table(spark, SF, "documents")
    same(manifest.op11(docs), docs.collect())


@pytest.mark.parametrize("span", [1, 3])
def test_many_bands_and_odd_rows(spark, monkeypatch, span):
    """Bands of one and three levels, sizes around powers of two, null and repeated ids and rows, wide ids, clashing columns."""
    monkeypatch.setattr(manifest, "SPAN", span)
    rng, rows = random.Random(span), []
    for lang, n in {None: 3, "": 1, "a": 2, "b": 17, "c": 16, "é": 33, "z": 129}.items():
        for _ in range(n):
            i = rng.choice([None, rng.randrange(40), 2**60 + rng.randrange(1000)])
            rows.append((i, rng.choice([None, "", "x" * 20_000, "ñ " * rng.randrange(9)]), lang, rng.choice([None, "s", "5:x"]), rng.choice([None, 0, 7]), "t", 1, 2))
    rows += rows[:30]
    docs = spark.createDataFrame(rows, DOC).repartition(7)
    same(manifest.op11(docs), docs.collect())


def test_sql(spark):
    """The registered SQL gives the same rows."""
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(c.execute(manifest.sql()).fetchall()) == sorted(plain([r.asDict() for r in table(spark, SF, "documents").collect()]))


def test_small_tables(spark):
    assert manifest.op11(spark.createDataFrame([], DOC)).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None, "t", 1, 2)], DOC)
    r = manifest.op11(one).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root == h("-----") and r.proof_sha256 == h("") and r.verified


def test_events_in_any_order():
    """Children may arrive in any order and over several combiners; what is left open is the frontier alone."""
    rng = random.Random(1)
    for n in [2, 3, 5, 8, 21, 64, 65]:
        digests = [h(str(i)) for i in range(n)]
        order = list(range(n))
        rng.shuffle(order)
        made, rest = [], []
        for part in (order[: n // 2], order[n // 2 :]):
            state = manifest.Parents()
            for i in part:
                state.arrive("t", n, 0, i, digests[i])
            made += state.emitted()
            rest += state.frontier()
        last = manifest.Parents()
        for row in rest:
            last.arrive(*row[:5])
        made += last.emitted()
        assert not last.frontier() and len(made) == sum(map(len, levels(digests)[1:]))
        assert {(r[2], r[3]): r[4] for r in made} == {(k + 1, i): d for k, level in enumerate(levels(digests)[1:]) for i, d in enumerate(level)}


def test_leaves_are_written_once(spark, monkeypatch):
    """Each file that a task writes locally spawns processes of the executor's size."""
    made, own = [], manifest.written
    monkeypatch.setattr(manifest, "written", lambda df: made.append(df.columns) or own(df))
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i, None, None, None) for i in range(9)], DOC)
    left = sum(zlib.crc32(str(i).encode()) % 7 != 0 for i in range(9))
    assert manifest.op11(docs).where("verified").count() == left and sum("tampered" in c and "doc_id" in c and "leaf" in c for c in made) == 1
