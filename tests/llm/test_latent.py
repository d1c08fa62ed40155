"""What the latent search adds: paraphrases whose rare words were all replaced."""

import random
import sys

import numpy as np

from poolstat.llm import decontaminate
from poolstat.llm.common import table

SF = "/root/testdata/sf0.01"


def test_latent_search_finds_paraphrases_without_rare_words(spark, monkeypatch):
    """Every rare word of an item and others are replaced; found with the latent search, not without it; clean texts are left alone."""
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    index = next(decontaminate.indexes(docs, items)).value
    rng, with_, without, n = random.Random(1), 0, 0, 0
    for item, text in [(r.item_id, r.text) for r in items.collect()]:
        words = text.split()
        if len(words) < 30:
            continue
        rare = set().union(*[r for i, r in zip(index.ids, index.rare) if i == item])
        gone = [bool({int(h) for h in decontaminate.words(w)} & rare) for w in words]
        doc = " ".join(["alpha"] * 30 + [f"zq{rng.randrange(10**6)}" if g else w for w, g in zip(words, gone)] + ["omega"] * 30)
        n += 1
        with_ += item in index.search(doc)
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "LATENT", 2.0)
            without += item in index.search(doc)
    assert n >= 10 and with_ >= 0.75 * n and without == 0, (n, with_, without)
    found = [(i, set(index.search(t))) for i, t in docs.select("doc_id", "text").collect()]
    with monkeypatch.context() as m:
        m.setattr(decontaminate, "LATENT", 2.0)
        assert found == [(i, set(index.search(t))) for i, t in docs.select("doc_id", "text").collect()]


def test_marks_never_lose_a_pair(spark):
    """The bits only rule out pairs whose words could not reach the least share."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(200):
        a, b = ([rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] for _ in range(2))
        b = b + rng.sample(a, rng.randrange(len(a)))
        wa, wb = decontaminate.words(" ".join(a)), decontaminate.words(" ".join(b))
        own = set(wa.tolist())
        bits = decontaminate.np.bitwise_or.reduce(decontaminate.marks(wa), axis=0)
        there = decontaminate.np.bitwise_or.reduce(decontaminate.marks(wb), axis=0)
        shared = len(own & set(wb.tolist()))
        assert int(decontaminate.np.bitwise_count(bits & there).sum()) >= shared - (len(own) - int(decontaminate.np.bitwise_count(bits).sum()))


def plain_power(texts, idf, q):
    """A'(AQ) passage by passage."""
    z = np.zeros(q.shape)
    for t in texts:
        for at in decontaminate.passage_starts(len(t)):
            p, tf = np.unique(t[at : at + decontaminate.PASSAGE], return_counts=True)
            x = tf * idf[p]
            x = x / np.linalg.norm(x)
            z[p] += np.outer(x, x @ q[p])
    return z


def test_a_round_of_the_fit_equals_its_plain_form(monkeypatch):
    """Texts of all lengths about a half passage, frequent words, long texts in pieces."""
    rng = np.random.default_rng(4)
    idf, q = rng.random(decontaminate.TERMS) * 5 + 1, rng.standard_normal((decontaminate.TERMS, 7))
    texts = [np.minimum(rng.zipf(1.3, n) - 1, decontaminate.TERMS - 1) for n in [1, 2, 23, 24, 25, 47, 48, 49, 71, 72, 73, 96, 97, 500, 3000]]
    want = plain_power(texts, idf, q)
    for batch in (1, 2, 5, 10_000):
        monkeypatch.setattr(decontaminate, "BATCH", batch)
        word, sums = decontaminate.power([p for t in texts for p in decontaminate.pieces(t)], idf, decontaminate.with_zeros(idf[:, None] * q))
        got = np.zeros(want.shape)
        got[word] = sums * idf[word, None]
        assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()


def test_the_basis_is_fitted_on_every_passage(spark):
    """More passages than the 20,000 that were once sampled; the second half of the documents has words of its own."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(150) + 150 * (i >= 20_000)}" for _ in range(5))) for i in range(40_000)]
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for i in range(20)]
    index = next(decontaminate.indexes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))).value
    texts = [decontaminate.terms(decontaminate.words(t)) for _, t in docs + items]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts[: len(docs)]]), minlength=decontaminate.TERMS)
    idf = np.log((1 + len(docs)) / (1 + df)) + 1
    q = np.linalg.qr(np.random.default_rng(decontaminate.SEED).standard_normal((decontaminate.TERMS, decontaminate.RANK)))[0]
    for _ in range(2):
        q = np.linalg.qr(plain_power(texts, idf, q))[0]
    got = index.latent[: decontaminate.TERMS] / idf[:, None]
    assert np.abs(np.abs(np.linalg.svd(got.T @ q)[1]) - 1).max() < 1e-3  # the same space


def test_signs_part_words_as_the_pattern_says():
    """Letters and digits of all scripts stay, all other signs beyond ASCII and lone halves of pairs are blanks."""
    text = "".join(map(chr, range(0x80, 0x110000, 7))) + "ein—wort “zwei” \ud800ñandú\udfff ²x 中文。字 \U0001f600"
    assert decontaminate.without_signs(text) == "".join(decontaminate.SIGNS.sub(" ", c) for c in text)
    assert decontaminate.without_signs("ñandú") == "ñandú"
    got = decontaminate.words("a—b\ud800c _“ñ”_")
    assert got.tolist() == decontaminate.words("a b c ñ").tolist() and len(got) == 4


def test_many_short_texts_share_their_calls(spark):
    """The search takes short texts together; one by one, these took 104 calls each."""
    index = next(decontaminate.indexes(table(spark, "/root/testdata/sf0.001", "documents"), table(spark, SF, "benchmark"))).value
    rng = random.Random(7)
    pool = [w for p in index.windows for w in p]
    of = {int(decontaminate.words(x)[0]): x for r in table(spark, SF, "benchmark").collect() for x in r.text.split() if len(decontaminate.words(x)) == 1}
    texts = [" ".join(of.get(rng.choice(pool), "x") for _ in range(5)) for _ in range(3000)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    want = [index.search(t) for t in texts]
    sys.setprofile(count)
    try:
        got = list(index.search_each(texts))
    finally:
        sys.setprofile(None)
    assert got == want and calls < 25 * len(texts), calls / len(texts)


def test_a_round_of_the_fit_gathers_each_word_twice(monkeypatch):
    """Rare terms are not padded to whole runs: over half passages and over terms, a row each time a word occurs, and few more."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, decontaminate.TERMS, 2400) for _ in range(10)]
    idf, own = np.ones(decontaminate.TERMS), decontaminate.with_zeros(rng.standard_normal((decontaminate.TERMS, 3)))
    taken, take = 0, np.take

    def counted(table, at, *a, **b):
        nonlocal taken
        taken += len(at) if table.ndim == 2 else 0
        return take(table, at, *a, **b)

    monkeypatch.setattr(np, "take", counted)
    decontaminate.power(texts, idf, own)
    assert taken < 2.2 * sum(map(len, texts)), taken
