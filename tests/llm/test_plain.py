"""Toxicity, language and the draws against plain versions: every row recomputed without the operators' vectorised paths."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import zstandard

from poolstat.llm import language, sharding, toxicity
from poolstat.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_score(text, weights, bias):
    """Noisy-or of the sentences' sigmoids, sums over distinct features, sentence by sentence."""
    clean, worst = 1.0, (0.0, None)
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        feats = set()
        for word in re.findall(r"[^\W_]+", m[0].lower()):
            for key in [word] + ["^" + word[:n] for n in (4, 5, 6, 7) if len(word) >= n]:
                feats.add(zlib.crc32(key.encode()) % len(weights))
        z = sum(float(weights[f]) for f in feats)
        if z:
            p = 1 / (1 + math.exp(-min(30.0, z + bias)))
            clean *= 1 - min(p, 1 - 1e-9)
            worst = max(worst, (p, m.start()), key=lambda x: x[0])
    return 1 - clean, worst[1]


def test_toxicity_rows_equal_a_plain_scorer(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    weights, bias = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.op3(docs, labels).collect()}
    assert np.count_nonzero(weights) > 5
    for r in docs.collect():
        score, start = plain_score(r.text, weights, bias)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-5) and got[r.doc_id].worst_start == start
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_fit_equals_a_plain_one():
    """The fit's steps, number by number: the gradient is the noisy-or likelihood's, checked by differences."""
    rng = np.random.default_rng(4)
    docs = [([np.array(sorted(rng.choice(6, rng.integers(1, 4), replace=False))) for _ in range(rng.integers(1, 4))], int(rng.random() < 0.5)) for _ in range(30)]
    odds = rng.uniform(2, 4, 6)
    w, bias = [0.3 * x for x in odds], -2.0
    g2, gb2 = [1e-2] * 6, 1e-2
    order = np.random.default_rng(3)

    def loss(w, bias, sents, y):
        clean = math.prod(1 - min(1 / (1 + math.exp(-(sum(w[f] for f in s) + bias))), 1 - 1e-9) for s in sents)
        return -math.log(1 - clean) if y else -math.log(clean)

    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(docs)):
            sents, y = docs[k]
            z = [sum(w[f] for f in s) + bias for s in sents]
            p = [1 / (1 + math.exp(-v)) for v in z]
            clean = math.prod(1 - min(q, 1 - 1e-9) for q in p)
            grad = [q if not y else -q * clean / max(1 - clean, 1e-6) for q in p]
            eps = 1e-6
            by_difference = (loss(w, bias + eps, sents, y) - loss(w, bias - eps, sents, y)) / (2 * eps)
            assert sum(grad) == pytest.approx(by_difference, rel=1e-3, abs=1e-4)
            for s, g in zip(sents, grad):
                for f in s:
                    gi = g + 1e-3 * w[f]
                    g2[f] += gi * gi
                    w[f] -= 0.2 * gi / math.sqrt(g2[f])
                gb2 += g * g
                bias -= 0.05 * g / math.sqrt(gb2)
    got, b = toxicity.fit(docs, odds)
    assert np.allclose(got, np.maximum(w, 0), atol=1e-8) and b == pytest.approx(min(bias, -1.0), abs=1e-8)


def test_language_rows_equal_a_plain_compressor(spark):
    docs = table(spark, SF, "documents")
    dictionaries = language.learn(docs)
    got = {r.doc_id: r for r in language.op4(docs).collect()}
    for r in docs.collect():
        sizes = {}
        for lang, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data = r.text.lower().encode()
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
        if not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        best = min(sizes, key=lambda k: (sizes[k], k))
        second = min(v for k, v in sizes.items() if k != best)
        margin = (second - sizes[best]) / second
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(min(1, 5 * margin)) and got[r.doc_id].rejected == (margin < language.MARGIN)


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (1, 9, 5), (20, 3, 10), (40, 40, 30)])
def test_hypergeometric_draws_have_the_exact_probabilities(good, bad, draws):
    rng, n = random.Random(good * 100 + bad), 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    chi, cells = 0.0, 0
    for k in range(max(0, draws - bad), min(draws, good) + 1):
        want = n * float(Fraction(math.comb(good, k) * math.comb(bad, draws - k), math.comb(good + bad, draws)))
        if want >= 5:
            chi, cells = chi + (seen[k] - want) ** 2 / want, cells + 1
    assert set(seen) <= set(range(max(0, draws - bad), min(draws, good) + 1))
    assert chi < cells + 5 * math.sqrt(2 * cells) + 5


def test_split_counts_have_the_exact_probabilities():
    """Three blocks, three draws: each outcome of the multivariate law."""
    rng, n, counts = random.Random(9), 30_000, [2, 3, 4]
    seen = Counter(tuple(sharding.split_counts(rng, counts, 3)) for _ in range(n))
    for a in range(3):
        for b in range(4):
            if 0 <= (c := 3 - a - b) <= 3:
                want = n * math.comb(2, a) * math.comb(3, b) * math.comb(4, c) / math.comb(9, 3)
                assert abs(seen[a, b, c] - want) < 5 * math.sqrt(want) + 3
    assert all(sum(k) == 3 for k in seen)
