"""Personal data: base spans against the plain patterns, the random field against brute force, held-out lines, defined results."""

import random
import re
import time
from hashlib import sha256
from itertools import product

import numpy as np
import pytest

from poolstat.llm import pii
from poolstat.llm.common import table

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, f string, spans string, n_email int"
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def lucky(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(digits) <= 19 and lucky(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(pii.labelled(spark))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(2)
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect()]
    texts += ["".join(rng.choice(["@", ".", "-", "a", "Z", "7", "4", "+", " ", "%", "(", ")", "é", "١", "0.0.0.0", "255", "4111111111111111", "a@b.c", "\n"]) for _ in range(rng.randrange(60))) for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t
    began = time.time()
    for t in ("a" * 300_000 + " ", "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" + "(" * 300_000, "+1 " * 100_000, "1-" * 150_000):
        pii.base_spans(t)
    assert time.time() - began < 20


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    follow = rng.normal(size=(4, 4))
    scores = [rng.normal(size=(n, 4)) for n in [1, 2, 5, 3, 5, 1, 4, 6]]
    for got, s in zip(pii.decoded(scores, follow), scores):
        value = lambda y, s=s: sum(s[t, k] for t, k in enumerate(y)) + sum(follow[a, b] for a, b in zip(y, y[1:]))
        assert tuple(got) == max(product(range(4), repeat=len(s)), key=value)


def test_fit_is_at_the_likelihoods_top():
    """The gradient of the penalised likelihood, by differences over all labellings, is small at the fitted weights."""
    rows = [("call 7 now", "phone:5:6"), ("at 7 pm", ""), ("x 9@a.b y", "email:2:7")] * 3
    m = pii.fit(rows)
    made = []
    for text, spans in rows:
        words = pii.WORD.findall(text)
        feats = pii.chain_features(words, 0, len(words))
        gold = tuple(1 + pii.ORDER[spans.split(":")[0]] if spans and w in text[int(spans.split(":")[1]) :][: len(w)] and text.index(w) == int(spans.split(":")[1]) else 0 for w in words)
        made.append((feats, gold))

    def loss(weights, follow):
        out = pii.PENALTY / 2 * ((weights**2).sum() + (follow**2).sum())
        for feats, gold in made:
            s = np.array([sum(weights[m.names[f]] for f in w) for w in feats])
            value = lambda y, s=s: sum(s[t, k] for t, k in enumerate(y)) + sum(follow[a, b] for a, b in zip(y, y[1:]))
            out += np.log(sum(np.exp(value(y)) for y in product(range(5), repeat=len(s)))) - value(gold)
        return out

    best = loss(m.weights, m.follow)
    rng = np.random.default_rng(0)
    for _ in range(20):
        dw, df = rng.normal(size=m.weights.shape) * 0.05, rng.normal(size=m.follow.shape) * 0.05
        dw[-1] = 0
        assert loss(m.weights + dw, m.follow + df) > best


def test_scores_equal_the_features_sums(model):
    words = "write kim at mail dot example dot com or +1 (415) 555-0132, 4111 1111 1111 1111 and 10.0.0.1 now".split()
    for a, b in pii.chains(words):
        want = np.array([sum((model.weights[model.names[f]] for f in w if f in model.names), np.zeros(5)) for w in pii.chain_features(words, a, b)])
        assert np.allclose(model.scores(words, a, b, {}), want)


def test_held_out_lines(model):
    """Kinds of spans that no base pattern finds, in words that the labelled table has not; and clean lines left alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + x for x in "0123456789" if lucky(d + x))

    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    dirty = [lambda: f"({rng.randrange(200, 999)}) 555-{n(4)}", lambda: f"{word()} at {word()} dot {word()} dot com", lambda: f"{word()} [at] {word()} [dot] org",
             lambda: (lambda d: ".".join(d[i : i + 4] for i in range(0, 16, 4)))(card()), lambda: f"2001:db8:{n(4)}::{n(3)}:{n(4)}", lambda: f"0044 20 7946 {n(4)}"]
    clean = [lambda: n(10), lambda: f"{n(3)}.{n(2)}", lambda: f"20{n(2)}-1{rng.randrange(3)}-2{rng.randrange(9)}", lambda: f"{word()}={n(3)}", lambda: f"{n(1)} {n(2)} {n(1)}", lambda: f"{rng.randrange(1, 24)}:{rng.randrange(10, 60)}",
             lambda: next(d for _ in range(99) if not lucky(d := "7" + n(15))), lambda: f"#{n(5)}", lambda: f"@{word()}", lambda: f"{n(4)}{word()}{n(2)}"]
    line = lambda x: f"{word()} {word()} {word()} {x} {word()} {word()} {word()}"
    bad = [line(f()) for f in dirty for _ in range(50)]
    good = [line(f()) for f in clean for _ in range(50)]
    found = pii.found_in(bad + good, model, {})
    hits, false = sum(bool(m) for _, m in found[: len(bad)]), sum(bool(m) for _, m in found[len(bad) :])
    assert hits >= 0.9 * len(bad) and false <= 0.02 * len(good), (hits, len(bad), false, len(good))


def test_query_equals_a_plain_walk(spark, model):
    """The query's rows, document by document, with every chain decoded alone."""
    docs = table(spark, SF, "documents")
    for r in pii.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        base, mine, words = plain(r.text), [], [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", r.text)]
        for a, b in pii.chains([r.text[x:y] for x, y in words]):
            s = model.scores([r.text[x:y] for x, y in words], a, b, {})
            mine += pii.spans_of(pii.viterbi(s[None], np.array([b - a]), model.follow)[0], words[a:b], r.text)
        all_ = sorted(base + [m for m in mine if all(m[2] <= x or y <= m[0] for x, _, y in base)])
        told = lambda spans: ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == sha256(told(base).encode()).hexdigest() and r.spans == told(all_) and r.n_model == len(mine)


def test_odd_rows(spark):
    empty, card = sha256(b"").hexdigest(), "4111 1111 1111 1111"
    rows = [(1, None), (2, ""), (None, "me@x.org"), (2, ""), (5, "word " * 60_000 + card), (6, f"é {card} {card}"), (7, "1 " * 50_000)]
    got = pii.scan(spark.createDataFrame([(i, t, "a", "b", 3) for i, t in rows], DOC)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].spans == by[2].spans == by[7].spans == "" and by[1].base_sha256 == empty
    assert by[None].spans == "email:0:8" and by[None].base_sha256 == sha256(b"email:0:8").hexdigest() and by[None].n_email == 1
    assert by[5].spans == "card:300000:300019" and by[6].n_card == 0 and [r.spans for r in got if r.doc_id == 2] == ["", ""]
    assert pii.scan(spark.createDataFrame([], DOC)).collect() == []
    bare = pii.scan(spark.createDataFrame([(1, "me@x.org 0044 20 7946 0321")], "doc_id long, text string"), spark.createDataFrame([], "text string, spans string")).collect()[0]
    assert bare.spans == "email:0:8" and bare.n_model == 0
    text = pii.redacted(spark.createDataFrame([(1, f"to me@x.org, {card} or (415) 555-0177 now"), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in text} == {1: "to [email], [card] or [phone] now", 2: None}
