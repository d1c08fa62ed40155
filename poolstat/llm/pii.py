"""Personal data: a linear-chain conditional random field over word shapes, beside the base patterns.

Words are runs without white space. A word that holds a digit, `@` or the word `dot` is a signal; words within REACH of a
signal form chains, all other words carry no label by definition, so chains are all that is decoded. A word's label (none or
a kind) is scored by its own and its neighbours' shapes, checks of its digits and the words of the labelled table; the
weights maximise the penalised likelihood of that table's chains (forward-backward, full batches, no randomness). Tasks
decode all chains of an Arrow batch by Viterbi in padded numpy arrays. Spans that touch no base span are added to these.

The labelled table has `text` and `spans` (kind:start:end, comma-joined); at most MAX_LABELLED rows by hash order are used,
which come to the driver; every other part works document by document, without shuffles.

Defined results: null texts are empty, have no spans and the digest of the empty text; texts of any length are read whole;
equal starts are ordered by kind as listed; repeated rows are read alike; an empty table gives no rows; other columns are
ignored; with an empty labelled table only base spans are found.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: words on each side of a signal that a chain takes in; words on each side that a word's features look at; rows of the labelled table; chain cells decoded at once; words remembered by a task
REACH, CONTEXT, MAX_LABELLED, CELLS, MEMO = 3, 2, 5000, 1 << 17, 100_000
STEPS, RATE, PENALTY = 250, 0.1, 0.02
#: Kinds in order.
KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The base patterns, written so that no start is tried twice.
LOCAL_END, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP, CARD, PHONE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), re.compile(r"[0-9](?:[\x20-]?[0-9])++"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, SIGNAL = re.compile(r"[0-9]"), re.compile(r"[0-9@]|^[\[({<]?(?:dot|DOT)[\])}>]?$")
DOT = re.compile(r"(?<![^\x20\x09-\x0D])[\[({<]?(?:dot|DOT)[\])}>]?(?![^\x20\x09-\x0D])")
SHAPE = re.compile(r"[0-9]+|[A-Z]+|[^\W\d_]+")
SIX = re.compile(r"[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}")
GROUP = re.compile(r"[0-9]+(?:[-./][0-9]+)*[.,;:]?")

#: The labelled table: [[kind ...]] marks a span.
LABELLED = """
Write to [[email jane.doe@mail.example.org]] before noon
Contact: [[email ops-team@corp.example.com]], thanks
Reach me <[[email m.rossi77@posta.example.it]]> or later
Mail [[email a_b%c@host-9.example.net]] and wait
sender [[email lena@uni.example.edu]] wrote this
write [[email jane [at] mail [dot] org]] for keys
ask [[email bob (at) site (dot) example (dot) com]] about it
reach [[email kim at mail dot example dot com]] today
it is [[email paul.w at host dot net]] if needed
send [[email nora dot may at web dot example dot org]] a note
mail [[email j.smith@host [dot] example [dot] com]] please
or [[email info@shop dot example dot com]] instead
The dot on the map marks the spot
a red dot at the end of the line
put a dot after each number 4 at most
we met at 7 and left at 9 sharp
follow @jane_doe and @team9 on the site
the @media rule and @2x images load
meet @ 5 pm near gate 12
price is 3 @ 20 each
server [[ip 10.20.30.40]] answered
from [[ip 192.168.7.254]], port 80
host [[ip 8.8.4.4]] is up
ping [[ip 172.16.254.1]] twice
address [[ip 2001:db8:85a3:0:0:8a2e:370:7334]] on the link
route to [[ip fe80::1ff:fe23:4567:890a]] dropped
via [[ip 2001:db8::ff00:42:8329]] again
version 10.20.300.40 is out
build 1.2.3 and 4.5.6 differ
release 2.0.1.5000 came late
section 3.1. and section 3.2. follow
at 12:30:45 the run ended
time 10:15:30:22 was logged
card [[card 4111 1111 1111 1111]] was charged
visa [[card 5555555555554444]] expires soon
pay by [[card 4012-8888-8888-1881]] now
number [[card 378282246310005]] on file
use [[card 4242.4242.4242.4242]] to test
charge [[card 6011/1111/1111/1117]] once
the card [[card 5105 1051 0510 5100]] ends today
old card [[card 30569309025904]] is void
order 4111111111111112 was sent
parcel 9807915762804490 is late
code 1234567890123456 again
item 8001234567890 in stock
row 81035767239482 of the log
id 3417 9022 5561 8830 of the batch
key 4111.1111.1111.1112 fails
serial 0810992847249404 and more
call [[phone +1 (415) 555-0132]] today
ring [[phone +44 20 7946 0958]] after six
tel [[phone +49 30 1234567]] or come by
phone [[phone (212) 555-0187]] works
dial [[phone (646) 555-0121]] first
call [[phone 415-555-0199]] again
at [[phone 303.555.0143]] most days
mobile [[phone 0044 20 7946 0321]] only
fax [[phone 0049 89 7654321]] too
text [[phone 917-555-0106]], then wait
reach [[phone +33 1 70 36 39 50]] soon
number [[phone +1 202 555 0175]] is new
room 415-555 is on the left
part 415-555-01990 was sold
case 2023-11-27 is closed
on 2024-02-29 at 10 the
from 12-05-2021 to 14-06-2022 we
date 27.11.2023 and 28.11.2023 hold
between 1914 and 1918 it was
about 3,000 people and 12,500 more
it cost 19.99 or 1.299,00 in all
pages 120-135 and 140-152 cover it
isbn 978-3-16-148410-0 is listed
zip 94105-1234 in the file
item 555-7713 of the list
score 3-0 and 2-1 at home
chapter 7 verse 12 line 9
9 8 7 6 5 4 3 2 1 0
10 20 30 40 50 60 70 80
47369625730995 was the count
23904 and 9812 and 77
lot 982347612 or lot 98234761
number 2357111317 comes next
sum of 1234567 and 7654321
ratio 16:9 or 4:3 on screen
key = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in the file
hash 9f86d081884c7d659a2feaa0c55ad015 matched
token = "a94f3c0e77" was used
sha 3b18e512dba79e4c8300dd08aeb37f8e728b8dad is old
| 12 | 450 | 33 | 1200 |
[1] see [2] and [13]
$12.50 and 45% of 300 kg
e4 d5 2 nf3 nc6 3 bb5
mp3 and h264 in 4k at 60fps
enea [[ip 97.51.17.173]] ueadoos raie
oner [[ip 129.38.82.176]] esnd and
menteez | [[ip 161.17.88.162]] | quedoar
thor of thon [[ip 96.153.118.61]] the bleer.
eitge ertz, [[ip 233.254.104.120]] ergebe enge
Lyon, [[ip 43.21.141.162]] from
[[ip 56.187.231.175]] Keit in lich
a la [[ip 83.229.25.121]] esat
oben [[ip 190.137.223.4]] unter
et puis [[ip 5.44.3.209]].
enea ti 97.51.317.173 ueadoos
oner of 629.38.82.176 esnd
stin [[card 4000056655665556]] ththinnt
shou | [[card 6011000990139424]] | erea
erle [[card 3530111333300000]] thing
nd of [[card 5200828282828210]].
la [[card 4000 0025 0000 3155]] ciones
stin 4952935900253053 ththinnt
shou | 4795522935961214 | erea
erle 7536784127813057 thing
la 4000 0025 0000 3156 ciones
nd of 8123456701234567.
thonble [[phone +1 (017) 555-7713]] rethsh
onhaat | [[phone +1 (974) 555-3436]] | enon
tre [[phone +61 2 5550 1234]] oile
des [[phone (831) 555-0164]] eree
la [[phone 0033 1 70 36 12 34]] ciones
thon [[phone 0044 20 7946 0958]] erle
oben [[phone 0049 30 1234 5678]] unter
enea ti [[ip 2001:db8:85a3::8a2e:370:7334]] ueadoos
oner [[ip fe80:0:0:0:1ff:fe23:4567:890a]] esnd and
la [[ip 2001:db8:1::42]].
tre 12:34:56 oile
nd of 1:2:3:4 thing
tzzu [[email und.34@mail7.example.com]] geiever
of [[email oi78@mail2.example.com]], erst
B2B and 3D on day 1
"""
MARK = re.compile(r"\[\[(\w+) (.*?)\]\](?!\])")


def labelled(spark: SparkSession) -> DataFrame:
    """The default labelled table: text, spans."""
    rows = []
    for line in LABELLED.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in MARK.finditer(line):
            text += line[at : m.start()]
            spans.append(f"{m[1]}:{len(text)}:{len(text) + len(m[2])}")
            text, at = text + m[2], m.end()
        rows.append((text + line[at:], ",".join(spans)))
    return spark.createDataFrame(rows, "text string, spans string")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns' matches, ordered."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def shape(word: str) -> str:
    """Letters fall together by case; digits keep their number up to 4, and beyond only its range."""

    def one(m: re.Match) -> str:
        run = m[0]
        if not run[0].isascii() or not run[0].isdigit():
            return "A" if "A" <= run[0] <= "Z" else "a"
        n = len(run)
        return f"d{n if n <= 4 else 5 if n < 12 else 'L' if n <= 19 else 'X'}"

    return SHAPE.sub(one, word[:200])


def local_features(word: str) -> list[str]:
    """What one word tells: its shape, its ends, its digits, the checks it passes, and itself if it is a plain word."""
    own, n = shape(word), len(digits := "".join(DIGIT.findall(word)))
    out = ["bias", f"s={own}", f"p={own[:4]}", f"q={own[-4:]}", f"n={n if n < 5 else '5-8' if n < 9 else '9-11' if n < 12 else '12-19' if n < 20 else '20'}"]
    core = word.strip(".,;:!?\"'<>|")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("quad")
    if SIX.fullmatch(core) and any(c in "abcdefABCDEF" or c == ":" for c in core) and (core.count(":") == 7 or "::" in core):
        out.append("six")
    if "@" in core[1:-1]:
        out.append("mail" if "." in core.split("@")[-1] else "half")
    if core.startswith("00") and core.isdigit() and n <= 5:
        out.append("abroad")
    if 12 <= n <= 19:
        out.append("luhn" if luhn(digits) else "unlucky")
    plain = core.strip("[](){}").lower()
    if plain.isalpha() and len(plain) <= 12:
        out.append(f"w={plain}")
    return out


def group_features(words: list[str]) -> list[list[str]]:
    """Of each word: what the run of digit groups that it stands in comes to."""
    out, k = [[] for _ in words], 0
    while k < len(words):
        end = k
        while end < len(words) and GROUP.fullmatch(words[end]):
            end += 1
        if end - k > 1:
            digits = "".join("".join(DIGIT.findall(w)) for w in words[k:end])
            kind = ("run luhn" if luhn(digits) else "run unlucky") if 12 <= len(digits) <= 19 else "run short" if len(digits) < 12 else "run long"
            out[k:end] = [[kind]] * (end - k)
        k = max(end, k + 1)
    return out


def chains(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs of words within REACH of a signal."""
    out: list[list[int]] = []
    for i, w in enumerate(words):
        if SIGNAL.search(w):
            a, b = max(0, i - REACH), min(len(words), i + REACH + 1)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def chain_features(words: list[str], a: int, b: int) -> list[list[str]]:
    """Names of the features of words[a:b], neighbours' ones with their distance."""
    lo, hi = max(0, a - CONTEXT), min(len(words), b + CONTEXT)
    own, runs = [local_features(w) for w in words[lo:hi]], group_features(words[a:b])
    return [[f"{d}|{f}" for d in range(-CONTEXT, CONTEXT + 1) if 0 <= i + d - lo < hi - lo for f in own[i + d - lo]] + runs[i - a] for i in range(a, b)]


class Model:
    """Weights of the features by label (rows; the last row is zero), and of a label after another."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, follow: np.ndarray):
        self.names, self.weights, self.follow = names, weights, follow

    def scores(self, words: list[str], a: int, b: int, memo: dict) -> np.ndarray:
        """Scores of words[a:b] by label; a word's own part is remembered."""
        lo, hi = max(0, a - CONTEXT), min(len(words), b + CONTEXT)
        own, labels = [], self.weights.shape[1]
        for w in words[lo:hi]:
            got = memo.get(w)
            if got is None:
                feats = local_features(w)
                got = np.zeros((2 * CONTEXT + 1, labels))
                for d in range(-CONTEXT, CONTEXT + 1):
                    at = [k for f in feats if (k := self.names.get(f"{d}|{f}")) is not None]
                    got[d + CONTEXT] = self.weights[at].sum(0)
                if len(memo) < MEMO:
                    memo[w] = got
            own.append(got)
        all_ = np.stack(own)
        out = np.zeros((b - a, labels))
        for d in range(-CONTEXT, CONTEXT + 1):
            x, y = max(lo, a + d), min(hi, b + d)
            if x < y:
                out[x - d - a : y - d - a] += all_[x - lo : y - lo, d + CONTEXT]
        for i, feats in enumerate(group_features(words[a:b])):
            for f in feats:
                if f in self.names:
                    out[i] += self.weights[self.names[f]]
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Best labels of padded chains (chain, place, label); places past a chain's length get 0."""
    n, most, labels = scores.shape
    best, back = scores[:, 0], np.zeros((n, most, labels), "int8")
    for t in range(1, most):
        ways = best[:, :, None] + follow[None]
        back[:, t] = ways.argmax(1)
        best = np.where((t < lengths)[:, None], ways.max(1) + scores[:, t], best)
    out = np.zeros((n, most), "int8")
    at, rows = best.argmax(1), np.arange(n)
    for t in range(most - 1, -1, -1):
        inside = t < lengths
        out[:, t] = np.where(inside, at, 0)
        at = np.where(inside, back[rows, t, at], at) if t else at
    return out


def decoded(scores: list[np.ndarray], follow: np.ndarray) -> list[np.ndarray]:
    """Labels of every chain; chains of like length go together, CELLS places at a time."""
    out: list[np.ndarray] = [np.zeros(0, "int8")] * len(scores)
    order, k = sorted(range(len(scores)), key=lambda i: len(scores[i])), 0
    while k < len(order):
        end = k + 1
        while end < len(order) and (end + 1 - k) * len(scores[order[end]]) <= CELLS:
            end += 1
        mine = order[k:end]
        lengths = np.array([len(scores[i]) for i in mine])
        pad = np.zeros((len(mine), lengths[-1], follow.shape[0]))
        for row, i in enumerate(mine):
            pad[row, : lengths[row]] = scores[i]
        for row, (i, labels) in enumerate(zip(mine, viterbi(pad, lengths, follow))):
            out[i] = labels[: lengths[row]]
        k = end
    return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """Penalised maximum likelihood over the chains of (text, spans), by Adam over full batches."""
    feats, gold = [], []
    for text, spans in rows:
        at = [(int(a), int(b), 1 + ORDER[k]) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s)]
        found = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        words = [text[a:b] for a, b in found]
        for a, b in chains(words):
            feats.append(chain_features(words, a, b))
            gold.append([next((k for x, y, k in at if x < end and start < y), 0) for start, end in found[a:b]])
    labels, names = 1 + len(KINDS), {f: i for i, f in enumerate(sorted({f for c in feats for w in c for f in w}))}
    weights, follow = np.zeros((len(names) + 1, labels)), np.zeros((labels, labels))
    if not feats:
        return Model(names, weights, follow)
    n, most, wide = len(feats), max(map(len, feats)), max(len(w) for c in feats for w in c)
    ids, y, lengths = np.full((n, most, wide), len(names)), np.zeros((n, most), int), np.array([len(c) for c in feats])
    for i, c in enumerate(feats):
        y[i, : len(c)] = gold[i]
        for t, w in enumerate(c):
            ids[i, t, : len(w)] = [names[f] for f in w]
    inside = np.arange(most)[None] < lengths[:, None]
    hit = np.eye(labels)[y] * inside[..., None]
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(follow), np.zeros_like(follow)]
    top = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for step in range(1, STEPS + 1):
        s = weights[ids].sum(2)
        ahead, behind = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, most):
            ahead[:, t] = np.where(inside[:, t, None], top(ahead[:, t - 1, :, None] + follow[None], 1) + s[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(inside[:, t + 1, None], top(follow[None] + (s[:, t + 1] + behind[:, t + 1])[:, None], 2), 0)
        whole = top(ahead[:, -1], 1)
        share = np.exp(ahead + behind - whole[:, None, None]) * inside[..., None]
        gw, gf = PENALTY * weights, PENALTY * follow
        np.add.at(gw, ids, np.broadcast_to((share - hit)[:, :, None], (*ids.shape, labels)))
        for t in range(1, most):
            both = np.exp(ahead[:, t - 1, :, None] + follow[None] + (s[:, t] + behind[:, t])[:, None] - whole[:, None, None]) * inside[:, t, None, None]
            gf = gf + both.sum(0) - np.einsum("na,nb->ab", hit[:, t - 1] * inside[:, t, None], hit[:, t])
        gw[-1] = 0
        for x, g, a, b in ((weights, gw, 0, 1), (follow, gf, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            x -= RATE * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    return Model(names, weights, follow)


def learn(table: DataFrame) -> Model:
    rows = table.select("text", "spans").orderBy(F.xxhash64("text", "spans"), "text", "spans").limit(MAX_LABELLED).collect()
    return fit([(r.text, r.spans) for r in rows if r.text])


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the punctuation and brackets around it."""
    while a < b and (text[a] in "\"'<>[{|,;:" or text[a] == "(" and ")" not in text[a:b]):
        a += 1
    while a < b and (text[b - 1] in ".,;:!?\"'<>{|" or text[b - 1] == ")" and "(" not in text[a:b] or text[b - 1] in "]}" and text[b - 1] not in text[a : b - 1] and "[" not in text[a:b]):
        b -= 1
    return a, b


def sound(kind: int, text: str) -> bool:
    """The exact check of a span that the model found."""
    digits = "".join(DIGIT.findall(text))
    if kind == 0:
        return "@" in text or bool(DOT.search(text))
    if kind == 1:
        return bool({"quad", "six"} & set(local_features(text)))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def spans_of(labels: np.ndarray, words: list[tuple[int, int]], text: str):
    """(start, place of the kind, end) of each run of a label; a word that is sound alone is a span of its own, where its run is not."""
    k = 0
    while k < len(labels):
        end = k + 1
        while end < len(labels) and labels[end] == labels[k]:
            end += 1
        if kind := int(labels[k]):
            x, y = trimmed(text, words[k][0], words[end - 1][1])
            whole = x < y and sound(kind - 1, text[x:y])
            for x, y in [(x, y)] if whole else [trimmed(text, *w) for w in words[k:end]]:
                if whole or (x < y and kind - 1 in (1, 2) and sound(kind - 1, text[x:y])):
                    yield x, kind - 1, y
        k = end


def found_in(texts: list[str | None], model: Model, memo: dict) -> list[tuple[list, list]]:
    """Of each text: base spans and the model's spans, as (start, place of the kind, end)."""
    base = [base_spans(t) if t else [] for t in texts]
    where, scores, places = [], [], {}
    for i, text in enumerate(texts):
        if text and ("@" in text or DIGIT.search(text) or DOT.search(text)):
            words = WORD.findall(text)
            own = chains(words)
            for a, b in own:
                where.append((i, a, b))
                scores.append(model.scores(words, a, b, memo))
            if own:
                places[i] = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out: list[tuple[list, list]] = [(b, []) for b in base]
    for (i, a, _), labels in zip(where, decoded(scores, model.follow)):
        if labels.any():
            out[i][1].extend(spans_of(labels, places[i][a : a + len(labels)], texts[i]))
    return out


def with_base(base: list[tuple], mine: list[tuple]) -> list[tuple]:
    """Base spans, and those of the model's that touch none."""
    out, k, reach = list(base), 0, 0
    for a, kind, b in sorted(mine):
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        # every base span that starts before b has been seen; the last ends decide only where they lie after a
        if reach <= a:
            out.append((a, kind, b))
    return sorted(out)


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all), n_model (spans the model found), n_added (those no base span touches)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(labelled(spark) if table is None else table))  # bounded by MAX_LABELLED
    columns = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_model", "n_added"]

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long, n_added long")
    def found(texts: pd.Series) -> pd.DataFrame:
        out, memo = [], {}
        for base, mine in found_in(list(texts), shared.value, memo):
            all_ = with_base(base, mine)
            counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
            out.append((*counts, sha256(told(base).encode()).hexdigest(), told(all_), len(mine), len(all_) - len(base)))
        return pd.DataFrame(out, columns=columns)

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def redacted(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets (overlapping spans as one, by the first kind)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(labelled(spark) if table is None else table))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out, memo, rows = [], {}, list(texts)
        for text, (base, mine) in zip(rows, found_in(rows, shared.value, memo)):
            made, at = [], 0
            for a, kind, b in with_base(base, mine):
                if a >= at:
                    made += [text[at:a], f"[{KINDS[kind]}]"]
                at = max(at, b)
            out.append(text if text is None else "".join(made) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", clean("text").alias("text"))
