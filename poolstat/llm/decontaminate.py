"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages (PASSAGE words, half overlapping) are projected on a basis from a distributed randomised SVD, and every
passage of a document is compared with every benchmark passage by cosine. A pair at LATENT or more is a candidate by
itself, so a paraphrase is found whose rare words were all replaced; for that the item's passage must be half a passage
long. A pair at COSINE or more is one if it passes the answer check (half of the item's rarest words must occur); the
check's counts come from an inverted index of these words. A longest common subsequence over words decides. Idf, basis and
checks cover all documents, each text whole, and the basis all items too; texts are cut into terms once, the two rounds of
the fit read these.
Items are searched ITEMS at a time, each round over all documents.

Defined results: null and wordless texts and items match nothing; a row of documents is reported once per item_id, with
its best passage (the earliest on ties); rows with null ids are judged and reported alike; an empty benchmark or an
empty table gives no rows; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .shingling import word_hashes, word_spans

PASSAGE, TERMS, RANK, SEED = 48, 1 << 13, 96, 5
COSINE, LATENT, LCS, ANSWERS, ITEMS = 0.3, 0.65, 0.7, 4, 20_000
#: pairs of a text that are compared at once; bits of a set of words
PAIRS, MARKS = 1 << 22, 512
#: stands in the column of terms where a row holds a text
TEXT = -2
#: characters of texts that are hashed and projected together
TOGETHER = 1 << 16
HALF, SIEVE = PASSAGE // 2, (1 << 20) - 1
#: half passages of a text that are projected at once; half passages that a round of the fit adds up at once, rows of a sum that are
#: added at once, and how many rows make a run
CHUNK, BATCH, ROWS, RUN = 32, 10_000, 2048, 16
#: all that is neither an ASCII letter or digit nor beyond ASCII parts words; other signs beyond ASCII are blanked before
APART = np.array([not chr(c).isalnum() if c < 128 else False for c in range(256)])
SIGNS = re.compile(r"[^\w\x00-\x7f]+")
RESULT = "doc_id long, item_id long, overlap double, cosine double, at_word int"


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters and digits) of a text."""
    return words_each([text])[0]


@cache
def signs() -> np.ndarray:
    """For each code point whether it is one of SIGNS."""
    out = np.zeros(0x110000, dtype=bool)
    for run in SIGNS.finditer("".join(map(chr, range(0x110000)))):
        out[run.start() : run.end()] = True
    return out


def without_signs(text: str) -> str:
    """The text with a blank for each of SIGNS."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    hit = np.take(signs(), points)
    return np.where(hit, np.uint32(32), points).tobytes().decode("utf-32-le") if hit.any() else text


def words_each(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The words of each text; texts are hashed together."""
    parts = []
    for text in texts:
        low = (text or "").lower()
        parts.append((low if low.isascii() else without_signs(low)).encode("utf-8"))
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    starts, ends = word_spans(data, APART)
    begins = np.cumsum([len(x) + 1 for x in parts[:-1]], dtype=np.int64)
    return np.split(word_hashes(data, starts, ends), np.searchsorted(starts, begins))


def some(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in lists of about TOGETHER characters; a longer one is a list by itself."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def terms(w: np.ndarray) -> np.ndarray:
    return (w % np.uint64(TERMS)).astype(np.int64)


def passage_starts(n: int) -> range:
    """Starts of the windows of a text of n words, each half a passage after the one before; a short text is one window."""
    return range(0, max(1, n - HALF), HALF) if n else range(0)


def marks(w: np.ndarray) -> np.ndarray:
    """One bit of MARKS for each word."""
    out = np.zeros((len(w), MARKS // 64), dtype=np.uint64)
    out[np.arange(len(w)), ((w >> np.uint64(6)) % np.uint64(MARKS // 64)).astype(np.int64)] = np.uint64(1) << (w & np.uint64(63))
    return out


class Texts:
    """Words of some texts that have any, one text after the other; their passages are numbered through."""

    def __init__(self, ws: list[np.ndarray]):
        self.words, self.sizes = np.concatenate(ws), np.array([len(w) for w in ws])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.halves = -(-self.sizes // HALF)
        #: passages of a text, and the number of its first
        self.many = np.maximum(1, self.halves - 1)
        self.first = np.cumsum(self.many) - self.many

    def marks(self) -> np.ndarray:
        """For each passage p the marks of the halves p - 1 .. p + 2 of its text, together."""
        room = self.halves + 2  # two empty halves behind each text, one before the first
        start = np.cumsum(room) - room + 1
        hit = np.zeros((room.sum() + 1) * MARKS, dtype=bool)
        at = np.arange(len(self.words)) - np.repeat(self.begins, self.sizes)
        hit[(np.repeat(start, self.sizes) + at // HALF) * MARKS + (self.words & np.uint64(MARKS - 1)).astype(np.int64)] = True
        own = np.packbits(hit, bitorder="little").view("<u8").reshape(-1, MARKS // 64)
        p = np.arange(self.many.sum()) + np.repeat(start - self.first, self.many)
        return own[p - 1] | own[p] | own[p + 1] | own[p + 2]


def lcs(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, bit-parallel over the words of a."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if w in masks:
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def document_terms(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """The terms of every text (as `cut` writes them), the frequency of each over the half passages of all documents, and their number."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TERMS, dtype=np.int64), 0

        def take(held: list[np.ndarray]) -> int:
            at = np.concatenate([np.arange(len(t)) // HALF + k for t, k in zip(held, np.cumsum([0] + [-(-len(t) // HALF) for t in held]))])
            key = at * TERMS + np.concatenate(held)
            key = np.sort(key.astype(np.int32) if at[-1] < 1 << 17 else key)
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            df[:] += np.bincount(key % TERMS, minlength=TERMS)
            return int(at[-1]) + 1

        for part in parts:
            held, size, every = [], 0, []
            for w in (w for texts in some(part["text"]) for w in words_each(texts)):
                t = terms(w)
                if len(t):
                    held.append(t)
                    every.append(t.astype("<u2").tobytes())
                    size += len(t)
                if size > 1 << 18:
                    n += take(held)
                    held, size = [], 0
            if held:
                n += take(held)
            yield pd.DataFrame({"term": TEXT, "n": 1, "terms": every})
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[hit, -1], "n": np.r_[df[hit], n], "terms": None})

    step = written(docs.select("text").mapInPandas(count, "term long, n long, terms binary"))
    rows = dict(step.where(F.col("term") != TEXT).groupBy("term").agg(F.sum("n")).collect())  # TERMS + 1 rows at most
    n = rows.pop(-1, 0)
    out = np.zeros(TERMS)
    out[list(rows)] = list(rows.values())
    return step.where(F.col("term") == TEXT).select("terms"), out, n


def cut(texts: DataFrame) -> DataFrame:
    """terms: of each text with words, two bytes a word."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"terms": [t.astype("<u2").tobytes() for t in (terms(w) for texts in some(part["text"]) for w in words_each(texts)) if len(t)]})

    return written(texts.select("text").mapInPandas(each, "terms binary"))


def row_sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row of `rows`, the sum of the rows of `table` that it names."""
    out = np.empty((len(rows), table.shape[1]), dtype=table.dtype)
    for at in range(0, len(rows), ROWS):
        part = rows[at : at + ROWS].T.astype(np.intp, order="C")
        own, one = out[at : at + ROWS], np.empty((part.shape[1], table.shape[1]), dtype=table.dtype)
        np.take(table, part[0], axis=0, out=own, mode="clip")
        for k in range(1, len(part)):
            own += np.take(table, part[k], axis=0, out=one, mode="clip")
    return out


def run_sums(table: np.ndarray, at: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the rows `at` of `table` over consecutive runs of `times` rows: RUN rows at once, the longest first, and their sums again."""
    while True:
        many = -(-times // RUN)
        last = np.cumsum(many) - 1
        length = np.full(last[-1] + 1, RUN)
        length[last] -= many * RUN - times
        start = np.cumsum(length) - length
        order = np.argsort((RUN - length).astype(np.uint8), kind="stable")
        out = np.empty((len(length), table.shape[1]), dtype=table.dtype)
        for first in range(0, len(order), ROWS):
            run = order[first : first + ROWS]
            begin, long = start[run], length[run]
            own = np.take(table, at[begin], axis=0, mode="clip")
            one = np.empty_like(own)
            for k in range(1, int(long[0])):
                n = int(np.count_nonzero(long > k))
                own[:n] += np.take(table, at[begin[:n] + k], axis=0, out=one[:n], mode="clip")
            out[run] = own
        if len(out) == len(times):
            return out
        table, at, times = out, np.arange(len(out)), many


def pieces(t: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text of BATCH passages at most; each passage is whole in one of them."""
    n = len(passage_starts(len(t)))
    return (t[at * HALF : (min(at + BATCH, n) + 1) * HALF] for at in range(0, n, BATCH))


def power(texts: list[np.ndarray], idf: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms that occur in the passages A of some texts, and their rows of A'(AQ), without the factor idf of the row; own: idf times Q, and a row of zeros."""
    sizes, t = np.array([len(x) for x in texts]), np.concatenate(texts).astype(np.int64)
    halves = -(-sizes // HALF)
    ends = np.cumsum(halves + 1)  # an empty half stands behind each text
    at = np.arange(len(t)) + np.repeat((ends - halves - 1) * HALF - (np.cumsum(sizes) - sizes), sizes)
    rows = np.full((ends[-1], HALF), TERMS, dtype=np.int32)
    rows.ravel()[at] = t
    # passage p takes in the halves p and p + 1; behind a text's last one is none
    passage = np.ones(ends[-1], dtype=bool)
    passage[ends - 1] = False
    passage[(ends - 2)[halves > 1]] = False
    # length of a passage: a word's k-th time adds 2k - 1 times its idf squared, which makes tf squared together
    once = np.append(idf * idf, 0.0)
    squared = np.take(once, rows).sum(axis=1)
    squared[:-1] += squared[1:].copy()
    word = np.sort(np.concatenate([rows[:-1], rows[1:]], axis=1), axis=1)
    same = np.zeros(word.shape, dtype=bool)
    same[:, 1:] = (word[:, 1:] == word[:, :-1]) & (word[:, 1:] < TERMS)
    again = np.flatnonzero(same)
    k = np.arange(len(again))
    first = np.diff(again, prepend=-1) != 1
    first[:1] = True
    k -= np.maximum.accumulate(np.where(first, k, 0))
    squared[:-1] += np.bincount(again // (2 * HALF), weights=2 * (k + 1) * once[word.ravel()[again]], minlength=len(word))
    weight = np.zeros(ends[-1], dtype="float32")
    weight[passage] = 1 / squared[passage]
    both = row_sums(own, rows)
    both[:-1] += both[1:]
    both *= weight[:, None]
    both[1:] += both[:-1]
    order = np.argsort(t.astype(np.uint16), kind="stable")
    times = np.bincount(t, minlength=TERMS)
    word = np.flatnonzero(times)
    return word, run_sums(both, at[order] // HALF, times[word])


def basis(texts: DataFrame, idf: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Randomised SVD: the leading right singular vectors (TERMS x RANK) of the TF-IDF passages of `texts` (terms, as `cut` writes them).

    Each partition adds up its part of A'(AQ), TERMS x RANK numbers; Spark sums the parts.
    """
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((TERMS, RANK)))[0]
    names = [f"z{k}" for k in range(RANK)]
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((idf, with_zeros(idf[:, None] * q)))

        def add(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            (idf, own), z = shared.value, np.zeros((TERMS, RANK))

            def take(held: list[np.ndarray]):
                word, sums = power(held, idf, own)
                z[word] += sums * idf[word, None]

            held, size = [], 0
            for part in parts:
                for raw in part["terms"]:
                    for t in pieces(np.frombuffer(raw, dtype="<u2")):
                        held.append(t)
                        size += len(t)
                        if size >= BATCH * HALF:
                            take(held)
                            held, size = [], 0
            if held:
                take(held)
            hit = np.flatnonzero(np.abs(z).sum(axis=1))
            yield pd.DataFrame(np.column_stack([hit, z[hit]]), columns=["term", *names])

        summed = texts.mapInPandas(add, ", ".join(f"{c} double" for c in ["term", *names])).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
        z = np.zeros((TERMS, RANK))
        for r in summed.collect():  # TERMS rows of RANK numbers at most
            z[int(r[0])] = r[1:]
        q = np.linalg.qr(z)[0]
    return q


def with_zeros(table: np.ndarray) -> np.ndarray:
    """In single precision, with a row of zeros behind it, which stands for no word."""
    return np.concatenate([table, np.zeros((1, table.shape[1]))]).astype("float32")


class Index:
    """Windows of up to ITEMS items: latent vectors, words, and an inverted index of their rarest words."""

    def __init__(self, items: list[tuple], idf: np.ndarray, latent: np.ndarray):
        self.latent = latent  # idf times the basis, with_zeros: a passage's vector is the sum over its words
        self.ids, self.windows, self.bags, self.rare = [], [], [], []
        for item, text in items:
            w = words(text)
            for at in passage_starts(len(w)):
                p = w[at : at + PASSAGE]
                if len(p) >= 5 or len(p) == len(w):
                    self.ids.append(item)
                    self.windows.append(p.tolist())
                    self.bags.append(set(p.tolist()))
                    rarest = sorted(self.bags[-1], key=lambda h: (-idf[h % TERMS], h))
                    self.rare.append(set(rarest[:ANSWERS]))
        if not self.windows:
            return
        self.target = np.stack([self.project(np.array(p, dtype=np.uint64)) for p in self.windows])
        self.long = np.flatnonzero([len(p) >= HALF for p in self.windows])
        self.far = self.target[self.long].T.copy()
        self.marks = np.stack([np.bitwise_or.reduce(marks(np.array(p, dtype=np.uint64)), axis=0) for p in self.windows])
        size = np.array([len(b) for b in self.bags])
        # words that share a bit count once: at least so many bits must be there for LCS of the words to be
        self.least = np.ceil(LCS * size) - (size - np.bitwise_count(self.marks).sum(axis=1))
        self.need = np.array([-(-len(r) // 2) for r in self.rare])
        pairs = np.array([(h, j) for j, r in enumerate(self.rare) for h in r], dtype=[("h", "u8"), ("j", "i8")])
        pairs.sort(order="h")
        self.keys, first, self.times = np.unique(pairs["h"], return_index=True, return_counts=True)
        self.first, self.holds = first, pairs["j"]
        self.mask = np.uint64(min(SIEVE, (1 << (64 * len(self.keys)).bit_length()) - 1))  # a small sieve stays in the cache
        self.sieve = np.zeros(int(self.mask) + 1, dtype=bool)
        self.sieve[(self.keys & self.mask).astype(np.int64)] = True

    def project(self, p: np.ndarray) -> np.ndarray:
        v = self.latent[terms(p)].sum(axis=0)
        return v / (np.linalg.norm(v) or 1.0)

    def promising(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(passage, window) pairs whose surroundings hold enough of the window's rare words, repeats counted."""
        w = texts.words
        at = np.flatnonzero(self.sieve[(w & self.mask).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, w[at]), len(self.keys) - 1)
        own = self.keys[k] == w[at]
        at, k = at[own], k[own]
        if not len(at):
            return at, at
        # passage p looks at halves p - 1 .. p + 2
        text = np.searchsorted(texts.begins, at, side="right") - 1
        half = (at - texts.begins[text]) // HALF
        p = half[:, None] + np.array([-2, -1, 0, 1])
        p = np.where((p >= 0) & (p < texts.many[text, None]), p + texts.first[text, None], -1)
        times = self.times[k]
        start = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        p, j = np.repeat(p, times, axis=0), self.holds[start + np.arange(times.sum())]
        key = (p * len(self.windows) + j[:, None])[p >= 0]
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(new, append=len(key))
        key = key[new]
        key = key[n >= self.need[key % len(self.windows)]]
        return key // len(self.windows), key % len(self.windows)

    def passages(self, texts: Texts) -> np.ndarray:
        """Latent vectors of the passages, of length 1: sums over half passages, two by two."""
        ends = np.cumsum(texts.halves)
        rows = np.full(ends[-1] * HALF, TERMS)
        rows[np.arange(len(texts.words)) + np.repeat((ends - texts.halves) * HALF - texts.begins, texts.sizes)] = terms(texts.words)
        out = row_sums(self.latent, rows.reshape(-1, HALF))
        goes_on = np.ones(len(out), dtype=bool)
        goes_on[ends - 1] = False
        pair = np.flatnonzero(goes_on)
        out[pair] += out[pair + 1]
        goes_on[(ends - 1)[texts.halves == 1]] = True
        out = out[goes_on]
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out

    def near(self, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, window) pairs at LATENT or more, of windows long enough to be told by it."""
        if not len(self.long):
            return self.long, self.long
        step = max(1, min(CHUNK * 4, PAIRS // len(self.long)))
        hits = [np.flatnonzero(lat[at : at + step] @ self.far >= LATENT) + at * len(self.long) for at in range(0, len(lat), step)]
        p, j = np.divmod(np.concatenate(hits), len(self.long))
        return p, self.long[j]

    def candidates(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, windows and cosines of the pairs that the last check is for, by passage and window."""
        lat = self.passages(texts)
        p, j = (np.concatenate(x) for x in zip(self.near(lat), self.promising(texts)))
        if len(p):
            wide = texts.marks()
            fits = np.bitwise_count(wide[p] & self.marks[j]).sum(axis=1) >= self.least[j]
            p, j = np.divmod(np.unique(p[fits] * len(self.windows) + j[fits]), len(self.windows))
        cos = np.einsum("ij,ij->i", lat[p], self.target[j])
        fits = cos >= COSINE
        return p[fits], j[fits], cos[fits]

    def search_each(self, texts: Iterable[str | None], first: bool = False) -> Iterator[dict]:
        """For each text item_id -> (overlap, cosine, at_word) of its best passage; with `first`, any one item."""
        for group in some(texts):
            ws = words_each(group)
            out: list[dict] = [{} for _ in ws]
            held = [k for k, w in enumerate(ws) if len(w)] if self.windows else []
            if held:
                laid = Texts([ws[k] for k in held])
                p, j, cos = self.candidates(laid)
                text = np.searchsorted(laid.first, p, side="right") - 1
                for k, at, window, c in zip(text.tolist(), ((p - laid.first[text]) * HALF).tolist(), j.tolist(), cos):
                    found = out[held[k]]
                    if not (first and found):
                        self.tell(found, ws[held[k]], at, window, c)
            yield from out

    def search(self, text: str | None, first: bool = False) -> dict:
        return next(self.search_each([text], first))

    def tell(self, out: dict, w: np.ndarray, at: int, j: int, c: np.floating) -> None:
        """The last check: puts the window's item into `out` if the passage at word `at` holds it, and better than what is there."""
        # the check looks half a passage to each side, so that no item is cut
        around = w[max(0, at - HALF) : at + PASSAGE + HALF].tolist()
        there = set(around)
        told = c >= LATENT and len(self.windows[j]) >= HALF
        if len(self.bags[j] & there) < LCS * len(self.bags[j]) or not (told or len(self.rare[j] & there) * 2 >= len(self.rare[j])):
            return
        share = lcs(self.windows[j], around) / len(self.windows[j])
        if share >= LCS and share > out.get(self.ids[j], (0,))[0]:
            out[self.ids[j]] = (share, float(c), at)


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast Index for each ITEMS items; idf and basis are made once."""
    spark = docs.sparkSession
    texts, df, n = document_terms(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    latent = with_zeros(idf[:, None] * basis(texts.unionByName(cut(benchmark)), idf))
    rows = iter(benchmark.select("item_id", "text").toLocalIterator())
    while chunk := [tuple(r) for r in islice(rows, ITEMS)]:
        index = Index(chunk, idf, latent)
        if index.windows:
            yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, overlap, cosine, at_word."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for shared in indexes(docs, benchmark):

        def search(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = [(doc, item, *hit) for doc, hits in zip(part["doc_id"], shared.value.search_each(part["text"])) for item, hit in hits.items()]
                got = pd.DataFrame(found, columns=["doc_id", "item_id", "overlap", "cosine", "at_word"])
                yield got.astype({"doc_id": "Int64", "item_id": "Int64", "overlap": float, "cosine": float, "at_word": "int32"})

        found = rows.mapInPandas(search, RESULT)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in shared.value.search_each(texts, first=True)], dtype=bool)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: rows whose text holds a benchmark passage go; all other rows stay as they are."""
    out = docs
    for shared in indexes(docs, benchmark):
        out = out.where(_clean(shared)("text"))
    return out
