"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

The fit uses a bounded sample of labelled rows: at most SAMPLE_DOCS, by hash order, each text whole. Executors reduce
them twice: first to counts of features by label, then to the sentences' features that carry weight, which are few;
only those come to the driver.
Defined results: null and empty texts score 0 and have no worst sentence; without labels of both kinds every score is
0; of equally bad sentences the first is reported; rows of one doc_id are labelled and scored alike; repeated labels of
a row count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .language import held_out

BUCKETS, SAMPLE_DOCS, EPOCHS, SUPPORT, THRESHOLD = 1 << 20, 4000, 15, 4, 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def features(word: str, memo: dict) -> list[int]:
    """Hash buckets of a word and of its leading 4 to 7 characters."""
    got = memo.get(word)
    if got is None:
        keys = [word] + [f"^{word[:n]}" for n in range(4, 8) if len(word) >= n]
        got = [zlib.crc32(k.encode("utf-8", "replace")) % BUCKETS for k in keys]
        if len(memo) < 200_000:
            memo[word] = got
    return got


def sentences(text: str | None, memo: dict):
    """(start, end, distinct features) of each sentence that has words."""
    for m in SENTENCE.finditer(text or ""):
        words = WORD.findall(m.group().lower())
        if words:
            yield m.start(), m.end(), np.array(sorted({f for w in words for f in features(w, memo)}))


def evidence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows(text, _y) -> features that speak for label 1 (SUPPORT toxic documents, log odds of 2 or more), their odds, documents by label."""

    def count(parts):
        memo: dict = {}
        seen: list[dict] = [{}, {}]
        total = [0, 0]
        for part in parts:
            for text, y in zip(part["text"], part["_y"]):
                own = {int(f) for _, _, s in sentences(text, memo) for f in s}
                total[y] += bool(own)
                for f in own:
                    seen[y][f] = seen[y].get(f, 0) + 1
        for y in (0, 1):
            yield pd.DataFrame({"f": [-1, *seen[y]], "y": y, "n": [total[y], *seen[y].values()]}).astype({"f": "int64", "y": "int32", "n": "int64"})

    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    sums = rows.mapInPandas(count, "f long, y int, n long").groupBy("f").agg(n(0).alias("clean"), n(1).alias("toxic"))
    got = sums.where((F.col("f") < 0) | (F.col("toxic") >= SUPPORT)).toPandas()  # BUCKETS rows at most
    whole = got[got["f"] < 0]
    total = np.array([whole["clean"].sum(), whole["toxic"].sum()], dtype=float)
    got = got[got["f"] >= 0].sort_values("f")
    odds = np.log((got["toxic"] + 0.5) / (total[1] + 1)) - np.log((got["clean"] + 0.5) / (total[0] + 1))
    keep = (odds >= 2).to_numpy()
    return got["f"].to_numpy()[keep], odds.to_numpy()[keep], total


def bags(rows: DataFrame, carry: np.ndarray) -> list[tuple[list[np.ndarray], int]]:
    """Each document as its sentences' features among `carry` (as places there); what has none is left out."""

    def reduce(parts):
        memo: dict = {}
        place = {int(f): k for k, f in enumerate(carry)}
        for part in parts:
            made = [[[place[f] for f in map(int, s) if f in place] for _, _, s in sentences(text, memo)] for text in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["_y"].astype("int32"), "bag": [[s for s in b if s] for b in made]})

    got = rows.mapInPandas(reduce, "doc_id long, y int, bag array<array<int>>").where(F.size("bag") > 0).collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.y, r.bag))
    return [([np.array(s) for s in r.bag], r.y) for r in got]


def fit(documents: list[tuple[list[np.ndarray], int]], odds: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the carried features and bias of sentence scores p = sigmoid(w.x + b), doc score 1 - prod(1 - p), by AdaGrad.

    A sentence without a carried feature has p = 0, so clean sentences do not add up in long documents.
    """
    w, bias, g2, gb2 = odds * 0.3, -2.0, np.full(len(odds), 1e-2), 1e-2
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(documents)):
            sents, y = documents[k]
            z = np.array([w[s].sum() for s in sents]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            # d loss / d z_i: p_i for a clean document; -p_i * clean / (1 - clean) for a toxic one
            grad = p if not y else -p * clean / max(1 - clean, 1e-6)
            for s, g in zip(sents, grad):
                gi = g + 1e-3 * w[s]
                g2[s] += gi * gi
                w[s] -= 0.2 * gi / np.sqrt(g2[s])
                gb2 += g * g
                bias -= 0.05 * g / np.sqrt(gb2)
    return np.maximum(w, 0), float(min(bias, -1.0))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights by feature bucket, and the bias."""
    known = labels.where(~held_out(4, 2) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(SAMPLE_DOCS)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"))
    weights = np.zeros(BUCKETS, dtype="float32")
    carry, odds, total = evidence(rows)
    if not total.all() or not len(carry):
        return weights, -2.0
    weights[carry], bias = fit(bags(rows, carry), odds)
    return weights, bias


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, worst_start, worst_end (character span of the worst sentence), worst_score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, labels))  # BUCKETS floats: 4 MB at every size

    @F.pandas_udf("score double, worst_start int, worst_end int, worst_score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        (w, bias), memo, out = shared.value, {}, []
        for text in texts:
            log_clean, worst = 0.0, (0.0, None, None)
            for a, b, s in sentences(text, memo):
                z = float(w[s].sum())
                if z == 0:
                    continue
                p = 1 / (1 + math.exp(-min(30.0, z + bias)))
                log_clean += math.log1p(-min(p, 1 - 1e-9))
                worst = max(worst, (p, a, b), key=lambda x: x[0])
            out.append((1 - math.exp(log_clean), worst[1], worst[2], worst[0]))
        df = pd.DataFrame(out, columns=["score", "worst_start", "worst_end", "worst_score"])
        return df.astype({"worst_start": "Int32", "worst_end": "Int32"})

    return docs.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end"
    )
