"""Ranked lexical search: WAND over document shards, and the shards' heaps merged.

One pass over the texts writes an index of bounded shards, one row each: the documents in order of their ids, and the
postings of the terms asked for. From the index come the corpus' counts, which set every term's weight. Then each shard
answers each item: its terms' cursors are ordered by document, the pivot is the first document at which the sum of the
terms' highest impacts in the shard beats the heap's lowest score, and all cursors before it skip there; only pivots that
all cursors before them have reached are scored. A task keeps its best documents of an item over all its shards, so later
shards start at a threshold; the tasks' heaps are ranked together.

The terms asked for are broadcast up to MAX_TERMS; beyond that all terms are indexed, and items are answered in blocks
of about MAX_TERMS terms, each a pass over the index.

Defined results: null texts and texts without terms are no documents and no items (they give no row); rows of one item_id
are one item with the terms of all; repeated documents are ranked each by itself, null doc_ids before others of equal
score; texts of any length count whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from heapq import heappush, heapreplace
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_az, written

#: terms that are broadcast; documents and postings that close a shard; raw words remembered by a task
MAX_TERMS, SHARD_DOCS, SHARD_POSTINGS, MEMO = 500_000, 1 << 16, 2_000_000, 500_000
#: Fixed value: what a term is made of, in Python's and in Java's form of its complement.
TERM, BETWEEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_AZ = str.maketrans(UPPER, LOWER)
SHARD = "n_docs long, n_terms long, doc_ids array<long>, named array<boolean>, lengths array<long>, terms array<string>, dfs array<int>, places array<int>, tfs array<int>"
END = 1 << 62


def terms_of(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    words = F.filter(F.split(lower_az(F.col("text")), BETWEEN), lambda w: w != "")
    return items.select("item_id", F.explode(words).alias("term")).distinct()


class Shard:
    """Documents and postings gathered for one row of the index."""

    def __init__(self):
        self.n_docs = self.n_terms = 0
        self.ids, self.named, self.lengths = array("q"), array("b"), array("q")
        self.term, self.place, self.tf = array("i"), array("i"), array("i")
        self.terms: dict[str, int] = {}

    def add(self, doc_id: int | None, n: int, counts: dict[str, int]):
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + n
        if counts:
            at = len(self.ids)
            self.ids.append(0 if doc_id is None else doc_id)
            self.named.append(doc_id is not None)
            self.lengths.append(n)
            for term, tf in counts.items():
                self.term.append(self.terms.setdefault(term, len(self.terms)))
                self.place.append(at)
                self.tf.append(tf)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.tf) >= SHARD_POSTINGS

    def row(self) -> pd.DataFrame:
        ids, named, lengths = (np.array(x) for x in (self.ids, self.named, self.lengths))
        order = np.lexsort((ids, named))
        rank = np.empty(len(order), "int32")
        rank[order] = np.arange(len(order), dtype="int32")
        term, place, tf = np.array(self.term, "int32"), rank[np.array(self.place, "int32")], np.array(self.tf, "int32")
        at = np.lexsort((place, term))
        dfs = np.bincount(term, minlength=len(self.terms)).astype("int32")
        made = (self.n_docs, self.n_terms, ids[order], named[order].astype(bool), lengths[order], list(self.terms), dfs, place[at], tf[at])
        return pd.DataFrame({c.split()[0]: [x] for c, x in zip(SHARD.split(", "), made)})


def index(docs: DataFrame, vocabulary: set[str] | None) -> DataFrame:
    """A row a shard: counts over all its documents, and the postings of `vocabulary` (None: of all terms), by term and place."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def gather(parts):
        wanted, memo, shard = shared.value, {}, Shard()
        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                words = TERM.findall(text) if text else ()
                if not words:
                    continue
                counts: dict[str, int] = {}
                for raw, tf in Counter(words).items():
                    term = memo.get(raw)
                    if term is None:
                        term = raw.translate(LOWER_AZ)
                        term = term if wanted is None or term in wanted else ""
                        if len(memo) < MEMO:
                            memo[raw] = term
                    if term:
                        counts[term] = counts.get(term, 0) + tf
                shard.add(None if doc_id is None else int(doc_id), len(words), counts)
                if shard.full():
                    yield shard.row()
                    shard = Shard()
        if shard.n_docs:
            yield shard.row()

    # doc_id travels as text: pandas would make floats of longs beside nulls
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(gather, SHARD)


def impacts(weight: int, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to the scores of its documents."""
    tf = tf.astype("int64")
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * norm))


def wand(lists: list[tuple[list[int], list[int], int]], k: int, above: int) -> list[tuple[int, int]]:
    """The k best (score, -place) with a score over `above`; of equal scores the smallest places.

    lists: of each term its places in ascending order, END behind them, their impacts, and the highest of these.
    """
    heap: list[tuple[int, int]] = []
    cursors = [[places[0], 0, bound, places, own] for places, own, bound in lists if bound > 0]
    doc = itemgetter(0)
    while True:
        cursors.sort(key=doc)
        reach, pivot = 0, END
        for c in cursors:
            reach += c[2]
            if reach > above:
                pivot = c[0]
                break
        if pivot == END:
            return heap
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                at = c[1]
                score += c[4][at]
                c[1] = at + 1
                c[0] = c[3][at + 1]
            if score > above:
                if len(heap) < k:
                    heappush(heap, (score, -pivot))
                else:
                    heapreplace(heap, (score, -pivot))
                if len(heap) == k:
                    above = max(above, heap[0][0])
        else:
            for c in cursors:
                if c[0] >= pivot:
                    break
                at = c[1] = bisect_left(c[3], pivot, c[1] + 1)
                c[0] = c[3][at]


def answers(shards: DataFrame, items: list[tuple[object, list[str]]], weights: dict[str, int], k: int, n_docs: int, n_terms: int, item_type: str) -> DataFrame:
    """Each task's k best documents of each item."""
    shared = shards.sparkSession.sparkContext.broadcast((items, weights))

    def search(parts):
        items, weights = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        for part in parts:
            for row in part.itertuples(index=False):
                norm = 10 + 90 * np.asarray(row.lengths, "int64") * n_docs // n_terms
                at, lists = 0, {}
                for term, df in zip(row.terms, row.dfs):
                    if weights.get(term):
                        places, own = row.places[at : at + df], row.tfs[at : at + df]
                        own = impacts(weights[term], own, norm[places])
                        lists[term] = ([*places.tolist(), END], own.tolist(), int(own.max()))
                    at += df
                for mine, (_, terms) in zip(best, items):
                    found = wand([lists[t] for t in terms if t in lists], k, -mine[-1][0] - 1 if len(mine) == k else 0)
                    if found:
                        mine += [(-score, bool(row.named[-place]), int(row.doc_ids[-place])) for score, place in found]
                        mine.sort()
                        del mine[k:]
        out = [(item, doc_id if named else None, -score) for (item, _), mine in zip(items, best) for score, named, doc_id in mine]
        yield pd.DataFrame(out, columns=["item_id", "doc_id", "score"], dtype=object)

    return shards.drop("n_docs", "n_terms").mapInPandas(search, f"item_id {item_type}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores above 0."""
    wanted = terms_of(items)
    n_wanted = wanted.count()
    vocabulary = {r.term for r in wanted.select("term").distinct().collect()} if n_wanted <= MAX_TERMS else None
    shards = written(index(docs, vocabulary))
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    counted = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    blocks = max(1, -(-n_wanted // MAX_TERMS))
    kept = written if blocks > 1 else lambda df: df  # what is read once needs no table
    asked = kept(wanted.join(counted, "term"))
    item_type, found = items.schema["item_id"].dataType.simpleString(), None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else asked.collect()
        weights = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in rows}
        by_item: dict[object, list[str]] = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append(r.term)
        got = kept(answers(shards, [(i, sorted(t)) for i, t in by_item.items()], weights, k, n_docs, n_terms, item_type))
        found = got if found is None else found.union(got)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: op12's rows in SQL.
SQL = r"""with cut as (
 select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws, row_number() over () as r from documents
), docs as (
 select doc_id, r, len(ws) as n, ws from cut where len(ws) > 0
), total as (
 select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from docs
), asked as (
 select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), posted as (
 select doc_id, r, n, term, count(*)::bigint as tf from (select doc_id, r, n, unnest(ws) as term from docs) group by all
), weighed as (
 select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from posted group by term), total
), scored as (
 select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
 from asked join weighed using (term) join posted using (term), total group by item_id, doc_id, r
), ranked as (
 select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10"""
