"""MinHash near-dedup with tensored banding.

Two small collections of `m` tuples of K minhashes each; table key (i, j) joins tuple i of the first with tuple j
of the second, so m * m tables of 2K rows cost 2 * m * K minhashes. Rows of one bucket are chained by a range sort,
so that a hot bucket is split over tasks. Documents joined by buckets form a candidate cluster; a cluster's texts
are dealt once to units of block pairs, and each unit intersects full shingle sets as sparse 0/1 blocks and gives
out a spanning forest of its links only, so rows stay in proportion to documents. A cluster over LARGE blocks is
first contracted around its buckets' smallest members; what is still apart is then held against its buckets.

Defined results: null or wordless text has no shingles, n_shingles 0, and links with nothing; a null doc_id is a
class of its own with a null component_id and kept; rows of one doc_id are one document, linked by any of their
texts; repeated rows share one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .shingling import shingles

K, MOST = 3, 10
#: shingles in a block of a cluster's texts; blocks over which a cluster is contracted first; rows of a 0/1 block; its columns at a time
BLOCK, LARGE, ROWS, COLUMNS = 1 << 20, 16, 256, 4096
_rng = np.random.default_rng(9)
TIMES, PLUS = _rng.integers(0, 1 << 63, 2 * MOST * K, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 1 << 63, 2 * MOST * K, dtype=np.uint64)


def tuples_for(percent: int) -> int:
    """Tuples in a collection: the fewest (up to MOST) that miss a pair at the similarity with a chance of 0.002 or less."""
    own = (percent / 100) ** K
    return next((m for m in range(2, MOST) if 1 - (1 - (1 - own) ** m) ** 2 <= 0.002), MOST)


def minhashes(s: np.ndarray, n: int) -> np.ndarray:
    low = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, ((s[at : at + 4096, None] * TIMES[:n] + PLUS[:n]) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return low.view(np.int32)


def _sketcher(width: int, n: int):
    @F.pandas_udf("n_shingles long, x long, y long, h array<int>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = shingles(text, width)
            x, y = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
            out.append((len(s), x, y, minhashes(s, n) if len(s) else np.empty(0, dtype=np.int32)))
        return pd.DataFrame(out, columns=["n_shingles", "x", "y", "h"])

    return sketch


def table_keys(m: int) -> Column:
    """Bucket keys of a row's minhashes `h`, one for each pair of tuples."""

    def tuples(at: int) -> Column:
        return F.array(*[F.xxhash64(F.lit(i), F.slice("h", at + i * K + 1, K)) for i in range(m)])

    return F.flatten(F.transform(tuples(0), lambda a: F.transform(tuples(m * K), lambda b: F.xxhash64(a, b))))


def bucket_links(rows: DataFrame) -> DataFrame:
    """rows(key, rep) -> links (a, b) that join the rows of each key: every row to the first of its key's run in a partition."""

    def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = pivot = None
        for part in parts:
            k, r = part["key"].to_numpy(), part["rep"].to_numpy()
            if not len(k):
                continue
            first = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            own = np.where(first, r, 0)
            at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
            to = np.where(at >= 0, own[at], pivot if pivot is not None else 0)
            if key is None:
                yield pd.DataFrame({"a": r[:1], "b": r[:1], "k": k[:1]})
            link = to != r
            yield pd.DataFrame({"a": r[link], "b": to[link], "k": None})
            key, pivot = k[-1], to[-1]
        if key is not None:
            yield pd.DataFrame({"a": [pivot], "b": [pivot], "k": [key]})

    dealt = rows.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")
    found = written(dealt.mapInPandas(chain, "a long, b long, k long"))
    # a key cut by a partition's end: two rows of each partition tell
    ends = found.where("k is not null")
    over = ends.join(ends.groupBy("k").agg(F.min("a").alias("p")), "k").select("a", F.col("p").alias("b"))
    return found.where("k is null").select("a", "b").union(over).where("a <> b")


def groups(parts: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Runs of equal `by` of sorted batches, one at a time."""
    rest = None
    for part in parts:
        if len(part):
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            v = part[by].to_numpy()
            cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1)]
            for s, e in zip(cuts, cuts[1:]):
                yield part.iloc[s:e]
            rest = part.iloc[cuts[-1] :]
    if rest is not None:
        yield rest


def forest(label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links between rows of unlike labels, by full sets."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, lab = [sets[i] for i in order], np.unique(label[order], return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    row = np.repeat(np.arange(len(sets)), size)[common]
    column = column[common]
    at = np.searchsorted(row, np.arange(len(sets) + 1))
    new, out = np.full(len(times), -1), []

    def dense(rows: np.ndarray, n: int, low: int) -> np.ndarray:
        """0/1 rows over the columns low .. low + n - 1 of the renumbering `new`."""
        m = np.zeros((len(rows), n), dtype=np.float32)
        spans = [column[at[r] : at[r + 1]] for r in rows]
        c = new[np.concatenate(spans)] - low
        i = np.repeat(np.arange(len(rows)), [len(s) for s in spans])
        fits = (c >= 0) & (c < n)
        m[i[fits], c[fits]] = 1
        return m

    for p in range(0, len(sets), ROWS):
        for q in range(p, len(sets), ROWS):
            a, b = np.arange(p, min(p + ROWS, len(sets))), np.arange(q, min(q + ROWS, len(sets)))
            if size[a[-1]] * 100 < size[b[0]] * percent:
                break  # all later rows are larger still
            if len(np.unique(lab[b])) == 1:
                a = a[lab[a] != lab[b[0]]]
            elif len(np.unique(lab[a])) == 1:
                b = b[lab[b] != lab[a[0]]]
            if not len(a) or not len(b):
                continue
            shared = np.intersect1d(column[at[a[0]] : at[a[-1] + 1]], column[at[b[0]] : at[b[-1] + 1]])
            if not len(shared):
                continue
            new[shared] = np.arange(len(shared))
            both = np.zeros((len(a), len(b)), dtype=np.float32)
            for low in range(0, len(shared), COLUMNS):
                n = min(COLUMNS, len(shared) - low)
                both += dense(a, n, low) @ dense(b, n, low).T
            new[shared] = -1
            linked = both.astype(np.int64) * (100 + percent) >= percent * (size[a][:, None] + size[b][None, :])
            for i, ok in zip(a, linked):
                js = b[ok]
                js = js[lab[js] != lab[i]]
                while len(js):
                    out.append((int(order[i]), int(order[js[0]])))
                    lab[lab == lab[js[0]]] = lab[i]
                    js = js[lab[js] != lab[i]]
    return out


def verified(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """rows(unit, rep, label), texts(rep, text) -> links (a, b) that join a unit's rows of unlike labels as full sets join them."""

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(parts, "unit"):
            ids, label = g["rep"].to_numpy(), g["label"].to_numpy()
            sets = [shingles(t, width) for t in g["text"]]
            full = np.array([len(s) > 0 for s in sets])
            if full.sum() > 1:
                found = forest(label[full], [s for s in sets if len(s)], percent)
                own = ids[full]
                if found:
                    yield pd.DataFrame([(own[i], own[j]) for i, j in found], columns=["a", "b"])

    dealt = rows.join(texts, "rep").repartition("unit").sortWithinPartitions("unit")
    return written(dealt.mapInPandas(search, "a long, b long").where("a <> b"))


def block_pairs(rows: DataFrame, by: Column) -> DataFrame:
    """rows(rep, label, blocks) -> unit, rep, label: every two rows of one `by` meet in a unit of two of its blocks."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.select("rep", "label", by.alias("_by"), own.alias("_o"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_k"))
    return dealt.select(F.xxhash64("_by", F.least("_o", "_k"), F.greatest("_o", "_k")).alias("unit"), "rep", "label")


def _contracted(large: DataFrame, classes: DataFrame, buckets: DataFrame, m: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of clusters too large for block pairs: around pivots, then of each bucket's outsiders with the bucket."""
    blocks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / BLOCK).cast("int")
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1).cast("array<long>"))
    sized = classes.select("rep", "size")
    stars = buckets.join(large, F.col("a") == F.col("rep")).select("rep", F.col("b").alias("pivot")).distinct()
    counts = stars.join(sized, "rep").groupBy("pivot").agg(blocks(F.sum("size")).alias("blocks"))
    spokes = stars.join(counts, "pivot").select("pivot", "rep", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("k"))
    hubs = counts.select("pivot", F.col("pivot").alias("rep"), span("blocks").alias("k"))
    around = spokes.union(hubs).select(F.xxhash64("pivot", "k").alias("unit"), "rep", F.col("rep").alias("label"))
    links = verified(around, texts, width, percent)
    comp = components(links).withColumnsRenamed({"id": "rep", "component_id": "c"})
    rows = classes.join(large, "rep", "left_semi").select("rep", "size", F.explode(table_keys(m)).alias("key"))
    told = written(rows.join(comp, "rep", "left").select("key", "rep", "size", F.coalesce("c", "rep").alias("label")))
    parts = told.groupBy("key", "label").agg(F.sum("size").alias("s"))
    main = parts.groupBy("key").agg(F.max_by("label", "s").alias("main"), F.sum("s").alias("all"), F.max("s").alias("most")).where(F.col("all") > F.col("most"))
    main = main.select("key", "main", blocks(F.col("all")).alias("nb"), blocks(F.col("all") - F.col("most")).alias("ob"))
    both, h = told.join(main, "key"), F.xxhash64("rep")
    left = both.where("label <> main").select("key", "rep", "label", F.pmod(h, F.col("ob")).alias("i"), span("nb").alias("j"))
    right = both.select("key", "rep", "label", span("ob").alias("i"), F.pmod(h, F.col("nb")).alias("j"))
    units = left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("unit"), "rep", "label").distinct()
    return links.union(verified(units, texts, width, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept (one row per row)."""
    m = tuples_for(percent)
    # sets themselves are never stored: a row keeps its size, a fingerprint of 128 bits and its minhashes
    made = docs.select("doc_id", _sketcher(width, 2 * m * K)("text").alias("k"))
    per_doc = written(made.select("doc_id", "k.n_shingles", "k.x", "k.y", "k.h"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    # equal sets form one class before any comparison: the smallest doc_id stands for it
    known = per_doc.where("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("x", "y").agg(F.min("doc_id").cast("long").alias("rep"), F.first("h").alias("h"), F.first("n_shingles").alias("size")))
    buckets = bucket_links(classes.select("rep", F.explode(table_keys(m)).alias("key")))
    clusters = components(buckets)
    inside = clusters.select(F.col("id").alias("rep"), F.col("component_id").alias("cluster"))
    tokens = inside.join(classes.select("rep", "size"), "rep")
    blocks = written(tokens.groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")))
    dealt = inside.join(blocks.where(F.col("blocks") <= LARGE), "cluster").withColumn("label", F.col("rep"))
    links = verified(block_pairs(dealt, F.col("cluster")), texts, width, percent)
    if not blocks.where(F.col("blocks") > LARGE).isEmpty():
        large = inside.join(blocks.where(F.col("blocks") > LARGE), "cluster").select("rep").distinct()
        links = links.union(_contracted(large, classes, buckets, m, texts, width, percent))
    # a doc_id with several texts ties their classes
    again = known.groupBy("doc_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("z", F.max))]).where("ax <> zx or ay <> zy").select("doc_id")
    tied = known.join(again, "doc_id").join(classes.select("x", "y", "rep"), ["x", "y"]).select(F.col("doc_id").cast("long").alias("a"), F.col("rep").alias("b"))
    comp = components(links.union(tied))
    roots = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("x", "y", F.coalesce("component_id", "rep").alias("root"))
    return per_doc.drop("h").join(roots, ["x", "y"], "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays; of rows of one doc_id, the one least by hash.

    Rows without a doc_id stay.
    """
    told = written(near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")))
    kept = told.where("kept")
    rows = docs.where("doc_id is not null").join(kept.select("doc_id"), "doc_id", "left_semi")
    if not kept.where("n > 1").isEmpty():
        own = [c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]
        hashed = docs.where("doc_id is not null").select("doc_id", F.xxhash64(*own).alias("h"))
        first = hashed.join(kept.where("n > 1").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"))
        single = rows.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_anti")
        first = first.select(F.col("doc_id").alias("_first"), F.col("h").alias("_least"))
        repeated = docs.join(first, (F.col("doc_id") == F.col("_first")) & (F.xxhash64(*own) == F.col("_least")), "left_semi")
        rows = single.unionByName(repeated.dropDuplicates(own))
    return rows.select(docs.columns).unionByName(docs.where("doc_id is null"))
