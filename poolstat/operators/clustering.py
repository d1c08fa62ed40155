"""Average linkage under a threshold, for pools of any size.

Average linkage never joins clusters between which no pair is under the threshold, so a pool falls into the connected
components of its near pairs, and each is merged by itself. A pool of up to SMALL vectors is one such part as it is. A
larger one is dealt into blocks; each pair of blocks is compared in one task, which tells only how its vectors hang
together (at most one link a vector); components follow from these links. A component is merged in one task: by its square
of distances up to MATRIX vectors, beyond that by the clusters' mean vectors alone, as the mean cosine distance of two
clusters is 1 less the product of their means. The task then holds as much as its vectors; its time is their square. One
over MAX_PART is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check
from poolstat.sources.tables import written

from .components import components

#: vectors of a pool that goes to one task as it is; vectors of a block; vectors of a part merged by a square matrix; vectors of a part
SMALL, BLOCK, MATRIX, MAX_PART = 2_000, 2_048, 2_048, 1_000_000
#: distances of one pair may differ by rounding between matrices of unlike shape; distances so close are a tie; numbers of a block of products
SLACK, TIE, PRODUCTS = 1e-9, 1e-12, 1 << 20


def unit_rows(vectors) -> np.ndarray:
    """Vectors as rows of length 1; null, unlike, zero and non-finite ones are refused."""
    check(all(v is not None for v in vectors) and len({len(v) for v in vectors}) <= 1, "a pool's vectors have one length and are not null")
    x = np.stack(list(vectors)).astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    check(bool(np.isfinite(norm).all() and (norm > 0).all()), "a pool holds a zero or non-finite vector")
    return x / norm


def distance_matrix(x) -> np.ndarray:
    u = unit_rows(x)
    return 1 - u @ u.T


def connected(near: np.ndarray) -> list[np.ndarray]:
    """Connected parts of a symmetric boolean matrix, singles left out."""
    left, out = near.any(axis=1), []
    while left.any():
        part = np.zeros(len(near), dtype=bool)
        edge = part.copy()
        edge[int(left.argmax())] = True
        while edge.any():
            part |= edge
            edge = near[edge].any(axis=0) & ~part
        left &= ~part
        if part.sum() > 1:
            out.append(np.flatnonzero(part))
    return out


def merge_part(x: np.ndarray, stop: float) -> tuple[list[float], list[tuple[float, list[int]]]]:
    """(heights, clusters with the height of their last merge) of a square matrix, merged in place while the least is under `stop`.

    A merged cluster takes the row of the one before it in order, and goes last in order; of equal distances the first
    pair in order is merged. Every row knows its least distance, so a merge costs as much as a few rows.
    """
    n = len(x)
    x = x.astype(float)
    np.fill_diagonal(x, np.inf)
    order, size, alive = np.arange(n), np.ones(n), np.ones(n, dtype=bool)
    members, last, heights = [[i] for i in range(n)], [0.0] * n, []
    least = x.min(axis=1)
    while n > 1 and (height := float(least.min())) < stop:
        rows = np.flatnonzero(least == height)
        i = int(rows[order[rows].argmin()])
        partners = np.flatnonzero(x[i] == height)
        j = int(partners[order[partners].argmin()])
        heights.append(height)
        both = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
        touched = alive & ((least == x[i]) | (least == x[j]))  # rows whose least may be gone
        x[j], x[:, j], least[j], alive[j] = np.inf, np.inf, np.inf, False
        both[[i, j]] = np.inf
        both[~alive] = np.inf
        x[i], x[:, i] = both, both
        size[i], order[i] = size[i] + size[j], n + len(heights)
        members[i], last[i] = members[i] + members[j], height
        touched[i], touched[j] = True, False
        np.minimum(least, both, out=least, where=alive)
        least[touched] = x[touched].min(axis=1)
    return heights, [(last[i], members[i]) for i in np.flatnonzero(alive)]


def merge_means(u: np.ndarray, stop: float) -> tuple[list[float], list[tuple[float, list[int]]]]:
    """merge_part of unit rows by their clusters' mean vectors; no matrix of distances.

    Every row knows a bound that its least distance is not under. Merging never brings a cluster nearer to a third one, so a
    bound outlives the row's neighbour, and is made exact again only when it is the least of all.
    """
    n = len(u)
    mean, size, order, at = u.astype(float), np.ones(n), np.arange(n), np.arange(n)
    members, last, heights = [[i] for i in range(n)], [0.0] * n, []
    least, near = np.empty(n), np.empty(n, dtype=int)
    for k in range(0, n, step := max(1, (1 << 22) // n)):
        d = 1 - mean[k : k + step] @ mean.T
        d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
        near[k : k + step] = d.argmin(axis=1)
        least[k : k + step] = d.min(axis=1)
    exact, alive, left = np.ones(n, dtype=bool), np.ones(n, dtype=bool), n

    def row(i: int) -> np.ndarray:
        d = 1 - mean @ mean[i]
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    while left > 1 and (height := float(least.min())) < stop:
        rows = np.flatnonzero(least == height)
        if not exact[rows].all():
            for i in rows[~exact[rows]]:
                d = row(i)
                near[i] = d.argmin()
                least[i], exact[i] = d[near[i]], True
            continue
        i = int(rows[order[rows].argmin()])
        d = row(i)
        partners = np.flatnonzero(d == d.min())
        j = int(partners[order[partners].argmin()])
        heights.append(height)
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        alive[j], least[j], left = False, np.inf, left - 1
        size[i], order[i] = size[i] + size[j], n + len(heights)
        members[at[i]] += members[at[j]]
        members[at[j]], last[at[i]] = [], height
        exact[alive & ((near == i) | (near == j))] = False
        d = row(i)
        nearer = d <= least
        nearer[j] = False
        least[nearer], near[nearer], exact[nearer] = d[nearer], i, True
        near[i] = d.argmin()
        least[i], exact[i] = d[near[i]], True
        if 2 * left < len(alive):  # rows of clusters that are gone are left out
            new = np.cumsum(alive) - 1
            near = np.where(alive[near], new[near], 0)[alive]
            mean, size, order, at, least, exact = mean[alive], size[alive], order[alive], at[alive], least[alive], exact[alive]
            alive = np.ones(left, dtype=bool)
    return heights, [(last[k], m) for k, m in enumerate(members) if m]


def neighbours(mean: np.ndarray, rough: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows `at`: their nearest other row, its distance, and whether another is as near.

    Products are made in single precision (`rough`); where these leave the nearest open, the row is made in double.
    """
    blur = 2 * (mean.shape[1] + 2) * 2.0**-23
    near, least, tied = np.zeros(len(at), dtype=int), np.empty(len(at)), np.zeros(len(at), dtype=bool)
    for k in range(0, len(at), step := max(1, PRODUCTS // len(mean))):
        rows = at[k : k + step]
        own, to = np.arange(len(rows)), slice(k, k + step)
        s = rough[rows] @ rough.T
        s[own, rows] = -np.inf
        j = s.argmax(axis=1)
        top = s[own, j]
        s[own, j] = -np.inf
        near[to], least[to] = j, 1 - np.einsum("ij,ij->i", mean[rows], mean[j])
        open_ = k + np.flatnonzero(s.max(axis=1) >= top - blur)
        if len(open_):
            own = np.arange(len(open_))
            d = 1 - mean[at[open_]] @ mean.T
            d[own, at[open_]] = np.inf
            near[open_] = j = d.argmin(axis=1)
            least[open_] = d[own, j]
            d[own, j] = np.inf
            tied[open_] = d.min(axis=1) <= least[open_] + TIE
    return near, least, tied


def merges_by_rounds(u: np.ndarray, stop: float) -> int | None:
    """How often merge_means merges unit rows under `stop`; None where ties, or a height at `stop`, leave it to the order of merges.

    Two clusters that are each other's nearest are merged sooner or later whatever else is, as merging brings no cluster
    nearer to a third one; so a round merges all such pairs, after copies. A row at `stop` or beyond is done.
    """
    if stop <= SLACK:
        return None
    _, first, copies = np.unique(u.round(12), axis=0, return_index=True, return_counts=True)
    mean, size, merges = u[first], copies.astype(float), len(u) - len(first)
    rough, stale = mean.astype(np.float32), np.ones(len(first), dtype=bool)
    near, least, tied = np.zeros(len(first), dtype=int), np.empty(len(first)), np.zeros(len(first), dtype=bool)
    while len(mean) > 1:
        near[stale], least[stale], tied[stale] = neighbours(mean, rough, np.flatnonzero(stale))
        if (np.abs(least - stop) <= TIE).any():
            return None
        live = least < stop
        near, (mean, rough, size, least, tied) = (np.cumsum(live) - 1)[near[live]], (x[live] for x in (mean, rough, size, least, tied))
        if not len(mean):
            break
        rows = np.arange(len(mean))
        a = rows[(near[near] == rows) & (rows < near)]
        b = near[a]
        if not len(a) or tied[a].any() or tied[b].any():
            return None
        merges += len(a)
        mean[a] = (size[a, None] * mean[a] + size[b, None] * mean[b]) / (size[a] + size[b])[:, None]
        rough[a] = mean[a]
        size[a] += size[b]
        stale, keep = np.isin(rows, [a, b]), ~np.isin(rows, b)
        stale = (stale | stale[near])[keep]
        near = np.where(keep[near], (np.cumsum(keep) - 1)[near], 0)[keep]
        mean, rough, size, least, tied = (x[keep] for x in (mean, rough, size, least, tied))
    return merges


def merged_rows(vectors, stop: float) -> tuple[list[float], list[list[int]]]:
    """`merged` of a part's vectors."""
    if len(vectors) <= MATRIX:
        return merged(distance_matrix(vectors), stop)
    heights, clusters = merge_means(unit_rows(vectors), stop)
    alone = [m for _, m in clusters if len(m) == 1]
    return heights, alone + [m for _, m in sorted(c for c in clusters if len(c[1]) > 1)]


def merged(d: np.ndarray, stop: float) -> tuple[list[float], list[list[int]]]:
    """Heights under `stop` of the merges, and the clusters: those never merged in order, then by their last merge."""
    near = d < stop
    np.fill_diagonal(near, False)
    heights, done, single = [], [], np.ones(len(d), dtype=bool)
    for part in connected(near):
        single[part] = False
        own, clusters = merge_part(d[np.ix_(part, part)], stop)
        heights += own
        for height, members in clusters:
            if len(members) > 1:
                done.append((height, [int(part[k]) for k in members]))
            else:
                single[part[members[0]]] = True
    return heights, [[int(i)] for i in np.flatnonzero(single)] + [m for _, m in sorted(done)]


def block_links(part: pd.DataFrame, stop: float) -> pd.DataFrame:
    """(a, b): for each set of vectors of two blocks that near pairs between them (or within the one) join, links to its least id."""
    part = part.sort_values("_id")
    ids, own = part["_id"].to_numpy(), part["_own"].to_numpy()
    u = unit_rows(part["_v"].to_list())
    near = 1 - u @ u.T < stop + SLACK
    np.fill_diagonal(near, False)
    if len(set(own)) > 1:
        near &= own[:, None] != own[None, :]  # pairs within a block have a task of their own
    found = [(ids[p[0]], ids[k]) for p in connected(near) for k in p[1:]]
    return pd.DataFrame(found, columns=["a", "b"])


def parts(vectors: DataFrame, pool: str, vector: str, stop: float, *more: str) -> DataFrame:
    """pool, _id, _v, more..., _part: vectors of one pool and part may merge under `stop`, others never do.

    _part is 0 in small pools and null for a vector without a near one.
    """
    rows = written(vectors.select(F.col(pool), *more, F.col(vector).cast("array<double>").alias("_v")).withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.groupBy(pool).agg(F.count("*").alias("_n"))
    large = written(sizes.where(F.col("_n") > SMALL).select(F.col(pool).alias("_pool"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")))
    if large.isEmpty():
        return rows.withColumn("_part", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")
    dealt = rows.join(large, F.col(pool).eqNullSafe(F.col("_pool"))).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pairs = dealt.select("_pool", "_id", "_v", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    links = pairs.groupBy("_pool", "_i", "_j").applyInPandas(lambda part: block_links(part, stop), "a long, b long")
    joined = written(components(written(links.where("a is not null"))))
    most = joined.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    check(most <= MAX_PART, f"{most} vectors hang together under {stop}, over {MAX_PART}")
    big = rows.join(large, F.col(pool).eqNullSafe(F.col("_pool")), "left_semi").join(joined.select(F.col("id").alias("_id"), F.col("component").alias("_part")), "_id", "left")
    small = rows.join(large, F.col(pool).eqNullSafe(F.col("_pool")), "left_anti").withColumn("_part", F.lit(0).cast("long"))
    return small.unionByName(big)


def counts(vectors: DataFrame, pool: str, vector: str, cuts: list[float]) -> DataFrame:
    """pool, n, k0, k1, ...: clusters of each pool at each of the cuts; vectors less the merges under it."""
    dealt, stop = parts(vectors, pool, vector, max(cuts)), max(cuts)
    kind, names = dict(dealt.dtypes)[pool], [f"_m{i}" for i in range(len(cuts))]

    def merges(part: pd.DataFrame) -> pd.DataFrame:
        heights = np.array(merged_rows(part.sort_values("_id")["_v"].to_list(), stop)[0])
        return pd.DataFrame({pool: [part[pool].iloc[0]], "_n": [len(part)]} | {c: [int((heights < cut).sum())] for c, cut in zip(names, cuts)})

    joint = dealt.where("_part is not null").select(pool, "_part", "_id", "_v").groupBy(pool, "_part").applyInPandas(merges, f"{pool} {kind}, _n long, " + ", ".join(f"{c} long" for c in names))
    alone = dealt.where("_part is null").select(pool, F.lit(1).cast("long").alias("_n"), *[F.lit(0).cast("long").alias(c) for c in names])
    sums = joint.union(alone).groupBy(pool).agg(F.sum("_n").alias("n"), *[F.sum(c).alias(c) for c in names])
    return sums.select(pool, "n", *[(F.col("n") - F.col(c)).alias(f"k{i}") for i, c in enumerate(names)])


def labels(vectors: DataFrame, pool: str, key: str, vector: str, threshold: float) -> DataFrame:
    """pool, key, cluster (the smallest key of its members)."""
    dealt = parts(vectors, pool, vector, threshold, key)
    kinds = dict(dealt.dtypes)

    def own(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable").reset_index(drop=True)
        named = part[key].copy()
        for members in merged_rows(part["_v"].to_list(), threshold)[1]:
            named.iloc[members] = part[key].iloc[min(members)]
        return pd.DataFrame({pool: part[pool], key: part[key], "cluster": named})

    joint = dealt.where("_part is not null").select(pool, key, "_part", "_v").groupBy(pool, "_part").applyInPandas(own, f"{pool} {kinds[pool]}, {key} {kinds[key]}, cluster {kinds[key]}")
    return joint.union(dealt.where("_part is null").select(pool, key, F.col(key).alias("cluster")))
