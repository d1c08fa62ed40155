"""Pool metrics over embedded items."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check

from . import clustering
from .clustering import counts, distance_matrix, labels, merged, merged_rows, merges_by_rounds, unit_rows

#: tasks that draw, or one a pool if these are more; partitions they are dealt to, at most
TASKS, MAX_TASKS = 64, 2000


def pool_diversity(vectors: DataFrame, pool: str, vector: str) -> DataFrame:
    """Mean pairwise cosine distance by the closed form 1 - (|sum u|^2 - n) / (n (n - 1)); no pairs are made.

    Unit vectors are summed by element, first in each task, so the plan is as small at any dimension; a null, zero or odd-sized vector raises; pools of one give no row.
    """
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    alike = F.lit("a pool's vectors have one length and are not zero")
    unit = F.when(F.col(vector).isNull() | F.coalesce(norm == 0, F.lit(True)), F.raise_error(alike).cast("array<double>")).otherwise(F.transform(v, lambda x: x / norm))
    sums = vectors.select(pool, F.posexplode(unit).alias("_k", "_x")).groupBy(pool, "_k").agg(F.sum("_x").alias("_s"), F.count("*").alias("_c"))
    out = sums.groupBy(pool).agg(F.max("_c").alias("n"), F.min("_c").alias("_least"), F.sum(F.col("_s") * F.col("_s")).alias("_square")).where("n >= 2")
    n = F.when(F.col("_least") != F.col("n"), F.raise_error(alike).cast("long")).otherwise(F.col("n"))
    return out.select(pool, n.alias("n"), "_square").select(pool, "n", (1 - (F.col("_square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def min_pool_size(vectors: DataFrame, pool: str) -> DataFrame:
    """One row: the size of the smallest pool."""
    return vectors.groupBy(pool).count().agg(F.min("count").alias("n"))


def average_linkage(d: np.ndarray, threshold: float) -> list[list[int]]:
    """Merge the closest pair (first in order on ties; a merged cluster goes last) until none is under the threshold."""
    return merged(d, threshold)[1]


def merge_heights(d: np.ndarray, stop: float) -> list[float]:
    """Heights under `stop` of average_linkage's merges; it never goes down, so clusters are points less the heights under a cut."""
    return merged(d, stop)[0]


def cluster_count(d: np.ndarray, threshold: float) -> int:
    return len(d) - len(merge_heights(d, threshold))


def distinct_k(vectors: DataFrame, pool: str, vector: str, threshold: float) -> DataFrame:
    """Semantic distinct count of each pool, of any size."""
    out = counts(vectors, pool, vector, [threshold])
    return out.select(pool, "n", F.col("k0").alias("k"), (1 - F.col("k0") / F.col("n")).alias("collapse_rate"))


def clusters(vectors: DataFrame, pool: str, key: str, vector: str, threshold: float) -> DataFrame:
    """pool, key, cluster: the smallest key of the cluster's members; pools of any size."""
    return labels(vectors, pool, key, vector, threshold)


def sensitivity(vectors: DataFrame, pool: str, vector: str, threshold: float, band: float = 0.05) -> DataFrame:
    """Distinct counts at the threshold and a band to each side (not under 0), from one dendrogram a part."""
    check(threshold >= 0 and band >= 0, f"threshold {threshold} and band {band} must not be negative")
    out = counts(vectors, pool, vector, [max(0.0, threshold - band), threshold, threshold + band])
    return out.select(pool, "n", F.col("k0").alias("k_low"), F.col("k1").alias("k"), F.col("k2").alias("k_high"))


def mulberry32_of(seeds, at: np.ndarray) -> np.ndarray:
    """Draws `at` (from 0) of the mulberry32 streams of the seeds, by the counter form."""
    mask = np.uint64(0xFFFFFFFF)
    a = (np.asarray(seeds).astype(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x6D2B79F5)) & mask
    t = ((a ^ a >> np.uint64(15)) * (a | np.uint64(1))) & mask
    t ^= (t + (((t ^ t >> np.uint64(7)) * (t | np.uint64(61))) & mask)) & mask
    return ((t ^ t >> np.uint64(14)) & mask) / 4294967296.0


def mulberry32_draws(seed: int, start: int, n: int) -> np.ndarray:
    """Draws start .. start + n - 1 of the mulberry32 stream."""
    return mulberry32_of(seed & 0xFFFFFFFF, np.arange(start, start + n, dtype=np.uint64))


def splice_draw(pool: int, draws: np.ndarray) -> list[int]:
    """Indices without replacement, in draw order; each draw points into what is left, in order."""
    left = list(range(pool))
    return [left.pop(int(u * len(left))) for u in draws]


def rarefied_k(
    vectors: DataFrame, pool: str, vector: str, size: int | None, threshold: float, rounds: int = 1000, seed: int = 20260901, order: str | None = None
) -> DataFrame:
    """Mean distinct count over seeded draws of `size` items (None: the smallest pool's) without replacement.

    Every pool restarts the seed; its items count in the order of the column `order`. A task takes one pool and an equal share
    of its draws, so a pool is copied TASKS / pools times, whatever the rounds. Draws are merged by rounds; one whose ties
    leave its count open is merged pair by pair, by the pool's matrix of distances up to clustering.MATRIX vectors.
    """
    kind, cols = dict(vectors.dtypes)[pool], [pool, vector] + ([order] if order else [])
    least, pools = vectors.groupBy(pool).count().agg(F.min("count"), F.count("*")).first()
    size, batches = size or least or 0, max(1, min(rounds, -(-TASKS // max(1, pools))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if order:
            g = g.sort_values(order, kind="stable")
        u, d, k = unit_rows(g[vector].to_list()), None, 0
        for r in range(int(g["_batch"].iloc[0]), rounds, batches):
            at = splice_draw(len(u), mulberry32_draws(seed, r * size, size))
            merges = merges_by_rounds(u[at], threshold)
            if merges is None and len(u) <= clustering.MATRIX:
                d = 1 - u @ u.T if d is None else d
                merges = len(merge_heights(d[np.ix_(at, at)], threshold))
            k += size - (len(merged_rows(list(u[at]), threshold)[0]) if merges is None else merges)
        return pd.DataFrame({pool: [g[pool].iloc[0]], "_k": [k]})

    dealt = vectors.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("_batch"))
    dealt = dealt.repartition(min(MAX_TASKS, max(1, 4 * pools * batches)), pool, "_batch")  # few bytes but long tasks: not to be coalesced
    sums = dealt.groupBy(pool, "_batch").applyInPandas(run, f"{pool} {kind}, _k long")
    return sums.groupBy(pool).agg((F.sum("_k") / rounds).alias("mean_k"))
