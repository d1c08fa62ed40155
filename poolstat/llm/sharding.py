"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by hash; a matrix of exact block-to-shard counts is drawn (its row sums
are the block sizes, its column sums the shard sizes); each block is permuted and cut by its
matrix row; each shard is permuted again. Blocks are at most MAX_BLOCKS, so the matrix that the driver draws is of
bounded size. Defined results: null text has size 1 and null crc; rows that are equal in doc_id, text, source and lang
are interchangeable and fall into one block; an empty table gives no rows; columns shard and slot of the input are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: rows in sixteen blocks while there are few; blocks at most, so that the matrix is of bounded size
BLOCK_ROWS, MAX_BLOCKS = 100_000, 2048


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw by inversion outward from the mode: O(standard deviation) steps."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up = down = mode
    pu = pd = p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def split_counts(rng: random.Random, counts: list[int], draws: int) -> list[int]:
    """Multivariate hypergeometric: how many of `draws` come from each of `counts`."""
    out, left = [], sum(counts)
    for n in counts:
        left -= n
        out.append(hypergeometric(rng, n, left, draws))
        draws -= out[-1]
    return out


def matrix(seed: int, blocks: list[int], shards: int) -> list[list[int]]:
    rng, total = random.Random(seed), sum(blocks)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in blocks:
        row = split_counts(rng, room, n)
        room = [r - x for r, x in zip(room, row)]
        out.append(row)
    return out


def shard(docs: DataFrame, shards: int = 16, seed: int = 10) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard); shard counts are at most one apart.

    Carries the columns it is given through two exchanges: give it ids, and join texts on them.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = [c for c in ("doc_id", "text_crc32", "size", "source", "lang") if c in docs.columns]
    own = [f"_row.{c}" for c in names]
    n = docs.count()
    parts = min(MAX_BLOCKS, max(1, math.ceil(n / BLOCK_ROWS)) * 16)
    whole = docs.select(F.struct("*").alias("_row"))
    keyed = whole.withColumn("_h", F.xxhash64(F.lit(seed), *own)).withColumn("_b", F.pmod("_h", F.lit(parts)).cast("int"))
    sizes = dict(keyed.groupBy("_b").count().collect())  # one number per block, MAX_BLOCKS at most
    drawn = matrix(seed, [sizes.get(b, 0) for b in range(parts)], shards)
    bounds = spark.createDataFrame(
        [(b, [sum(row[: s + 1]) for s in range(shards)]) for b, row in enumerate(drawn)], "_b int, _cut array<bigint>"
    )
    local = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), "_h"), *own)
    placed = (
        keyed.withColumn("_r", F.row_number().over(local)).join(bounds, "_b")
        .withColumn("shard", F.size(F.filter("_cut", lambda c: c < F.col("_r"))))
        .withColumn("_g", F.xxhash64(F.lit(seed + 2), "_h"))
        .withColumn("_q", F.shiftrightunsigned("_g", 40) * parts / (1 << 24)).withColumn("_q", F.col("_q").cast("int"))
        .drop("_cut", "_r", "_b")
    )
    # the second permutation is by hash order: hash ranges within a shard, ranked apart, offset by counts before
    ranges = placed.groupBy("shard", "_q").count()
    before = ranges.select("shard", "_q", (F.sum("count").over(Window.partitionBy("shard").orderBy("_q")) - F.col("count")).alias("_o"))
    inner = Window.partitionBy("shard", "_q").orderBy("_g", "_h", *own)
    return (
        placed.withColumn("_r", F.row_number().over(inner)).join(before, ["shard", "_q"])
        .withColumn("slot", F.col("_o") + F.col("_r") - 1)
        .select("_row.*", "shard", "slot")
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32 of each document, with source and lang for ties."""
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "source", "lang",
    )


def op10(docs: DataFrame) -> DataFrame:
    return shard(digest(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
