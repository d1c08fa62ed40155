"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into hash blocks; the quota of a source is a number of block copies, exact to the word at
its last block. The tree splits the quotas among output shards; each shard draws its own disjoint run of the permuted
blocks. Sources are collected (MAX_SOURCES at most, more raise), blocks are MAX_BLOCKS at most.

Defined results: null or empty text has size 0 and takes 0; null source is a source of its own, ordered last; a source
whose texts are all empty has target 0; repeated rows fall into one block and are taken like any other rows, ties in a
block going by doc_id and size; texts of any length count whole; null doc_ids are kept; an empty table gives no rows; a
column mix_shard of the input is replaced. A document of which the mix takes a part is copied whole by the pipeline.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import space_words, written
from .sharding import split_counts

BLOCK_DOCS, MAX_SOURCES, MAX_BLOCKS = 4096, 100_000, 1 << 16


def targets(sizes: list[float], weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Budget by weight, no source above `most` times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, budget = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if budget * w[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = budget * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        budget -= sum(out[i] for i in over)
        free -= over
    return out


def split_tree(rng: random.Random, quotas: list[int], shards: int) -> list[list[int]]:
    """Halve the shards again and again; each half gets its exact part of every quota."""
    if shards == 1:
        return [quotas]
    left, total = shards // 2, sum(quotas)
    a = split_counts(rng, quotas, total * left // shards)
    return split_tree(rng, a, left) + split_tree(rng, [q - x for q, x in zip(quotas, a)], shards - left)


def block_copies(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """blocks(sid, block, source_size, target, words) -> sid, block, words, extra, held: the shard of each copy.

    A source's copies are numbered round by round over its permuted blocks, the copies of the
    last, partial round after them; copy n belongs to the shard whose run of quotas holds n.
    """
    spark = blocks.sparkSession
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "block"), "block")
    cut = blocks.select(
        "sid", "block", "words", F.row_number().over(order).alias("at"), (F.sum("words").over(order) - F.col("words")).alias("before"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("rounds"),
        F.floor("target").alias("whole"), "source_size", F.count("*").over(Window.partitionBy("sid")).alias("n"),
    ).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("words"), F.col("whole") - F.col("rounds") * F.col("source_size") - F.col("before"))))
    cut = cut.withColumn("more", (F.col("extra") > 0).cast("int")).withColumn("more_at", F.sum("more").over(order))
    quotas = {r.sid: r.q for r in cut.groupBy("sid").agg(F.sum(F.col("rounds") + F.col("more")).alias("q")).collect()}
    sids = sorted(quotas)
    tree = split_tree(random.Random(seed), [quotas[i] for i in sids], shards)
    runs = spark.createDataFrame(
        [(i, list(accumulate(t[k] for t in tree))) for k, i in enumerate(sids)], "sid int, runs array<bigint>"
    )
    number = F.transform(
        F.array_repeat(F.lit(0), F.col("rounds") + F.col("more")),
        lambda _, c: F.when(c < F.col("rounds"), c * F.col("n") + F.col("at")).otherwise(F.col("rounds") * F.col("n") + F.col("more_at")),
    )
    held = F.transform(number, lambda k: F.size(F.filter("runs", lambda r: r < k)))
    return cut.join(F.broadcast(runs), "sid").select("sid", "block", "words", "extra", held.alias("held"))


def source_blocks(docs: DataFrame, seed: int) -> DataFrame:
    """Each row of docs (as `row`) with its size, its source's number and its hash block; a source has blocks by its row count."""
    spark = docs.sparkSession
    d = docs.select(
        F.struct("*").alias("row"), "doc_id", F.size(space_words(F.col("text"))).cast("long").alias("size"), F.col("source").alias("_src"),
        F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text").cast("binary"))).alias("h"),
    )
    per = docs.groupBy("source").count().limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per = sorted(per, key=lambda r: (r.source is None, (r.source or "").encode()))
    wanted = [max(16, -(-r["count"] // BLOCK_DOCS)) for r in per]
    share = min(1.0, MAX_BLOCKS / max(1, sum(wanted)))
    known = [(r.source, i, max(1, int(n * share))) for i, (r, n) in enumerate(zip(per, wanted))]
    facts = spark.createDataFrame(known, "src string, sid int, blocks int")
    b = d.join(F.broadcast(facts), F.col("_src").eqNullSafe(F.col("src")))
    return b.withColumn("block", F.pmod("h", F.col("blocks")).cast("int")).drop("_src", "src", "blocks")


def block_sizes(rows: DataFrame) -> DataFrame:
    """rows of source_blocks -> sid, block, words, source_size, target."""
    sums = written(rows.groupBy("sid", "block").agg(F.sum("size").alias("words")))
    per = sorted((r.sid, r.s) for r in sums.groupBy("sid").agg(F.sum("words").alias("s")).collect())
    goal = targets([s for _, s in per])
    facts = rows.sparkSession.createDataFrame([(i, s, g) for (i, s), g in zip(per, goal)], "sid int, source_size bigint, target double")
    return sums.join(F.broadcast(facts), "sid")


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 2) -> DataFrame:
    """row (all of a document's columns), doc_id, size, source_size, target, taken, mix_shards (the shard of each copy taken, whole or in part), mix_rank.

    The table of blocks has at most MAX_BLOCKS rows and one for each source more, so it is broadcast and no text is
    shuffled but those of each source's one block that is taken in part.
    """
    b = source_blocks(docs, seed)
    sums = block_sizes(b)
    held = written(block_copies(sums, shards, seed).join(sums.select("sid", "block", "source_size", "target"), ["sid", "block"]))
    edge = F.col("extra").between(F.lit(1), F.col("words") - 1)
    copies = F.size("held")
    plain = b.join(F.broadcast(held.where(~edge)), ["sid", "block"]).withColumn("part", F.lit(0).cast("long")).withColumn("whole", copies)
    within = Window.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed + 2), "h"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = b.join(F.broadcast(held.where(edge)), ["sid", "block"]).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.coalesce(F.sum("size").over(within), F.lit(0))))).withColumn("whole", copies - 1)
    n = F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("int")).otherwise(0)
    return plain.unionByName(part).select(
        "row", "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.slice("held", 1, n).alias("mix_shards"), F.xxhash64(F.lit(seed + 3), "h").alias("mix_rank"),
    )


def mix(docs: DataFrame, shards: int = 16, seed: int = 2) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, mix_shards, mix_rank."""
    return mixed_rows(docs, shards, seed).drop("row")


def apply_mix(docs: DataFrame) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, whole (a part counts as one), with each copy's mix_shard.

    Rows carry their own columns through the mix, so null and repeated doc_ids are taken like any other.
    """
    out = mixed_rows(docs.drop("mix_shard"))
    return out.select("row.*", F.explode("mix_shards").alias("mix_shard"))
