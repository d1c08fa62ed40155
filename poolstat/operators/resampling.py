"""Cluster bootstrap of ratios and rarefied frames, on the counter form of the seeded generator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.errors import MixedPoolCoverage, PoolsUnavailable, check
from poolstat.functions.keys import mulberry32_at

from .frame import Frame
from .vectors import distinct_k, rarefied_k

ITERATIONS, LEVEL, SEED = 2000, 0.95, 1
# What each pool metric does under rarefaction.
TREATMENT = {
    "distinct_k": "rarefied", "poolFlexibility": "rarefied", "poolFluency": "excluded-full-pool-descriptive",
    "collapseRate": "excluded-full-pool-descriptive", "poolDiversity": "full-pool", "distinctKPerDollar": "full-pool-self-correcting",
}


def bootstrap_ratio(rows: DataFrame, arm: str, brief: str, response: str, cost: str, key: str, iterations: int = ITERATIONS, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """arm, ratio of sums, and its percentile interval over resampled briefs; each arm restarts the seed.

    Briefs count in order of first appearance by key. Rows are reduced to one pair of sums for each brief before
    any draw, so a draw joins arms x briefs lines; a cost that is not positive is refused.
    """
    per = rows.groupBy(arm, brief).agg(F.sum(response).alias("_r"), F.sum(cost).alias("_c"), F.min(key).alias("_k"))
    per = per.withColumn("_i", F.row_number().over(Window.partitionBy(arm).orderBy("_k")) - 1).withColumn("_b", F.count("*").over(Window.partitionBy(arm)))
    draws = per.groupBy(arm).agg(F.max("_b").alias("_b")).select(arm, "_b", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_it"))
    draws = draws.select(arm, "_b", "_it", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)).alias("_n"))
    u = mulberry32_at(F.lit(seed), F.col("_it").cast("long") * F.col("_b") + F.col("_n"))
    picked = draws.withColumn("_i", F.floor(u * F.col("_b")).cast("int")).select(arm, "_it", "_i").join(per.select(arm, "_i", "_r", "_c"), [arm, "_i"])
    refuse = lambda r, c: F.when(c <= 0, F.raise_error(F.lit("total cost is not positive")).cast("double")).otherwise(r / c)
    samples = picked.groupBy(arm, "_it").agg(refuse(F.sum("_r"), F.sum("_c")).alias("_q"))
    alpha = 1 - level
    low, high = max(0, int(alpha / 2 * iterations // 1)), min(iterations - 1, -int(-(1 - alpha / 2) * iterations // 1) - 1)
    ordered = samples.groupBy(arm).agg(F.sort_array(F.collect_list("_q")).alias("_s"))  # `iterations` numbers an arm
    whole = per.groupBy(arm).agg(refuse(F.sum("_r"), F.sum("_c")).alias("ratio"))
    return whole.join(ordered, arm).select(arm, "ratio", F.get("_s", F.lit(low)).alias("ci_lower"), F.get("_s", F.lit(high)).alias("ci_upper"))


def cost_lane(frame: Frame, seed: int = SEED, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(arm means with their place on the Pareto frontier, ratios with intervals), on full pools only."""
    from .aggregates import summarize_by_arm
    from .joins import on_frontier

    check(not frame.rarefied, "the cost lane is registered on full pools; a rarefied frame is refused")
    check(not frame.rows.isEmpty(), "no rows for a cost lane")
    means = summarize_by_arm(frame.rows)
    return on_frontier(means, "mean_cost", "mean_response"), bootstrap_ratio(frame.rows, "arm", "brief", "response", "cost", "key", iterations, seed=seed)


def rarefied_frame(frame: Frame, vectors: DataFrame, arms: list[str], threshold: float, metric: str = "distinct_k", rounds: int = 1000, seed: int = 20260901) -> Frame:
    """The contrast's rows with their distinct count rarefied to the smallest pool; vectors(key, position, vector).

    All rows must have pools (none at all is its own refusal), and the full pool's count must be the stored response.
    """
    check(len(arms) >= 2, f"a contrast has two arms or more, got {arms}")
    check(TREATMENT.get(metric) == "rarefied", f"{metric} is {TREATMENT.get(metric, 'unknown')}, not rarefied")
    rows = frame.rows.where(F.col("arm").isin(arms))
    check(not rows.isEmpty(), f"no row of {arms}")
    own = vectors.join(rows.select("key"), "key", "left_semi")
    bare = rows.join(own, "key", "left_anti").select("key")
    if not bare.isEmpty():
        check(not own.isEmpty(), f"no pools for {arms}", PoolsUnavailable)
        raise MixedPoolCoverage(f"some rows of {arms} have no pool: {[r['key'] for r in bare.limit(5).collect()]}")
    full = distinct_k(own, "key", "vector", threshold).select("key", F.col("k").alias("_k"), F.col("n").alias("pool_size"))
    mean = rarefied_k(own, "key", "vector", None, threshold, rounds, seed, order="position")
    least = full.agg(F.min("pool_size")).first()[0]
    same = F.when(F.abs(F.col("_k") - F.col("response")) > 1e-9, F.raise_error(F.concat(F.lit("stored and recomputed counts differ: "), F.col("key"))).cast("double")).otherwise(F.col("response"))
    out = rows.join(full, "key").join(mean, "key").withColumn("response_full_pool", same).withColumn("response", F.col("mean_k")).withColumn("rarefied_n", F.lit(least)).drop("_k", "mean_k")
    return replace(frame, rows=out, arms=[a for a in frame.arms if a in arms], response=f"{metric}_rarefied", rarefied=True)
