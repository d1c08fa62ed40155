"""Whole steps of a run: plan and price, measure cells, control the embedder, validate a judge; `pruning` has the store's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check
from poolstat.functions.keys import poly31

from . import judging, pricing, thresholds
from .joins import reuse, stale, todo
from .vectors import distinct_k, pool_diversity


@dataclass
class Plan:
    todo: DataFrame
    reuse: DataFrame
    stale: DataFrame
    projection: DataFrame


def plan_and_price(cells: DataFrame, stored: DataFrame, arms: DataFrame, rates: DataFrame, fitted: DataFrame | None = None) -> Plan:
    """cells and stored(key, arm, brief, replicate, cfg) -> what is to do, what is stored, what is stored under another configuration, and the price of the first."""
    left = todo(cells, stored, ["key"])
    return Plan(left, reuse(cells, stored, ["key"]), stale(left, stored.drop("key"), ["arm", "brief", "replicate"], "cfg"), pricing.price_grid(left.withColumn("cell_key", F.col("key")), arms, rates, fitted))


def structural_grid(cells: DataFrame, arms: DataFrame, rates: DataFrame, batch: bool = True) -> DataFrame:
    """The older estimate: plan tokens spread evenly over slots, efforts aside, one discount for all."""
    even = arms.withColumn("slots", F.transform("slots", lambda s: F.struct(s["model"].alias("model"), F.lit("high").alias("effort"))))
    return pricing.price_grid(cells, even, rates.withColumn("batch_discount", F.lit(pricing.BATCH_DISCOUNT)), None, batch).drop("usd_high", "calibrated")


def cell_metrics(vectors: DataFrame, cell: str, vector: str, threshold: float) -> DataFrame:
    """cell, n, distinct_k, pool_diversity (null for one candidate), collapse_rate, fluency, flexibility."""
    k = distinct_k(vectors, cell, vector, threshold).select(cell, "n", F.col("k").alias("distinct_k"), "collapse_rate")
    d = pool_diversity(vectors, cell, vector).select(cell, F.col("diversity").alias("pool_diversity"))
    return k.join(d, cell, "left").withColumn("fluency", F.col("n")).withColumn("flexibility", F.col("distinct_k"))


def phase0(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors(pool, vector) with pools low, average, high, duplicate and random -> one row: the ordering, and both controls' verdicts."""
    d = pool_diversity(vectors, "pool", "vector")
    k = distinct_k(vectors.where(F.col("pool").isin("duplicate", "random")), "pool", "vector", threshold)
    control = thresholds.ordering_control(d, "pool", "diversity")
    of = lambda t, pool, c: t.where(F.col("pool") == pool).select(F.col(c).alias(f"{pool}_{c}"))
    parts = [of(d, "duplicate", "diversity"), of(d, "random", "diversity"), of(k, "duplicate", "k"), of(k, "random", "k"), of(k, "random", "n")]
    for p in parts:
        control = control.crossJoin(p)  # one row each
    control = control.withColumn("copies_pass", thresholds.duplicate_verdict(F.col("duplicate_k"), F.col("duplicate_diversity")))
    verdict = thresholds.random_verdict(F.col("random_k"), F.col("random_n"), F.col("random_diversity"), F.col("high"), F.col("ordered"))
    return control.withColumn("floor", verdict["floor"]).withColumn("failed", ~F.col("copies_pass") | verdict["failed"])


def validation_requests(ideas: DataFrame, seed: int = 1) -> DataFrame:
    """ideas(idea, topic, text) -> one row a topic: its seed and candidates in order; an idea without topic or text is refused."""
    bad = (F.trim(F.coalesce("topic", F.lit(""))) == "") | (F.trim(F.coalesce("text", F.lit(""))) == "")
    own = ideas.withColumn("topic", F.when(bad, F.raise_error(F.lit("an idea without topic or text")).cast("string")).otherwise(F.col("topic")))
    listed = F.array_sort(F.collect_list(F.struct("idea", "text")))
    out = own.groupBy("topic").agg(F.transform(listed, lambda x: x["text"]).alias("candidates"), F.transform(listed, lambda x: x["idea"]).alias("ideas"))
    return out.withColumn("seed", F.lit(seed).cast("long").bitwiseXOR(poly31(F.col("topic"))))


def judge_validation(ideas: DataFrame, replies: DataFrame, axis: str, floor: float = judging.ACCURACY_FLOOR) -> DataFrame:
    """ideas(idea, expert_scores), replies(idea, originality, feasibility) -> the gate's row over all ideas; every idea needs a reply."""
    lost = ideas.join(replies, "idea", "left_anti")
    check(lost.isEmpty(), f"ideas without a score: {[r['idea'] for r in lost.limit(5).collect()]}")
    empty = F.size("expert_scores") == 0
    mean = F.when(empty, F.raise_error(F.lit("an idea without expert scores")).cast("double")).otherwise(F.aggregate("expert_scores", F.lit(0.0), lambda a, x: a + x) / F.size("expert_scores"))
    rows = ideas.join(replies, "idea").select(F.lit(axis).alias("axis"), "idea", mean.alias("expert"), F.col(axis).alias("judge"))
    return judging.gate(rows, ["axis"], "judge", "expert", "idea", floor)
