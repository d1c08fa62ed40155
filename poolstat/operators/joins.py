"""Planning, pricing and dominance joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import large_groups, with_ranges


def plan_cells(arms: DataFrame, briefs: DataFrame, replicates: int) -> DataFrame:
    """arms x briefs x replicates; the grid is what is asked for, so the product is its size."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    return arms.join(briefs, how="cross").select("*", reps)


def reuse(plan: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    return plan.join(stored, key, "left_semi")


def todo(plan: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    return plan.join(stored, key, "left_anti")


def stale(todo_rows: DataFrame, stored: DataFrame, key: list[str], cfg: str) -> DataFrame:
    """Rows to do that are stored under another configuration."""
    other = stored.select(*key, F.col(cfg).alias("stored_cfg"))
    return todo_rows.join(other, key).where(F.col(cfg) != F.col("stored_cfg"))


def price(ledger: DataFrame, rates: DataFrame, on: str, day: str) -> DataFrame:
    """Rate by model, intro rate up to and on intro_until; a missing rate is flagged, not dropped."""
    usd = F.when(F.col(day) <= F.col("intro_until"), F.col("intro_rate")).otherwise(F.col("rate"))
    return ledger.join(rates, on, "left").withColumn("usd", F.col("tokens") * usd).withColumn("missing", F.col("rate").isNull())


def on_frontier(points: DataFrame, cost: str, value: str) -> DataFrame:
    """Points with `on_frontier`: false where another is cheaper or equal and better or equal, one of them strictly.

    Costs are reduced to their best value; ranges of costs (`with_ranges`) carry the best of the ranges before them.
    """
    best = points.groupBy(cost).agg(F.max(value).alias("_best"))
    earlier = (Window.unboundedPreceding, -1)
    large = large_groups(best, [])
    if large:
        best = with_ranges(best, [], cost, large)
        tops = best.groupBy("_q").agg(F.max("_best").alias("_top"))  # one row a range
        lower = tops.withColumn("_lower", F.max("_top").over(Window.orderBy("_q").rowsBetween(*earlier))).drop("_top")
        local = best.withColumn("_prior", F.max("_best").over(Window.partitionBy("_q").orderBy(cost).rowsBetween(*earlier)))
        front = local.join(F.broadcast(lower), "_q").withColumn("_prior", F.greatest("_prior", "_lower")).drop("_q", "_lower")
    else:
        front = best.withColumn("_prior", F.max("_best").over(Window.orderBy(cost).rowsBetween(*earlier)))  # SPLIT_ROWS at most
    return points.join(front, cost).withColumn("on_frontier", (F.col(value) == F.col("_best")) & (F.col("_prior").isNull() | (F.col("_best") > F.col("_prior")))).drop("_best", "_prior")


def pareto_frontier(points: DataFrame, cost: str, value: str) -> DataFrame:
    """Points no other dominates."""
    return on_frontier(points, cost, value).where("on_frontier").drop("on_frontier")
