"""Grouped and global aggregates over cells(arm, brief, replicate, response, cost) and attempt rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize_by_arm(cells: DataFrame) -> DataFrame:
    return cells.groupBy("arm").agg(F.count("*").alias("n"), F.avg("response").alias("mean_response"), F.avg("cost").alias("mean_cost"))


def tally_states(rows: DataFrame, cfg: str, state: str) -> DataFrame:
    """Rows and distinct sorted states of each configuration."""
    return rows.groupBy(F.col(cfg).alias("cfg")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(state)), ",").alias("states"))


def reconcile(rows: DataFrame, state: str, completed: str, failed: str, skipped: str) -> DataFrame:
    is_ = lambda v: F.count_if(F.col(state) == v)
    return rows.agg(F.count("*").alias("planned"), is_(completed).alias("completed"), is_(failed).alias("failed"), is_(skipped).alias("skipped"))


def failure_rate(rows: DataFrame, key: str, state: str, failed: str) -> DataFrame:
    """Failures over all planned rows."""
    return rows.groupBy(key).agg(F.avg(F.coalesce((F.col(state) == failed).cast("double"), F.lit(0.0))).alias("rate"))


def latency_percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p95."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return rows.groupBy(key).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def cost_diversity_ratio(cells: DataFrame) -> DataFrame:
    """Ratio of sums, not mean of ratios."""
    return cells.groupBy("arm").agg((F.sum("response") / F.sum("cost")).alias("ratio"))


def latest_record(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The record with the largest order in each key, and the next attempt's number."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias("latest"), (F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_attempt"))


def two_level_mean(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Sum within inner groups, mean over them."""
    return rows.groupBy(outer, inner).agg(F.sum(value).alias("s")).groupBy(outer).agg(F.avg("s").alias("mean_sum"))


def pooled_within_cell_variance(cells: DataFrame) -> DataFrame:
    """Sum of squares within (arm, brief) over its degrees of freedom; singletons give none."""
    g = cells.groupBy("arm", "brief").agg(F.count("response").alias("n"), F.var_samp("response").alias("v")).where("n > 1")
    return g.agg((F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("variance"), F.sum(F.col("n") - 1).alias("df"))


def anova_means(cells: DataFrame) -> DataFrame:
    """Cell, arm, brief and grand means: rows are summed by cell first, the cube adds up cells."""
    own = cells.groupBy("arm", "brief").agg(F.count("*").alias("_n"), F.sum("response").alias("_t"), F.count("response").alias("_m"))
    return own.cube("arm", "brief").agg(F.sum("_n").alias("n"), (F.sum("_t") / F.sum("_m")).alias("mean"))


def over_retention(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    return rows.groupBy(*keys).count().where(F.col("count") > most).groupBy(keys[0]).agg(F.count("*").alias("groups_over"))


def top_k_sum(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Worst case of k rows in flight."""
    return rows.orderBy(F.desc(value)).limit(k).agg(F.sum(value).alias("worst"))
