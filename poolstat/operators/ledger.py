"""Accounts of runs, attempt records, and the retention of what failed runs leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.errors import check
from poolstat.functions.keys import parse_attempt_key
from poolstat.functions.text import FAILURE_KINDS, reason_category

# Attempt families and how many records of each cell are kept.
ATTEMPTS = ["generation-attempt", "metrics-attempt", "judge-call", "pruned-cell"]
REPLAY = "batch-replay"
KEEP_ATTEMPTS, KEEP_REPLAYS = 5, 1


def account(planned: DataFrame, states: DataFrame) -> DataFrame:
    """planned(key), states(key, state, kind, detail) joined: every planned key has exactly one known terminal state.

    Unplanned, repeated, unclassified or missing states are refused.
    """
    missing = planned.join(states, "key", "left_anti")
    check(missing.isEmpty(), f"no terminal state: {[r['key'] for r in missing.limit(5).collect()]}")
    unplanned = states.join(planned, "key", "left_anti")
    check(unplanned.isEmpty(), f"never planned: {[r['key'] for r in unplanned.limit(5).collect()]}")
    twice = states.groupBy("key").count().where("count > 1")
    check(twice.isEmpty(), f"several terminal states: {[r['key'] for r in twice.limit(5).collect()]}")
    bad = states.where(~F.coalesce(F.col("state").isin("completed", "failed", "skipped"), F.lit(False)) | ((F.col("state") == "failed") & ~F.coalesce(F.col("kind").isin(FAILURE_KINDS), F.lit(False))))
    check(bad.isEmpty(), f"unknown state or kind: {[(r['key'], r['state'], r['kind']) for r in bad.limit(5).collect()]}")
    return planned.select("key").join(states, "key")


def summary(states: DataFrame) -> DataFrame:
    """One row: planned, completed, failed, skipped."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(F.count("*").alias("planned"), n("completed"), n("failed"), n("skipped"))


def by_kind(states: DataFrame) -> DataFrame:
    return states.where("state = 'failed'").groupBy("kind").agg(F.count("*").alias("n"))


def skipped_by_reason(states: DataFrame) -> DataFrame:
    """Skips by the text before the first colon of their detail."""
    return states.where("state = 'skipped'").groupBy(reason_category(F.col("detail")).alias("reason")).agg(F.count("*").alias("n"))


def operational_summary(states: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Parse-failure, empty-pool and refusal rates over all planned rows; nearest-rank latencies over completed ones."""
    rate = lambda k: F.avg(F.coalesce(((F.col("state") == "failed") & (F.col("kind") == k)).cast("double"), F.lit(0.0)))
    ms = F.when(F.col("state") == "completed", F.when(F.col(latency).isNull(), F.raise_error(F.lit("a completed row has no latency")).cast("double")).otherwise(F.col(latency)))
    rows = states.withColumn("_ms", ms)
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by _ms)")
    return rows.agg(rate("parse_failure").alias("parse_failure_rate"), rate("empty_pool").alias("empty_pool_rate"), rate("refusal").alias("refusal_rate"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.count("_ms").alias("n"))


def attempts(keys: DataFrame) -> DataFrame:
    """Records whose key is an attempt, with family, cell, through and compacted."""
    parsed = keys.withColumn("_a", parse_attempt_key(F.col("key"), [*ATTEMPTS, REPLAY])).where("_a is not null")
    return parsed.select("*", "_a.*").drop("_a")


def next_attempt(records: DataFrame) -> DataFrame:
    """family, cell, and one more than the largest number there."""
    return records.groupBy("family", "cell").agg((F.max("through") + 1).alias("next_attempt"))


def resume_state(records: DataFrame, lever: str) -> DataFrame:
    """The newest replay record of each cell, if it is not retired and was priced alike."""
    newest = records.where(F.col("family") == REPLAY).groupBy("cell").agg(F.max_by(F.struct("key", "through", "retired", "lever"), "through").alias("r")).select("cell", "r.*")
    return newest.where(~F.coalesce("retired", F.lit(False)) & (F.col("lever") == lever))


def contributing(records: DataFrame) -> DataFrame:
    """Records whose spend counts: the top compacted one of a family and cell, and the raw ones after it."""
    top = records.groupBy("family", "cell").agg(F.max(F.when(F.col("compacted"), F.col("through"))).alias("_top"))
    own = records.join(top, ["family", "cell"])
    return own.where(F.col("_top").isNull() | (F.col("through") > F.col("_top")) | (F.col("compacted") & (F.col("through") == F.col("_top")))).drop("_top")


def prune_plan(records: DataFrame, keep: int = KEEP_ATTEMPTS, keep_replays: int = KEEP_REPLAYS) -> DataFrame:
    """`keep` for the newest records of each family and cell (compacted before raw at one number), else `evict`."""
    newest = Window.partitionBy("family", "cell").orderBy(F.desc("through"), F.col("compacted").cast("int"))
    limit = F.when(F.col("family") == REPLAY, keep_replays).otherwise(keep)
    return records.withColumn("_r", F.row_number().over(newest)).withColumn("action", F.when(F.col("_r") <= limit, "keep").otherwise("evict")).drop("_r")


def compacted_ledger(evicted: DataFrame, lines: DataFrame) -> DataFrame:
    """One compacted record for each family and cell whose raw records go: their tokens by model, up to the last number."""
    rows = lines.join(contributing(evicted).select("key", "family", "cell"), "key")
    per = rows.groupBy("family", "cell", "model", "billing_mode", "pricing_regime").agg(*[F.sum(t).alias(t) for t in ("input_tokens", "output_tokens")], F.max("timestamp").alias("timestamp"))
    return per.join(evicted.groupBy("family", "cell").agg(F.max("through").alias("through")), ["family", "cell"])


def salvaged_spend(evicted: DataFrame, kept: DataFrame) -> DataFrame:
    """Ledger rows of evicted cells that were not salvaged before, told by the time they were stored."""
    return evicted.join(kept.select("cell", "pruned_from"), (evicted["cell"] == kept["cell"]) & (evicted["stored_at"] == kept["pruned_from"]), "left_anti")


def usage_sums(usage: DataFrame, *by: str) -> DataFrame:
    """Token sums of replies; either vendor's field names count, cache fields only where they are not zero."""
    have = set(usage.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(0))
    cache = lambda n: F.sum(F.when(F.col(n) != 0, F.col(n))) if n in have else F.lit(None).cast("long")
    return usage.groupBy(*by).agg(
        F.sum(first("input_tokens", "prompt_tokens")).alias("input_tokens"), F.sum(first("output_tokens", "completion_tokens")).alias("output_tokens"),
        cache("cache_read_input_tokens").alias("cache_read_input_tokens"), cache("cache_creation_input_tokens").alias("cache_creation_input_tokens"),
    )


def replies_to_requests(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """requests(custom_id, ...), lines(line) of a batch's JSONL -> each request with its reply; a request without one is a transport error.

    Unreadable lines and replies to nothing are ignored; of several replies to one id the largest text counts.
    """
    parsed = lines.select(F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.text").alias("text"), F.get_json_object("line", "$.error").alias("error"))
    one = parsed.where("custom_id is not null").groupBy("custom_id").agg(F.max(F.struct("text", "error")).alias("r")).select("custom_id", "r.*")
    kind = F.when(F.col("text").isNotNull() & F.col("error").isNull(), F.lit(None)).otherwise("transport_error")
    return requests.join(one, "custom_id", "left").withColumn("failure_kind", kind)
