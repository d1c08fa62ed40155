"""Records a run appends to its store, as tables ready for `sources.store.put`: key, family columns, state, and the body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check
from poolstat.functions.keys import attempt_key, judge_scores_key, validation_key
from poolstat.functions.text import AXES, FAILURE_KINDS

from .ledger import REPLAY, attempts, next_attempt


def _finished(rows: DataFrame, key: Column, state: Column, arm: str, brief: Column, cfg: Column, result: Column, kind: Column | None = None, detail: Column | None = None, cost_rows: Column | None = None) -> DataFrame:
    """key, state, arm, brief, replicate, cfg and body (JSON of key, result, accounting, cost rows)."""
    none = F.lit(None).cast("string")
    accounting = F.struct(state.alias("state"), (none if kind is None else kind).alias("kind"), (none if detail is None else detail).alias("detail"))
    body = F.to_json(F.struct(key.alias("key"), result.alias("result"), accounting.alias("accounting"), (F.array() if cost_rows is None else cost_rows).alias("costRows")))
    return rows.select(key.alias("key"), state.alias("state"), F.lit(arm).alias("arm"), brief.alias("brief"), F.lit(0).cast("long").alias("replicate"), cfg.alias("cfg"), body.alias("body"))


def judge_scores(rows: DataFrame) -> DataFrame:
    """rows(pool, judge, judge_provider, scores): a score without both axes is refused."""
    for a in AXES:
        whole = F.forall("scores", lambda s: s[a].isNotNull())  # noqa: B023
        rows = rows.withColumn("scores", F.when(whole, F.col("scores")).otherwise(F.raise_error(F.lit(f"a score without {a}"))))
    result = F.struct(F.lit("judge-scores").alias("kind"), F.col("pool").alias("poolKey"), F.col("judge").alias("judgeModel"), F.col("judge_provider").alias("judgeProvider"), "scores")
    return _finished(rows, judge_scores_key(F.col("pool"), F.col("judge")), F.lit("completed"), "__judge-scores__", F.col("pool"), F.col("judge"), result)


def validations(rows: DataFrame) -> DataFrame:
    """rows(judge_hash, request_hash, slice_id, accuracy, floor, verdict, n, rho): verdicts other than pass and drop, and missing figures, are refused."""
    bad = ~F.coalesce(F.col("verdict").isin("pass", "drop"), F.lit(False)) | F.col("accuracy").isNull() | F.isnan("accuracy") | ~F.coalesce(F.col("n") > 0, F.lit(False)) | (F.coalesce("request_hash", F.lit("")) == "")
    rows = rows.withColumn("verdict", F.when(bad, F.raise_error(F.lit("incomplete validation")).cast("string")).otherwise(F.col("verdict")))
    result = F.struct(F.lit("judge-validation").alias("kind"), "accuracy", "floor", "verdict", "n", "rho", F.col("request_hash").alias("judgeRequestHash"))
    return _finished(rows, validation_key(F.col("judge_hash"), F.col("slice_id"), F.col("request_hash")), F.lit("completed"), "__judge-validation__", F.col("slice_id"), F.col("judge_hash"), result)


def _numbered(rows: DataFrame, stored: DataFrame, family: str) -> DataFrame:
    """rows with `attempt`: one more than the largest stored number of their cell in the family."""
    parsed = attempts(stored.select("key"))
    own = next_attempt(parsed.where(F.col("family") == family)).select("cell", F.col("next_attempt").alias("attempt"))
    return rows.join(own, "cell", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0).cast("long")))


def failed_attempts(rows: DataFrame, stored: DataFrame, family: str = "generation-attempt") -> DataFrame:
    """rows(cell, cfg, kind, detail, cost_rows) of failures whose spend is kept under the cell's next attempt; unknown kinds are refused."""
    check(family in ("generation-attempt", "metrics-attempt"), f"no failures are kept under {family!r}")
    kind = F.lit("harness_error") if family == "metrics-attempt" else F.when(F.col("kind").isin(FAILURE_KINDS), F.col("kind")).otherwise(F.raise_error(F.lit("unknown failure kind")).cast("string"))
    own = _numbered(rows, stored, family)
    result = F.struct(F.lit(family).alias("kind"), F.col("cell").alias("cellKey"), "attempt", "detail")
    return _finished(own, attempt_key(F.lit(family), F.col("cell"), F.col("attempt")), F.lit("failed"), f"__{family}__", F.col("cell"), F.col("cfg"), result, kind, F.col("detail"), F.col("cost_rows"))


def judge_calls(rows: DataFrame, stored: DataFrame, mode: str = "batch") -> DataFrame:
    """rows(pool, judge, timestamp, input_tokens, output_tokens): one ledger row under the next call of a pool and judge."""
    check(mode in ("batch", "single"), f"mode is batch or single, got {mode!r}")
    own = _numbered(rows.withColumn("cell", F.concat(F.col("pool"), F.lit("|judge="), F.col("judge"))), stored, "judge-call")
    line = F.struct(F.col("pool").alias("cell_key"), "timestamp", F.lit("api").alias("billing_mode"), F.lit(mode).alias("pricing_regime"), F.col("judge").alias("model"), "input_tokens", "output_tokens")
    result = F.struct(F.lit("judge-call").alias("kind"), F.col("pool").alias("cellKey"), F.col("judge").alias("judgeModel"), "attempt")
    return _finished(own, attempt_key(F.lit("judge-call"), F.col("cell"), F.col("attempt")), F.lit("completed"), "__judge-call__", F.col("pool"), F.col("judge"), result, cost_rows=F.array(line))


def resume_records(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows(cell, cfg, lever, retired, replies, outstanding): resumable state; rows with neither replies nor outstanding requests are skipped."""
    own = _numbered(rows.where((F.size("replies") > 0) | (F.size("outstanding") > 0)), stored, REPLAY)
    lever = F.when(F.col("lever").isin("batch", "single"), F.col("lever")).otherwise(F.raise_error(F.lit("a resume record needs its pricing lever")).cast("string"))
    result = F.struct(F.lit(REPLAY).alias("kind"), F.col("cell").alias("cellKey"), "attempt", "retired", lever.alias("pricingLever"), "replies", "outstanding")
    return _finished(own, attempt_key(F.lit(REPLAY), F.col("cell"), F.col("attempt")), F.lit("skipped"), "__batch-replay__", F.col("cell"), F.col("cfg"), result, F.lit(REPLAY))


def cost_rows_for(cell: Column, timestamp: Column, regime: Column, tokens: Column) -> Column:
    """A ledger row of a reply's tokens, or none where it has no model."""
    row = F.struct(cell.alias("cell_key"), timestamp.alias("timestamp"), F.lit("api").alias("billing_mode"), regime.alias("pricing_regime"), tokens["model"].alias("model"), tokens["input_tokens"].alias("input_tokens"), tokens["output_tokens"].alias("output_tokens"))
    return F.filter(F.array(row), lambda r: F.coalesce(r["model"], F.lit("")) != "")


def agent_counts(attempted: Column, failed: Column) -> Column:
    """struct(attempted, failed, realized), null where the counts make no sense."""
    ok = (attempted >= 0) & (failed >= 0) & (failed <= attempted)
    return F.when(ok, F.struct(attempted.alias("attempted"), failed.alias("failed"), (attempted - failed).alias("realized")))


def pricing_lever(batch: Column) -> Column:
    return F.when(batch, "batch").otherwise("single")


def valid_responses(rows: DataFrame) -> DataFrame:
    """rows(state, kind): a provider answers completed or failed, a failure with a known kind; anything else raises."""
    ok = (F.col("state") == "completed") | ((F.col("state") == "failed") & F.col("kind").isin(FAILURE_KINDS))
    return rows.withColumn("state", F.when(F.coalesce(ok, F.lit(False)), F.col("state")).otherwise(F.raise_error(F.lit("not a provider's answer")).cast("string")))
