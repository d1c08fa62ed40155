"""The analysis frame: stored records, priced and split into completed, failed, skipped and stale rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.errors import AmbiguousStoredConfig, DifferentialAttrition, NoCellsSelected, NoStoredConfig, UnknownStoredConfig, check
from poolstat.functions.keys import is_study_cell_key

from .pricing import price_rows


@dataclass
class Frame:
    rows: DataFrame
    excluded: DataFrame
    arms: list[str]
    briefs: list[str]
    configs: list[str]
    response: str = "response"
    rarefied: bool = False


def get_path(column: str, path: str) -> Column:
    """Null-safe nested field by a dotted path."""
    return F.col(f"{column}.{path}" if path else column)


def bucketed(records: DataFrame, configs: list[str]) -> DataFrame:
    """records(key, cfg, state, ...) with `bucket`: stale, other (no study cell), failed, skipped, completed; an unknown state raises."""
    own = F.col("cfg").isin(configs)
    bad = F.raise_error(F.concat(F.lit("unknown state of "), F.col("key"), F.lit(": "), F.coalesce("state", F.lit("null")))).cast("string")
    state = F.when(F.col("state").isin("failed", "skipped", "completed"), F.col("state")).otherwise(bad)
    bucket = F.when(~F.coalesce(own, F.lit(False)), "stale").when(~is_study_cell_key(F.col("key"), F.col("cfg")), "other").otherwise(state)
    return records.withColumn("bucket", bucket)


def build_frame(records: DataFrame, ledger: DataFrame, rates: DataFrame, configs: list[str], response: str = "result.distinct_k", arms: list[str] | None = None, briefs: list[str] | None = None) -> Frame:
    """records(key, arm, brief, replicate, cfg, state, kind, detail, result) and ledger(cell_key, ...) -> Frame.

    Costs are api totals, single-priced where the regime is unsaid. An arm that was seen without a completed row, and a
    completed cell without a finite response, are refused.
    """
    dealt = bucketed(records, configs)
    value = get_path(*response.split(".", 1)) if "." in response else F.col(response)
    value = value.cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    good = F.when(usable, value).otherwise(F.raise_error(F.concat(F.lit("no numeric response in "), F.col("key"))).cast("double"))
    cost = price_rows(ledger, rates, "cell_key", batch=False).select(F.col("cell_key").alias("key"), F.col("total_usd").alias("_usd"))
    done = dealt.where("bucket = 'completed'").withColumn("response", good).join(cost, "key", "left").withColumn("cost", F.coalesce("_usd", F.lit(0.0))).drop("_usd", "bucket")
    seen = dealt.where("bucket in ('completed', 'failed', 'skipped')")
    counts = seen.groupBy("arm").agg(F.count_if(F.col("bucket") == "completed").alias("completed"), F.count_if(F.col("bucket") == "failed").alias("failed"), F.count_if(F.col("bucket") == "skipped").alias("skipped")).collect()
    arms = arms or sorted(r["arm"] for r in counts)
    for r in counts:
        check(r["arm"] not in arms or r["completed"] > 0, f"arm {r['arm']!r} has no completed row (failed {r['failed']}, skipped {r['skipped']})", DifferentialAttrition)
    briefs = briefs or sorted(r["brief"] for r in seen.select("brief").distinct().collect())
    return Frame(done, dealt.where("bucket in ('stale', 'failed', 'skipped')"), arms, briefs, configs)


def failures_by_arm(excluded: DataFrame) -> DataFrame:
    return excluded.where("bucket = 'failed'").groupBy("arm", "kind").agg(F.count("*").alias("n"))


def skipped_by_arm(excluded: DataFrame) -> DataFrame:
    return excluded.where("bucket = 'skipped'").groupBy("arm").agg(F.count("*").alias("n"))


def stale_by_config(excluded: DataFrame) -> DataFrame:
    """Stale study cells of each configuration held."""
    return excluded.where("bucket = 'stale'").where(is_study_cell_key(F.col("key"), F.col("cfg"))).groupBy("cfg").agg(F.count("*").alias("n"))


def cells_selected(frame: Frame) -> Frame:
    """Refuse a frame without rows, with what was excluded in the message."""
    if frame.rows.isEmpty():
        n = {r["bucket"]: r["count"] for r in frame.excluded.groupBy("bucket").count().collect()}
        held = ", ".join(f"{r['cfg']} ({r['n']})" for r in stale_by_config(frame.excluded).orderBy("cfg").limit(20).collect())
        raise NoCellsSelected(f"no cell of {frame.configs}: {n.get('stale', 0)} stale, {n.get('failed', 0)} failed, {n.get('skipped', 0)} skipped; the store holds {held or 'none'}")
    return frame


def tally_configs(records: DataFrame) -> DataFrame:
    """Study cells of each configuration: count and distinct sorted states."""
    own = records.where(F.coalesce(F.col("cfg"), F.lit("")) != "").where(is_study_cell_key(F.col("key"), F.col("cfg")))
    return own.groupBy("cfg").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"))


def resolve_config(records: DataFrame, named: list[str] | str | None = None) -> list[str]:
    """The configurations to analyse: those named, which must be held, or the only one held."""
    held = sorted(r["cfg"] for r in tally_configs(records).select("cfg").collect())
    named = list(dict.fromkeys([named] if isinstance(named, str) else named or []))
    if named:
        lost = [c for c in named if c not in held]
        check(not lost, f"{lost} not among the stored configurations {held}", UnknownStoredConfig)
        return named
    check(len(held) > 0, "the store holds no study cell", NoStoredConfig)
    check(len(held) == 1, f"the store holds {len(held)} configurations, name one of {held}", AmbiguousStoredConfig)
    return held


def apply_arm_configs(rows: DataFrame, rule: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of arms with a rule keep only its configuration: (kept, dropped)."""
    wanted = F.lit(None).cast("string")
    for arm, cfg in rule.items():
        wanted = F.when(F.col("arm") == arm, cfg).otherwise(wanted)
    ok = wanted.isNull() | F.coalesce(F.col("cfg") == wanted, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def exactly_one_other(configs: list[str], fixed: str) -> str | None:
    """The only configuration besides `fixed`, which must be held; none yet is None, several are refused."""
    check(fixed in configs, f"the store does not hold {fixed}: {configs}", UnknownStoredConfig)
    others = [c for c in configs if c != fixed]
    check(len(others) <= 1, f"several other configurations: {others}", AmbiguousStoredConfig)
    return others[0] if others else None


def subset(cells: DataFrame, **wanted: list) -> DataFrame:
    """Cells of the named arms, briefs or replicates; a name that no cell has is refused."""
    out = cells
    for column, values in wanted.items():
        if values:
            have = {r[0] for r in cells.select(column).where(F.col(column).isin(values)).distinct().collect()}
            check(not set(values) - have, f"unknown {column}: {sorted(set(values) - have, key=str)}")
            out = out.where(F.col(column).isin(values))
    return out
