"""Pruning a store as one plan: cells that leave so that they are planned again, their spend salvaged under an attempt
record; attempt records folded into a compacted one; replay records that a newer one supersedes. What the ledger is worth
must not change: both sides are priced and compared before a result is handed out.

records: key, state, and where known kind, cfg, stored_at, pruned_from (of a salvage record the stored_at of the cells it
holds). lines: key, cell_key, timestamp, billing_mode, pricing_regime, model, token columns, and `at`, the row's place in
its record. A record may be there twice over, as a crash leaves it: a cell whose salvage is written, or raw attempts beside
the compacted record that covers them. Such spend is a known duplicate, which a prune takes away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.errors import check
from poolstat.functions.keys import attempt_key, parse_attempt_key, parse_cell_key
from poolstat.functions.text import FAILURE_KINDS, expand_kinds
from poolstat.sources.tables import written

from .ledger import ATTEMPTS, KEEP_ATTEMPTS, KEEP_REPLAYS, REPLAY, next_attempt
from .pricing import TOKENS, price_lines

SALVAGE = "pruned-cell"
OPTIONAL = {"kind": "string", "cfg": "string", "stored_at": "string", "pruned_from": "array<string>"}
LINE = ["key", "at", "cell_key", "timestamp", "billing_mode", "pricing_regime", "model", *TOKENS]
RELATIVE = 1e-9


@dataclass
class Pruned:
    plan: DataFrame
    records: DataFrame
    lines: DataFrame
    duplicates: DataFrame


def whole(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in records.columns}).select("key", "state", *OPTIONAL)


def prune_plan(
    records: DataFrame, cfg: str | None = None, arms: list[str] | None = None, briefs: list[str] | None = None, kinds: list[str] | None = None,
    states: list[str] | None = None, allow_completed: bool = False, keep: int | None = KEEP_ATTEMPTS, keep_replays: int | None = KEEP_REPLAYS,
) -> DataFrame:
    """Every record with its action: evict, refuse (a completed cell, without allow_completed), fold, supersede or keep.

    Without a selector no cell leaves. By default failed cells of transient and payment kinds do; `kinds` names others. Of
    each attempt family and cell the newest `keep` records stay, older ones fold into the record named by `into`, to which
    those that `contributes` bring their rows; of replay records the newest `keep_replays` stay. None leaves a family alone.
    """
    for n in (keep, keep_replays):
        check(n is None or n >= 1, f"what is kept is a positive number or None, not {n}")
    own = whole(records).withColumn("_c", parse_cell_key(F.col("key"))).withColumn("_a", parse_attempt_key(F.col("key"), [*ATTEMPTS, REPLAY]))
    wanted = F.lit(any(x is not None for x in (cfg, arms, briefs, kinds, states))) & F.col("_c").isNotNull() & F.col("state").isin(states or ["failed"])
    for part, values in (("cfg", None if cfg is None else [cfg]), ("arm", arms), ("brief", briefs)):
        wanted = wanted & F.col(f"_c.{part}").isin(values) if values is not None else wanted
    named = F.coalesce(F.col("kind").isin(expand_kinds(kinds or ["transient", "payment"])), F.lit(False))
    wanted = F.coalesce(wanted & F.when(F.col("state") == "failed", named).otherwise(F.lit(kinds is None)), F.lit(False))
    newest = Window.partitionBy("_a.family", "_a.cell").orderBy(F.desc("_a.through"), F.col("_a.compacted").cast("int"))
    limit = F.when(F.col("_a.family") == REPLAY, F.lit(keep_replays)).otherwise(F.lit(keep))
    told = own.where("_a is not null").withColumn("_old", F.coalesce(F.row_number().over(newest) > limit, F.lit(False)))
    of = Window.partitionBy("_a.family", "_a.cell", "_old")
    old, fold = F.col("_old"), F.col("_old") & (F.col("_a.family") != REPLAY)
    through = F.max("_a.through").over(of)
    top = F.max(F.when(F.col("_a.compacted"), F.col("_a.through"))).over(of)
    into = F.when(fold, attempt_key(F.col("_a.family"), F.col("_a.cell"), through, F.lit(True)))
    alone = F.count("*").over(of) == F.count_if(F.col("key") == into).over(of)  # nothing would go
    counts = top.isNull() | (F.col("_a.through") > top) | (F.col("_a.compacted") & (F.col("_a.through") == top))
    told = told.withColumn("into", into).withColumn("contributes", fold & counts).withColumn("through", through).withColumn("_alone", fold & alone)
    action = F.when(fold & ~F.col("_alone"), "fold").when(old & ~fold, "supersede").otherwise("keep")
    told = told.select("key", action.alias("action"), F.when(action == "fold", F.col("into")).alias("into"), ((action == "fold") & F.col("contributes")).alias("contributes"), "_a.family", "_a.cell", "through", "_a.compacted", *own.columns[1:-2])
    kept = F.when(~wanted, "keep").when((F.col("state") == "completed") & F.lit(not allow_completed), "refuse").otherwise("evict")
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    rest = own.where("_a is null").select("key", kept.alias("action"), null("string", "into"), F.lit(False).alias("contributes"), null("string", "family"), null("string", "cell"), null("long", "through"), null("boolean", "compacted"), *own.columns[1:-2])
    return told.union(rest)


def folded(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """lines(into, ...) -> rows of one cell, mode, regime and model set fall together, at the latest timestamp; a record
    whose price that would change, as its rows lie on both sides of a dated rate, keeps its rows as they are."""
    row = ["into", "key", "at"]
    own = lines.withColumn("_row", F.xxhash64(*row)).withColumn("_set", F.array_join(F.sort_array(F.collect_set("model").over(Window.partitionBy(*row))), "+"))
    same = ["into", "cell_key", "billing_mode", "pricing_regime", "_set", "model"]
    less = own.groupBy(*same).agg(F.max("timestamp").alias("timestamp"), *[F.sum(t).alias(t) for t in TOKENS])

    sides = own.select("into", *LINE[2:]).withColumn("row_id", F.concat(F.lit("was|"), "into")).unionByName(less.select("into", *LINE[2:]).withColumn("row_id", F.concat(F.lit("now|"), "into")))
    worth = price_lines(sides.drop("into"), rates, batch=True).withColumn("into", F.substring("row_id", 5, 1 << 30))
    of = lambda side, *modes: F.sum(F.when(F.col("row_id").startswith(side) & F.col("billing_mode").isin(*modes), F.col("usd")).otherwise(0.0))
    both = worth.groupBy("into").agg(*[of(side, *modes).alias(f"_{side}{name}") for side in ("was", "now") for name, modes in (("", ["api"]), ("_all", ["api", "subscription"]))])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= RELATIVE * F.greatest(F.lit(1.0), F.abs(F.col(a)))
    safe = both.where(near("_was", "_now") & near("_was_all", "_now_all")).select("into")
    place = Window.partitionBy("into").orderBy("cell_key", "billing_mode", "pricing_regime", "_set", "timestamp", "model")
    less = less.join(safe, "into").withColumn("at", F.dense_rank().over(Window.partitionBy("into").orderBy("cell_key", "billing_mode", "pricing_regime", "_set")) - 1)
    rest = own.join(safe, "into", "left_anti").withColumn("at", F.dense_rank().over(place) - 1)
    cols = ["into", "at", *LINE[2:]]
    return less.select(cols).union(rest.select(cols)).withColumnRenamed("into", "key")


def conserved(before: DataFrame, after: DataFrame, rates: DataFrame) -> None:
    """Refuse a change of tokens by model, mode and regime, or of what they are worth."""
    both = before.select(LINE).withColumn("row_id", F.lit("before")).union(after.select(LINE).withColumn("row_id", F.lit("after")))
    sign = F.when(F.col("row_id") == "before", 1).otherwise(-1)
    sums = price_lines(both, rates, batch=True).groupBy("model", "billing_mode", "pricing_regime").agg(
        *[F.sum((F.col(t) * sign).cast("decimal(38,6)")).alias(t) for t in TOKENS], F.sum(F.col("usd") * sign).alias("usd"), F.sum(F.abs("usd")).alias("_size")
    )
    wrong = F.abs("usd") > RELATIVE * F.greatest(F.lit(1.0), F.col("_size"))
    for t in TOKENS:
        wrong = wrong | (F.col(t) != 0)
    bad = sums.where(wrong).limit(5).collect()
    check(not bad, f"pruning would change the ledger: {[(r['model'], r['billing_mode'], r['pricing_regime'], r['usd']) for r in bad]}")


def prune(records: DataFrame, lines: DataFrame, rates: DataFrame, **how) -> Pruned:
    """Records and lines as they are after the plan (`how` as in prune_plan), the plan, and the known duplicates it took away."""
    plan = written(prune_plan(records, **how))
    rows = lines.withColumns({t: F.coalesce(F.col(t).cast("double"), F.lit(0.0)) if t in lines.columns else F.lit(0.0) for t in TOKENS})
    rows = written((rows if "at" in rows.columns else rows.withColumn("at", F.lit(0))).select(LINE))
    evicted = plan.where("action = 'evict'").select("key", "state", "kind", "cfg", "stored_at")
    held = plan.where(F.col("family") == SALVAGE).select("cell", "key", "through", "family", F.explode_outer("pruned_from").alias("_from"))
    covered = evicted.join(held, (F.col("cell") == evicted["key"]) & (F.col("_from") == evicted["stored_at"]), "left_semi").select("key")
    number = next_attempt(held).select(F.col("cell").alias("_cell"), "next_attempt")
    spent = evicted.join(rows.select("key").distinct(), "key", "left_semi").join(covered, "key", "left_anti")
    salvage = spent.join(number, F.col("key") == F.col("_cell"), "left").withColumn("_new", attempt_key(F.lit(SALVAGE), F.col("key"), F.coalesce("next_attempt", F.lit(0).cast("long"))))
    moved = rows.join(salvage.select("key", "_new"), "key").withColumn("key", F.col("_new")).select(LINE)
    fold = plan.where("action = 'fold'")
    less = folded(rows.join(fold.where("contributes").select("key", "into"), "key"), rates).select(LINE)
    gone = plan.where("action in ('evict', 'fold')").select("key")
    after = written(rows.join(gone, "key", "left_anti").union(moved).union(less))
    again = rows.join(covered, "key", "left_semi").union(rows.join(fold.where("not contributes").select("key"), "key", "left_semi"))
    taken = covered.union(fold.where("not contributes").select("key"))
    conserved(rows.join(taken, "key", "left_anti"), after, rates)
    lost = rows.join(plan.where("action = 'supersede'").select("key"), "key", "left_semi")
    check(lost.isEmpty(), "a replay record that would go carries cost rows")
    known = F.coalesce(F.col("kind").isin(FAILURE_KINDS), F.lit(False))
    new = salvage.select(F.col("_new").alias("key"), F.lit("failed").alias("state"), F.when(known, F.col("kind")).otherwise("harness_error").alias("kind"), "cfg", F.lit(None).cast("string").alias("stored_at"), F.array("stored_at").alias("pruned_from"))
    done = F.col("family") == "judge-call"
    compacted = fold.where("contributes").groupBy(F.col("into").alias("key")).agg(
        F.when(F.first(done), "completed").otherwise("failed").alias("state"), F.when(~F.first(done), "harness_error").alias("kind"), F.min_by("cfg", "through").alias("cfg"),
        F.lit(None).cast("string").alias("stored_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pruned_from", F.array().cast("array<string>")))))).alias("pruned_from"),
    )
    left = whole(records).join(plan.where("action in ('evict', 'fold', 'supersede')").select("key"), "key", "left_anti")
    return Pruned(plan, left.unionByName(new).unionByName(compacted), after, again)
