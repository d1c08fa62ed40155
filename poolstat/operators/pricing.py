"""Read-time pricing of token ledgers: tokens x dated rates, never a stored amount.

A ledger row has cell_key, timestamp (ISO text), billing_mode (api or subscription), pricing_regime (batch, single or
null), and either tokens_by_model (map of model -> token struct) or model with its own token columns. `model_lines` turns
it into one line for each model; all prices are columns over lines, so totals are one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.errors import MissingRate, check

from .admission import admitted  # noqa: F401  the ceiling's gate is used with the prices here

TOKENS = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
MILLION = 1_000_000
#: rates of more models than this are joined by shuffle
MAX_BROADCAST_RATES = 100_000
# Discounts, estimates and multipliers.
BATCH_DISCOUNT, EMBEDDER_DISCOUNT = 0.5, 1 / 3
EMBEDDER_PREFIXES = ["voyage-"]
PROVIDER_PREFIXES = {"claude-": "anthropic", "openai-": "openai", "gpt-": "openai"}
EFFORT_OUTPUT = {"low": 0.55, "high": 1.0, "max": 6.16}
PLAN_TOKENS = {"panel": (16000, 9000), "solo": (2500, 1500)}
JUDGE_TOKENS, JUDGE_POOL = (700, 40), 30
UNCALIBRATED_HIGH = 2.5
MIN_CELLS_PER_ARM, MIN_CELLS_PER_EFFORT = 3, 10


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(c.startswith(p), F.lit(False))
    return out


def is_embedder(model: Column) -> Column:
    """Models whose spend belongs to no provider."""
    return starts_with_any(model, EMBEDDER_PREFIXES)


def provider_of(model: Column, strict: bool = True) -> Column:
    """Provider by prefix; an unknown one raises (strict) or is null."""
    out = F.raise_error(F.concat(F.lit("no provider for model "), F.coalesce(model, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    for prefix, name in reversed(PROVIDER_PREFIXES.items()):
        out = F.when(model.startswith(prefix), name).otherwise(out)
    return out


def effort_multiplier(effort: Column, table: dict[str, float] | None = None) -> Column:
    """Output multiplier of an effort level; absent counts as high, an unknown level raises."""
    table = table or EFFORT_OUTPUT
    level = F.coalesce(effort, F.lit("high"))
    out = F.raise_error(F.concat(F.lit("no multiplier for effort "), level)).cast("double")
    for name, value in table.items():
        out = F.when(level == name, F.lit(float(value))).otherwise(out)
    return out


def valid_ledger(rows: DataFrame) -> DataFrame:
    """Rows with their refusals attached: a row that cannot be priced later stops the job."""
    refuse = lambda bad, why: F.when(bad, F.raise_error(F.lit(why)).cast("string"))
    cols = dict(rows.dtypes)
    named = F.lit(False)
    for c in ("model", "tokens_by_model"):
        if c in cols:
            named = named | F.col(c).isNotNull()
    regime = F.col("pricing_regime") if "pricing_regime" in cols else F.lit(None).cast("string")
    check(not {"cost_usd", "notional_usd"} & set(cols), "amounts are never stored in a ledger")
    checked = F.coalesce(
        refuse(F.coalesce(F.col("cell_key"), F.lit("")) == "", "a ledger row needs cell_key"),
        refuse(F.coalesce(F.col("timestamp"), F.lit("")) == "", "a ledger row needs timestamp"),
        refuse(~F.coalesce(F.col("billing_mode").isin("api", "subscription"), F.lit(False)), "billing_mode must be api or subscription"),
        refuse(regime.isNotNull() & ~regime.isin("batch", "single"), "pricing_regime must be batch or single"),
        refuse(~named, "a ledger row needs model or tokens_by_model"),
        F.col("cell_key"),
    )
    return rows.withColumn("cell_key", checked)


def model_lines(ledger: DataFrame) -> DataFrame:
    """One line for each row and model, with token columns; `row_id`, if there, tells rows apart."""
    cols = dict(ledger.dtypes)
    tokens = lambda get: F.struct(*[F.coalesce(get(t).cast("double"), F.lit(0.0)).alias(t) for t in TOKENS])
    own = lambda t: F.col(t) if t in cols else F.lit(None).cast("double")
    single = F.array(F.struct(F.col("model").alias("model"), tokens(own).alias("tokens"))) if "model" in cols else None
    if "tokens_by_model" in cols:
        many = F.transform(F.map_entries("tokens_by_model"), lambda e: F.struct(e["key"].alias("model"), tokens(lambda t: e["value"][t]).alias("tokens")))
        lines = many if single is None else F.when(F.col("tokens_by_model").isNotNull(), many).otherwise(single)
    else:
        lines = single
    keep = [c for c in ("row_id", "cell_key", "timestamp", "billing_mode", "pricing_regime") if c in cols]
    rows = ledger if "pricing_regime" in cols else ledger.withColumn("pricing_regime", F.lit(None).cast("string"))
    keep = keep if "pricing_regime" in keep else [*keep, "pricing_regime"]
    return rows.select(*keep, F.explode(lines).alias("_l")).select(*keep, "_l.model", "_l.tokens.*")


def with_rates(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """rates(model, rate_in, rate_out, intro_until, intro_in, intro_out, batch_discount): a miss is flagged, not dropped.

    The intro rate holds up to and on intro_until, compared as text.
    """
    own = rates.select("model", "rate_in", "rate_out", "intro_until", "intro_in", "intro_out", "batch_discount")
    few = own.limit(MAX_BROADCAST_RATES + 1).count() <= MAX_BROADCAST_RATES
    joined = lines.join(F.broadcast(own) if few else own, "model", "left")
    intro = F.coalesce((F.col("timestamp") <= F.col("intro_until")) & F.col("intro_in").isNotNull(), F.lit(False))
    return (
        joined.withColumn("missing_rate", F.col("rate_in").isNull())
        .withColumn("rate_in", F.when(intro, F.col("intro_in")).otherwise(F.col("rate_in")))
        .withColumn("rate_out", F.when(intro, F.col("intro_out")).otherwise(F.col("rate_out")))
        .withColumn("batch_discount", F.coalesce("batch_discount", F.when(is_embedder(F.col("model")), EMBEDDER_DISCOUNT).otherwise(BATCH_DISCOUNT)))
        .drop("intro_until", "intro_in", "intro_out")
    )


def price_lines(ledger: DataFrame, rates: DataFrame, batch: bool | Column = False) -> DataFrame:
    """Lines with base_usd, usd and flags. `batch` decides rows without a regime; cache tokens bill as input."""
    fallback = F.lit(batch) if isinstance(batch, bool) else batch
    lines = with_rates(model_lines(ledger), rates)
    tokens_in = F.col("input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_creation_input_tokens")
    base = F.when(F.col("missing_rate"), 0.0).otherwise(tokens_in / MILLION * F.col("rate_in") + F.col("output_tokens") / MILLION * F.col("rate_out"))
    in_batch = F.when(F.col("pricing_regime").isNull(), fallback).otherwise(F.col("pricing_regime") == "batch")
    return (
        lines.withColumn("legacy", F.col("pricing_regime").isNull()).withColumn("in_batch", in_batch).withColumn("base_usd", base)
        .withColumn("usd", F.col("base_usd") * (1 - F.when(F.col("in_batch"), F.col("batch_discount")).otherwise(0.0)))
    )


def totals(lines: DataFrame, *by: str) -> DataFrame:
    """total_usd (api), notional_usd (subscription), models without a rate, and rows priced by the fallback regime."""
    api = F.col("billing_mode") == "api"
    rows = F.count_distinct(F.when(F.col("legacy"), F.col("row_id"))) if "row_id" in lines.columns else F.count_if("legacy")
    return lines.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(api, F.col("usd"))), F.lit(0.0)).alias("total_usd"),
        F.coalesce(F.sum(F.when(~api, F.col("usd"))), F.lit(0.0)).alias("notional_usd"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("missing_rate"), F.col("model")))), ",").alias("missing_models"),
        rows.alias("legacy_rows"),
    )


def price_rows(ledger: DataFrame, rates: DataFrame, *by: str, batch: bool | Column = False) -> DataFrame:
    return totals(price_lines(ledger, rates, batch), *by)


def reprice(ledger: DataFrame, rates: DataFrame, other: DataFrame, *by: str, batch: bool = False) -> DataFrame:
    """What-if: totals under both tables and their difference."""
    was = price_rows(ledger, rates, *by, batch=batch).select(*by, F.col("total_usd").alias("was_usd"))
    new = price_rows(ledger, other, *by, batch=batch).select(*by, F.col("total_usd").alias("new_usd"))
    both = was.join(new, list(by)) if by else was.crossJoin(new)  # one row each
    return both.withColumn("change_usd", F.col("new_usd") - F.col("was_usd"))


def by_provider(lines: DataFrame, *by: str, provider: Column | None = None) -> DataFrame:
    """Spend of each provider; embedders stand apart under provider null, models without a rate are counted, not priced."""
    own = F.when(F.col("missing_rate") | is_embedder(F.col("model")), F.lit(None).cast("string")).otherwise(provider_of(F.col("model")) if provider is None else provider)
    return lines.withColumn("provider", own).groupBy(*by, "provider").agg(
        F.sum(F.when(~F.col("missing_rate"), F.col("usd")).otherwise(0.0)).alias("usd"), F.count_if("missing_rate").alias("missing_lines"),
    )


def spend_to_date(bodies: DataFrame, rates: DataFrame) -> DataFrame:
    """Whole-ledger spend: every record's cost_rows of every key family and configuration, batch where unsaid."""
    rows = bodies.select("key", F.posexplode("cost_rows").alias("_at", "_r")).select(F.concat_ws("#", "key", "_at").alias("row_id"), "_r.*")
    return price_rows(rows, rates, batch=True)


def fold_cost_rows(ledger: DataFrame) -> DataFrame:
    """Rows of one cell, billing mode, regime and model set fall together: tokens summed by model, the latest timestamp."""
    lines = model_lines(ledger)
    per = lines.groupBy("row_id").agg(F.concat_ws("+", F.sort_array(F.collect_set("model"))).alias("models"))
    keys = ["cell_key", "billing_mode", "pricing_regime", "models", "model"]
    return lines.join(per, "row_id").groupBy(*keys).agg(F.max("timestamp").alias("timestamp"), *[F.sum(t).alias(t) for t in TOKENS])


def folded_safely(ledger: DataFrame, rates: DataFrame, relative: float = 1e-9) -> tuple[DataFrame, bool]:
    """The folded ledger, or the ledger itself where folding would change a price by more than `relative`."""
    folded = fold_cost_rows(ledger)
    was = price_rows(ledger, rates, batch=True).first()
    now = price_rows(folded.drop("models"), rates, batch=True).first()
    same = all(abs(was[c] - now[c]) <= relative * max(1.0, abs(was[c])) for c in ("total_usd", "notional_usd")) and was["missing_models"] == now["missing_models"]
    return (folded, True) if same else (ledger, False)


def arm_tokens(ledger: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean generation tokens of an arm's completed cells; embedders and cells without output do not count."""
    done = cells.where(F.col("state") == "completed").select("cell_key", "arm")
    lines = model_lines(ledger).where(~is_embedder(F.col("model"))).join(done, "cell_key")
    per = lines.groupBy("arm", "cell_key").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")).where("o > 0")
    return per.groupBy("arm").agg(F.avg("i").alias("input_tokens"), F.avg("o").alias("output_tokens"), F.count("*").alias("n"))


def effort_level(slots: Column) -> Column:
    """The one effort level of an arm's slots, or null where they differ or there are none."""
    levels = F.array_distinct(F.transform(slots, lambda s: F.coalesce(s["effort"], F.lit("high"))))
    return F.when(F.size(levels) == 1, levels[0])


def effort_fit(measured: DataFrame, arms: DataFrame, minimum: int = MIN_CELLS_PER_EFFORT, static: dict[str, float] | None = None) -> DataFrame:
    """Output multiplier of each effort level: cell-weighted mean output of a slot over that at high; thin levels keep the static one.

    arms(arm, slots); arms of mixed effort and arms that are not configured do not count.
    """
    static = static or EFFORT_OUTPUT
    per = measured.join(arms.select("arm", effort_level(F.col("slots")).alias("effort"), F.size("slots").alias("slots")), "arm").where("effort is not null")
    level = per.groupBy("effort").agg((F.sum(F.col("output_tokens") / F.col("slots") * F.col("n")) / F.sum("n")).alias("slot_output"), F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("arm")), ",").alias("arms"))
    base = level.where((F.col("effort") == "high") & (F.col("n") >= minimum)).select(F.col("slot_output").alias("base"))
    known = measured.sparkSession.createDataFrame(sorted(static.items()), "effort string, static double")
    joined = known.join(level, "effort", "full").join(base, how="left")
    fits = F.col("base").isNotNull() & (F.coalesce("n", F.lit(0)) >= minimum)
    return joined.select(
        "effort", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("arms", F.lit("")).alias("arms"),
        F.when(fits, F.col("slot_output") / F.col("base")).otherwise(F.col("static")).alias("multiplier"), fits.alias("fitted"),
    )


def judge_leg_usd(candidates: Column, rate_in: Column, rate_out: Column, discount: Column) -> Column:
    """Estimated price of judging a pool; an unknown size counts as the usual pool, a judge without a rate raises."""
    n = F.when(F.coalesce(candidates, F.lit(0)) > 0, candidates).otherwise(JUDGE_POOL)
    usd = (n * JUDGE_TOKENS[0] / MILLION * rate_in + n * JUDGE_TOKENS[1] / MILLION * rate_out) * (1 - discount)
    return F.when(rate_in.isNull(), F.raise_error(F.lit("no rate for a judge model")).cast("double")).otherwise(usd)


def price_grid(cells: DataFrame, arms: DataFrame, rates: DataFrame, fitted: DataFrame | None = None, batch: bool = True, multipliers: dict[str, float] | None = None) -> DataFrame:
    """cells(cell_key, arm), arms(arm, mode, slots), fitted(arm, input_tokens, output_tokens) -> cell_key, usd, usd_high, calibrated.

    A fitted arm spreads its measured tokens over its slots; any other takes the structural estimate of its mode, weighted by
    effort, and a high bound of UNCALIBRATED_HIGH times. Arms or models that are unknown raise.
    """
    known = arms.select("arm", "mode", F.posexplode("slots").alias("_k", "slot"), F.size("slots").alias("_n"))
    own = fitted.select("arm", F.col("input_tokens").alias("_fi"), F.col("output_tokens").alias("_fo")) if fitted is not None else None
    slots = known.join(own, "arm", "left") if own is not None else known.withColumn("_fi", F.lit(None).cast("double")).withColumn("_fo", F.lit(None).cast("double"))
    done = F.coalesce(F.col("_fo") > 0, F.lit(False))
    panel, solo = PLAN_TOKENS["panel"], PLAN_TOKENS["solo"]
    estimate = lambda i: F.when(F.col("mode") == "solo", solo[i]).otherwise(panel[i])
    r = rates.select(F.col("model").alias("_m"), "rate_in", "rate_out", "batch_discount")
    priced = slots.join(r, F.col("slot.model") == F.col("_m"), "left")
    weight = F.when(done, 1.0).otherwise(effort_multiplier(F.col("slot.effort"), multipliers))
    tokens_in, tokens_out = F.when(done, F.col("_fi")).otherwise(estimate(0)) / F.col("_n"), F.when(done, F.col("_fo")).otherwise(estimate(1)) / F.col("_n") * weight
    discount = F.coalesce("batch_discount", F.lit(BATCH_DISCOUNT)) if batch else F.lit(0.0)
    usd = F.when(F.col("rate_in").isNull(), F.raise_error(F.concat(F.lit("no rate for model "), F.coalesce(F.col("slot.model"), F.lit("null")))).cast("double"))
    usd = usd.otherwise((tokens_in / MILLION * F.col("rate_in") + tokens_out / MILLION * F.col("rate_out")) * (1 - discount))
    arm = priced.withColumn("_usd", usd).withColumn("_done", done).groupBy("arm").agg(F.sum("_usd").alias("usd"), F.bool_or("_done").alias("calibrated"))
    out = cells.select("cell_key", "arm").join(arm, "arm", "left")
    usd = F.when(F.col("usd").isNull(), F.raise_error(F.concat(F.lit("unknown arm, or one without slots: "), F.col("arm"))).cast("double")).otherwise(F.col("usd"))
    return out.select("cell_key", "arm", usd.alias("usd"), (usd * F.when(F.col("calibrated"), 1.0).otherwise(UNCALIBRATED_HIGH)).alias("usd_high"), "calibrated")


def provider_ceilings(projection: DataFrame, prior: DataFrame, ceilings: DataFrame) -> DataFrame:
    """projection(provider, usd), prior(provider, usd), ceilings(provider, ceiling) -> projected with prior spend, against the ceiling."""
    all_ = projection.select("provider", "usd").unionByName(prior.select("provider", "usd")).groupBy("provider").agg(F.sum("usd").alias("usd"))
    return all_.join(ceilings, "provider", "left").withColumn("over", F.coalesce(F.col("usd") > F.col("ceiling"), F.lit(False)))


def require_rates(lines: DataFrame) -> DataFrame:
    """Refuse a total that a missing rate would understate: for use under a spend ceiling."""
    lost = [r["model"] for r in lines.where("missing_rate").select("model").distinct().limit(20).collect()]
    check(not lost, f"models without a rate: {sorted(lost)}", MissingRate)
    return lines
