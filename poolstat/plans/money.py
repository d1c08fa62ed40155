"""Queries of pricing, calibration, projection and ledgers."""

from pyspark.sql import functions as F

from poolstat.operators import pricing as P
from poolstat.sources.tables import table

from . import views as V

#: every decision in turn, as a text of flags
ADMISSION = """with o as (
 select o_orderkey, o_totalprice, cast(o_totalprice as decimal(18, 6)) x, row_number() over (order by o_orderkey, o_totalprice) i from orders
), run as (
 select list_reduce(list_prepend({'spent': 500::decimal(18, 6), 'x': 0::decimal(18, 6), 'flags': ''}, list({'spent': 0::decimal(18, 6), 'x': x, 'flags': ''} order by i)),
  lambda s, e: {'spent': (s.spent + case when s.spent + e.x <= 10000000 then e.x else 0 end)::decimal(18, 6), 'x': 0::decimal(18, 6), 'flags': s.flags || case when s.spent + e.x <= 10000000 then '1' else '0' end}).flags flags from o
), told as (select o.*, flags[i] = '1' admitted from o, run)
select o_orderkey, round(o_totalprice, 2) o_totalprice, admitted, round((500 + sum(case when admitted then x else 0 end) over (order by i))::double, 2) spent from told"""
R = lambda c, n=6: f"round({c}, {n})"


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def _mapped(s, d):
    """Odd lines carry two models in a map, even ones their own columns."""
    tokens = lambda i, o: F.struct(i.alias("input_tokens"), o.alias("output_tokens"), F.lit(None).cast("double").alias("cache_read_input_tokens"), F.lit(None).cast("double").alias("cache_creation_input_tokens"))
    two = F.create_map(F.col("model"), tokens(F.col("input_tokens"), F.col("output_tokens")), F.lit("gpt-98"), tokens(F.lit(10.0), F.lit(5.0)))
    odd = F.col("l_linenumber") % 2 == 1
    return V.ledger(s, d).withColumn("tokens_by_model", F.when(odd, two)).withColumn("model", F.when(~odd, F.col("model")))


def _bodies(s, d):
    rows = V.ledger(s, d).select("cell_key", F.struct("cell_key", "timestamp", "billing_mode", "pricing_regime", "model", "input_tokens", "output_tokens").alias("r"))
    return rows.groupBy(F.col("cell_key").alias("key")).agg(F.collect_list("r").alias("cost_rows"))


def _cells(s, d):
    return table(s, d, "orders").selectExpr("cast(o_orderkey as string) as cell_key", "cast(o_custkey % 25 as int) as arm", "case o_orderstatus when 'F' then 'completed' when 'O' then 'completed' else 'failed' end as state")


CELLS = "(select cast(o_orderkey as varchar) as cell_key, cast(o_custkey % 25 as int) as arm, case o_orderstatus when 'F' then 'completed' when 'O' then 'completed' else 'failed' end as state from orders)"
MEASURED = f"""(select arm, avg(i) as input_tokens, avg(o) as output_tokens, count(*) as n from (select arm, cell_key, sum(input_tokens) i, sum(output_tokens) o from {V.LEDGER} join (select * from {CELLS} where state = 'completed') using (cell_key)
 where model not like 'voyage-%' group by 1, 2) where o > 0 group by 1)"""
LEVELS = f"""(select effort, sum(output_tokens / k * n) / sum(n) as slot_output, cast(sum(n) as bigint) as n, string_agg(cast(arm as varchar), ',' order by arm) as arms from {MEASURED}
 join (select arm, min(effort) as effort, count(*) as k from {V.SLOTS} group by 1 having min(effort) = max(effort)) using (arm) group by 1)"""
GRID = f"""(select c.cell_key, c.arm, usd, usd * case when calibrated then 1 else 2.5 end as usd_high, calibrated from {CELLS} c join (select s.arm, bool_or(coalesce(m.output_tokens > 0, false)) as calibrated, sum(
 (case when m.output_tokens > 0 then m.input_tokens when s.mode = 'solo' then 2500 else 16000 end / s.n / 1e6 * r.rate_in
 + case when m.output_tokens > 0 then m.output_tokens else case when s.mode = 'solo' then 1500 else 9000 end * case s.effort when 'low' then 0.55::double when 'max' then 6.16::double else 1 end end / s.n / 1e6 * r.rate_out)
 * (1 - coalesce(r.batch_discount, 0.5))) as usd from {V.SLOTS} s join {V.RATES} r on s.model = r.model left join (select * from {MEASURED} where n >= {{least}}) m on s.arm = m.arm group by 1) a on c.arm = a.arm)"""


def _measured(s, d):
    return P.arm_tokens(V.ledger(s, d), _cells(s, d))


def _grid(s, d, least):
    arms = V.slots(s, d)
    known = _cells(s, d).join(arms.select("arm"), "arm", "left_semi")
    return P.price_grid(known, arms, V.rates(s), _measured(s, d).where(F.col("n") >= least))


def _totals(batch, by="", extra=""):
    return f"""select {by + ', ' if by else ''}round(coalesce(sum(usd) filter (billing_mode = 'api'), 0), 4) total_usd, round(coalesce(sum(usd) filter (billing_mode <> 'api'), 0), 4) notional_usd,
 coalesce(string_agg(distinct model, ',' order by model) filter (missing_rate), '') missing_models, count(*) filter (pricing_regime is null) legacy_rows from {V.LINES.format(batch=batch)} {'group by ' + by if by else ''}"""


PROVIDER = "case when missing_rate or model like 'voyage-%' then null when model like 'claude-%' then 'anthropic' else 'openai' end"
QUERIES = {
    "price_lines": (
        lambda s, d: rounded(P.price_lines(V.ledger(s, d), V.rates(s)).groupBy("model", "in_batch").agg(F.sum("base_usd").alias("base_usd"), F.sum("usd").alias("usd"), F.count_if("missing_rate").alias("missing"), F.count("*").alias("n")), 4),
        f"select model, in_batch, round(sum(base), 4) base_usd, round(sum(usd), 4) usd, count(*) filter (missing_rate) missing, count(*) n from {V.LINES.format(batch='false')} group by 1, 2",
    ),
    "price_model_maps": (
        lambda s, d: rounded(P.price_lines(_mapped(s, d), V.rates(s)).groupBy("model").agg(F.sum("usd").alias("usd"), F.count("*").alias("n")), 4),
        f"select model, round(sum(usd), 4) usd, count(*) n from (select model, usd from {V.LINES.format(batch='false')} union all select 'gpt-98', 0 from {V.LEDGER} where l_linenumber % 2 = 1) group by 1",
    ),
    "price_rows": (lambda s, d: rounded(P.price_rows(V.ledger(s, d), V.rates(s)), 4), _totals("false")),
    "price_rows_by_flag": (lambda s, d: rounded(P.price_rows(V.ledger(s, d).drop("l_linestatus"), V.rates(s), "pricing_regime", batch=True), 4), _totals("true", "pricing_regime")),
    "valid_ledger": (lambda s, d: P.valid_ledger(V.ledger(s, d)).groupBy("billing_mode").agg(F.count("cell_key").alias("n")), f"select billing_mode, count(*) n from {V.LEDGER} group by 1"),
    "spend_by_provider": (
        lambda s, d: rounded(P.by_provider(P.price_lines(V.ledger(s, d), V.rates(s))), 4),
        f"select {PROVIDER} provider, round(sum(case when missing_rate then 0 else usd end), 4) usd, count(*) filter (missing_rate) missing_lines from {V.LINES.format(batch='false')} group by 1",
    ),
    "spend_to_date": (lambda s, d: rounded(P.spend_to_date(_bodies(s, d), V.rates(s)), 4), _totals("true")),
    "reprice": (
        lambda s, d: rounded(P.reprice(V.ledger(s, d), V.rates(s), V.rates(s, scale=2.0), batch=False), 4),
        f"select round(was, 4) was_usd, round(new, 4) new_usd, round(new - was, 4) change_usd from (select sum(usd) filter (billing_mode = 'api') was from {V.LINES.format(batch='false')}), "
        f"(select sum(usd) filter (billing_mode = 'api') new from {V.LINES.format(batch='false').replace('r.rate_in end', '2 * r.rate_in end')})",
    ),
    "fold_cost_rows": (
        lambda s, d: rounded(P.fold_cost_rows(V.ledger(s, d).withColumn("row_id", F.monotonically_increasing_id())).drop("cache_read_input_tokens", "cache_creation_input_tokens", "models"), 4),
        f"select cell_key, billing_mode, pricing_regime, model, max(timestamp) as timestamp, round(sum(input_tokens), 4) input_tokens, round(sum(output_tokens), 4) output_tokens from {V.LEDGER} group by 1, 2, 3, 4",
    ),
    "arm_tokens": (lambda s, d: rounded(_measured(s, d), 4), f"select arm, round(input_tokens, 4) input_tokens, round(output_tokens, 4) output_tokens, n from {MEASURED}"),
    "effort_fit": (
        lambda s, d: rounded(P.effort_fit(_measured(s, d), V.slots(s, d)).drop("arms"), 5),
        f"""select effort, coalesce(n, 0) n, round(case when fits then slot_output / base else static end, 5) multiplier, fits as fitted from (select k.effort, l.n, l.slot_output, k.static, b.base, b.base is not null and coalesce(l.n, 0) >= 10 as fits
 from (values ('low', 0.55::double), ('high', 1.0::double), ('max', 6.16::double)) k(effort, static) left join {LEVELS} l on k.effort = l.effort left join (select slot_output as base from {LEVELS} where effort = 'high' and n >= 10) b on true)""",
    ),
    "effort_level": (
        lambda s, d: V.slots(s, d).select("arm", P.effort_level(F.col("slots")).alias("effort")),
        f"select arm, case when min(effort) = max(effort) then min(effort) end effort from {V.SLOTS} group by 1",
    ),
    "price_grid": (
        lambda s, d: rounded(_grid(s, d, 3), 6),
        f"select cell_key, arm, round(usd, 6) usd, round(usd_high, 6) usd_high, calibrated from {GRID.format(least=3)}",
    ),
    "price_grid_structural": (
        lambda s, d: rounded(_grid(s, d, 1 << 40).groupBy("arm", "calibrated").agg(F.max("usd").alias("usd"), F.max("usd_high").alias("usd_high")), 6),
        f"select arm, calibrated, round(max(usd), 6) usd, round(max(usd_high), 6) usd_high from {GRID.format(least=1 << 40)} group by 1, 2",
    ),
    "judge_leg_usd": (
        lambda s, d: rounded(table(s, d, "part").select("p_partkey", P.judge_leg_usd(F.col("p_size") % 7, F.lit(2.0), F.lit(10.0), F.lit(0.5)).alias("usd"))),
        "select p_partkey, round((n * 700 / 1e6 * 2 + n * 40 / 1e6 * 10) * 0.5, 6) usd from (select p_partkey, case when p_size % 7 > 0 then p_size % 7 else 30 end n from part)",
    ),
    "effort_multiplier": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", P.effort_multiplier(F.when(F.col("o_orderkey") % 3 == 0, "low").when(F.col("o_orderkey") % 3 == 1, "max")).alias("m")),
        "select o_orderkey, case o_orderkey % 3 when 0 then 0.55::double when 1 then 6.16::double else 1.0::double end m from orders",
    ),
    "provider_ceilings": (
        lambda s, d: rounded(P.provider_ceilings(
            P.by_provider(P.price_lines(V.ledger(s, d), V.rates(s))).where("provider is not null"), s.createDataFrame([("anthropic", 100.0)], "provider string, usd double"), s.createDataFrame([("anthropic", 50.0), ("openai", 1e9)], "provider string, ceiling double"),
        ), 4),
        f"""select provider, round(usd, 4) usd, ceiling, usd > ceiling as over from (select provider, sum(usd) + case when provider = 'anthropic' then 100 else 0 end usd, case when provider = 'anthropic' then 50.0::double else 1e9::double end ceiling
 from (select {PROVIDER} provider, case when missing_rate then 0 else usd end usd from {V.LINES.format(batch='false')}) where provider is not null group by 1)""",
    ),
    "spend_admission": (lambda s, d: rounded(P.admitted(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 1e7, 500.0), 2), ADMISSION),
}
