"""Queries of the store: index, frame, accounts and attempts."""

import uuid

from pyspark.sql import functions as F

from poolstat.functions import keys as K
from poolstat.functions import text as T
from poolstat.operators import frame as FR
from poolstat.operators import joins as J
from poolstat.operators import ledger as L
from poolstat.sources import store as S
from poolstat.sources.keyed import Keyed
from poolstat.sources.tables import shared_dir, table, written

from . import views as V


def records(s, d):
    return S.latest_lines(V.index_log(s, d), "event_id")


def states(s, d):
    return records(s, d).select("key", "state", "kind", "detail", F.col("value").alias("latency_ms"), "arm")


def attempts(s, d):
    return L.attempts(V.attempt_log(s, d))


BUCKETED = f"(select *, case when cfg <> 'c0' then 'stale' when not (regexp_matches(key, '^arm=(.+)\\|brief=(.+)\\|rep=(\\d+)\\|cfg=(.+)$') and regexp_extract(key, '^arm=(.+)\\|brief=(.+)\\|rep=(\\d+)\\|cfg=(.+)$', 4) = cfg) then 'other' else state end as bucket from {V.RECORDS})"
STUDY = "key like 'arm=%'"
CONTRIBUTING = f"(select a.* from {V.ATTEMPT_LOG} a join (select family, cell, max(through) filter (compacted) as top from {V.ATTEMPT_LOG} group by 1, 2) t using (family, cell) where top is null or through > top or (compacted and through = top))"
PLANNED = f"(select key, cfg from {V.RECORDS})"


def _cell(c, alias=False):
    p = K.parse_cell_key(F.col(c))
    return [p[x].alias(x) for x in ("arm", "brief", "replicate", "cfg")]


#: a cost row for every line of the log, the lines of a repeated key too: all were paid
_COSTS = [
    ("cell_key", "key"), ("timestamp", "case when event_id % 3 = 0 then '1997-01-01' else '1999-01-01' end"), ("billing_mode", "case when event_id % 7 = 0 then 'subscription' else 'api' end"),
    ("pricing_regime", "case event_id % 4 when 0 then 'batch' when 1 then 'single' end"), ("model", "case event_id % 5 when 0 then 'claude-1' when 1 then 'gpt-2' when 2 then 'claude-4' else 'voyage-3' end"),
    ("input_tokens", "cast(event_id * 100 as double)"), ("output_tokens", "cast(value * 1000 as double)"),
]
#: api totals of a cell, rows without a regime as single
CELL_COST = f"""(select c.cell_key as key, sum((c.input_tokens / 1e6 * case when r.intro_in is not null and c.timestamp <= r.intro_until then r.intro_in else r.rate_in end
 + c.output_tokens / 1e6 * case when r.intro_in is not null and c.timestamp <= r.intro_until then r.intro_out else r.rate_out end)
 * (1 - case when c.pricing_regime = 'batch' then coalesce(r.batch_discount, case when c.model like 'voyage-%' then 1 / 3.0::double else 0.5::double end) else 0 end)) filter (c.billing_mode = 'api') as cost
 from (select {", ".join(f"{e} as {n}" for n, e in _COSTS)} from {V.INDEX_LOG}) c join {V.RATES} r on c.model = r.model group by 1)"""


def _frame(s, d):
    rows = records(s, d).withColumn("result", F.struct(F.col("value").alias("distinct_k"))).drop("value")
    return FR.build_frame(rows, V.index_log(s, d).selectExpr(*[f"{e} as {n}" for n, e in _COSTS]), V.rates(s), ["c0"])


def _keyed(s, d):
    """Two puts of bodies, the second with half of the first again, then the bodies of some keys."""
    store = Keyed(s, f"{shared_dir(s)}/keyed-{uuid.uuid4().hex}", 16)
    bodies = written(records(s, d).select("key", "state", F.to_json(F.struct("event_id", "value")).alias("body"), "replicate"))
    store.put(bodies.where("replicate < 2"))
    store.put(bodies.where("replicate > 0"))
    return store.of(bodies.where("state = 'failed'")).select("key", "state", F.get_json_object("body", "$.event_id").cast("long").alias("event_id"))


QUERIES = {
    "keyed_bodies": (_keyed, f"select key, state, event_id from {V.RECORDS} where state = 'failed'"),
    "store_index": (records, f"select * from {V.RECORDS}"),
    "store_has": (
        lambda s, d: S.has(records(s, d), table(s, d, "nation").selectExpr("'arm=A' || (n_nationkey % 5) || '|brief=b' || n_nationkey || '|rep=0|cfg=c' || (n_nationkey % 2) as key")),
        f"select k as key, k in (select key from {V.RECORDS}) as stored from (select 'arm=A' || (n_nationkey % 5) || '|brief=b' || n_nationkey || '|rep=0|cfg=c' || (n_nationkey % 2) as k from nation)",
    ),
    "store_put_plan": (
        lambda s, d: S.put_plan(
            records(s, d).where("replicate = 0").select("key", F.to_json(F.struct("state", "event_id")).alias("body")),
            records(s, d).select("key", "state", F.to_json(F.struct("event_id", "state")).alias("body")),
        ).select("key", "outcome"),
        f"select key, case when replicate = 0 then 'unchanged' else 'written' end outcome from {V.RECORDS}",
    ),
    "store_remove": (
        lambda s, d: S.remove(records(s, d), records(s, d).where("state = 'failed'").select("key")).select("key", "state"),
        f"select key, state from {V.RECORDS} where state <> 'failed'",
    ),
    "body_file": (lambda s, d: records(s, d).select("key", K.body_file(F.col("key")).alias("file")), f"select key, substr(sha256(key), 1, 16) || '.json' as file from {V.RECORDS}"),
    "study_cell_keys": (lambda s, d: records(s, d).select("key", K.is_study_cell_key(F.col("key"), F.lit("c1")).alias("own")), f"select key, {STUDY} and cfg = 'c1' as own from {V.RECORDS}"),
    "parse_cell_key": (
        lambda s, d: records(s, d).where(K.parse_cell_key(F.col("key"), True).isNotNull()).select("key", *_cell("key")),
        f"select key, arm, brief, replicate, cfg from {V.RECORDS} where {STUDY}",
    ),
    "cell_key": (
        lambda s, d: table(s, d, "supplier").select(K.cell_key(F.concat(F.lit("A"), F.col("s_nationkey")), F.col("s_name"), F.col("s_suppkey"), F.lit("c")).alias("key")),
        "select 'arm=A' || s_nationkey || '|brief=' || s_name || '|rep=' || s_suppkey || '|cfg=c' as key from supplier",
    ),
    "frame_buckets": (
        lambda s, d: FR.bucketed(records(s, d), ["c0"]).select("key", "bucket"), f"select key, bucket from {BUCKETED}",
    ),
    "frame_rows": (
        lambda s, d: _frame(s, d).rows.select("key", "arm", "brief", "replicate", F.round("response", 4).alias("response"), F.round("cost", 9).alias("cost")),
        f"select b.key, arm, brief, replicate, round(value, 4) response, round(coalesce(c.cost, 0)::double, 9) as cost from {BUCKETED} b left join {CELL_COST} c on c.key = b.key where bucket = 'completed'",
    ),
    "frame_arm_costs": (
        lambda s, d: _frame(s, d).rows.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("response"), 4).alias("response"), F.round(F.sum("cost"), 7).alias("cost")),
        f"select arm, count(*) n, round(avg(value), 4) response, round(sum(coalesce(c.cost, 0)), 7) as cost from {BUCKETED} b left join {CELL_COST} c on c.key = b.key where bucket = 'completed' group by 1",
    ),
    "frame_failures": (lambda s, d: FR.failures_by_arm(_frame(s, d).excluded), f"select arm, kind, count(*) n from {BUCKETED} where bucket = 'failed' group by 1, 2"),
    "frame_skipped": (lambda s, d: FR.skipped_by_arm(_frame(s, d).excluded), f"select arm, count(*) n from {BUCKETED} where bucket = 'skipped' group by 1"),
    "frame_stale": (lambda s, d: FR.stale_by_config(_frame(s, d).excluded), f"select cfg, count(*) n from {BUCKETED} where bucket = 'stale' and {STUDY} group by 1"),
    "tally_configs": (lambda s, d: FR.tally_configs(records(s, d)), f"select cfg, count(*) n, string_agg(distinct state, ',' order by state) states from {V.RECORDS} where {STUDY} group by 1"),
    "arm_config_rule": (lambda s, d: FR.apply_arm_configs(records(s, d), {"A1": "c0", "A2": "c1"})[0].select("key"), f"select key from {V.RECORDS} where not (arm = 'A1' and cfg <> 'c0') and not (arm = 'A2' and cfg <> 'c1')"),
    "subset_cells": (lambda s, d: FR.subset(records(s, d), arm=["A1", "A3"], replicate=[0, 2]).select("key"), f"select key from {V.RECORDS} where arm in ('A1', 'A3') and replicate in (0, 2)"),
    "plan_stale_todo": (
        lambda s, d: J.stale(J.todo(_planned(s, d), _stored(s, d), ["key"]), _stored(s, d).drop("key"), ["arm", "brief", "replicate"], "cfg"),
        f"""select p.key, p.arm, p.brief, p.replicate, p.cfg, t.cfg stored_cfg from (select distinct 'arm=' || arm || '|brief=' || brief || '|rep=' || replicate || '|cfg=c1' as key, arm, brief, replicate, 'c1' as cfg from {V.RECORDS} where {STUDY}) p
 join (select arm, brief, replicate, cfg from {V.RECORDS} where {STUDY}) t on p.arm = t.arm and p.brief = t.brief and p.replicate = t.replicate and t.cfg <> p.cfg where p.key not in (select key from {V.RECORDS})""",
    ),
    "account_summary": (
        lambda s, d: L.summary(L.account(states(s, d).select("key"), states(s, d))),
        f"select count(*) planned, count(*) filter (state = 'completed') completed, count(*) filter (state = 'failed') failed, count(*) filter (state = 'skipped') skipped from {V.RECORDS}",
    ),
    "account_by_kind": (lambda s, d: L.by_kind(states(s, d)), f"select kind, count(*) n from {V.RECORDS} where state = 'failed' group by 1"),
    "account_skip_reasons": (
        lambda s, d: L.skipped_by_reason(states(s, d)),
        f"select case when coalesce(detail, '') = '' then 'unknown' else trim(split_part(detail, ':', 1)) end reason, count(*) n from {V.RECORDS} where state = 'skipped' group by 1",
    ),
    "operational_summary": (
        lambda s, d: L.operational_summary(states(s, d)).select(*[F.round(c, 6).alias(c) for c in ("parse_failure_rate", "empty_pool_rate", "refusal_rate", "p50", "p95")], "n"),
        f"""select 0.0::double parse_failure_rate, 0.0::double empty_pool_rate, round(avg(case when state = 'failed' and kind = 'refusal' then 1.0::double else 0 end), 6) refusal_rate,
 round(quantile_disc(value, 0.5) filter (state = 'completed'), 6) p50, round(quantile_disc(value, 0.95) filter (state = 'completed'), 6) p95, count(*) filter (state = 'completed') n from {V.RECORDS}""",
    ),
    "failure_classes": (
        lambda s, d: states(s, d).select("key", T.is_transient(F.col("kind")).alias("transient"), T.is_payment(F.col("kind")).alias("payment")),
        f"select key, coalesce(kind = 'timeout', false) transient, false as payment from {V.RECORDS}",
    ),
    "attempt_keys": (lambda s, d: attempts(s, d).select("key", "family", "cell", "through", "compacted"), f"select key, family, cell, through, compacted from {V.ATTEMPT_LOG}"),
    "next_attempt": (lambda s, d: L.next_attempt(attempts(s, d)), f"select family, cell, max(through) + 1 next_attempt from {V.ATTEMPT_LOG} group by 1, 2"),
    "contributing_attempts": (lambda s, d: L.contributing(attempts(s, d)).select("key"), f"select key from {CONTRIBUTING}"),
    "prune_plan": (
        lambda s, d: L.prune_plan(attempts(s, d)).select("key", "action"),
        f"select key, case when row_number() over (partition by family, cell order by through desc, compacted) <= case when family = 'batch-replay' then 1 else 5 end then 'keep' else 'evict' end as action from {V.ATTEMPT_LOG}",
    ),
    "resume_state": (
        lambda s, d: L.resume_state(attempts(s, d).withColumn("retired", F.col("event_id") % 3 == 0).withColumn("lever", F.when(F.col("event_id") % 2 == 0, "batch").otherwise("single")), "batch"),
        f"select cell, key, through, event_id % 3 = 0 as retired, 'batch' as lever from (select * from {V.ATTEMPT_LOG} where family = 'batch-replay' qualify row_number() over (partition by cell order by through desc) = 1) where event_id % 3 <> 0 and event_id % 2 = 0",
    ),
    "compacted_ledger": (
        lambda s, d: L.compacted_ledger(
            L.prune_plan(attempts(s, d)).where("action = 'evict'"),
            attempts(s, d).selectExpr("key", "'m' || (event_id % 3) as model", "'api' as billing_mode", "'batch' as pricing_regime", "event_id as input_tokens", "event_id % 10 as output_tokens", "cast(event_id as string) as timestamp"),
        ).drop("timestamp"),
        f"""with e as (select * from {V.ATTEMPT_LOG} qualify row_number() over (partition by family, cell order by through desc, compacted) > case when family = 'batch-replay' then 1 else 5 end),
 t as (select family, cell, max(through) filter (compacted) top, max(through) through from e group by 1, 2)
 select family, cell, 'm' || (event_id % 3) model, 'api' billing_mode, 'batch' pricing_regime, cast(sum(event_id) as bigint) input_tokens, cast(sum(event_id % 10) as bigint) output_tokens, any_value(t.through) through
 from e join t using (family, cell) where top is null or e.through > top or (compacted and e.through = top) group by family, cell, event_id % 3""",
    ),
    "usage_sums": (
        lambda s, d: L.usage_sums(table(s, d, "orders").selectExpr("o_orderpriority", "case when o_orderkey % 2 = 0 then o_orderkey end as input_tokens", "case when o_orderkey % 2 = 1 then o_orderkey end as prompt_tokens", "o_custkey as output_tokens", "o_orderkey % 3 as cache_read_input_tokens"), "o_orderpriority").drop("cache_creation_input_tokens"),
        "select o_orderpriority, cast(sum(o_orderkey) as bigint) input_tokens, cast(sum(o_custkey) as bigint) output_tokens, cast(nullif(sum(o_orderkey % 3), 0) as bigint) cache_read_input_tokens from orders group by 1",
    ),
    "replies_to_requests": (
        lambda s, d: L.replies_to_requests(
            table(s, d, "customer").selectExpr("'r' || c_custkey as custom_id"),
            table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).selectExpr("case when k % 5 = 0 then '{bad' when k % 5 = 1 then '{\"custom_id\":\"r' || o_custkey || '\",\"error\":\"x\"}' else '{\"custom_id\":\"r' || o_custkey || '\",\"text\":\"t' || k || '\"}' end as line"),
        ).select("custom_id", "text", "failure_kind"),
        """select 'r' || c_custkey custom_id, case when k % 5 > 1 then 't' || k end as text, case when k % 5 > 1 then null else 'transport_error' end failure_kind from customer left join (select o_custkey, max(o_orderkey) k from orders group by 1) on c_custkey = o_custkey""",
    ),
    "salvaged_spend": (
        lambda s, d: L.salvaged_spend(table(s, d, "supplier").selectExpr("s_nationkey as cell", "s_suppkey as stored_at", "s_acctbal as usd"), table(s, d, "supplier").where("s_acctbal > 0").selectExpr("s_nationkey as cell", "s_suppkey as pruned_from")),
        "select s_nationkey cell, s_suppkey stored_at, s_acctbal usd from supplier where not s_acctbal > 0",
    ),
    "key_order": (lambda s, d: records(s, d).select("key").orderBy("key"), f"select key from {V.RECORDS} order by key"),
}


def _planned(s, d):
    rows = records(s, d).where(K.parse_cell_key(F.col("key")).isNotNull()).select("arm", "brief", "replicate").distinct().withColumn("cfg", F.lit("c1"))
    return rows.withColumn("key", K.cell_key(F.col("arm"), F.col("brief"), F.col("replicate"), F.col("cfg")))


def _stored(s, d):
    return records(s, d).where(K.parse_cell_key(F.col("key")).isNotNull()).select("key", "arm", "brief", "replicate", "cfg")
