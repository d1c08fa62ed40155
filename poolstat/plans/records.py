"""Queries of records, corpus hashes and whole run steps."""

from pyspark.sql import functions as F

from poolstat.operators import corpus as C
from poolstat.operators import pruning as PR
from poolstat.operators import records as R
from poolstat.operators import runs as U
from poolstat.operators import teams as TE
from poolstat.sources.tables import table

from . import views as V
from .judges import scores
from .money import rounded
from .store import _planned, _stored
from .store import records as table_records


def _briefs(s, d):
    return table(s, d, "nation").selectExpr("n_name as id", "'brief of ' || n_name as text", "n_regionkey as region")


NEXT = f"(select cell, max(through) + 1 n from {V.ATTEMPT_LOG} where family = '{{family}}' group by 1)"
ITEMS = "(select n_regionkey region, '[' || string_agg('{\"id\":\"' || n_name || '\",\"contentHash\":\"' || substr(sha256('brief of ' || n_name), 1, 12) || '\"}', ',' order by n_name) || ']' j from nation group by 1)"


def _failures(s, d):
    return table(s, d, "customer").selectExpr("'arm=x|u' || c_custkey as cell", "'c' as cfg", "'timeout' as kind", "c_name as detail").withColumn("cost_rows", F.array(F.struct(F.lit("m").alias("model"))))


def _cells(s, d):
    """Stored study cells, and salvage records of some: of the very cell (left by a crash), or of an older one of its key."""
    cells = table_records(s, d).where("key like 'arm=%'").selectExpr("key", "state", "kind", "cfg", "cast(event_id as string) as stored_at", "event_id")
    held = cells.where("kind = 'timeout' and event_id % 5 < 2").selectExpr(
        "'pruned-cell|cell=' || key || '|attempt=0' as key", "'failed' as state", "kind", "cfg", "cast(null as string) as stored_at", "event_id", "array(case when event_id % 5 = 0 then stored_at else 'old' end) as pruned_from"
    )
    return cells.withColumn("pruned_from", F.lit(None).cast("array<string>")).unionByName(held)


def _attempts(s, d):
    return V.attempt_log(s, d).selectExpr("key", "case when key like 'judge-call%' then 'completed' else 'failed' end as state", "'timeout' as kind", "'c0' as cfg", "cast(null as string) as stored_at", "event_id", "cast(null as array<string>) as pruned_from")


def _prunable(s, d):
    return _attempts(s, d).unionByName(_cells(s, d))


def _pruned(s, d):
    rows = _prunable(s, d)
    lines = rows.where("key not like 'batch-replay%'").selectExpr(
        "key", "regexp_replace(regexp_replace(key, '^[a-z-]+[|]cell=', ''), '[|](attempt|through)=[0-9]+$', '') as cell_key", "case when event_id % 4 = 0 then '1997-01-01' else '1999-01-01' end as timestamp",
        "case when event_id % 3 = 0 then 'subscription' else 'api' end as billing_mode", "'batch' as pricing_regime", "case when key like 'generation-%' then 'claude-4' else 'claude-1' end as model", "event_id * 1000 as input_tokens", "100L as output_tokens",
    )
    return PR.prune(rows, lines, V.rates(s), states=["failed", "completed"])


#: every record with what the prune does to it; claude-4 has a dated rate, so that generation attempts of both sides do not fold
PRUNE = f"""(with cells as (select key, state, kind, event_id from {V.RECORDS} where key like 'arm=%'),
 a as (select key, family, cell, through, compacted, event_id, case when family = 'judge-call' then 'completed' else 'failed' end as state, 'timeout' as kind, null as pruned_from from {V.ATTEMPT_LOG}
  union all select 'pruned-cell|cell=' || key || '|attempt=0', 'pruned-cell', key, 0, false, event_id, 'failed', kind, case when event_id % 5 = 0 then event_id::varchar else 'old' end from cells where kind = 'timeout' and event_id % 5 < 2),
 o as (select *, row_number() over (partition by family, cell order by through desc, compacted) > case when family = 'batch-replay' then 1 else 5 end as old from a),
 t as (select *, family || '-compacted|cell=' || cell || '|through=' || max(through) over w as target, max(through) filter (compacted) over w as top, count(*) over w as n from o window w as (partition by family, cell, old)),
 k as (select *, case when not old then 'keep' when family = 'batch-replay' then 'supersede' when n = 1 and key = target then 'keep' else 'fold' end as action from t)
 select key, action, case when action = 'fold' then target end as into_, action = 'fold' and (top is null or through > top or (compacted and through = top)) as contributes, cell, event_id, state, kind, pruned_from from k
 union all select key, case when kind = 'timeout' then 'evict' when state = 'completed' then 'refuse' else 'keep' end, null, false, key, event_id, state, kind, null from cells)"""
#: the salvage key of each cell that leaves with a spend not yet salvaged
SALVAGED = f"(select key, 'pruned-cell|cell=' || key || '|attempt=' || case when event_id % 5 = 1 then 1 else 0 end as target, event_id, kind from {PRUNE} where action = 'evict' and event_id % 5 <> 0)"
PRUNED_LEDGER = f"""with p as (select * from {PRUNE}),
 f as (select into_ as key, event_id % 3 = 0 as mode, event_id % 4 = 0 as early, event_id, into_ like 'generation-%' as dated from p where contributes),
 g as (select key, mode, count(*) n, any_value(dated) and count(distinct early) > 1 as apart, sum(event_id) * 1000 i, count(*) * 100 o from f group by 1, 2)
 select key, cast(n as bigint) n, cast(i as bigint) input_tokens, cast(o as bigint) output_tokens from (
 select key, 1 n, event_id * 1000 i, 100 o from p where action in ('keep', 'refuse') and key not like 'batch-replay%' union all select target, 1, event_id * 1000, 100 from {SALVAGED}
 union all select key, case when bool_or(apart) then sum(n) else count(*) end, sum(i), sum(o) from g group by 1)"""
PRUNED_RECORDS = f"""select key, state, kind, pruned_from from {PRUNE} where action in ('keep', 'refuse')
 union all select target, 'failed', kind, event_id::varchar from {SALVAGED}
 union all select into_, case when into_ like 'judge-call%' then 'completed' else 'failed' end, case when into_ not like 'judge-call%' then 'harness_error' end, '' from {PRUNE} where contributes group by 1"""


QUERIES = {
    "corpus_hash": (lambda s, d: C.corpus_hash(_briefs(s, d), "region"), f"select region, substr(sha256(j), 1, 12) as hash from {ITEMS}"),
    "brief_hashes": (lambda s, d: C.content_hashes(_briefs(s, d)), "select n_name id, substr(sha256('brief of ' || n_name), 1, 12) content_hash from nation"),
    "first_corpus_hash": (
        lambda s, d: C.first_corpus_hash(_briefs(s, d), [r.n_name for r in table(s, d, "nation").where("n_regionkey = 1").select("n_name").collect()]),
        f"select substr(sha256(j), 1, 12) as hash from {ITEMS} where region = 1",
    ),
    "judge_score_records": (
        lambda s, d: R.judge_scores(scores(s, d).withColumn("judge", F.concat(F.lit("m-"), "judge_provider"))).select("key", "state", "arm", "brief", "cfg", F.get_json_object("body", "$.result.kind").alias("kind")),
        "select distinct 'judge-scores|pool=p' || s_nationkey || '|judge=m-' || j as key, 'completed' state, '__judge-scores__' arm, 'p' || s_nationkey brief, 'm-' || j cfg, 'judge-scores' kind from (select s_nationkey, case when s_suppkey % 2 = 0 then 'anthropic' else 'openai' end j from supplier)",
    ),
    "validation_records": (
        lambda s, d: R.validations(table(s, d, "nation").selectExpr("'j' as judge_hash", "'r' || n_regionkey as request_hash", "n_name as slice_id", "0.6D as accuracy", "0.561D as floor", "'pass' as verdict", "20 as n", "0.5D as rho")).select("key", "cfg", F.get_json_object("body", "$.result.verdict").alias("verdict")),
        "select 'judge-validation|judge=j|req=r' || n_regionkey || '|slice=' || n_name as key, 'j' cfg, 'pass' verdict from nation",
    ),
    "failed_attempt_records": (
        lambda s, d: R.failed_attempts(_failures(s, d), V.attempt_log(s, d)).select("key", "state", F.get_json_object("body", "$.accounting.kind").alias("kind")),
        f"select 'generation-attempt|cell=arm=x|u' || c_custkey || '|attempt=' || coalesce(n, 0) as key, 'failed' state, 'timeout' kind from customer left join {NEXT.format(family='generation-attempt')} on cell = 'arm=x|u' || c_custkey",
    ),
    "metrics_attempt_records": (
        lambda s, d: R.failed_attempts(_failures(s, d), V.attempt_log(s, d), "metrics-attempt").select("key", F.get_json_object("body", "$.accounting.kind").alias("kind")),
        f"select 'metrics-attempt|cell=arm=x|u' || c_custkey || '|attempt=' || coalesce(n, 0) as key, 'harness_error' kind from customer left join {NEXT.format(family='metrics-attempt')} on cell = 'arm=x|u' || c_custkey",
    ),
    "judge_call_records": (
        lambda s, d: R.judge_calls(table(s, d, "customer").selectExpr("c_name as pool", "'m' as judge", "'2026-01-01' as timestamp", "c_custkey as input_tokens", "1 as output_tokens"), V.attempt_log(s, d)).select("key", F.get_json_object("body", "$.costRows[0].input_tokens").cast("long").alias("tokens")),
        "select 'judge-call|cell=' || c_name || '|judge=m|attempt=0' as key, c_custkey tokens from customer",
    ),
    "resume_records": (
        lambda s, d: R.resume_records(table(s, d, "customer").selectExpr("'arm=x|u' || c_custkey as cell", "'c' as cfg", "'batch' as lever", "false as retired", "filter(array(c_name), x -> c_custkey % 3 = 0) as replies", "filter(array(c_name), x -> c_custkey % 2 = 0) as outstanding"), V.attempt_log(s, d)).select("key", "state"),
        f"select 'batch-replay|cell=arm=x|u' || c_custkey || '|attempt=' || coalesce(n, 0) as key, 'skipped' state from customer left join {NEXT.format(family='batch-replay')} on cell = 'arm=x|u' || c_custkey where c_custkey % 3 = 0 or c_custkey % 2 = 0",
    ),
    "cost_rows_for": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", F.explode(R.cost_rows_for(F.col("s_name"), F.lit("2026-01-01"), R.pricing_lever(F.col("s_suppkey") % 2 == 0), F.struct(F.when(F.col("s_suppkey") % 3 > 0, "m").alias("model"), F.col("s_suppkey").alias("input_tokens"), F.lit(1).alias("output_tokens")))).alias("r")).select("s_suppkey", "r.cell_key", "r.pricing_regime", "r.input_tokens"),
        "select s_suppkey, s_name cell_key, case when s_suppkey % 2 = 0 then 'batch' else 'single' end pricing_regime, s_suppkey input_tokens from supplier where s_suppkey % 3 > 0",
    ),
    "agent_counts": (
        lambda s, d: table(s, d, "part").select("p_partkey", R.agent_counts(F.col("p_size") % 7, F.col("p_partkey") % 9)["realized"].alias("realized")), "select p_partkey, case when p_partkey % 9 <= p_size % 7 then p_size % 7 - p_partkey % 9 end realized from part",
    ),
    "resolved_models": (
        lambda s, d: table(s, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("p"), F.col("s_suppkey") % 2).alias("persona"), F.col("s_name").alias("model")))).alias("slots")).select("s_nationkey", F.explode(TE.resolved_models(F.col("slots")))).select("s_nationkey", F.col("key").alias("persona"), F.col("value").alias("model")),
        "select s_nationkey, case when r > 1 then 'p' || (s_suppkey % 2) || '#' || (i - 1) else 'p' || (s_suppkey % 2) end persona, s_name model from (select *, row_number() over (partition by s_nationkey, s_suppkey % 2 order by s_suppkey) r, row_number() over (partition by s_nationkey order by s_suppkey) i from supplier)",
    ),
    "structural_grid": (
        lambda s, d: rounded(U.structural_grid(V.slots(s, d).selectExpr("cast(arm as string) as cell_key", "arm"), V.slots(s, d), V.rates(s))),
        f"select cast(s.arm as varchar) cell_key, s.arm, round(sum((case when mode = 'solo' then 2500 else 16000 end / s.n / 1e6 * rate_in + case when mode = 'solo' then 1500 else 9000 end / s.n / 1e6 * rate_out) * 0.5), 6) usd from {V.SLOTS} s join {V.RATES} r on s.model = r.model group by 1, 2",
    ),
    "cell_metrics": (
        lambda s, d: U.cell_metrics(table(s, d, "embeddings"), "label", "embedding", 0.0).select("label", "n", "distinct_k", F.round("pool_diversity", 4).alias("pool_diversity"), "collapse_rate", "fluency", "flexibility"),
        "with u as (select vec_id, label, embedding::double[] v from embeddings), c as (select label, count(*) n from u group by 1) select a.label, any_value(n) n, any_value(n) distinct_k, round(avg(1 - list_cosine_similarity(a.v, b.v)), 4) pool_diversity, 0.0::double collapse_rate, any_value(n) fluency, any_value(n) flexibility from u a join u b on a.label = b.label and a.vec_id < b.vec_id join c on c.label = a.label group by 1",
    ),
    "validation_requests": (
        lambda s, d: U.validation_requests(table(s, d, "nation").selectExpr("n_nationkey as idea", "'t' || n_regionkey as topic", "n_name as text")).select("topic", F.array_join("candidates", ",").alias("candidates")),
        "select 't' || n_regionkey topic, string_agg(n_name, ',' order by n_nationkey) candidates from nation group by 1",
    ),
    "pruned_keys": (
        lambda s, d: PR.prune_plan(V.attempt_log(s, d).select("key", F.lit("failed").alias("state"))).where("action = 'keep'").select("key"),
        f"select key from {V.ATTEMPT_LOG} qualify row_number() over (partition by family, cell order by through desc, compacted) <= case when family = 'batch-replay' then 1 else 5 end",
    ),
    "prune_actions": (
        lambda s, d: PR.prune_plan(_prunable(s, d), states=["failed", "completed"]).select("key", "action", "into", "contributes"),
        f"select key, action, into_ as \"into\", contributes from {PRUNE}",
    ),
    "pruned_ledger": (lambda s, d: _pruned(s, d).lines.groupBy("key").agg(F.count("*").alias("n"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens")), PRUNED_LEDGER),
    "pruned_records": (lambda s, d: _pruned(s, d).records.select("key", "state", "kind", F.array_join("pruned_from", ",").alias("pruned_from")), PRUNED_RECORDS),
    "plan_and_price": (
        lambda s, d: U.plan_and_price(_planned(s, d), _stored(s, d), V.slots(s, d).withColumn("arm", F.concat(F.lit("A"), F.col("arm"))), V.rates(s)).projection.select("cell_key", "calibrated"),
        f"select key as cell_key, false as calibrated from (select distinct 'arm=' || arm || '|brief=' || brief || '|rep=' || replicate || '|cfg=c1' as key from {V.RECORDS} where key like 'arm=%') where key not in (select key from {V.RECORDS})",
    ),
}
