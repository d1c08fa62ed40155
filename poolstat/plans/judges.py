"""Queries of judges, pools, score frames and validation."""

from pyspark.sql import functions as F

from poolstat.functions import keys as K
from poolstat.operators import judging as J
from poolstat.operators import pricing as P
from poolstat.operators import teams as TE
from poolstat.sources.tables import table

from . import views as V
from .money import rounded

CLAUDES, GPTS = ["claude-1", "claude-4", "claude-7", "claude-99"], ["gpt-2", "gpt-5"]


def pools(s, d):
    arms = V.slots(s, d).select(F.concat(F.lit("p"), F.col("arm")).alias("pool"), F.concat(F.lit("a"), F.col("arm")).alias("arm"), F.transform("slots", lambda x: x["model"]).alias("models"))
    return arms.withColumn("generator_providers", F.when(F.col("arm").rlike("[02468]$"), F.array(F.lit("anthropic"))).otherwise(F.array(F.lit("anthropic"), F.lit("openai"))))


def judges(s):
    return s.createDataFrame([("anthropic", CLAUDES), ("openai", GPTS)], "provider string, candidates array<string>")


def matrix(s, d):
    return J.judge_matrix(pools(s, d).select("pool", "models"), judges(s), 1)


def scores(s, d):
    """Score records: an anthropic and an openai judge on the pool of each nation, axes from supplier balances."""
    rows = table(s, d, "supplier").selectExpr("'p' || s_nationkey as pool", "case when s_suppkey % 2 = 0 then 'anthropic' else 'openai' end as judge_provider", "s_suppkey", "s_acctbal as originality", "cast(s_suppkey % 10 as double) as feasibility")
    return rows.groupBy("pool", "judge_provider").agg(F.collect_list(F.struct("originality", "feasibility")).alias("scores"), F.min("s_suppkey").alias("k")).withColumn("key", K.judge_scores_key(F.col("pool"), F.col("judge_provider")))


PICK = "case {p} when 'anthropic' then case " + " ".join(f"when not list_contains(models, '{c}') then '{c}'" for c in CLAUDES) + " end else 'gpt-2' end"
POOLS = f"(select 'p' || arm as pool, list(model) as models from {V.SLOTS} group by arm)"
MATRIX = f"(select pool, p as provider, {PICK.format(p='p')} as judge from {POOLS}, (select unnest(['anthropic', 'openai']) as p))"
FRAME = """(select 'p' || s_nationkey as pool, 'a' || s_nationkey as arm, case when s_suppkey % 2 = 0 then 'anthropic' else 'openai' end as judge_provider, s_suppkey % 2 = 0 or s_nationkey % 2 = 1 as same_provider, avg((s_acctbal + s_suppkey % 10) / 2) as response, min(s_suppkey) k from supplier group by all)"""


def frame(s, d):
    return J.score_frame(scores(s, d), pools(s, d))


QUERIES = {
    "judge_matrix": (lambda s, d: matrix(s, d).select("pool", "provider", "judge", "key"), f"select pool, provider, judge, 'judge-scores|pool=' || pool || '|judge=' || judge as key from {MATRIX}"),
    "judge_open_legs": (
        lambda s, d: J.open_legs(matrix(s, d), matrix(s, d).where("provider = 'openai'").select("key")).select("pool", "provider"), f"select pool, provider from {MATRIX} where provider <> 'openai'",
    ),
    "judge_leg_states": (
        lambda s, d: J.leg_states(table(s, d, "orders").selectExpr("o_orderkey as key", "o_orderpriority as provider", "o_orderkey as at"), table(s, d, "orders").where("o_orderstatus <> 'O'").selectExpr("o_orderkey as key", "'completed' as state", "case when o_orderkey % 997 = 3 then 'payment_required' end as kind")).select("key", "state"),
        "select o_orderkey as key, case when o_orderkey > (select min(o_orderkey) from orders b where b.o_orderpriority = a.o_orderpriority and o_orderstatus <> 'O' and o_orderkey % 997 = 3) then 'skipped' when o_orderstatus <> 'O' then 'completed' else 'deferred' end state from orders a",
    ),
    "generator_providers": (
        lambda s, d: V.slots(s, d).select("arm", F.array_join(J.generator_providers(F.col("slots")), ",").alias("providers")), f"select distinct arm, 'anthropic' providers from {V.SLOTS}",
    ),
    "score_frame": (
        lambda s, d: rounded(frame(s, d).select("pool", "arm", "judge_provider", "same_provider", "response"), 5), f"select pool, arm, judge_provider, same_provider, round(response, 5) response from {FRAME}",
    ),
    "bias_by_judge": (lambda s, d: J.bias_by_judge(frame(s, d)), f"select judge_provider, count(distinct same_provider) flags, count(*) n from {FRAME} group by 1"),
    "axis_scores": (
        lambda s, d: scores(s, d).select("key", F.posexplode(J.scores_for_axis(F.col("scores"), "feasibility"))).groupBy("key").agg(F.sum("col").alias("feasibility")),
        "select 'judge-scores|pool=p' || s_nationkey || '|judge=' || case when s_suppkey % 2 = 0 then 'anthropic' else 'openai' end as key, cast(sum(s_suppkey % 10) as double) feasibility from supplier group by 1",
    ),
    "instrument": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", J.instrument(F.when(F.col("s_suppkey") % 3 == 0, "h1").when(F.col("s_suppkey") % 3 == 1, "h2"), F.lit("h1"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("s")), F.lit("s")).alias("use")),
        "select s_suppkey, case when s_suppkey % 3 = 0 then 'match' when s_suppkey % 3 = 1 then 'mismatch' when s_suppkey % 2 = 0 then 'match' else 'unknown' end as use from supplier",
    ),
    "licensed_scores": (
        lambda s, d: J.licensed(scores(s, d).select("key"), table(s, d, "nation").selectExpr("'judge-validation|judge=j|req=h|slice=' || n_name as key", "case when n_nationkey % 2 = 0 then 'h' else 'g' end as request_hash", "case when n_nationkey = 4 then 'pass' else 'drop' end as verdict"), "j", "h"),
        "select distinct 'judge-scores|pool=p' || s_nationkey || '|judge=' || case when s_suppkey % 2 = 0 then 'anthropic' else 'openai' end as key from supplier",
    ),
    "judge_requests": (
        lambda s, d: J.judge_requests(scores(s, d).selectExpr("pool || judge_provider as pool", "k as seed", "transform(scores, x -> cast(x.originality as string)) as candidates")).groupBy("pool").agg(F.count("*").alias("n"), F.count_distinct("index").alias("distinct_n"), F.max("position").alias("last")),
        "select 'p' || s_nationkey || case when s_suppkey % 2 = 0 then 'anthropic' else 'openai' end as pool, count(*) n, count(*) distinct_n, cast(count(*) - 1 as int) as last from supplier group by 1",
    ),
    "unpermuted_scores": (
        lambda s, d: J.unpermuted(table(s, d, "supplier").selectExpr("s_nationkey as pool", "s_suppkey as index", "s_acctbal as score")).select("pool", F.round(F.col("scores")[0], 4).alias("first"), F.size("scores").alias("n")),
        "select s_nationkey pool, round(arg_min(s_acctbal, s_suppkey), 4) as first, cast(count(*) as int) n from supplier group by 1",
    ),
    "judge_legs_priced": (
        lambda s, d: rounded(TE.judge_legs(matrix(s, d), table(s, d, "nation").selectExpr("'p' || n_nationkey as pool", "case when n_nationkey % 4 = 0 then 'solo' else 'panel' end as mode", "n_nationkey as wanted"), 5, 6, 2).join(V.rates(s), F.col("judge") == F.col("model"), "left").where("rate_in is not null").select("pool", "provider", "candidates", P.judge_leg_usd(F.col("candidates"), F.col("rate_in"), F.col("rate_out"), F.lit(0.5)).alias("usd"))),
        f"select pool, provider, n as candidates, round((case when n > 0 then n else 30 end * 700 / 1e6 * rate_in + case when n > 0 then n else 30 end * 40 / 1e6 * rate_out) * 0.5, 6) usd from (select m.*, case when n_nationkey % 4 = 0 then n_nationkey else 60 end n from {MATRIX} m join nation on pool = 'p' || n_nationkey) join {V.RATES} on judge = model",
    ),
    "agents": (
        lambda s, d: TE.agents(V.slots(s, d).withColumn("ideas", F.lit(6)), "ideas").select("arm", "agent", "model", "effort", "ideas"),
        f"select arm, case when mode = 'solo' then 'solo' else 'k' || k || '#' || (row_number() over (partition by arm order by k) - 1) end agent, model, effort, 6 ideas from (select *, row_number() over (partition by s_nationkey order by s_suppkey) r from (select s_nationkey, s_suppkey, s_nationkey as arm, s_suppkey as k, 'claude-' || (1 + 3 * (s_suppkey % 5)) as model, case s_nationkey % 3 when 0 then 'low' when 1 then 'high' else case when s_suppkey % 2 = 0 then 'high' else 'max' end end as effort, case when s_nationkey % 4 = 0 then 'solo' else 'panel' end as mode from supplier)) where mode <> 'solo' or r = 1",
    ),
    "mock_completions": (
        lambda s, d: TE.mock_completions(V.slots(s, d)).select("arm", "model", "input_tokens", "output_tokens"),
        f"select arm, model, 500 * count(*) input_tokens, 300 * count(*) output_tokens from {V.SLOTS} group by 1, 2",
    ),
    "embed_pairs": (
        lambda s, d: TE.texts_once(V.pairs(s, d).select("a", "b")), "select distinct t as text from (select a t from (select a.vec_id a, b.vec_id b from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 10) union all select b from (select a.vec_id a, b.vec_id b from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 10))",
    ),
}
