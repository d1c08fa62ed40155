"""Views of the test tables that stand in for stores, ledgers, arms and judges, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.sources.tables import table

BRAND = "cast(substr(p_brand, 7) as int)"
MODEL = f"case when {BRAND} % 3 = 0 then 'voyage-' || {BRAND} when {BRAND} % 3 = 1 then 'claude-' || {BRAND} else 'gpt-' || {BRAND} end"
LEDGER_COLUMNS = [
    ("cell_key", "cast(l_orderkey as {text})"), ("timestamp", "{day}"), ("billing_mode", "case when l_returnflag = 'R' then 'subscription' else 'api' end"),
    ("pricing_regime", "case when l_linenumber = 7 then null when l_linestatus = 'F' then 'batch' else 'single' end"),
    ("model", MODEL), ("input_tokens", "l_quantity * 1000"), ("output_tokens", "cast(l_linenumber * 100 as double)"),
]


def ledger(s, d) -> DataFrame:
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(*[f"{e.format(text='string', day='date_format(l_shipdate, {0!r})'.format('yyyy-MM-dd'))} as {n}" for n, e in LEDGER_COLUMNS], "l_returnflag", "l_linestatus", "l_linenumber")


LEDGER = "(select " + ", ".join(f"{e.format(text='varchar', day='strftime(l_shipdate, {0!r})'.format('%Y-%m-%d'))} as {n}" for n, e in LEDGER_COLUMNS) + ", l_returnflag, l_linestatus, l_linenumber from lineitem join part on l_partkey = p_partkey)"

_RATE = [
    ("model", "case when n % 3 = 0 then 'voyage-' || n when n % 3 = 1 then 'claude-' || n else 'gpt-' || n end"), ("rate_in", "{x}n / 10.0{y}"), ("rate_out", "{x}n / 2.0{y}"),
    ("intro_until", "case when n % 4 = 0 then '1998-01-01' end"), ("intro_in", "case when n % 4 = 0 then {x}n / 20.0{y} end"), ("intro_out", "case when n % 4 = 0 then {x}n / 4.0{y} end"),
    ("batch_discount", "case when n % 5 <> 0 then {x}0.25{y} end"),
]


def rates(s, d=None, scale: float = 1.0) -> DataFrame:
    """Rates of 24 models; a 25th has none."""
    rows = s.range(1, 25).selectExpr("cast(id as int) as n")
    out = rows.selectExpr(*[f"{e.format(x='cast(', y=' as double)')} as {c}" for c, e in _RATE])
    return out if scale == 1.0 else out.withColumn("rate_in", F.col("rate_in") * scale)


RATES = "(select " + ", ".join(f"{e.format(x='cast(', y=' as double)')} as {c}" for c, e in _RATE) + " from (select cast(unnest(range(1, 25)) as int) as n))"
#: lines of LEDGER with rates, the fallback regime and the price; {batch} is what rows without a regime count as
LINES = f"""(select *, base * (1 - case when in_batch then discount else 0 end) as usd from (select l.*, r.model is null as missing_rate,
 coalesce(r.batch_discount, case when l.model like 'voyage-%' then 1 / 3.0::double else 0.5::double end) as discount,
 case when l.pricing_regime is null then {{batch}} else l.pricing_regime = 'batch' end as in_batch,
 case when r.model is null then 0 else l.input_tokens / 1e6 * case when r.intro_in is not null and l.timestamp <= r.intro_until then r.intro_in else r.rate_in end
  + l.output_tokens / 1e6 * case when r.intro_in is not null and l.timestamp <= r.intro_until then r.intro_out else r.rate_out end end as base
 from {LEDGER} l left join {RATES} r on l.model = r.model))"""


def slots(s, d) -> DataFrame:
    """Arms of three slots each: an arm for each nation, its models and efforts by its suppliers."""
    rows = table(s, d, "supplier").selectExpr("s_nationkey as arm", "s_suppkey as k", "'claude-' || (1 + 3 * (s_suppkey % 5)) as model", "case s_nationkey % 3 when 0 then 'low' when 1 then 'high' else case when s_suppkey % 2 = 0 then 'high' else 'max' end end as effort")
    return rows.groupBy("arm").agg(F.sort_array(F.collect_list(F.struct("k", "model", "effort"))).alias("slots")).withColumn("mode", F.when(F.col("arm") % 4 == 0, "solo").otherwise("panel"))


SLOTS = "(select s_nationkey as arm, 'claude-' || (1 + 3 * (s_suppkey % 5)) as model, case s_nationkey % 3 when 0 then 'low' when 1 then 'high' else case when s_suppkey % 2 = 0 then 'high' else 'max' end end as effort, case when s_nationkey % 4 = 0 then 'solo' else 'panel' end as mode, count(*) over (partition by s_nationkey) as n from supplier)"

#: store index lines: a key is written again and again, the last line counts
_INDEX = [
    ("key", "case when user_id % 7 = 0 then 'judge-call|cell=arm=' || user_id else 'arm=A' || (user_id % 5) || '|brief=b' || user_id || '|rep=' || (event_id % 3) || '|cfg=c' || (user_id % 2) end"),
    ("arm", "'A' || (user_id % 5)"), ("brief", "'b' || user_id"), ("replicate", "event_id % 3"), ("cfg", "'c' || (user_id % 2)"),
    ("state", "case event_type when 'error' then 'failed' when 'view' then 'skipped' else 'completed' end"), ("kind", "case when event_type = 'error' then case when event_id % 2 = 0 then 'timeout' else 'refusal' end end"),
    ("detail", "case when event_type = 'view' then case when event_id % 3 = 0 then 'budget_exceeded:anthropic' when event_id % 3 = 1 then 'no slot : later' else '' end end"), ("value", "value"), ("event_id", "event_id"),
]


def index_log(s, d) -> DataFrame:
    return table(s, d, "events").selectExpr(*[f"{e} as {n}" for n, e in _INDEX])


INDEX_LOG = "(select " + ", ".join(f"{e} as {n}" for n, e in _INDEX) + " from events)"
RECORDS = f"(select * from {INDEX_LOG} qualify row_number() over (partition by key order by event_id desc) = 1)"

#: attempt records: numbered by time within family and user, every tenth a compacted one
_ATTEMPT = "case event_type when 'error' then 'generation-attempt' when 'view' then 'metrics-attempt' when 'click' then 'judge-call' when 'signup' then 'pruned-cell' else 'batch-replay' end"


def attempt_log(s, d) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("family", "user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").selectExpr(f"{_ATTEMPT} as family", "user_id", "ts", "event_id", "value", "event_type").withColumn("n", F.row_number().over(w) - 1)
    return rows.selectExpr("case when n % 10 = 9 then family || '-compacted|cell=arm=x|u' || user_id || '|through=' || n else family || '|cell=arm=x|u' || user_id || '|attempt=' || n end as key", "event_id", "value")


ATTEMPT_LOG = f"""(select case when n % 10 = 9 then family || '-compacted|cell=arm=x|u' || user_id || '|through=' || n else family || '|cell=arm=x|u' || user_id || '|attempt=' || n end as key, event_id, value, family, 'arm=x|u' || user_id as cell, n as through, n % 10 = 9 as compacted
 from (select *, row_number() over (partition by family, user_id order by ts, event_id) - 1 as n from (select {_ATTEMPT} as family, * from events)))"""


def ratings(s, d) -> DataFrame:
    """Ideas rated by experts (few levels, many ties) and by a judge; topic by source."""
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return rows.selectExpr("doc_id as idea", "coalesce(lang, 'xx') as topic", "cast(2 * coalesce(quality, 0) + coalesce(toxic, 0) as double) as expert", "cast(n_chars as double) as judge")


RATINGS = "(select doc_id as idea, coalesce(lang, 'xx') as topic, cast(2 * coalesce(quality, 0) + coalesce(toxic, 0) as double) as expert, cast(n_chars as double) as judge from documents join labels using (doc_id))"


def pairs(s, d) -> DataFrame:
    """Each vector with the next ten by id; `same` if they share a label."""
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    a = v.select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("step")).withColumn("b", F.col("a") + F.col("step"))
    return a.join(v.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b").select("a", "b", F.when(F.col("la") == F.col("lb"), "same").otherwise("different").alias("label"))


PAIRS = "(select a.vec_id a, b.vec_id b, case when a.label = b.label then 'same' else 'different' end as label, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as distance from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 10)"
