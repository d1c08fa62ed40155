"""Queries of row checks and canonical forms."""

from pyspark.sql import functions as F

from poolstat.operators import checks as C
from poolstat.operators import judging as J
from poolstat.operators import pricing as P
from poolstat.operators import records as R
from poolstat.operators import teams as TE
from poolstat.sources.rates import RATES, rate_table
from poolstat.sources.tables import table

from . import views as V

SCORE = """case when event_id % 11 = 0 then '[1,2]' when event_id % 7 = 0 then '{"originality":"' || event_id % 5 || '","feasibility":3}'
 else '{"originality":' || event_id % 5 || ',"feasibility":' || user_id % 5 || case when event_id % 3 = 0 then ',"overallScore":2}' else '}' end end"""
LINE = """'{"qty":' || cast(l_quantity as int) || ',"flag":"' || l_returnflag || '","line":' || l_linenumber || '}'"""
RESUME = """case s_suppkey % 4 when 0 then '{"replies":{"r' || s_suppkey || '":"ok"},"outstanding":["b' || s_nationkey || '"]}' when 1 then '{"replies":{"a":"' || s_suppkey || '"}}' when 2 then '{"outstanding":["x","y"]}' end"""

QUERIES = {
    "axes_collapsed": (
        lambda s, d: table(s, d, "events").select("event_id", C.axes_collapsed(F.expr(SCORE)).alias("why")),
        """select event_id, case when event_id % 11 = 0 then 'no object' when event_id % 7 = 0 then 'an axis is missing' when event_id % 5 = user_id % 5 and event_id % 3 = 0 then 'a composite beside the axes' end as why from events""",
    ),
    "canonical_order": (
        lambda s, d: C.canonical_order(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(LINE).alias("row")), ["l_orderkey"], "row").select("l_orderkey", "l_linenumber", "position"),
        f"select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by {LINE}) - 1 as position from lineitem",
    ),
    "templates_hash": (
        lambda s, d: C.templates_hash(table(s, d, "nation").select("n_regionkey", "n_name", F.expr("'Write ideas on ' || n_name || '.'").alias("text")), "n_regionkey", "n_name", "text"),
        """select n_regionkey, substr(sha256('{' || string_agg('"' || n_name || '":"Write ideas on ' || n_name || '."', ',' order by n_name) || '}'), 1, 12) as hash from nation group by 1""",
    ),
    "resume_normalized": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", C.resume_state(F.expr(RESUME)).alias("r")).select("s_suppkey", F.to_json("r.replies").alias("replies"), F.array_join("r.outstanding", ",").alias("outstanding")),
        """select s_suppkey, case s_suppkey % 4 when 0 then '{"r' || s_suppkey || '":"ok"}' when 1 then '{"a":"' || s_suppkey || '"}' else '{}' end replies, case s_suppkey % 4 when 0 then 'b' || s_nationkey when 2 then 'x,y' else '' end outstanding from supplier""",
    ),
    "abandoned_batches": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.struct(F.concat(F.lit("b"), "o_orderkey").alias("batch_id"), F.floor(F.col("o_totalprice")).alias("elapsed_ms"), F.lit(1000).alias("max_poll_ms"), F.col("o_orderstatus").alias("last_status"), (F.col("o_orderkey") % 2 == 0).alias("cancelled"))))).alias("a")).select("o_custkey", C.abandon_prefix(F.lit("anthropic"), F.col("a")).alias("detail")),
        """select o_custkey, coalesce('anthropic: POLL_CEILING_REACHED -- gave up waiting; the API did NOT fail. abandoned_batches=[' || string_agg('{"batch_id":"b' || o_orderkey || '","elapsed_ms":' || floor(o_totalprice)::bigint || ',"max_poll_ms":1000,"last_status":"F","cancelled":' || (o_orderkey % 2 = 0) || '}', ',' order by 'b' || o_orderkey) filter (o_orderstatus = 'F') || '] -- ', '') as detail from orders group by 1""",
    ),
    "judge_view": (
        lambda s, d: TE.deidentified(table(s, d, "documents").selectExpr("source as pool", "doc_id as `index`", "lang as arm", "substr(text, 1, 40) as text").where("trim(text) <> ''")).selectExpr("pool", "`index` as place", "text"),
        "select source as pool, doc_id as place, substr(text, 1, 40) as text from documents where trim(substr(text, 1, 40), ' ') <> ''",
    ),
    "judge_payloads": (
        lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("t")).select("n_regionkey", F.to_json(TE.payload(F.concat(F.lit("brief "), "n_regionkey"), F.col("t"))).alias("payload")),
        """select n_regionkey, '{"brief":"brief ' || n_regionkey || '","candidates":[' || string_agg('{"text":"' || n_name || '"}', ',' order by n_name) || ']}' as payload from nation group by 1""",
    ),
    "distinct_evaluators": (
        lambda s, d: V.slots(s, d).select("arm", J.distinct_evaluator(F.concat(F.lit("gpt-"), F.col("arm").cast("string")), F.transform("slots", lambda x: x["model"])).alias("judge")),
        "select distinct s_nationkey as arm, 'gpt-' || s_nationkey as judge from supplier",
    ),
    "mock_scores": (
        lambda s, d: TE.mock_scores(table(s, d, "customer").select("c_custkey")).groupBy("originality", "feasibility").agg(F.count("*").alias("n")),
        "select 5.0::double originality, 4.0::double feasibility, count(*) n from customer",
    ),
    "pilot_slice": (
        lambda s, d: TE.pilot_slice(table(s, d, "lineitem").selectExpr("l_orderkey as cell", "l_linenumber as place", "'b' || (l_suppkey % 24) as brief", "l_linenumber as replicate"), ["b0", "b4", "b8", "b12", "b16", "b20"]).select("cell", "place", "brief"),
        "select l_orderkey as cell, l_linenumber as place, 'b' || (l_suppkey % 24) as brief from lineitem where l_suppkey % 4 = 0 and l_linenumber = 1",
    ),
    "cell_token_bounds": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.floor(F.col("o_totalprice") / 10).cast("int")).alias("b"), F.max("o_orderkey").cast("int").alias("asked")).select("o_custkey", TE.cell_max_tokens(F.col("b"), F.col("asked")).alias("bound")),
        "select o_custkey, greatest(max(floor(o_totalprice / 10)::int), max(o_orderkey))::int as bound from orders group by 1",
    ),
    "valid_responses": (
        lambda s, d: R.valid_responses(table(s, d, "events").selectExpr("event_type", "case when event_type = 'error' then 'failed' else 'completed' end as state", "case when event_type = 'error' then 'timeout' end as kind")).groupBy("event_type", "state").agg(F.count("*").alias("n")),
        "select event_type, case when event_type = 'error' then 'failed' else 'completed' end as state, count(*) n from events group by 1",
    ),
    "dated_rate_spend": (
        lambda s, d: P.totals(P.price_lines(_dated(s, d), rate_table(s), batch=True), "model").select("model", F.round("total_usd", 6).alias("usd"), "missing_models"),
        f"""select l.model, round(sum((qty * 1000 / 1e6 * coalesce(rate_in, 0) + qty * 100 / 1e6 * coalesce(rate_out, 0)) * (1 - coalesce(off, 0))), 6) as usd, case when any_value(rate_in) is null then l.model else '' end as missing_models
 from (select case l_suppkey % 9 {" ".join(f"when {i} then '{r[0]}'" for i, r in enumerate(RATES))} else 'unknown-1' end as model, l_quantity as qty from lineitem) l
 left join (values {", ".join(f"('{m}', {i}::double, {o}::double, {b}::double)" for m, i, o, b, _ in RATES)}) r(model, rate_in, rate_out, off) on r.model = l.model group by 1""",
    ),
}


def _dated(s, d):
    """Lines of lineitem under the models of the dated rate table, and one that it lacks."""
    models = F.when(F.lit(False), F.lit(""))
    for i, r in enumerate(RATES):
        models = models.when(F.col("l_suppkey") % 9 == i, r[0])
    rows = table(s, d, "lineitem").withColumn("model", models.otherwise("unknown-1"))
    return rows.selectExpr("cast(l_orderkey as string) as cell_key", "'2026-09-09' as timestamp", "'api' as billing_mode", "'batch' as pricing_regime", "model", "l_quantity * 1000 as input_tokens", "l_quantity * 100 as output_tokens")
