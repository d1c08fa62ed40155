"""Queries of text, reply and transport functions."""

from pyspark.sql import functions as F

from poolstat.functions import documents as D
from poolstat.functions import keys as K
from poolstat.functions import text as T
from poolstat.operators import requests as RQ
from poolstat.operators import teams as TE
from poolstat.sources import store as S
from poolstat.sources.tables import table

REPLY = "case event_id % 6 when 0 then '[{\"text\":\"a' || event_id || '\"},{\"text\":\"b\"}]' when 1 then '```json\n[{\"text\":\"c\"}]\n```' when 2 then '[{\"text\":\"d\"},{\"text\":\"e' when 3 then 'no json' when 4 then '[]' else 'Sure: {\"text\":\"f\"}' end"
#: what each of REPLY's six kinds holds: objects, whether parsed at once, lost
KINDS = "(values (0, 2, true, 0), (1, 1, true, 0), (2, 1, false, 1), (3, 0, false, 0), (4, 0, true, 0), (5, 1, true, 0)) kinds(kind, found, parsed, lost)"
STATUS = "case event_id % 5 when 0 then 429 when 1 then 500 when 2 then 400 when 3 then 402 else 403 end"
MESSAGE = "case event_id % 7 when 0 then 'Your credit balance is too low' when 1 then 'see plans & billing' when 2 then 'other' else '' end"


def _replies(s, d):
    rows = table(s, d, "events").selectExpr("event_id", "user_id", f"{REPLY} as text", "case when event_id % 4 = 0 then 'max_tokens' when event_id % 4 = 1 then 'refusal' else 'end_turn' end as stop")
    r = D.salvaged(F.col("text"))
    return rows.withColumn("r", r).withColumn("found", F.size("r.objects")).withColumn("s", T.summarize_reply(F.col("text"), F.col("stop"), F.lit(3), F.col("r.parsed"), F.col("found"), F.col("r.lost")))


REPLIES = f"""(select e.*, found, parsed, lost, case when event_id % 4 = 0 then 'max_tokens' when event_id % 4 = 1 then 'refusal' else 'end_turn' end as stop, event_id % 4 = 0 as truncated,
 case when parsed then 'ok' when found > 0 then 'salvaged' else 'failed' end as parse from events e join {KINDS} on event_id % 6 = kind)"""


def _counts(s, d):
    rows = _replies(s, d)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("replies"), F.count_if("s.truncated").alias("truncated"), F.count_if(F.col("stop") == "refusal").alias("refused"),
        F.count_if(~F.col("s.truncated") & (F.col("s.parse") == "failed")).alias("bad"), F.count_if((F.col("found") == 0) & (F.col("s.truncated") | (F.col("s.parse") == "failed") | (F.col("stop") == "refusal"))).alias("idle"),
    )


COUNTS = f"(select user_id, count(*) replies, count(*) filter (truncated) truncated, count(*) filter (stop = 'refusal') refused, count(*) filter (not truncated and parse = 'failed') bad, count(*) filter (found = 0 and (truncated or parse = 'failed' or stop = 'refusal')) idle from {REPLIES} group by 1)"

QUERIES = {
    "normalize_title": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title")),
        "select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) title from documents",
    ),
    "normalize_id": (lambda s, d: table(s, d, "part").select("p_partkey", T.normalize_id(F.col("p_name")).alias("id")), r"select p_partkey, regexp_replace(p_name, '\s+', '', 'g') id from part"),
    "strip_extension": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.strip_mapping_extension(F.concat(F.lit(" "), "p_name", F.when(F.col("p_partkey") % 3 == 0, ".JSON ").when(F.col("p_partkey") % 3 == 1, ".txt").otherwise(".csv"))).alias("name")),
        "select p_partkey, trim(p_name || case p_partkey % 3 when 2 then '.csv' else '' end) as name from part",
    ),
    "title_line": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.title_line(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("title:  No "), F.col("doc_id").cast("string"), F.lit("  \nmore"))).otherwise("Untitled")).alias("title")),
        "select doc_id, case when doc_id % 2 = 0 then 'No ' || doc_id end title from documents",
    ),
    "csv_escape": (lambda s, d: table(s, d, "pages").select("page_id", T.csv_escape(F.col("html")).alias("cell")), """select page_id, case when regexp_matches(html, '[",\n]') then '"' || replace(html, '"', '""') || '"' else html end cell from pages"""),
    "xml_escape": (lambda s, d: table(s, d, "pages").select("page_id", F.md5(T.xml_escape(F.col("html"))).alias("h")), """select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) h from pages"""),
    "truncated_detail": (lambda s, d: table(s, d, "documents").select("doc_id", T.truncated_detail(F.col("text")).alias("detail")), "select doc_id, case when length(text) > 1400 then substr(text, 1, 1397) || '...' else text end detail from documents"),
    "salvaged_replies": (lambda s, d: _replies(s, d).select("event_id", "found", F.col("r.parsed").alias("parsed"), F.col("r.lost").alias("lost")), f"select event_id, found, parsed, lost from {REPLIES}"),
    "reply_summaries": (
        lambda s, d: _replies(s, d).select("event_id", "s.truncated", "s.parse", "s.text_length", "s.candidates", F.length("s.tail").alias("tail")),
        f"select event_id, truncated, parse, cast(length({REPLY}) as int) text_length, found candidates, 0 tail from {REPLIES}",
    ),
    "pool_failures": (
        lambda s, d: _counts(s, d).withColumn("f", T.pool_failure(F.col("replies"), F.col("truncated"), F.col("refused"), F.col("bad"), F.lit(False))).select("user_id", "f.kind", "f.cause"),
        f"select user_id, case when refused = replies then 'refusal' when truncated > 0 or bad > 0 then 'parse_failure' else 'empty_pool' end kind, case when refused = replies then 'refusal' when truncated > 0 then 'truncated' when bad > 0 then 'unparseable_complete' else 'genuinely_empty' end cause from {COUNTS}",
    ),
    "undersized_pools": (
        lambda s, d: _counts(s, d).withColumn("f", T.undersized_pool(F.col("user_id") % 2, F.col("idle"), F.col("truncated"), F.col("refused"), F.col("bad"))).select("user_id", "f.kind", "f.cause"),
        f"select user_id, case when user_id % 2 = 0 and idle = 0 then null when truncated > 0 then 'parse_failure' when refused > 0 then 'refusal' when bad > 0 then 'parse_failure' else 'harness_error' end kind, case when user_id % 2 = 0 and idle = 0 then null when truncated > 0 then 'partial_truncated' when refused > 0 then 'partial_refusal' when bad > 0 then 'partial_unparseable_complete' else 'partial_unexplained' end cause from {COUNTS}",
    ),
    "transport_kinds": (
        lambda s, d: table(s, d, "events").selectExpr("event_id", f"{STATUS} as status", f"{MESSAGE} as message", "case when event_id % 11 = 0 then 'insufficient_quota' end as codes").select("event_id", T.transport_kind(F.col("status"), F.col("message"), F.col("codes")).alias("kind")),
        f"select event_id, case when event_id % 7 < 2 or event_id % 11 = 0 then 'payment_required' when {STATUS} = 429 then 'rate_limited' else 'transport_error' end kind from events",
    ),
    "failure_kinds": (
        lambda s, d: table(s, d, "events").select("event_id", T.failure_kind(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0, F.col("event_type")).alias("kind")),
        "select event_id, case when event_id % 2 = 0 then 'payment_required' when event_id % 3 = 0 then 'timeout' when event_id % 5 = 0 then 'rate_limited' when event_id % 7 = 0 then 'transport_error' else event_type end kind from events",
    ),
    "finish_reasons": (
        lambda s, d: table(s, d, "events").select("event_id", T.finish_reason(F.when(F.col("event_id") % 4 == 0, "length").when(F.col("event_id") % 4 == 1, "stop").when(F.col("event_id") % 4 == 2, "content_filter").otherwise("tool")).alias("reason")),
        "select event_id, case event_id % 4 when 0 then 'max_tokens' when 1 then 'end_turn' when 2 then 'refusal' else 'tool' end reason from events",
    ),
    "block_text": (
        lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "text").otherwise("tool").alias("type"), "text"))).alias("b")).select("conv_id", F.md5(T.block_text(F.col("b"))).alias("h")),
        "select conv_id, md5(coalesce(string_agg(text, '' order by turn, text) filter (role = 'user'), '')) h from conversations group by 1",
    ),
    "retry_after": (
        lambda s, d: table(s, d, "events").select("event_id", T.retry_after_ms(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, "Mon, 01 Jan 2024 00:01:00 GMT").otherwise("soon"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("ms")),
        "select event_id, case event_id % 3 when 0 then event_id * 1000.0::double when 1 then 60000.0::double end ms from events",
    ),
    "results_expired": (
        lambda s, d: table(s, d, "events").select("event_id", T.results_expired(F.when(F.col("event_id") % 5 == 0, "nonsense").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.lit(86_400_000 * 3), F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("expired")),
        "select event_id, event_id % 5 <> 0 and date_trunc('second', ts) < timestamp '2024-01-07' as expired from events",
    ),
    "agents_realized": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.agents_realized(F.col("p_size") % 7, F.col("p_partkey") % 9).alias("n")), "select p_partkey, case when p_partkey % 9 <= p_size % 7 then p_size % 7 - p_partkey % 9 end n from part",
    ),
    "axis_scores_parsed": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", T.axis_scores(F.concat(F.lit('```json\n{"originality": '), 1 + F.col("s_suppkey") % 10, F.lit(', "feasibility": 2.5}\n```'))).alias("a")).select("s_suppkey", "a.originality", "a.feasibility"),
        "select s_suppkey, cast(1 + s_suppkey % 10 as double) originality, 2.5::double feasibility from supplier",
    ),
    "seed_list": (
        lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(T.seed_list(F.sort_array(F.collect_list("n_name"))).alias("seeds")),
        "select n_regionkey, string_agg(r || '. ' || n_name, chr(10) order by n_name) seeds from (select *, row_number() over (partition by n_regionkey order by n_name) r from nation) group by 1",
    ),
    "prompt_template": (
        lambda s, d: table(s, d, "nation").select(T.template("You are {who}.\nBRIEF: {brief}", who=F.col("n_name"), brief=F.col("n_regionkey")).alias("prompt")), "select 'You are ' || n_name || '.' || chr(10) || 'BRIEF: ' || n_regionkey as prompt from nation",
    ),
    "max_tokens": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.max_tokens(F.col("p_size") - 10, F.lit(175), 4096).alias("n")), "select p_partkey, cast(greatest(4096, ceil(case when p_size > 10 then p_size - 10 else 6 end * 437.5)) as bigint) n from part",
    ),
    "candidate_text": (lambda s, d: table(s, d, "events").select("event_id", T.candidate_text(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.col("props")).alias("text")), "select event_id, case when event_id % 2 = 0 then event_type else props end as text from events"),
    "arms_hash": (
        lambda s, d: table(s, d, "events").select("event_id", RQ.arms_hash(F.expr("""'{"_n": ' || event_id || ', "b": [{"purpose": "p", "slots": [' || props || ', {"label": 1}]}], "a": "' || event_type || '"}'""")).alias("hash")),
        """select event_id, substr(sha256('{"a":"' || event_type || '","b":[{"slots":[' || replace(props, ' ', '') || ',{}]}]}'), 1, 12) as hash from events""",
    ),
    "judge_hash": (
        lambda s, d: table(s, d, "supplier").groupBy("s_nationkey").agg(RQ.judge_hash(F.collect_list(F.concat(F.lit("m"), F.col("s_suppkey") % 7)), F.concat(F.lit("p"), F.col("s_nationkey"))).alias("hash")),
        """select s_nationkey, substr(sha256('{"prompt":"p' || s_nationkey || '","models":[' || string_agg(distinct '"m' || (s_suppkey % 7) || '"', ',' order by '"m' || (s_suppkey % 7) || '"') || ']}'), 1, 12) as hash from supplier group by 1""",
    ),
    "judge_request_hash": (
        lambda s, d: table(s, d, "part").select("p_partkey", RQ.judge_request_hash(F.expr("""case when p_size % 2 = 0 then '{"t": ' || p_size || ', "maxTokens": 40}' else '{"t": ' || p_size || '}' end"""), F.expr("case when p_size % 4 <> 2 then 40 end")).alias("hash")),
        """select p_partkey, substr(sha256('{"maxTokens":40,"t":' || p_size || '}'), 1, 12) as hash from part""",
    ),
    "content_ids": (
        lambda s, d: RQ.content_ids(table(s, d, "conversations").selectExpr("conv_id", "turn", "role", """'{"role": "' || role || '", "n": ' || length(text) % 50 || '}' as request"""), "request", ["conv_id", "turn", "role"]).select("conv_id", "turn", "role", "custom_id"),
        """select conv_id, turn, role, 'r' || substr(sha256(j), 1, 40) || '-' || (row_number() over (partition by j order by conv_id, turn, role) - 1) as custom_id from (select conv_id, turn, role, '{"n":' || length(text) % 50 || ',"role":"' || role || '"}' as j from conversations where text is not null and role is not null)""",
    ),
    "config_hash_text": (lambda s, d: table(s, d, "events").select("event_id", K.short_hash(D.canonical_json(F.concat(F.lit('{"z": 1.0, "a": '), "props", F.lit("}")))).alias("h")), """select event_id, substr(sha256('{"a":' || replace(props, ' ', '') || ',"z":1}'), 1, 12) h from events"""),
    "validation_keys": (
        lambda s, d: table(s, d, "nation").select(K.validation_key(F.lit("j"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("q"))).alias("key"), K.phase0_key(F.lit("dat"), F.col("n_name")).alias("phase0")),
        "select 'judge-validation|judge=j' || case when n_nationkey % 2 = 0 then '|req=q' else '' end || '|slice=' || n_name as key, 'dat@' || n_name phase0 from nation",
    ),
    "ideas_of_reviews": (
        lambda s, d: S.ideas_of(table(s, d, "orders").selectExpr("cast(o_custkey as string) as idea_id", "cast(null as string) as condition", "'t' || (o_custkey % 3) as topic", "o_totalprice as score")).select("idea_id", "topic", "n", F.round("mean_score", 6).alias("mean_score")),
        "select cast(o_custkey as varchar) idea_id, 't' || (o_custkey % 3) topic, count(*) n, round(avg(o_totalprice), 6) mean_score from orders group by 1, 2",
    ),
    "title_binding": (
        lambda s, d: S.bind_titles(
            table(s, d, "part").selectExpr("cast(p_partkey % 2 as string) as condition", "case when p_partkey % 3 = 0 then 'x' || p_partkey || '.txt' else 'Part No. ' || p_partkey || '.txt' end as filename", "case when p_partkey % 3 = 0 then 'Title: PART no ' || p_partkey || '\nbody' else 'body' end as text"),
            table(s, d, "part").selectExpr("cast(p_partkey as string) as id", "'part-no ' || p_partkey || '.json' as title"),
            table(s, d, "part").selectExpr("cast(p_partkey as string) as idea_id", "cast(p_partkey % 2 as string) as condition"),
        ).select("idea_id", "filename"),
        "select cast(p_partkey as varchar) idea_id, case when p_partkey % 3 = 0 then 'x' || p_partkey || '.txt' else 'Part No. ' || p_partkey || '.txt' end filename from part",
    ),
    "id_titles": (
        lambda s, d: S.id_titles(table(s, d, "orders").selectExpr("case when o_orderkey % 50 = 0 then 'ID' else cast(o_custkey as string) end as id", "case when o_orderkey % 50 = 0 then 'Title' when o_orderkey % 7 = 0 then null else ' t' || o_orderkey end as title", "o_orderkey as at"), "at"),
        "select cast(o_custkey as varchar) id, 't' || max(o_orderkey) title from orders where o_orderkey % 50 <> 0 and o_orderkey % 7 <> 0 group by 1",
    ),
    "sampled_keywords": (lambda s, d: S.sampled_keywords(table(s, d, "customer").select(F.col("c_mktsegment").alias("word")).union(table(s, d, "nation").select("n_name"))), None),
    "pilot_report": (
        lambda s, d: TE.pilot_report(table(s, d, "supplier").selectExpr("s_nationkey as arm", "case when s_suppkey % 4 = 0 then null else s_acctbal end as originality", "cast(s_suppkey as double) as feasibility", "s_suppkey % 4 = 0 as refused"), "arm").select("arm", F.round("originality", 4).alias("originality"), F.round("feasibility", 4).alias("feasibility"), "refused", F.round("refused_percent", 4).alias("refused_percent"), "n"),
        "select s_nationkey arm, round(avg(s_acctbal) filter (s_suppkey % 4 <> 0), 4) originality, round(avg(s_suppkey), 4) feasibility, count(*) filter (s_suppkey % 4 = 0) refused, round(100 * avg(case when s_suppkey % 4 = 0 then 1.0::double else 0 end), 4) refused_percent, count(*) n from supplier group by 1",
    ),
    "panel_geometry": (
        lambda s, d: table(s, d, "nation").withColumn("g", TE.panel_geometry(F.struct(F.when(F.col("n_nationkey") % 2 == 0, 9).alias("size"), F.lit(None).cast("int").alias("ideasPerAgent")), F.struct(F.lit(5).alias("size"), F.lit(6).alias("ideasPerAgent")), ("size", "ideasPerAgent"))).select("n_nationkey", "g.*"),
        'select n_nationkey, case when n_nationkey % 2 = 0 then 9 else 5 end as size, 6 as "ideasPerAgent" from nation',
    ),
    "rounds": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", F.size(TE.rounds(F.col("n_nationkey") % 4, F.lit("all"))).alias("n"), TE.rounds(F.col("n_nationkey") % 4, F.lit("all"))[0]["sharing"].alias("first")),
        "select n_nationkey, cast(nullif(n_nationkey % 4, 0) as int) n, cast(null as varchar) as first from nation",
    ),
    "tokens_per_idea": (
        lambda s, d: table(s, d, "part").select("p_partkey", TE.tokens_per_idea(F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")), F.when(F.col("p_partkey") % 3 == 0, "low").when(F.col("p_partkey") % 3 == 1, "max"), {"m0": {"low": 81, "high": 175, "max": 776}, "m1": {None: 558}}, 800).alias("rate")),
        "select p_partkey, case p_size % 3 when 0 then case p_partkey % 3 when 0 then 81 when 1 then 776 else 175 end when 1 then 558 else 800 end rate from part",
    ),
}
