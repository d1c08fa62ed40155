"""Registered queries of the core operators, with the SQL each must equal."""

from pyspark.sql import functions as F

from poolstat.functions.keys import mulberry32
from poolstat.operators import aggregates as A
from poolstat.operators import joins as J
from poolstat.operators import vectors as V
from poolstat.operators import windows as W
from poolstat.plans import checks, judges, money, records, statistics, store, streams, studies, texts
from poolstat.sources.tables import cells, table

CELLS = "(select l_returnflag arm, l_suppkey % 12 brief, l_linenumber replicate, l_quantity response, l_extendedprice / 1000 as cost from lineitem)"


def rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def _events(s, d):
    return table(s, d, "events")


def _plan(s, d):
    return J.plan_cells(table(s, d, "region").select("r_name"), table(s, d, "nation").select("n_name"), 3)


def _stored(s, d):
    return table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


def _ledger(s, d):
    rates = table(s, d, "part").selectExpr("p_partkey as l_partkey", "p_retailprice / 1000 as rate", "p_retailprice / 2000 as intro_rate", "date '1998-01-01' as intro_until")
    rows = table(s, d, "lineitem").selectExpr("l_partkey", "l_returnflag", "l_quantity as tokens", "cast(l_shipdate as date) as day")
    priced = J.price(rows, rates, "l_partkey", "day")
    return priced.groupBy("l_returnflag").agg(F.sum("usd").alias("usd"), F.count_if("missing").alias("missing"))


PLAN = "(select r_name, n_name, unnest([1, 2, 3]) replicate from region, nation)"
STORED = "(select r_name, n_name from nation join region on n_regionkey = r_regionkey)"
RANKED = """select {by} g, rank() over (partition by {by} order by {a}) + (count(*) over (partition by {by}, {a}) - 1) / 2.0 ra,
 rank() over (partition by {by} order by {b}) + (count(*) over (partition by {by}, {b}) - 1) / 2.0 rb from {t}"""


def _p(s, d):
    return _events(s, d).selectExpr("event_id", "event_type", "value / 100000 as p")


CATALOG = {
    "summarize_by_arm": (lambda s, d: rounded(A.summarize_by_arm(cells(s, d))), f"select arm, count(*) n, round(avg(response), 4) mean_response, round(avg(cost), 4) mean_cost from {CELLS} group by arm"),
    "tally_states": (lambda s, d: A.tally_states(_events(s, d), "user_id", "event_type"), "select user_id cfg, count(*) n, string_agg(distinct event_type, ',' order by event_type) states from events group by 1"),
    "reconcile": (lambda s, d: A.reconcile(_events(s, d), "event_type", "purchase", "error", "view"), "select count(*) planned, count(*) filter (event_type = 'purchase') completed, count(*) filter (event_type = 'error') failed, count(*) filter (event_type = 'view') skipped from events"),
    "failure_rate": (lambda s, d: rounded(A.failure_rate(_events(s, d), "user_id", "event_type", "error")), "select user_id, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 4) rate from events group by 1"),
    "failures_by_arm": (lambda s, d: _events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "select user_id, event_type, count(*) n from events group by 1, 2"),
    "latency_percentiles": (lambda s, d: A.latency_percentiles(_events(s, d), "event_type", "value"), "select event_type, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95 from events group by 1"),
    "cost_diversity_ratio": (lambda s, d: rounded(A.cost_diversity_ratio(cells(s, d))), f"select arm, round(sum(response) / sum(cost), 4) ratio from {CELLS} group by arm"),
    "latest_record": (lambda s, d: A.latest_record(_events(s, d), "user_id", "event_id", "event_type"), "select user_id, arg_max(event_type, event_id) latest, max(event_id) + 1 next_attempt from events group by 1"),
    "two_level_mean": (lambda s, d: rounded(A.two_level_mean(cells(s, d), "arm", "brief", "response")), f"select arm, round(avg(s), 4) mean_sum from (select arm, brief, sum(response) s from {CELLS} group by 1, 2) group by 1"),
    "pooled_variance": (lambda s, d: rounded(A.pooled_within_cell_variance(cells(s, d))), f"select round(sum((n - 1) * v) / sum(n - 1), 4) variance, cast(sum(n - 1) as bigint) df from (select count(response) n, var_samp(response) v from {CELLS} group by arm, brief) where n > 1"),
    "anova_means": (lambda s, d: rounded(A.anova_means(cells(s, d))), f"select arm, brief, count(*) n, round(avg(response), 4) mean from {CELLS} group by cube (arm, brief)"),
    "over_retention": (lambda s, d: A.over_retention(_events(s, d), ["event_type", "user_id"], 5), "select event_type, count(*) groups_over from (select event_type, user_id from events group by 1, 2 having count(*) > 5) group by 1"),
    "top_k_spend": (lambda s, d: rounded(A.top_k_sum(table(s, d, "orders"), "o_totalprice", 4), 2), "select round(sum(o_totalprice), 2) worst from (select o_totalprice from orders order by 1 desc limit 4)"),
    "plan_cells": (_plan, f"select * from {PLAN}"),
    "plan_reuse": (lambda s, d: J.reuse(_plan(s, d), _stored(s, d), ["r_name", "n_name"]), f"select * from {PLAN} semi join {STORED} s using (r_name, n_name)"),
    "plan_todo": (lambda s, d: J.todo(_plan(s, d), _stored(s, d), ["r_name", "n_name"]), f"select * from {PLAN} anti join {STORED} s using (r_name, n_name)"),
    "plan_stale": (
        lambda s, d: J.stale(table(s, d, "orders").selectExpr("o_orderkey as k", "o_orderpriority as cfg"), table(s, d, "orders").selectExpr("o_orderkey + 1 as k", "o_orderpriority as cfg"), ["k"], "cfg"),
        "select a.o_orderkey k, a.o_orderpriority cfg, b.o_orderpriority stored_cfg from orders a join orders b on a.o_orderkey = b.o_orderkey + 1 where a.o_orderpriority <> b.o_orderpriority",
    ),
    "price_ledger": (
        lambda s, d: rounded(_ledger(s, d), 2),
        "select l_returnflag, round(sum(l_quantity * case when cast(l_shipdate as date) <= date '1998-01-01' then p_retailprice / 2000 else p_retailprice / 1000 end), 2) usd, count(*) filter (p_partkey is null) missing "
        "from lineitem left join part on l_partkey = p_partkey group by 1",
    ),
    "pareto_frontier": (
        lambda s, d: J.pareto_frontier(table(s, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size"),
        "select p_partkey, p_retailprice, p_size from part a where not exists (select 1 from part b where b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size))",
    ),
    "holm": (
        lambda s, d: rounded(W.holm(_p(s, d), "event_type", "p", "event_id").drop("p"), 9),
        "select event_id, event_type, round(max(a) over (partition by event_type order by p, event_id rows unbounded preceding), 9) holm from (select event_id, event_type, value / 100000 as p, "
        "least(1.0, (count(*) over (partition by event_type) - row_number() over (partition by event_type order by value / 100000, event_id) + 1) * (value / 100000)) a from events)",
    ),
    "benjamini_hochberg": (
        lambda s, d: rounded(W.benjamini_hochberg(_p(s, d), "event_type", "p", "event_id").drop("p"), 6),
        "select event_id, event_type, round(min(a) over (partition by event_type order by p, event_id rows between current row and unbounded following), 6) bh from (select event_id, event_type, value / 100000 as p, "
        "least(1.0, value / 100000 * count(*) over (partition by event_type) / row_number() over (partition by event_type order by value / 100000, event_id)) a from events)",
    ),
    "rank_with_ties": (lambda s, d: W.rank_with_ties(_events(s, d).select("event_id", "event_type", "value"), "event_type", "value"), "select event_id, event_type, value, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0 rank_avg from events"),
    "spearman": (
        lambda s, d: rounded(W.spearman(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")),
        "select g l_returnflag, round(corr(ra, rb), 4) rho from (" + RANKED.format(by="l_returnflag", a="l_quantity", b="l_extendedprice", t="lineitem") + ") group by 1",
    ),
    "latest_state": (lambda s, d: W.latest_state(_events(s, d).select("user_id", "event_id", "event_type"), "user_id", "event_id"), "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1"),
    "retain_newest": (lambda s, d: W.retain(_events(s, d).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", 5), "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id desc) <= 5"),
    "pool_diversity": (
        lambda s, d: rounded(V.pool_diversity(table(s, d, "embeddings"), "label", "embedding")),
        "with u as (select vec_id, label, embedding::double[] v from embeddings) select a.label, cast((1 + sqrt(1 + 8 * count(*))) / 2 as bigint) n, round(avg(1 - list_cosine_similarity(a.v, b.v)), 4) diversity from u a join u b on a.label = b.label and a.vec_id < b.vec_id group by 1",
    ),
    "distinct_k": (lambda s, d: V.distinct_k(table(s, d, "embeddings"), "label", "embedding", 0.85), None),
    "rarefied_k": (lambda s, d: V.rarefied_k(table(s, d, "embeddings"), "label", "embedding", None, 0.85, order="vec_id"), None),
    "mulberry32": (lambda s, d: table(s, d, "orders").select("o_orderkey", mulberry32(F.col("o_orderkey")).alias("draw")), f"select o_orderkey, u as draw from {statistics.draw_sql('orders', '0', 'o_orderkey')}"),
    "models_union": (lambda s, d: table(s, d, "customer").selectExpr("c_nationkey as k").union(table(s, d, "supplier").selectExpr("s_nationkey as k")).distinct(), "select c_nationkey k from customer union select s_nationkey from supplier"),
    "absent_arms": (lambda s, d: table(s, d, "part").selectExpr("p_size as k").subtract(table(s, d, "nation").selectExpr("n_nationkey as k")), "select p_size k from part except select n_nationkey from nation"),
}


ALL = CATALOG | money.QUERIES | store.QUERIES | statistics.QUERIES | judges.QUERIES | texts.QUERIES | records.QUERIES | streams.QUERIES | studies.QUERIES | checks.QUERIES


def queries():
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql():
    return {k: q for k, (_, q) in ALL.items() if q}
