"""Queries of ranks, thresholds, vectors, resampling and variance components."""

from pyspark.sql import functions as F

from poolstat.functions.keys import fnv1a, leg_seed, mulberry32_at, poly31
from poolstat.models import variance as VC
from poolstat.operators import judging as JU
from poolstat.operators import resampling as R
from poolstat.operators import thresholds as T
from poolstat.operators import vectors as VE
from poolstat.operators import windows as W
from poolstat.sources.tables import table

from . import views as V
from .money import rounded

CELLS = "(select l_returnflag || '-' || l_linestatus as arm, 'b' || (l_suppkey % 24) as brief, l_quantity as response, l_extendedprice * (1 - l_discount) / 1e4 as cost, cast(l_orderkey as varchar) || '-' || l_linenumber || '-' || l_partkey as key from lineitem)"


def cells(s, d):
    return table(s, d, "lineitem").selectExpr("l_returnflag || '-' || l_linestatus as arm", "'b' || (l_suppkey % 24) as brief", "l_quantity as response", "l_extendedprice * (1 - l_discount) / 1e4 as cost", "cast(l_orderkey as string) || '-' || l_linenumber || '-' || l_partkey as key")


def balanced(s, d):
    """One response for each arm, brief and replicate 0 or 1: means of lines, so that the design is complete."""
    rows = table(s, d, "lineitem").selectExpr("l_returnflag as arm", "l_suppkey % 5 as brief", "l_linenumber % 2 as replicate", "l_quantity as response")
    return rows.groupBy("arm", "brief", "replicate").agg(F.avg("response").alias("response"))


BALANCED = "(select l_returnflag as arm, l_suppkey % 5 as brief, l_linenumber % 2 as replicate, avg(l_quantity) as response from lineitem group by 1, 2, 3)"
def draw_sql(t, i, s):
    """The generator's draw `u` at stream index `i` of seed `s` for each row of `t`, in wide integers."""
    return f"""(select *, xor(z, z >> 14) / 4294967296.0::double as u from (select *, xor(y, (y + ((xor(y, y >> 7)::hugeint * (y | 61)::hugeint) % 4294967296)::bigint) & 4294967295) as z
 from (select *, ((xor(a, a >> 15)::hugeint * (a | 1)::hugeint) % 4294967296)::bigint as y from (select *, (({s}::hugeint + ({i} + 1)::hugeint * 1831565813) % 4294967296)::bigint as a from {t}))))"""


PER = f"(select *, row_number() over (partition by arm order by k) - 1 as i, count(*) over (partition by arm) as b from (select arm, brief, sum(response) r, sum(cost) c, min(key) k from {CELLS} group by 1, 2))"
ITER = f"(select arm, b, it, n, it * b + n as pos from (select arm, max(b) b from {PER} group by 1), (select unnest(range(0, 200)) as it), (select unnest(range(0, 24)) as n) where n < b)"
BOOT = f"""select a.arm, round(ratio, 6) ratio, round(qs[6], 6) ci_lower, round(qs[195], 6) ci_upper from (select arm, sum(response) / sum(cost) ratio from {CELLS} group by 1) a
 join (select arm, list_sort(list(q)) qs from (select d.arm, it, sum(r) / sum(c) q from {draw_sql(ITER, 'pos', '1')} d join {PER} p on d.arm = p.arm and p.i = floor(d.u * d.b)::bigint group by 1, 2) group by 1) s on a.arm = s.arm"""

THRESHOLDS = f"""(select *, (tp / nullif(ns, 0) + (no - fp) / nullif(no, 0)) / 2 as ba from (select d, (d + lead(d) over (order by d)) / 2 as t, sum(s) over (order by d) tp, sum(o) over (order by d) fp, sum(s) over () ns, sum(o) over () no
 from (select round(distance, 9) d, count(*) filter (label = 'same')::double s, count(*) filter (label <> 'same')::double o from {V.PAIRS} group by 1)) where t is not null)"""
PLATEAU = f"""select round((a + b) / 2, 6) threshold, round(ba, 6) balanced_accuracy from (select min(t) a, max(t) b, max(ba) ba from (select *, i - row_number() over (order by t) g from (select *, row_number() over (order by t) i, max(ba) over () m from {THRESHOLDS})
 where abs(ba - m) < 1e-9) group by g) order by b - a desc, a limit 1"""


def distances(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return T.pair_distances(V.pairs(s, d), v, "vec_id", "v")


ANOVA = f"""with c as (select * from {BALANCED}), g as (select avg(response) g, count(*) n from c), a as (select arm, avg(response) ma from c group by 1), b as (select brief, avg(response) mb from c group by 1), ab as (select arm, brief, avg(response) m from c group by 1, 2),
 k as (select (select count(*) from a)::double na, (select count(*) from b)::double nb, 2.0::double r),
 s as (select nb * r * (select sum((ma - g) ** 2) from a, g) ssa, na * r * (select sum((mb - g) ** 2) from b, g) ssb, r * (select sum((m - ma - mb + g) ** 2) from ab join a using (arm) join b using (brief), g) ssab, (select sum((response - m) ** 2) from c join ab using (arm, brief)) sse, na, nb, r from k),
 m as (select *, ssa / (na - 1) msa, ssb / (nb - 1) msb, ssab / ((na - 1) * (nb - 1)) msab, sse / (na * nb * (r - 1)) mse from s)
 select round(msa, 5) ms_arm, round(msb, 5) ms_brief, round(msab, 5) ms_both, round(mse, 5) ms_error, round(greatest(0, (msab - mse) / r), 5) var_both, round(greatest(0, (msb - msab) / (na * r)), 5) var_brief, round(sqrt(2 * msab / (nb * r)), 5) contrast_se from m"""
TOPIC = f"(select *, count(*) over (partition by topic) n, floor(count(*) over (partition by topic) * 0.25)::bigint k from {V.RATINGS})"
ACCURACY = f"""(select topic, n, k, sum((y = 1 and g > k)::int) / k::double sensitivity, sum((y = 0 and g <= k)::int) / k::double specificity from (select *, row_number() over (partition by topic order by judge, idea) g from (select * from (select *, case when r <= k then 0 when r > n - k then 1 end y
 from (select *, row_number() over (partition by topic order by expert, idea) r from {TOPIC})) where y is not null)) group by 1, 2, 3)"""
RHO = f"(select topic, corr(ra, rb) rho from (select topic, rank() over (partition by topic order by judge) + (count(*) over (partition by topic, judge) - 1) / 2.0 ra, rank() over (partition by topic order by expert) + (count(*) over (partition by topic, expert) - 1) / 2.0 rb from {V.RATINGS}) group by 1)"

QUERIES = {
    "order_by_score": (
        lambda s, d: W.order_by_score(table(s, d, "events").select("event_type", "event_id", "value"), "event_type", "value", "event_id").select("event_id", "position"),
        "select event_id, row_number() over (partition by event_type order by value, event_id) - 1 as position from events",
    ),
    "holm_family": (
        lambda s, d: rounded(W.holm(table(s, d, "nation").selectExpr("n_regionkey as family", "n_nationkey as id", "n_nationkey / 100 as p"), "family", "p", "id", 5).drop("p")),
        "select family, id, round(max(a) over (partition by family order by id), 6) holm from (select n_regionkey family, n_nationkey id, least(1.0, (6 - row_number() over (partition by n_regionkey order by n_nationkey)) * n_nationkey / 100.0::double) a from nation)",
    ),
    "mulberry32_stream": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", mulberry32_at(F.lit(20260901), F.col("o_orderkey")).alias("u")),
        f"select o_orderkey, u from {draw_sql('orders', 'o_orderkey', '20260901')}",
    ),
    "string_hashes": (lambda s, d: table(s, d, "customer").select("c_name", fnv1a(F.col("c_name")).alias("fnv"), poly31(F.col("c_name")).alias("poly"), leg_seed(F.lit(7), F.col("c_name"), F.lit("x")).alias("seed")), None),
    "bootstrap_ratio": (lambda s, d: rounded(R.bootstrap_ratio(cells(s, d), "arm", "brief", "response", "cost", "key", 200), 6), BOOT),
    "bootstrap_ratio_full": (lambda s, d: rounded(R.bootstrap_ratio(cells(s, d), "arm", "brief", "response", "cost", "key"), 6), None),
    "pair_distances": (lambda s, d: rounded(distances(s, d)), f"select a, b, label, round(distance, 6) distance from {V.PAIRS}"),
    "accuracy_at": (
        lambda s, d: rounded(T.accuracy_at(distances(s, d), "distance", "label", 0.9)),
        f"select tp, fn, tn, fp, round(tp / (tp + fn), 6) sensitivity, round(tn / (tn + fp), 6) specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) balanced_accuracy from (select count(*) filter (label = 'same' and distance < 0.9) tp, count(*) filter (label = 'same' and distance >= 0.9) fn, count(*) filter (label <> 'same' and distance >= 0.9) tn, count(*) filter (label <> 'same' and distance < 0.9) fp from {V.PAIRS})",
    ),
    "select_threshold": (lambda s, d: rounded(T.select_threshold(distances(s, d).withColumn("distance", F.round("distance", 9)), "distance", "label")), PLATEAU),
    "gap_threshold": (
        lambda s, d: rounded(T.gap_threshold(table(s, d, "part").selectExpr("case when p_size <= 25 then 'same' else 'different' end as label", "cast(p_size as double) as distance"), "distance", "label")),
        "select max(p_size) filter (p_size <= 25)::double max_same, min(p_size) filter (p_size > 25)::double min_other, (max(p_size) filter (p_size <= 25) + min(p_size) filter (p_size > 25)) / 2.0::double threshold from part",
    ),
    "l2_normalized": (
        lambda s, d: rounded(table(s, d, "embeddings").select("vec_id", T.norm(T.l2_normalized(F.col("embedding").cast("array<double>"))).alias("norm"), T.l2_normalized(F.col("embedding").cast("array<double>"))[0].alias("first"))),
        "select vec_id, 1.0::double norm, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as first from embeddings",
    ),
    "collapse_rate": (lambda s, d: rounded(table(s, d, "part").select("p_partkey", T.collapse_rate(F.col("p_size"), F.lit(60)).alias("rate"))), "select p_partkey, round(1 - p_size / 60.0::double, 6) rate from part"),
    "control_verdicts": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.duplicate_verdict(F.col("p_size"), F.col("p_retailprice") / 20000).alias("copies"), T.random_verdict(F.col("p_size"), F.lit(50), F.col("p_retailprice"), F.lit(1300.0), F.col("p_partkey") % 2 == 0)["floor"].alias("floor"), T.random_verdict(F.col("p_size"), F.lit(50), F.col("p_retailprice"), F.lit(1300.0), F.col("p_partkey") % 2 == 0)["failed"].alias("failed")),
        "select p_partkey, p_size = 1 and p_retailprice / 20000 < 0.05 copies, case when p_partkey % 2 = 1 then 'inconclusive' when p_retailprice >= 1300 then 'pass' else 'fail' end floor, p_size < 45 or (p_partkey % 2 = 0 and p_retailprice < 1300) failed from part",
    ),
    "ordering_control": (
        lambda s, d: rounded(T.ordering_control(table(s, d, "part").groupBy(F.when(F.col("p_size") < 15, "low").when(F.col("p_size") < 35, "average").otherwise("high").alias("name")).agg(F.avg("p_size").alias("diversity")), "name", "diversity")),
        "select round(l, 6) low, round(m, 6) average, round(h, 6) high, l < m and m < h ordered, round(h - l, 6) margin from (select avg(p_size) filter (p_size < 15) l, avg(p_size) filter (p_size between 15 and 34) m, avg(p_size) filter (p_size >= 35) h from part)",
    ),
    "sensitivity": (lambda s, d: VE.sensitivity(table(s, d, "embeddings"), "label", "embedding", 0.85, 0.1), None),
    "clusters": (lambda s, d: VE.clusters(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.85), None),
    "smallest_pool": (lambda s, d: VE.min_pool_size(table(s, d, "embeddings"), "label"), "select min(n) n from (select count(*) n from embeddings group by label)"),
    "variance_by_arm": (
        lambda s, d: rounded(VC.within_cell_variance(cells(s, d), "arm")),
        f"select arm, round(sum((n - 1) * v) / sum(n - 1), 6) sigma2, cast(sum(n - 1) as bigint) df, count(*) cells from (select arm, brief, count(*) n, var_samp(response) v from {CELLS} group by 1, 2) where n > 1 group by 1",
    ),
    "balanced_anova": (lambda s, d: rounded(VC.balanced_anova(balanced(s, d)), 5), ANOVA),
    "scale_basis": (
        lambda s, d: rounded(VC.scale_basis(cells(s, d), "R-F", "A-F", 1.2088)),
        f"""select round(a.v / b.v, 6) variance_ratio, round(a.v / b.v / 3.277, 6) ratio_low, round(a.v / b.v * 3.277, 6) ratio_high, round(a.m / b.m, 6) mean_ratio, round(1.2088 * a.v / b.v, 6) brief_arm from
 (select sum((n - 1) * v) / sum(n - 1) v, sum(n * m) / sum(n) m from (select count(*) n, var_samp(response) v, avg(response) m from {CELLS} where arm = 'R-F' group by brief)) a,
 (select sum((n - 1) * v) / sum(n - 1) v, sum(n * m) / sum(n) m from (select count(*) n, var_samp(response) v, avg(response) m from {CELLS} where arm = 'A-F' group by brief)) b""",
    ),
    "mixed_fit": (lambda s, d: VC.fitted(s, cells(s, d)), None),
    "balanced_accuracy": (
        lambda s, d: rounded(JU.balanced_accuracy(V.ratings(s, d), ["topic"], "expert", "judge", "idea")),
        f"select topic, n, k, round(sensitivity, 6) sensitivity, round(specificity, 6) specificity, round((sensitivity + specificity) / 2, 6) accuracy from {ACCURACY}",
    ),
    "judge_gate": (
        lambda s, d: rounded(JU.gate(V.ratings(s, d), ["topic"], "judge", "expert", "idea").select("topic", "n", "accuracy", "verdict", "rho")),
        f"select topic, n, round((sensitivity + specificity) / 2, 6) accuracy, case when (sensitivity + specificity) / 2 >= 0.561 then 'pass' else 'drop' end verdict, round(rho, 6) rho from {ACCURACY} join {RHO} using (topic)",
    ),
    "split_half_interval": (
        lambda s, d: rounded(JU.interval(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("topic"), F.col("l_suppkey").alias("idea")).agg(F.sort_array(F.collect_list("l_quantity")).alias("scores")), "topic", "idea", "scores")),
        None,
    ),
    "split_half": (
        lambda s, d: rounded(JU.split_half(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("topic"), F.col("l_suppkey").alias("idea")).agg(F.sort_array(F.collect_list("l_quantity")).alias("scores")), "topic", "idea", "scores")),
        None,
    ),
}
