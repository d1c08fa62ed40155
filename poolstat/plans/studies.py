"""Queries of many studies: ladders, least squares with their sandwich, judge ladders and the registered family."""


from poolstat.models import studies as S
from poolstat.sources.tables import table

from .money import rounded

PANEL = ["B", "C", "D", "E", "F", "G", "H"]
ARM = "chr(65 + cast((l_orderkey + l_linenumber) % 8 as int))"


def _rows(s, d):
    return table(s, d, "lineitem").selectExpr("l_returnflag || l_linestatus as study", f"{ARM} as arm", "cast(l_suppkey % 24 as int) as brief", "l_quantity as response")


def _judged(s, d):
    return table(s, d, "lineitem").selectExpr("l_returnflag || l_linestatus as study", "'j' || (l_partkey % 3) as judge_provider", "l_linenumber % 2 = 0 as same_provider", "cast(l_suppkey % 40 as int) as run", "l_quantity + l_discount * (l_partkey % 3) as response")


#: arm means against the reference; a cluster's score of an arm is its residual sum over sqrt(1 - its share of the arm), as arms do not overlap
LEAST_SQUARES = f"""with c as (select l_returnflag || l_linestatus as study, {ARM} as arm, l_suppkey % 24 as brief, count(l_quantity)::double n, sum(l_quantity)::double t from lineitem group by 1, 2, 3),
 a as (select study, arm, sum(n) n, sum(t) / sum(n) m from c group by 1, 2),
 v as (select c.study, c.arm, brief, (t - c.n * m) / sqrt(1 - c.n / a.n) / a.n as v from c join a on a.study = c.study and a.arm = c.arm),
 k as (select x.study, x.arm, y.arm as other, sum(x.v * y.v) s from v x join v y on x.study = y.study and x.brief = y.brief group by 1, 2, 3),
 f as (select study, min(arm) ref from a group by 1), b as (select study, count(distinct brief) - 1 as df, cast(sum(n) as bigint) n from c group by 1)
select a.study, case when a.arm = ref then 'Intercept' else 'arm[T.' || a.arm || ']' end coefficient, round(case when a.arm = ref then a.m else a.m - r.m end, 6) estimate,
 round(sqrt(case when a.arm = ref then o.s else o.s + p.s - 2 * q.s end), 6) se, cast(df as int) df, b.n
from a join f on f.study = a.study join a r on r.study = a.study and r.arm = f.ref join b on b.study = a.study
 join k o on o.study = a.study and o.arm = a.arm and o.other = a.arm join k p on p.study = a.study and p.arm = f.ref and p.other = f.ref join k q on q.study = a.study and q.arm = a.arm and q.other = f.ref"""

QUERIES = {
    "study_fits": (lambda s, d: rounded(S.arm_fits(_rows(s, d), "study"), 4), None),
    "study_least_squares": (lambda s, d: rounded(S.arm_fits(_rows(s, d), "study").where("rung = 'R2'").select("study", "coefficient", "estimate", "se", "df", "n")), LEAST_SQUARES),
    "judge_ladder": (lambda s, d: rounded(S.judge_fits(_judged(s, d), "study"), 4), None),
    "registered_family": (lambda s, d: rounded(S.family_verdicts(_rows(s, d), "study", PANEL), 4), None),
}
