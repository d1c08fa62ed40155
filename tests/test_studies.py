"""Grouped fits against the single-study path on each study's own rows."""

import pytest

from poolstat.models import contrasts as C
from poolstat.models import fit as M
from poolstat.models import studies as S
from poolstat.plans import studies as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return Q._rows(spark, SF).cache()


def test_arm_fits_and_family_equal_single_studies(spark, rows):
    fits, family = S.arm_fits(rows, "study").collect(), S.family_verdicts(rows, "study", Q.PANEL).collect()
    studies = sorted({r.study for r in fits})
    assert len(studies) == 6 and len(family) == 30
    for study in studies[:2]:
        own = rows.where(f"study = '{study}'")
        arms = sorted(r.arm for r in own.select("arm").distinct().collect())
        names = M.coefficient_names(arms, "A")
        lines = M.arm_lines(own, arms, "A")
        ladder = M.run_ladder(lines, names)
        for rung, fit in ((ladder.rung, ladder.fit), ("R2", ladder.robust)):
            got = {r.coefficient: (r.estimate, r.se, r.chosen) for r in fits if r.study == study and r.rung == rung}
            for k, n in enumerate(names):
                assert got[n][0] == pytest.approx(fit.coefficients[k], rel=1e-5) and got[n][1] == pytest.approx(fit.vcov[k, k] ** 0.5, rel=1e-4) and got[n][2] == (rung == ladder.rung)
        want = C.verdicts([C.evaluate_spec(s, ladder.fit) for s in C.registered_family(Q.PANEL, "A", available=arms)])
        got = {r.id: r for r in family if r.study == study}
        for w in want:
            assert (got[w.id].estimable, got[w.id].kind) == (w.estimable, w.kind)
            if w.estimable:
                assert (got[w.id].p, got[w.id].holm_p, got[w.id].estimate) == pytest.approx((w.p, w.holm_p, w.estimate), rel=1e-3, abs=1e-9) and got[w.id].holds == w.holds
    assert not next(r for r in family if r.id == "H5").estimable


def test_judge_fits_equal_single_studies(spark):
    rows = Q._judged(spark, SF)
    got = S.judge_fits(rows, "study").collect()
    study = min(r.study for r in got)
    ladder = M.run_judge_ladder(M.judge_lines(rows.where(f"study = '{study}'"), ["j0", "j1", "j2"], "j0"), M.judge_names(["j0", "j1", "j2"], "j0"))
    own = {r.coefficient: r for r in got if r.study == study and r.rung == ladder.rung}
    for k, n in enumerate(ladder.fit.names):
        assert own[n].estimate == pytest.approx(ladder.fit.coefficients[k], rel=1e-5, abs=1e-7) and own[n].chosen


def test_thin_studies(spark):
    """One arm, one brief, or an arm that is not the reference: rows with reasons, no failure; nulls do not count."""
    rows = spark.createDataFrame([("one", "A", 1, 2.0), ("one", "A", 1, 3.0), ("two", "B", 1, 1.0), ("two", "C", 2, 2.0), ("two", "C", 3, None), ("nil", "A", 1, None)], "study string, arm string, brief int, response double")
    got = S.arm_fits(rows, "study").collect()
    assert {r.study for r in got} == {"one", "two"} and all(not r.chosen and r.reason for r in got if r.rung == "R2")
    family = S.family_verdicts(rows.where("study = 'two'"), "study", ["B", "C", "D"]).collect()
    assert len(family) == 5 and not any(r.estimable for r in family)
