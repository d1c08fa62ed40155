"""Fits against closed forms and literal algebra; distributions against known values; the family and its verdicts."""

import math

import numpy as np
import pytest

from poolstat.errors import FitSchema, FitUnavailable, PoolstatError
from poolstat.models import contrasts as C
from poolstat.models import distributions as D
from poolstat.models import fit as M
from poolstat.models import linalg, margin
from poolstat.models.variance import balanced_anova

ARMS = ["A", "B", "C"]


def lines(rows, arms=ARMS, reference="A"):
    names, cells = M.coefficient_names(arms, reference), {}
    for arm, brief, y in rows:
        cells.setdefault((brief, arm), []).append(y)
    out = []
    for (brief, arm), ys in sorted(cells.items()):
        x = np.array([1.0, *[float(M.coefficient_name(arm, reference) == n) for n in names[1:]]])
        out.append(M.Line(brief, x, len(ys), sum(ys), sum(y * y for y in ys)))
    return out, names


def design(rng, replicates=3, briefs=8):
    rows = []
    for b in range(briefs):
        shift = rng.normal() * 2
        for k, a in enumerate(ARMS):
            own = rng.normal()
            rows += [(a, f"b{b}", 10 + 3 * k + shift + own + rng.normal()) for _ in range(replicates)]
    return rows


def test_reml_equals_balanced_anova(spark):
    rows = design(np.random.default_rng(3))
    fit = M.fit_mixed("R0", *lines(rows))
    want = balanced_anova(spark.createDataFrame(rows, "arm string, brief string, response double")).first()
    assert math.isclose(fit.components["residual"], want.ms_error, rel_tol=1e-4)
    assert math.isclose(fit.components["cluster:line"], want.var_both, rel_tol=1e-3) and math.isclose(fit.components["cluster"], want.var_brief, rel_tol=1e-3)
    assert math.isclose(math.sqrt(fit.vcov[1, 1]), want.contrast_se, rel_tol=1e-4)
    means = {a: np.mean([y for x, _, y in rows if x == a]) for a in ARMS}
    assert np.allclose(fit.coefficients, [means["A"], means["B"] - means["A"], means["C"] - means["A"]])


def test_cr2_equals_the_literal_sandwich():
    rng = np.random.default_rng(4)
    rows = [r for r in design(rng) if rng.random() < 0.8]
    fit = M.fit_cr2("R2", *lines(rows))
    x = np.array([[1, a == "B", a == "C"] for a, _, _ in rows], float)
    y = np.array([r[2] for r in rows])
    p = np.linalg.inv(x.T @ x)
    e, meat = y - x @ (p @ x.T @ y), np.zeros((3, 3))
    for b in sorted({r[1] for r in rows}):
        i = [k for k, r in enumerate(rows) if r[1] == b]
        v = x[i].T @ linalg.inverse_root(np.eye(len(i)) - x[i] @ p @ x[i].T) @ e[i]
        meat += np.outer(v, v)
    assert np.allclose(fit.vcov, p @ meat @ p) and fit.df == 7
    few = M.fit_cr2("R2", *lines([r for r in rows if r[1] in ("b0", "b1")]))
    assert not few.converged and M.needs_descent(few)


def test_ladder_descends_but_not_on_failure():
    ls, names = lines(design(np.random.default_rng(5)))
    assert M.run_ladder(ls, names).rung == "R0"
    broken = M.Fit("R0", names, np.zeros(3), np.full((3, 3), np.nan), 1)
    ladder = M.run_ladder(ls, names, mixed=lambda *_: broken)
    assert ladder.rung == "R2" and [h[0] for h in ladder.history] == ["R0", "R1", "R2"] and ladder.robust is ladder.fit
    with pytest.raises(FitSchema):
        M.validated(M.Fit("R0", names[::-1], np.zeros(3), np.eye(3), 1), names)
    with pytest.raises(FitUnavailable):
        M.fit_mixed("R0", [], names)


def test_judge_ladder_from_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{r}", j, bool((r + k) % 2), float(5 + k + rng.normal() + r * 0.1)) for r in range(12) for k, j in enumerate(("x", "y")) for _ in range(2)]
    df = spark.createDataFrame(rows, "run string, judge_provider string, same_provider boolean, response double")
    names = M.judge_names(["x", "y"], "x")
    ladder = M.run_judge_ladder(M.judge_lines(df, ["x", "y"], "x"), names)
    assert ladder.rung == "J0" and ladder.fit.names[-1] == M.BIAS
    assert M.run_judge_ladder(M.judge_lines(df, ["x", "y"], "x"), names, mixed=lambda *_: M.Fit("J0", names, np.zeros(3), np.full((3, 3), np.nan), 1)).rung == "J1"


def test_distributions():
    assert math.isclose(D.t_two_sided(2.0, 10), 0.07338803477, rel_tol=1e-9) and math.isclose(D.t_quantile(0.975, 10), 2.2281388520, rel_tol=1e-9)
    assert math.isclose(D.t_cdf(-1.3, 23) + D.t_upper_tail(-1.3, 23), 1) and math.isclose(D.t_quantile(0.1, 4), -D.t_quantile(0.9, 4))
    for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999):
        assert abs(D.normal_cdf(D.normal_quantile(p)) - p) < 2e-7 and abs(D.t_cdf(D.t_quantile(p, 7), 7) - p) < 1e-9
    with pytest.raises(PoolstatError):
        D.t_quantile(1.0, 3)
    assert all(c["ok"] for c in margin.reproduction_checks()) and margin.margin_verdict(-2.0, margin.derive_delta(margin.BRIEF_ARM_60)) == "inside (non-inferior)"
    with pytest.raises(PoolstatError):
        linalg.inverse(np.ones((2, 2)))


def test_registered_family_keeps_five_slots():
    panel = ["A'", "B", "C", "D", "E", "F", "G", "H"]
    names = M.coefficient_names(["A", *panel], "A")
    fit = M.Fit("R0", names, np.array([30.0, *[-5.0] * 7, -1.0]), np.eye(9), 100)
    full = C.registered_family(panel)
    results = C.verdicts([C.evaluate_spec(s, fit) for s in full])
    assert [r.id for r in results] == ["H1", "H2", "H3", "H4", "H5"] and not results[4].estimable and results[4].p == 1.0
    assert math.isclose(results[0].estimate, (-5.0 * 7 - 1) / 8) and results[0].holds
    assert math.isclose(results[1].p, D.upper_tail(C.MARGIN / math.sqrt(2), None)) and results[2].components and results[2].p == max(c.p for c in results[2].components)
    some = C.registered_family(["B", "D", "E"])
    assert [s.estimable for s in some] == [False, True, False, True, False] and C.slot_count(some) == 5
    assert C.family_estimability([C.evaluate_spec(s, fit) for s in some])["slots"] == 5
    assert not C.registered_family(["B"], reference="Z")[0].estimable
    for bad in (lambda: C.registered_family(["A", "B"]), lambda: C.registered_family(["B", "B"]), lambda: C.checked_arm_set("A", ["A", "B"]), lambda: C.holm([0.1], 5), lambda: C.holm([1.5]), lambda: C.contrast_vector(names, {"arm[T.X]": 1.0})):
        with pytest.raises(PoolstatError):
            bad()
    assert C.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert M.arm_of("arm[T.S1-C0]") == "S1-C0" and M.arm_of("Intercept") is None
    assert len(M.analysis_hash(b"x", {"b": "1", "a": "2"})) == 12
