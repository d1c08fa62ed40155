"""Fits of many studies at once: rows are reduced to sufficient statistics by study, cluster and design row in one shuffle,
and each study's ladder, contrasts and verdicts are worked out from those few rows, a task a study."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import PoolstatError

from . import contrasts as C
from . import fit as M

FITS = "rung string, coefficient string, estimate double, se double, df int, n long, chosen boolean, reason string"
VERDICTS = "rung string, id string, kind string, estimable boolean, estimate double, se double, p double, holm_p double, holds boolean, reason string"


def stats(rows: DataFrame, study: str, cluster: str, keys: list[str], response: str) -> DataFrame:
    """study, cluster, keys, n, total, squares: all that the fits need."""
    y = F.col(response).cast("double")
    return rows.groupBy(study, cluster, *keys).agg(F.count(y).alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares")).where("n > 0")


def lines(part: pd.DataFrame, cluster: str, code) -> list[M.Line]:
    own = [M.Line(getattr(r, cluster), code(r), int(r.n), float(r.total), float(r.squares)) for r in part.itertuples(index=False)]
    return sorted(own, key=lambda x: (str(x.cluster), tuple(x.x)))


def arm_design(part: pd.DataFrame, arm: str, brief: str, reference: str | None) -> tuple[list[M.Line], list[str], list[str], str]:
    arms = sorted(part[arm].unique())
    first = reference if reference in arms else arms[0]
    names = M.coefficient_names(arms, first)
    return lines(part, brief, lambda r: [float(n == "Intercept" or n == M.coefficient_name(getattr(r, arm), first)) for n in names]), names, arms, first


def as_arrays(own: list[M.Line]) -> list[M.Line]:
    for x in own:
        x.x = M.np.array(x.x)
    return own


def told(fits: list[M.Fit], chosen: str) -> list[tuple]:
    out = []
    for f in fits:
        why = M.needs_descent(f)
        for k, n in enumerate(f.names):
            v = float(f.vcov[k, k])
            out.append((f.rung, n, float(f.coefficients[k]), v**0.5 if v >= 0 else float("nan"), f.df, int(f.n), f.rung == chosen, why))
    return out


def frame(rows: list[tuple], study: str, name, schema: str) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
    df.insert(0, study, name)
    return df


def arm_fits(rows: DataFrame, study: str, arm: str = "arm", brief: str = "brief", response: str = "response", reference: str | None = None) -> DataFrame:
    """study and its fits R0, R1, R2, one row a coefficient; `chosen` is the ladder's rung, `reason` why a rung was left.

    The reference is the one named, or the study's first arm. A study whose mixed fits are not defined keeps R2 alone.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, names, _, _ = arm_design(part, arm, brief, reference)
        own, fits = as_arrays(own), []
        for rung in ("R0", "R1"):
            try:
                fits.append(M.fit_mixed(rung, own, names))
            except (PoolstatError, ZeroDivisionError, M.np.linalg.LinAlgError):
                continue
        fits.append(M.fit_cr2("R2", own, names))
        chosen = next((f.rung for f in fits if M.needs_descent(f) is None), "R3")
        return frame(told(fits, chosen), study, part[study].iloc[0], FITS)

    kind = dict(rows.dtypes)[study]
    return stats(rows, study, brief, [arm], response).groupBy(study).applyInPandas(run, f"{study} {kind}, {FITS}")


def judge_fits(rows: DataFrame, study: str) -> DataFrame:
    """rows(study, judge_provider, same_provider, run, response) -> fits J0 and J1 of each study, as in arm_fits."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        judges = sorted(part["judge_provider"].unique())
        names = M.judge_names(judges, judges[0])
        code = lambda r: [1.0, *[float(r.judge_provider == j) for j in judges[1:]], float(r.same_provider)]
        own = as_arrays(lines(part, "run", code))
        ladder = M.run_judge_ladder(own, names)
        fits = [M.fit_cr2("J1", own, names)]
        try:
            fits.insert(0, M.fit_mixed("J0", own, names))
        except (PoolstatError, ZeroDivisionError, M.np.linalg.LinAlgError):
            pass
        return frame(told(fits, ladder.rung), study, part[study].iloc[0], FITS)

    kind = dict(rows.dtypes)[study]
    return stats(rows, study, "run", ["judge_provider", "same_provider"], "response").groupBy(study).applyInPandas(run, f"{study} {kind}, {FITS}")


def family_verdicts(rows: DataFrame, study: str, panel: list[str], reference: str = "A", arm: str = "arm", brief: str = "brief", response: str = "response", **family) -> DataFrame:
    """The registered family against each study's ladder: five slots a study, those it cannot estimate kept with the reason, Holm over all."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, names, arms, first = arm_design(part, arm, brief, reference)
        specs, ladder, why = C.registered_family(panel, reference, available=arms, **family), None, f"no rows of the reference {reference!r}"
        if first == reference:
            try:
                ladder = M.run_ladder(as_arrays(own), names)
                why = "no rung of the ladder holds"
            except (PoolstatError, ZeroDivisionError, M.np.linalg.LinAlgError) as e:
                why = f"no fit: {e}"
        if ladder is None or ladder.fit is None:
            out = [("R3", s.id, s.kind, False, *[None] * 5, s.reason or why) for s in specs]
        else:
            results = C.verdicts([C.evaluate_spec(s, ladder.fit) for s in specs])
            out = [(ladder.rung, r.id, r.kind, bool(r.estimable), *[x if r.estimable else None for x in (r.estimate, r.se, r.p, r.holm_p, r.holds)], r.reason) for r in results]
        return frame(out, study, part[study].iloc[0], VERDICTS)

    kind = dict(rows.dtypes)[study]
    return stats(rows, study, brief, [arm], response).groupBy(study).applyInPandas(run, f"{study} {kind}, {VERDICTS}")
