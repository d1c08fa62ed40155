"""Mixed models and cluster-robust regression from per-(cluster, design row) counts, sums and sums of squares.

Spark reduces rows to one line for each cluster and distinct design row (`cell_stats`); all that follows is small
algebra on those lines, so a fit costs one aggregation whatever the number of rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import FitSchema, FitUnavailable, PoolstatError, check

from .linalg import inverse, inverse_root

MAX_LINES = 1_000_000
BIAS = "judge_provider:generator_provider[T.same]"
RIDGE_STEPS = 400


@dataclass
class Fit:
    rung: str
    names: list[str]
    coefficients: np.ndarray
    vcov: np.ndarray
    n: int
    df: float | None = None
    components: dict[str, float] = field(default_factory=dict)
    converged: bool = True
    reason: str | None = None


@dataclass
class Line:
    """One cluster's rows that share a design row."""

    cluster: object
    x: np.ndarray
    n: int
    total: float
    squares: float


def coefficient_names(arms: list[str], reference: str) -> list[str]:
    check(reference in arms, f"reference arm {reference!r} is not among {arms}")
    return ["Intercept", *[coefficient_name(a, reference) for a in arms if a != reference]]


def coefficient_name(arm: str, reference: str) -> str:
    return "Intercept" if arm == reference else f"arm[T.{arm}]"


def arm_of(name: str) -> str | None:
    return name[len("arm[T.") : -1] if name.startswith("arm[T.") and name.endswith("]") and len(name) > 7 else None


def design_columns(arms: list[str], reference: str, arm: str = "arm") -> list:
    """Treatment coding as columns: the intercept and one indicator for each other arm."""
    names = coefficient_names(arms, reference)
    return [F.lit(1.0).alias(names[0]), *[(F.col(arm) == a).cast("double").alias(n) for a, n in zip([a for a in arms if a != reference], names[1:])]]


def judge_names(judges: list[str], reference: str) -> list[str]:
    check(reference in judges, f"reference judge {reference!r} is not among {judges}")
    return ["Intercept", *[f"judge_provider[T.{j}]" for j in judges if j != reference], BIAS]


def judge_design_columns(judges: list[str], reference: str) -> list:
    names = judge_names(judges, reference)
    others = [(F.col("judge_provider") == j).cast("double").alias(n) for j, n in zip([j for j in judges if j != reference], names[1:])]
    return [F.lit(1.0).alias(names[0]), *others, F.col("same_provider").cast("double").alias(BIAS)]


def cell_stats(rows: DataFrame, cluster: str, keys: list[str], response: str) -> DataFrame:
    """cluster, keys, n, total, squares: all a fit needs of the rows."""
    y = F.col(response).cast("double")
    return rows.groupBy(cluster, *keys).agg(F.count(y).alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares"))


def _lines(stats: DataFrame, cluster: str, code) -> list[Line]:
    rows = stats.where("n > 0").limit(MAX_LINES + 1).collect()
    check(len(rows) <= MAX_LINES, f"more than {MAX_LINES} distinct (cluster, design row) pairs")
    rows.sort(key=lambda r: str(r[cluster]))
    return [Line(r[cluster], code(r), r["n"], r["total"], r["squares"]) for r in rows]


def arm_lines(rows: DataFrame, arms: list[str], reference: str, arm: str = "arm", brief: str = "brief", response: str = "response") -> list[Line]:
    """Lines of y ~ arm by brief; an arm outside `arms` is refused."""
    names = coefficient_names(arms, reference)

    def code(r) -> np.ndarray:
        check(r[arm] in arms, f"row names arm {r[arm]!r}, which is not among {arms}")
        x = np.zeros(len(names))
        x[0] = 1
        if r[arm] != reference:
            x[names.index(coefficient_name(r[arm], reference))] = 1
        return x

    return _lines(cell_stats(rows, brief, [arm], response), brief, code)


def judge_lines(rows: DataFrame, judges: list[str], reference: str) -> list[Line]:
    names = judge_names(judges, reference)

    def code(r) -> np.ndarray:
        check(r["judge_provider"] in judges, f"row names judge {r['judge_provider']!r}, which is not among {judges}")
        x = np.zeros(len(names))
        x[0], x[-1] = 1, float(r["same_provider"])
        if r["judge_provider"] != reference:
            x[names.index(f"judge_provider[T.{r['judge_provider']}]")] = 1
        return x

    return _lines(cell_stats(rows, "run", ["judge_provider", "same_provider"], "response"), "run", code)


def _clusters(lines: list[Line]) -> list[list[Line]]:
    return [list(g) for _, g in groupby(lines, key=lambda x: x.cluster)]


def _minimise(f, start: np.ndarray) -> tuple[np.ndarray, bool]:
    """Downhill simplex."""
    points = [start] + [start + step for step in np.eye(len(start)) * 0.5]
    values = [f(p) for p in points]
    for _ in range(RIDGE_STEPS * len(start)):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-12 * (1 + abs(values[0])) and np.abs(points[-1] - points[0]).max() < 1e-7:
            return points[0], True
        centre = np.mean(points[:-1], axis=0)
        for scale in (1.0, 2.0, 0.5, -0.5):
            trial = centre + scale * (centre - points[-1])
            v = f(trial)
            if scale == 1.0:
                first, first_v = trial, v
                if values[0] <= v < values[-2]:
                    points[-1], values[-1] = trial, v
                    break
                if v >= values[-2]:
                    continue
            elif scale == 2.0:
                if first_v >= values[-2]:
                    continue
                points[-1], values[-1] = (trial, v) if v < first_v else (first, first_v)
                break
            elif v < min(first_v, values[-1]):
                points[-1], values[-1] = trial, v
                break
        else:
            points = [points[0]] + [points[0] + (p - points[0]) / 2 for p in points[1:]]
            values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))], False


def reml(rung: str, lines: list[Line], names: list[str], inner: bool) -> Fit:
    """Random intercept of the cluster, with `inner` also of each of its lines, by restricted maximum likelihood.

    Works on line means: a cluster's covariance over the residual variance is b * 11' + diag(a + 1/n); what lies
    within lines only enters through its sum of squares. Variance ratios are squares of the searched values.
    """
    check(len(lines) > 0, "no rows to fit", FitUnavailable)
    groups = [(np.array([x.x for x in g]), np.array([x.total / x.n for x in g]), np.array([x.n for x in g], dtype=float)) for g in _clusters(lines)]
    within = sum(x.squares - x.total * x.total / x.n for x in lines)
    count, k = sum(x.n for x in lines), len(names)

    def parts(v: np.ndarray):
        b, a = v[0] ** 2, (v[1] ** 2 if inner else 0.0)
        xvx, xvy, yvy, logs = np.zeros((k, k)), np.zeros(k), 0.0, 0.0
        for x, y, n in groups:
            d = 1 / (a + 1 / n)
            s = 1 + b * d.sum()
            solve = lambda m: d[:, None] * m - b / s * np.outer(d, d @ m)  # noqa: B023, E731
            z = solve(np.column_stack([x, y]))
            xvx += x.T @ z[:, :-1]
            xvy += x.T @ z[:, -1]
            yvy += y @ z[:, -1]
            logs += math.log(s) - np.log(d).sum()
        beta = np.linalg.solve(xvx, xvy)
        rest = within + yvy - xvy @ beta
        return beta, xvx, max(rest, 1e-300) / (count - k), logs

    def deviance(v: np.ndarray) -> float:
        try:
            _, xvx, s2, logs = parts(v)
        except np.linalg.LinAlgError as e:
            raise FitUnavailable(f"{rung}: singular design") from e
        return (count - k) * math.log(s2) + logs + np.linalg.slogdet(xvx)[1]

    tries = [_minimise(deviance, np.full(1 + inner, start)) for start in (0.3, 1.0)]
    v, ok = min(tries, key=lambda t: deviance(t[0]))
    for i in range(len(v)):  # a component at the edge of its range
        edge = v.copy()
        edge[i] = 0
        if deviance(edge) <= deviance(v) + 1e-9:
            v = edge
    beta, xvx, s2, _ = parts(v)
    components = {"cluster": float(v[0] ** 2 * s2), "residual": float(s2)}
    if inner:
        components["cluster:line"] = float(v[1] ** 2 * s2)
    return Fit(rung, names, beta, s2 * np.linalg.inv(xvx), int(count), None, components, ok)


def fit_mixed(rung: str, lines: list[Line], names: list[str]) -> Fit:
    """R0: brief and brief:arm intercepts; R1: brief alone; J0: run alone."""
    check(rung in ("R0", "R1", "J0"), f"unknown mixed rung {rung!r}")
    return validated(reml(rung, lines, names, rung == "R0"), names)


def validated(fit: Fit, names: list[str]) -> Fit:
    """Refuse a fit whose names or shapes are not those asked for; never align by position."""
    check(list(fit.names) == list(names), f"coefficients {fit.names} are not the requested {names}", FitSchema)
    check(len(fit.coefficients) == len(names) and np.shape(fit.vcov) == (len(names),) * 2, "coefficients or covariance of another size", FitSchema)
    return fit


def fit_cr2(rung: str, lines: list[Line], names: list[str]) -> Fit:
    """Least squares with the bias-reduced (CR2) sandwich; degrees of freedom are clusters - 1.

    Rows of a line are alike, so (I - H)^-1/2 acts within a cluster on its lines only: with S = N^1/2 C P C' N^1/2 the
    cluster's score is C' N^1/2 (I - S)^-1/2 N^-1/2 r, where r holds the lines' residual sums.
    """
    groups, k = _clusters(lines), len(names)
    n, df = int(sum(x.n for x in lines)), len(groups) - 1
    nothing = lambda why, beta=None: Fit(rung, names, np.full(k, np.nan) if beta is None else beta, np.full((k, k), np.nan), n, df, {}, False, why)
    if len(groups) <= k:
        return nothing(f"{len(groups)} clusters do not identify {k} parameters")
    xx = sum(x.n * np.outer(x.x, x.x) for x in lines)
    try:
        p = inverse(xx)
    except PoolstatError as e:
        return nothing(f"singular design: {e}")
    beta = p @ sum(x.total * x.x for x in lines)
    meat = np.zeros((k, k))
    for g in groups:
        c, root = np.array([x.x for x in g]), np.sqrt([x.n for x in g])
        r = np.array([x.total - x.n * (x.x @ beta) for x in g])
        s = root[:, None] * (c @ p @ c.T) * root
        v = c.T @ (root * (inverse_root(np.eye(len(g)) - s) @ (r / root)))
        meat += np.outer(v, v)
    return Fit(rung, names, beta, p @ meat @ p, n, df)


def needs_descent(fit: Fit) -> str | None:
    """Why a fit cannot be used, or None; a zero variance component is no reason."""
    if not fit.converged:
        return fit.reason or "did not converge"
    for i, d in enumerate(np.diag(fit.vcov)):
        if not np.isfinite(d) or d <= 0:
            return f"variance of coefficient {i} is {d}"
    return None


@dataclass
class Ladder:
    rung: str
    fit: Fit | None
    history: list[tuple[str, str | None]]
    robust: Fit | None = None


def run_ladder(lines: list[Line], names: list[str], mixed=fit_mixed) -> Ladder:
    """R0, R1, R2, else R3 (no fit); R2 is always computed as a check. A fit that fails outright is no descent."""
    robust, history = fit_cr2("R2", lines, names), []
    for rung in ("R0", "R1", "R2"):
        fit = robust if rung == "R2" else mixed(rung, lines, names)
        history.append((rung, needs_descent(fit)))
        if history[-1][1] is None:
            return Ladder(rung, fit, history, robust)
    return Ladder("R3", None, history, robust)


def run_judge_ladder(lines: list[Line], names: list[str], mixed=fit_mixed) -> Ladder:
    """J0, J1, else J2 (no fit)."""
    history = []
    for rung in ("J0", "J1"):
        fit = mixed(rung, lines, names) if rung == "J0" else fit_cr2(rung, lines, names)
        history.append((rung, needs_descent(fit)))
        if history[-1][1] is None:
            return Ladder(rung, fit, history)
    return Ladder("J2", None, history)


def analysis_hash(source: bytes, toolchain: dict[str, str]) -> str:
    """Provenance of a fit: hash of the hash of its source and of its sorted toolchain."""
    text = json.dumps(dict(sorted(toolchain.items())), separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256((hashlib.sha256(source).hexdigest() + text).encode()).hexdigest()[:12]
