"""The registered family of five hypotheses, contrasts of a fit, and their verdicts after Holm's correction."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from poolstat.errors import check

from .distributions import normal_cdf, normal_quantile, t_quantile, t_two_sided, upper_tail
from .fit import BIAS, Fit, arm_of, coefficient_name

# The registered margin, arm sets and levels.
MARGIN = 2.7976
H1_ARM_SETS = {"prereg-2026-08-01": ("A", ["A'", "B", "C", "D", "E", "F", "G", "H"])}
DEFAULT_H1 = "prereg-2026-08-01"
TWO_SIDED, ONE_SIDED = 0.05, 0.025


@dataclass(frozen=True)
class Spec:
    """A hypothesis: kind is superiority, margin, iut (all components must hold) or bias; missing arms keep its slot."""

    id: str
    description: str
    kind: str
    weights: dict[str, float] = field(default_factory=dict)
    components: tuple[tuple[str, dict[str, float]], ...] = ()
    delta: float = 0.0
    missing: tuple[str, ...] = ()
    estimable: bool = True
    reason: str | None = None


@dataclass(frozen=True)
class Result:
    id: str
    kind: str
    p: float = 1.0
    estimate: float | None = None
    se: float | None = None
    ci: tuple[float, float] | None = None
    one_sided: bool = False
    estimable: bool = True
    missing: tuple[str, ...] = ()
    reason: str | None = None
    components: tuple[Result, ...] = ()
    holm_p: float | None = None
    holds: bool | None = None


def contrast_vector(names: list[str], weights: dict[str, float]) -> np.ndarray:
    unknown = [w for w in weights if w not in names]
    check(not unknown, f"unknown coefficients {unknown}, not in {names}")
    return np.array([weights.get(n, 0.0) for n in names])


def evaluate_contrast(fit: Fit, c: np.ndarray, level: float = 0.95) -> dict:
    """Estimate, standard error, two-sided p and interval: t where the fit has degrees of freedom, else normal."""
    check(len(c) == len(fit.coefficients), f"{len(c)} weights for {len(fit.coefficients)} coefficients")
    used = np.flatnonzero(c)
    variance = float(c[used] @ np.asarray(fit.vcov)[np.ix_(used, used)] @ c[used]) if len(used) else 0.0
    check(math.isfinite(variance) and variance > 0, f"contrast variance is {variance}")
    estimate, se, upper = float(c @ fit.coefficients), math.sqrt(variance), 1 - (1 - level) / 2
    z = estimate / se
    p, width = (t_two_sided(z, fit.df), t_quantile(upper, fit.df)) if fit.df else (2 * (1 - normal_cdf(abs(z))), normal_quantile(upper))
    return {"estimate": estimate, "se": se, "p": p, "ci": (estimate - width * se, estimate + width * se)}


def checked_arm_set(reference: str, panel: list[str]) -> None:
    check(len(panel) >= 2, f"H1 is a mean over two arms or more, got {panel}")
    check(len(set(panel)) == len(panel), f"repeated arm in {panel}")
    check(reference not in panel, f"{reference!r} is the reference and cannot be a panel arm")


def registered_family(
    panel: list[str], reference: str = "A", h2=("E", "D"), h3=("G", "D", "H"), h4=("B", "D"),
    delta: float = MARGIN, h1_set: str = DEFAULT_H1, available: list[str] | None = None, bias_fitted: bool = False,
) -> list[Spec]:
    """H1 to H5, always five: what this run's arms cannot estimate keeps its slot and is never replaced."""
    check(len(panel) > 0 and len(set(panel)) == len(panel), f"panel arms must be given once each, got {panel}")
    check(h1_set in H1_ARM_SETS, f"unknown H1 arm set {h1_set!r}")
    own_reference, members = H1_ARM_SETS[h1_set]
    checked_arm_set(own_reference, members)
    check(reference not in [*panel, *h2, *h3, *h4], f"reference arm {reference!r} is a contrast member")
    here = set(available if available is not None else [reference, *panel])
    name = lambda a: coefficient_name(a, reference)

    def difference(id_: str, pair: tuple[str, str]) -> Spec:
        return Spec(id_, f"{pair[0]} >= {pair[1]} (one-sided, margin {delta})", "margin", {name(pair[0]): 1.0, name(pair[1]): -1.0}, delta=delta)

    first = Spec("H1", f"mean({', '.join(members)}) - {own_reference}", "superiority", {coefficient_name(a, own_reference): 1 / len(members) for a in members})
    third = Spec("H3", f"{h3[0]} > max({', '.join(h3[1:])})", "iut", components=tuple((f"H3:{h3[0]}-{b}", {name(h3[0]): 1.0, name(b): -1.0}) for b in h3[1:]))
    out = []
    for spec, arms in ((first, members), (difference("H2", h2), h2), (third, h3), (difference("H4", h4), h4)):
        if spec.id == "H1" and reference != own_reference:
            spec = replace(spec, estimable=False, reason=f"registered against {own_reference}, this run's reference is {reference}")
        elif missing := tuple(dict.fromkeys(a for a in arms if a not in here)):
            spec = replace(spec, estimable=False, missing=missing, reason=f"arms {list(missing)} are not in this run")
        out.append(spec)
    bias = Spec("H5", "same-provider judging raises scores", "bias", {BIAS: 1.0})
    return [*out, bias if bias_fitted else replace(bias, estimable=False, reason="no judge-score fit was supplied")]


def evaluate_spec(spec: Spec, fit: Fit) -> Result:
    """A hypothesis against a fit; margin and component tests are one-sided, the worst component is binding."""
    wanted = {**spec.weights, **{k: v for _, w in spec.components for k, v in w.items()}}
    absent = tuple(a for n in wanted if n not in fit.names and (a := arm_of(n)))
    if not spec.estimable or absent:
        return Result(spec.id, spec.kind, estimable=False, missing=spec.missing or absent, reason=spec.reason or f"the fit has no arms {list(absent)}")
    if spec.kind == "iut":
        parts = []
        for id_, weights in spec.components:
            e = evaluate_contrast(fit, contrast_vector(fit.names, weights))
            parts.append(Result(id_, "iut", upper_tail(e["estimate"] / e["se"], fit.df), e["estimate"], e["se"], e["ci"], True))
        worst = max(parts, key=lambda r: r.p)
        return replace(worst, id=spec.id, components=tuple(parts))
    e = evaluate_contrast(fit, contrast_vector(fit.names, spec.weights))
    if spec.kind == "margin":
        return Result(spec.id, spec.kind, upper_tail((e["estimate"] + spec.delta) / e["se"], fit.df), e["estimate"], e["se"], e["ci"], True)
    return Result(spec.id, spec.kind, e["p"], e["estimate"], e["se"], e["ci"])


def holm(p: list[float], family_size: int | None = None) -> list[float]:
    """Holm's step-down adjustment of a small list, in its order."""
    check(len(p) > 0, "no p-values")
    check(family_size is None or len(p) == family_size, f"{len(p)} p-values for a family of {family_size}")
    check(all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in p), f"p-values must lie in [0, 1], got {p}")
    order = np.argsort(p, kind="stable")
    steps = np.minimum(1.0, np.asarray(p, dtype=float)[order] * (len(p) - np.arange(len(p))))
    out = np.empty(len(p))
    out[order] = np.maximum.accumulate(steps)
    return out.tolist()


def verdicts(results: list[Result]) -> list[Result]:
    """Holm over all slots; a one-sided result must stay under 0.025, a two-sided one under 0.05."""
    adjusted = holm([r.p for r in results])
    return [r if not r.estimable else replace(r, holm_p=h, holds=h < (ONE_SIDED if r.one_sided else TWO_SIDED)) for r, h in zip(results, adjusted)]


def family_estimability(results: list[Result]) -> dict:
    lost = [r for r in results if not r.estimable]
    return {"slots": len(results), "estimated": len(results) - len(lost), "not_estimable": [(r.id, r.missing) for r in lost if r.missing]}


def slot_count(family: list[Spec]) -> int:
    return len(family)


