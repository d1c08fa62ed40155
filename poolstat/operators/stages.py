"""Registered stage analyses: one per-arm configuration rule, one rarefied contrast family, one full-pool cost lane."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from poolstat.errors import check
from poolstat.models.contrasts import Result, contrast_vector, evaluate_contrast, verdicts
from poolstat.models.fit import Ladder, arm_lines, coefficient_name, coefficient_names, run_ladder

from .frame import Frame, apply_arm_configs, cells_selected
from .resampling import cost_lane, rarefied_frame

# Fixed value: the least size pools may be rarefied to.
FLOOR = 48


@dataclass
class Stage:
    frame: Frame
    dropped: DataFrame
    rarefied: Frame
    ladder: Ladder
    results: list[Result]
    frontier: DataFrame
    ratios: DataFrame


def family(fit, contrasts: list[tuple[str, str, str | None]], reference: str) -> list[Result]:
    """contrasts (id, arm, arm it is held against or None for the reference) with Holm verdicts."""
    out = []
    for id_, arm, minus in contrasts:
        weights = {coefficient_name(arm, reference): 1.0} | ({coefficient_name(minus, reference): -1.0} if minus else {})
        check("Intercept" not in weights, f"{id_}: the reference arm cannot be a contrast member")
        e = evaluate_contrast(fit, contrast_vector(fit.names, weights))
        out.append(Result(id_, "superiority", e["p"], e["estimate"], e["se"], e["ci"]))
    return verdicts(out)


def analyse(frame: Frame, vectors: DataFrame, contrasts: list[tuple[str, str, str | None]], reference: str, threshold: float, rule: dict[str, str] | None = None, floor: int = FLOOR, rounds: int = 1000, iterations: int = 2000, seed: int = 1) -> Stage:
    """The stage: rows by the configuration rule, rarefied contrasts on the ladder, the cost lane on full pools.

    Pools smaller than `floor` are refused; a ladder without a fit gives no results.
    """
    kept, dropped = apply_arm_configs(frame.rows, rule or {})
    own = cells_selected(replace(frame, rows=kept))
    arms = sorted({reference, *[a for _, arm, minus in contrasts for a in (arm, minus) if a]})
    thin = rarefied_frame(own, vectors, arms, threshold, rounds=rounds)
    least = thin.rows.agg({"rarefied_n": "min"}).first()[0]
    check(least >= floor, f"the smallest pool has {least} items, the registered floor is {floor}")
    ladder = run_ladder(arm_lines(thin.rows, arms, reference), coefficient_names(arms, reference))
    results = family(ladder.fit, contrasts, reference) if ladder.fit else []
    return Stage(own, dropped, thin, ladder, results, *cost_lane(own, seed, iterations))
