"""Design arithmetic of a non-inferiority margin: standard errors, power at no difference, verdicts."""

from __future__ import annotations

import math

from .distributions import Z_975, Z_HOLM_WORST, contrast_se, normal_cdf

# Measured variance components at pools of about 60 and 30, and their registered standard errors.
BRIEF_ARM_60, RESIDUAL_60 = 7.8266, 3.6348
BRIEF_ARM_30, RESIDUAL_30 = 1.2088, 5.1181
BRIEFS, REPLICATES = 24, 2
REGISTERED_SE = [(BRIEF_ARM_60, RESIDUAL_60, 24, 2, 0.897), (BRIEF_ARM_60, RESIDUAL_60, 48, 2, 0.634), (BRIEF_ARM_60, RESIDUAL_60, 48, 3, 0.614), (BRIEF_ARM_30, RESIDUAL_30, 24, 2, 0.56)]
TOLERANCE = 0.005


def derive_delta(brief_arm: float) -> float:
    """The margin: one arm's brief-to-brief standard deviation."""
    return math.sqrt(brief_arm)


def contrast_sd(brief_arm: float) -> float:
    return math.sqrt(2 * brief_arm)


def power_at_zero(delta: float, se: float, z: float = Z_975) -> float:
    return normal_cdf(delta / se - z)


def margin_verdict(deficit: float, delta: float) -> str:
    return "inside (non-inferior)" if deficit > -delta else "outside (inferior)"


def reproduction_checks() -> list[dict]:
    """The registered standard errors computed again."""
    out = []
    for brief_arm, residual, briefs, replicates, wanted in REGISTERED_SE:
        se = contrast_se(brief_arm, residual, briefs, replicates)
        out.append({"briefs": briefs, "replicates": replicates, "expected": wanted, "computed": se, "ok": abs(se - wanted) <= TOLERANCE})
    return out


def registered_power() -> dict[str, float]:
    se = contrast_se(BRIEF_ARM_60, RESIDUAL_60, BRIEFS, REPLICATES)
    delta = derive_delta(BRIEF_ARM_60)
    return {"se": se, "one_sided": power_at_zero(delta, se), "holm_worst": power_at_zero(delta, se, Z_HOLM_WORST)}
