"""Text products: CSV, R script, markdown report and SVG of small results; all inputs are already reduced tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check
from poolstat.functions.text import csv_escape
from poolstat.models.contrasts import Result
from poolstat.models.fit import Ladder

ANALYSIS_COLUMNS = ["key", "arm", "brief", "replicate", "response", "cost"]
MAX_ROWS = 10_000


def analysis_csv(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One text column of CSV lines in a fixed column order, without a header; write it with `.write.text`."""
    return rows.select(F.concat_ws(",", *[csv_escape(F.col(c)) for c in columns or ANALYSIS_COLUMNS]).alias("value"))


def small(rows: DataFrame, *order: str) -> list:
    """Rows of a reduced table; a table that is not small is refused."""
    got = (rows.orderBy(*order) if order else rows).limit(MAX_ROWS + 1).collect()
    check(len(got) <= MAX_ROWS, f"over {MAX_ROWS} rows for a text product")
    return got


def r_script(csv_path: str, reference: str, response: str = "response") -> str:
    """An R script that fits the first rung of the ladder on the exported CSV."""
    return "\n".join([
        "library(lme4)",
        f'cells <- read.csv("{csv_path}", header = FALSE, col.names = c({", ".join(f"{c!r}" for c in ANALYSIS_COLUMNS)}))',
        f'cells$arm <- relevel(factor(cells$arm), ref = "{reference}")',
        f"fit <- lmer({response} ~ arm + (1 | brief) + (1 | brief:arm), data = cells, REML = TRUE)",
        "print(summary(fit))", "print(VarCorr(fit))", "",
    ])


def table(header: list[str], rows: list[list]) -> list[str]:
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(header) + " |", "|" + " --- |" * len(header), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]


def report(arms: DataFrame, ladder: Ladder, results: list[Result], ratios: DataFrame | None = None, exclusions: DataFrame | None = None) -> str:
    """Markdown: arm means, the rung that was fitted and why, contrasts with verdicts, ratios, exclusions."""
    out = ["# Analysis", "", "## Arms", "", *table(["arm", "n", "mean response", "mean cost"], [[r["arm"], r["n"], r["mean_response"], r["mean_cost"]] for r in small(arms, "arm")])]
    out += ["", "## Model", "", f"Rung {ladder.rung}" + ("" if ladder.fit else ": no model could be fitted"), ""]
    out += [f"- {rung}: {'kept' if why is None else 'left, ' + why}" for rung, why in ladder.history]
    if ladder.fit:
        out += ["", *table(["component", "variance"], sorted(ladder.fit.components.items())), "", *table(["coefficient", "estimate", "se"], [[n, float(b), float(v) ** 0.5] for n, b, v in zip(ladder.fit.names, ladder.fit.coefficients, ladder.fit.vcov.diagonal())])]
    word = lambda r: "not estimable: " + (r.reason or "") if not r.estimable else "holds" if r.holds else "does not hold"
    out += ["", "## Registered family", "", *table(["id", "estimate", "se", "p", "Holm p", "verdict"], [[r.id, r.estimate, r.se, r.p, r.holm_p, word(r)] for r in results])]
    if ratios is not None:
        out += ["", "## Response for a unit of cost (descriptive)", "", *table(["arm", "ratio", "low", "high"], [[r["arm"], r["ratio"], r["ci_lower"], r["ci_upper"]] for r in small(ratios, "arm")])]
    if exclusions is not None:
        out += ["", "## Excluded", "", *table(["bucket", "n"], [[r["bucket"], r["count"]] for r in small(exclusions.groupBy("bucket").count(), "bucket")])]
    return "\n".join([*out, ""])


def cost_lane_lines(means: DataFrame, ratios: DataFrame, seed: int) -> list[str]:
    out = ["cost and diversity, full pools:"]
    out += [f"  {r['arm']:<14} mean cost {r['mean_cost']:.4f}  mean response {r['mean_response']:.3f}  on the frontier: {'yes' if r['on_frontier'] else 'no'}" for r in small(means, "arm")]
    return out + [f"  {r['arm']:<14} ratio {r['ratio']:.3f}  [{r['ci_lower']:.3f}, {r['ci_upper']:.3f}]  (seed {seed})" for r in small(ratios, "arm")]


def pareto_svg(points: DataFrame, width: int = 640, height: int = 400, margin: int = 50) -> str:
    """Scatter of arms by cost and response, the frontier joined by a line."""
    rows = small(points, "mean_cost", "mean_response")
    check(len(rows) > 0, "no points to draw")
    xs, ys = [r["mean_cost"] for r in rows], [r["mean_response"] for r in rows]
    place = lambda v, all_, low, high: low + (v - min(all_)) / ((max(all_) - min(all_)) or 1.0) * (high - low)
    at = [(place(r["mean_cost"], xs, margin, width - margin), place(r["mean_response"], ys, height - margin, margin), r) for r in rows]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y, r in at if r["on_frontier"])
    marks = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="5" fill="{"#1f6f5c" if r["on_frontier"] else "#999"}"/><text x="{x + 8:.1f}" y="{y + 4:.1f}" font-size="12">{html.escape(str(r["arm"]))}</text>' for x, y, r in at]
    axes = f'<path d="M{margin} {margin}V{height - margin}H{width - margin}" fill="none" stroke="#333"/><text x="{width / 2}" y="{height - 10}">mean cost</text><text x="5" y="{margin - 15}">mean response</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{axes}<polyline points="{line}" fill="none" stroke="#1f6f5c"/>{"".join(marks)}</svg>'


def calibration_lines(arms: DataFrame, levels: DataFrame) -> list[str]:
    fitted = small(arms, "arm")
    out = [f"{r['arm']}: {r['input_tokens']:.0f} in / {r['output_tokens']:.0f} out tokens a cell, mean of {r['n']}" for r in fitted] or ["no arm has enough cells: structural estimates"]
    return out + [f"effort {r['effort']}: {r['multiplier']:.2f}x ({'fitted' if r['fitted'] else 'static'}, {r['n']} cells)" for r in small(levels, "effort")]


def prune_lines(plan: DataFrame) -> list[str]:
    return [f"{r['family']}: {r['action']} {r['count']}" for r in small(plan.groupBy("family", "action").count(), "family", "action")]


def spend_lines(totals: DataFrame, providers: DataFrame) -> list[str]:
    out = [f"total {r['total_usd']:.4f}, notional {r['notional_usd']:.4f}, without a rate: {r['missing_models'] or 'none'}, priced by the fallback regime: {r['legacy_rows']}" for r in small(totals)]
    return out + [f"  {r['provider'] or 'no provider'}: {r['usd']:.4f}" for r in small(providers, "provider")]


def phase0_lines(control: DataFrame, copies: bool, unrelated: dict) -> list[str]:
    r = small(control)[0]
    return [f"ordering {'holds' if r['ordered'] else 'is broken'}: {r['low']:.4f} {r['average']:.4f} {r['high']:.4f}", f"pool of copies: {'pass' if copies else 'FAIL'}", f"unrelated texts: floor {unrelated['floor']}, {'FAIL' if unrelated['failed'] else 'not failed'}"]
