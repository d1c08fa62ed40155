"""Report lines, small refusals and constants that no query carries."""

import pytest
from pyspark.sql import functions as F

from poolstat import reports
from poolstat.models import margin
from poolstat.operators import judging, records, teams, thresholds


def test_report_lines(spark):
    frame = spark.createDataFrame
    means, ratios = frame([("B", 1.0, 2.5, True), ("A", 0.5, 3.0, False)], "arm string, mean_cost double, mean_response double, on_frontier boolean"), frame([("A", 2.0, 1.5, 2.5)], "arm string, ratio double, ci_lower double, ci_upper double")
    lines = reports.cost_lane_lines(means, ratios, 7)
    assert lines[1].split()[0] == "A" and "on the frontier: no" in lines[1] and "yes" in lines[2] and lines[3].endswith("[1.500, 2.500]  (seed 7)")
    arms, levels = frame([("A", 10.4, 20.6, 3)], "arm string, input_tokens double, output_tokens double, n long"), frame([("low", 0.55, False, 0), ("high", 1.0, True, 12)], "effort string, multiplier double, fitted boolean, n long")
    assert reports.calibration_lines(arms, levels) == ["A: 10 in / 21 out tokens a cell, mean of 3", "effort high: 1.00x (fitted, 12 cells)", "effort low: 0.55x (static, 0 cells)"]
    assert reports.calibration_lines(arms.limit(0), levels.limit(0)) == ["no arm has enough cells: structural estimates"]
    assert reports.prune_lines(frame([("x", "keep"), ("x", "keep"), ("x", "fold")], "family string, action string")) == ["x: fold 1", "x: keep 2"]
    totals = frame([(1.25, 0.0, "", 0)], "total_usd double, notional_usd double, missing_models string, legacy_rows long")
    assert reports.spend_lines(totals, frame([("anthropic", 1.0), (None, 0.25)], "provider string, usd double")) == ["total 1.2500, notional 0.0000, without a rate: none, priced by the fallback regime: 0", "  no provider: 0.2500", "  anthropic: 1.0000"]
    control = frame([(0.1, 0.2, 0.3, True)], "low double, average double, high double, ordered boolean")
    assert reports.phase0_lines(control, False, {"floor": "pass", "failed": False}) == ["ordering holds: 0.1000 0.2000 0.3000", "pool of copies: FAIL", "unrelated texts: floor pass, not failed"]


def test_refusals(spark):
    one = spark.range(1)
    for bad, why in (
        (one.select(judging.distinct_evaluator(F.lit("m"), F.array(F.lit("m")))), "judges its own pool"),
        (records.valid_responses(spark.createDataFrame([("skipped", None)], "state string, kind string")), "not a provider"),
        (teams.deidentified(spark.createDataFrame([("p", 1, " ")], "pool string, `index` int, text string")), "without text"),
    ):
        with pytest.raises(Exception, match=why):
            bad.collect()
    assert thresholds.band_of_gap(0.1) == pytest.approx(0.5)
    with pytest.raises(Exception, match="positive"):
        thresholds.band_of_gap(0.0)
    levels = one.select(*[teams.request_floor(F.lit(e), 10).alias(str(e)) for e in ("low", "high", "max", None)]).first()
    assert min(levels) >= 10 and levels["None"] == levels["high"] <= levels["max"]


def test_margins():
    assert margin.contrast_sd(1.2088) == pytest.approx((2 * 1.2088) ** 0.5)
    power = margin.registered_power()
    assert 0 < power["holm_worst"] < power["one_sided"] < 1 and power["se"] > 0
