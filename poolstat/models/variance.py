"""Variance components of arm x brief designs, from one aggregation of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolstat.errors import check

from .distributions import F_975_12_12
from .fit import arm_lines, coefficient_names, fit_cr2, fit_mixed


def within_cell_variance(cells: DataFrame, *by: str) -> DataFrame:
    """by, sigma2, df, cells: squares within (arm, brief) over their degrees of freedom; cells of one row give none."""
    per = cells.groupBy("arm", "brief").agg(F.count("response").alias("n"), F.var_samp("response").alias("v")).where("n > 1")
    return per.groupBy(*by).agg((F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("sigma2"), F.sum(F.col("n") - 1).alias("df"), F.count("*").alias("cells"))


def balanced_anova(cells: DataFrame) -> DataFrame:
    """One row of mean squares, variance components and the standard error of a two-arm contrast.

    Cell sums are made once and added up to arms, briefs and the whole; a design with a missing cell or unlike counts is refused.
    """
    cell = cells.groupBy("arm", "brief").agg(F.count("response").alias("n"), F.sum("response").alias("t"), F.sum(F.col("response") * F.col("response")).alias("q"))
    shape = cell.agg(F.count_distinct("arm").alias("a"), F.count_distinct("brief").alias("b"), F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    a, b, r = shape["a"], shape["b"], shape["low"]
    check(shape["c"] == a * b and shape["low"] == shape["high"] and a > 1 and b > 1 and r > 1, f"not a balanced design of two rows or more a cell: {shape}")
    sums = cell.cube("arm", "brief").agg(F.grouping_id().alias("g"), F.sum("t").alias("t"), F.sum("q").alias("q"))
    # sums of squared totals by level of the cube
    level = lambda g: F.sum(F.when(F.col("g") == g, F.col("t") * F.col("t")))
    raw = sums.agg(level(0).alias("s_ab"), level(1).alias("s_a"), level(2).alias("s_b"), level(3).alias("s_0"), F.max(F.when(F.col("g") == 3, F.col("q"))).alias("q"))
    n = a * b * r
    ms = raw.select(
        ((F.col("s_a") / (b * r) - F.col("s_0") / n) / (a - 1)).alias("ms_arm"), ((F.col("s_b") / (a * r) - F.col("s_0") / n) / (b - 1)).alias("ms_brief"),
        ((F.col("s_ab") / r - F.col("s_a") / (b * r) - F.col("s_b") / (a * r) + F.col("s_0") / n) / ((a - 1) * (b - 1))).alias("ms_both"), ((F.col("q") - F.col("s_ab") / r) / (a * b * (r - 1))).alias("ms_error"),
    )
    zero = F.lit(0.0)
    return ms.select("*", F.greatest(zero, (F.col("ms_both") - F.col("ms_error")) / r).alias("var_both"), F.greatest(zero, (F.col("ms_brief") - F.col("ms_both")) / (a * r)).alias("var_brief"), F.sqrt(2 * F.col("ms_both") / (b * r)).alias("contrast_se"))


def scale_basis(cells: DataFrame, wide: str, centre: str, brief_arm: float) -> DataFrame:
    """Ratio of two arms' within-cell variances with its F interval, of their means, and the brief-by-arm variance carried over."""
    own = cells.where(F.col("arm").isin(wide, centre))
    v = within_cell_variance(own, "arm").agg(F.max(F.when(F.col("arm") == wide, F.col("sigma2"))).alias("w"), F.max(F.when(F.col("arm") == centre, F.col("sigma2"))).alias("c"))
    m = own.agg(F.avg(F.when(F.col("arm") == wide, F.col("response"))).alias("mw"), F.avg(F.when(F.col("arm") == centre, F.col("response"))).alias("mc"))
    ratio = F.col("w") / F.col("c")
    return v.crossJoin(m).select(ratio.alias("variance_ratio"), (ratio / F_975_12_12).alias("ratio_low"), (ratio * F_975_12_12).alias("ratio_high"), (F.col("mw") / F.col("mc")).alias("mean_ratio"), (ratio * brief_arm).alias("brief_arm"))  # one row each


def fitted(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """rung, coefficient, estimate, se of R0, R1 and R2 on the arms of a table, the first arm as reference."""
    arms = sorted(r["arm"] for r in cells.select("arm").distinct().collect())
    names = coefficient_names(arms, arms[0])
    lines = arm_lines(cells, arms, arms[0])
    fits = [fit_mixed("R0", lines, names), fit_mixed("R1", lines, names), fit_cr2("R2", lines, names)]
    return spark.createDataFrame([(f.rung, n, float(b), float(v) ** 0.5) for f in fits for n, b, v in zip(names, f.coefficients, f.vcov.diagonal())], "rung string, coefficient string, estimate double, se double")
