"""Spend admission in plan order, exact and without one task for all rows.

A row is admitted if the budget left covers it, so each decision depends on all before it. But while 2^k <= left < 2^(k+1),
every cost under 2^k fits, a cost of class k (2^k up to 2^(k+1)) fits only where it is at most what is left there, and
larger ones never do. So a run of rows is skipped as a whole if its small costs leave 2^k or more and none of its costs of
class k fits; both are read off a summary of the run: its costs by class, and by class k the least sum of such a cost and
the smaller ones before it. Summaries of neighbours join to the summary of both, which makes a tree: blocks of 2^12
rows, and nodes of blocks. The driver walks the tree from the top and opens only runs that cannot be skipped. In an opened
block what is left falls under the next power of two, so it opens at most one block for each bit of the budget.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolstat.errors import check
from poolstat.sources.tables import written

#: bits of a row's place that number it within its block, and within the nodes above; classes of costs; places of a unit behind the point at most
LEVELS, CLASSES, PLACES = (12, 22, 42), 50, 6
#: where sums stop to grow, over any budget; no cost
MOST, NONE = 1 << 61, 1 << 62
SUMMARY = "sums array<long>, least array<long>"


def units(amount: float, places: int) -> int:
    return int((Decimal(str(amount)) * 10**places).to_integral_value(ROUND_HALF_UP))


def class_of(left: int) -> int:
    return max(left.bit_length() - 1, 0)


def joined(parts) -> tuple[list[int], list[int]]:
    """Summary of runs that follow each other, from theirs."""
    sums, least = [0] * CLASSES, [NONE] * CLASSES
    for s, m in parts:
        below = 0
        for k in range(CLASSES):
            least[k] = min(least[k], m[k] + below) if m[k] < NONE else least[k]
            below = min(below + sums[k], MOST)
        sums = [min(a + int(b), MOST) for a, b in zip(sums, s)]
    return sums, least


def block_summary(costs: np.ndarray) -> tuple[list[int], list[int]]:
    """Summary of a block's costs (0 to the budget, others as -1); 2^12 of them, each under 2^50, stay in an integer's range."""
    classes = np.where(costs > 0, np.floor(np.log2(np.maximum(costs, 1))).astype(int), -1)
    classes = np.where((costs > 0) & (costs < np.left_shift(1, np.maximum(classes, 0))), classes - 1, classes)  # the logarithm may be rounded up
    sums, least = [0] * CLASSES, [NONE] * CLASSES
    for k in np.unique(classes[classes >= 0]):
        own = classes == k
        before = np.cumsum(np.where((classes >= 0) & (classes < k), costs, 0))
        sums[k], least[k] = int(costs[own].sum()), int((costs[own] + before[own]).min())
    return sums, least


def skipped(left: int, sums, least) -> int | None:
    """What a run leaves of `left` if it is skipped as a whole; None if it has to be opened."""
    k = class_of(left)
    after = left - int(sum(sums[:k]))
    if left and (after < 1 << k or (k < CLASSES and least[k] <= left)):
        return None
    return after


def admitted(plan: DataFrame, order: str, usd: str, ceiling: float, prior: float = 0.0) -> DataFrame:
    """plan with admitted, and spent after each row; a row that would pass the ceiling is skipped and takes no budget.

    Amounts count in units of 10^-PLACES, or the finest that a budget under 2^50 units allows, halves rounded up. Rows of
    one `order` go by amount, then by their other columns. Null and NaN amounts are never admitted, negative ones raise.
    """
    spark, places = plan.sparkSession, PLACES
    while places and units(ceiling, places) - units(prior, places) >= 1 << CLASSES:
        places -= 1
    budget = units(ceiling, places) - units(prior, places)
    check(budget < 1 << CLASSES, f"a budget of {ceiling - prior} is too large")
    amount = F.col(usd).cast("double")
    cost = F.when(amount < 0, F.raise_error(F.lit("an amount to admit is negative")).cast("long"))
    cost = cost.when(amount.isNull() | F.isnan(amount) | (amount > (budget + 1.0) / 10.0**places), F.lit(-1).cast("long"))
    cost = cost.otherwise(F.floor(F.col(usd).cast("decimal(38,12)") * F.lit(10**places).cast("decimal(7,0)") + F.lit(Decimal("0.5"))).cast("long"))
    if budget < 0:
        return plan.withColumn("admitted", F.lit(False)).withColumn("spent", F.lit(float(prior)))
    keys = [order, usd, F.xxhash64(*plan.columns)]
    rows = plan.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_cost", cost).withColumn("_cost", F.when(F.col("_cost") <= budget, F.col("_cost")).otherwise(F.lit(-1).cast("long"))))
    node = lambda level: F.shiftright("_at", LEVELS[level])

    def blocks(part: pd.DataFrame) -> pd.DataFrame:
        sums, least = block_summary(part.sort_values("_at")["_cost"].to_numpy())
        return pd.DataFrame({"_at": [part["_at"].min()], "sums": [sums], "least": [least]})

    def above(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        sums, least = joined(zip(part["sums"], part["least"]))
        return pd.DataFrame({"_at": [part["_at"].min()], "sums": [sums], "least": [least]})

    tree = [written(rows.select("_at", "_cost").groupBy(node(0)).applyInPandas(blocks, f"_at long, {SUMMARY}"))]
    for level in (1, 2):
        tree.append(written(tree[-1].groupBy(node(level)).applyInPandas(above, f"_at long, {SUMMARY}")))
    opened: dict[tuple[int, int], int] = {}  # what is left behind an opened node
    decided: list[tuple[int, bool]] = []

    def walk(level: int, nodes: list, left: int) -> int:
        for r in sorted(nodes, key=lambda r: r["_at"]):
            after = skipped(left, r["sums"], r["least"])
            if after is None:
                at = r["_at"] >> LEVELS[level]
                inside = F.col("_at").between(at << LEVELS[level], ((at + 1) << LEVELS[level]) - 1)
                if level:
                    after = walk(level - 1, tree[level - 1].where(inside).collect(), left)
                else:
                    after = left
                    for x in sorted(rows.where(inside).select("_at", "_cost").collect()):
                        fits = 0 <= x["_cost"] <= after
                        after -= x["_cost"] if fits else 0
                        decided.append((x["_at"], fits))
                opened[level, at] = after
            left = after
        return left

    top = tree[2].collect()
    walk(2, top, budget)

    def starts(nodes: list, level: int, left: int) -> list[tuple[int, int]]:
        """(place, what is left before it) of nodes in order, of a level."""
        out = []
        for at, sums, least in sorted(nodes, key=lambda r: r[0]):
            out.append((at, left))
            key = (level, at >> LEVELS[level])
            left = opened[key] if key in opened else skipped(left, sums, least)
        return out

    before = spark.createDataFrame(starts([(r["_at"], r["sums"], r["least"]) for r in top], 2, budget), "_at long, _left long").select(node(2).alias("_node"), "_left")

    def down(level: int):
        def place(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(starts(list(zip(part["_at"], part["sums"], part["least"])), level, int(part["_left"].iloc[0])), columns=["_at", "_left"])

        return place

    for level in (1, 0):
        below = tree[level].withColumn("_node", node(level + 1)).join(before, "_node")
        before = below.groupBy("_node").applyInPandas(down(level), "_at long, _left long").select(node(level).alias("_node"), "_left")
    held = rows.withColumn("_node", node(0)).join(before, "_node")
    told = spark.createDataFrame(decided, "_at long, _fits boolean")  # CLASSES blocks at most
    held = held.join(F.broadcast(told), "_at", "left")
    small = (F.col("_cost") >= 0) & (F.col("_cost") < F.expr("shiftleft(1L, length(bin(_left)) - 1)"))
    fits = F.coalesce("_fits", F.when(F.col("_left") > 0, small).otherwise(F.col("_cost") == 0))
    within = Window.partitionBy("_node").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.lit(budget) - F.col("_left") + F.sum(F.when(fits, F.col("_cost")).otherwise(0)).over(within)
    spent = F.lit(float(prior)) + spent / F.lit(10.0**places)
    return held.select(*plan.columns, fits.alias("admitted"), spent.alias("spent"))
