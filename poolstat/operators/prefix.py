"""Running sums of groups of any size: sorted by range, summed by range, shifted by what the ranges before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.sources.tables import written

#: rows of sums by range that are broadcast; rows of a table whose groups are windows as they are
MAX_BROADCAST, SPLIT_ROWS = 100_000, 2_000_000


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], following: dict[str, str] | None = None) -> DataFrame:
    """rows with the sum of each of `sums` up to a row (itself included) in the order of its group, as `name`, and over the
    whole group, as `name`_all; and with the next row's value of each of `following` (new name -> column), null at the end.

    A window sorts one range of a group, not the group; ranges are summed once, and a row a range and group goes through
    the window that shifts them.
    """
    following = following or {}
    at = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({f"__x_{n}": c for n, c in sums.items()}).withColumn("__at", F.monotonically_increasing_id())
    at = written(at).withColumn("__range", F.shiftright("__at", 33))
    per = at.groupBy(*by, "__range").agg(F.count("*").alias("__rows"), *[F.sum(f"__x_{n}").alias(n) for n in sums], *[F.min_by(c, "__at").alias(n) for n, c in following.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order_, before = group.orderBy("__range"), group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__b_{n}") for n in sums] + [F.sum(n).over(group).alias(f"{n}_all") for n in sums] + [F.lead(n).over(order_).alias(f"__n_{n}") for n in following]
    shifts = written(per.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__range").alias("__of"), *shift))
    few = shifts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    match = F.col("__range") == F.col("__of")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = at.join(F.broadcast(shifts) if few else shifts, match)
    own = Window.partitionBy(*by, "__range").orderBy("__at")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    last = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(F.desc("__at"))) == 1 if following else None
    cols = [(F.col(f"__b_{n}") + F.sum(f"__x_{n}").over(upto)).alias(n) for n in sums] + [f"{n}_all" for n in sums]
    cols += [F.when(last, F.col(f"__n_{n}")).otherwise(F.lead(c).over(own)).alias(n) for n, c in following.items()]
    return out.select(*rows.columns, *cols)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, size: str | None = None) -> DataFrame:
    """rows with their place from 1 in their group's order, and the group's size: by windows in a table of up to SPLIT_ROWS rows, by ranges beyond."""
    if rows.limit(SPLIT_ROWS + 1).count() > SPLIT_ROWS:
        out = running(rows, by, order, {name: F.lit(1)})
        return out.withColumnRenamed(f"{name}_all", size) if size else out.drop(f"{name}_all")
    group = Window.partitionBy(*by)
    out = rows.withColumn(name, F.row_number().over(group.orderBy(*order)))
    return out.withColumn(size, F.count("*").over(group)) if size else out
