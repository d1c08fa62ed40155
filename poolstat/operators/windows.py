"""Ranks, multiplicity corrections and retention.

Windows over few keys would sort a table in few tasks. Groups over SPLIT_ROWS are therefore cut into value ranges
(`with_ranges`): each range is ranked apart and shifted by what the ranges before it hold, so a group is spread over
RANGES tasks; equal values always share a range. Smaller groups are one range.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.errors import check

SPLIT_ROWS, RANGES = 2_000_000, 64


def large_groups(rows: DataFrame, by: list[str]) -> list:
    """Keys of groups over SPLIT_ROWS rows: at most rows / SPLIT_ROWS of them. A table under that has none, and is only counted."""
    if rows.limit(SPLIT_ROWS + 1).count() <= SPLIT_ROWS:
        return []
    return rows.groupBy(*by).count().where(F.col("count") > SPLIT_ROWS).drop("count").collect()


def with_ranges(rows: DataFrame, by: list[str], value: str, large: list) -> DataFrame:
    """rows with `_q`, the number of their value's range within a large group (0 in others)."""
    if by:
        keys = rows.sparkSession.createDataFrame(large, rows.select(*by).schema)
        own = rows.join(F.broadcast(keys), by, "left_semi")
    else:
        own = rows
    cuts = own.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    fixed = rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # RANGES numbers for each large group
    joined = rows.join(F.broadcast(fixed), by, "left") if by else rows.crossJoin(F.broadcast(fixed))
    return joined.withColumn("_q", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value).cast("double"))), F.lit(0))).drop("_cuts")


def _shifted(rows: DataFrame, by: list[str], what: Column, combine, backward: bool = False) -> DataFrame:
    """rows joined with `_before`: `what` combined over the ranges before their own (after it, if backward)."""
    per = rows.groupBy(*by, "_q").agg(what.alias("_own"))
    order = Window.partitionBy(*by).orderBy(F.desc("_q") if backward else "_q").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(per.withColumn("_before", combine("_own").over(order)).drop("_own"), [*by, "_q"])


def _p_values(p: DataFrame, by: list[str], value: str, family_size: int | None) -> DataFrame:
    """Rows with a p-value in [0, 1]; null ones do not count, others out of range raise."""
    v = F.col(value)
    bad = F.isnan(v.cast("double")) | (v < 0) | (v > 1)
    own = p.where(v.isNotNull()).withColumn(value, F.when(bad, F.raise_error(F.lit("a p-value lies in [0, 1]")).cast("double")).otherwise(v))
    if family_size is not None:
        other = own.groupBy(*by).count().where(F.col("count") != family_size)
        check(other.isEmpty(), f"not {family_size} p-values in {[tuple(r) for r in other.limit(5).collect()]}")
    return own


def _numbered(p: DataFrame, by: list[str], value: str, tie: str) -> tuple[DataFrame, list]:
    """rows with `_r`, the place of a row in its group, and `_m`, the group's size; and the large groups, if any."""
    large = large_groups(p, by)
    if not large:
        w = Window.partitionBy(*by)
        return p.withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_m", F.count("*").over(w)), large
    own = with_ranges(p, by, value, large)
    own = _shifted(own, by, F.count("*"), F.sum).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_q").orderBy(value, tie)) + F.coalesce("_before", F.lit(0)))
    return own.drop("_before").join(p.groupBy(*by).agg(F.count("*").alias("_m")), by), large


def _running(raw: DataFrame, large: list, by: list[str], order: list[str], name: str, backward: bool) -> DataFrame:
    """`name`: the running maximum of `_a` in the order that numbered the rows, or the minimum from the end."""
    f, way = (F.min, F.desc) if backward else (F.max, F.asc)
    keys = [*by, "_q"] if large else by
    # from the end by a sort of its own: a frame that runs on to the end is added up anew for every row
    out = raw.withColumn("_x", f("_a").over(Window.partitionBy(*keys).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0)))
    if not large:
        return out.withColumnRenamed("_x", name).drop("_r", "_m", "_a")
    out = _shifted(out, by, f("_a"), f, backward)
    pick = F.least if backward else F.greatest
    return out.withColumn(name, pick("_x", F.coalesce("_before", "_x"))).drop("_r", "_m", "_a", "_x", "_q", "_before")


def holm(p: DataFrame, by: str, value: str, tie: str, family_size: int | None = None) -> DataFrame:
    """Step-down adjustment: running maximum of (m - rank + 1) p, at most 1; null p-values do not count and get no row."""
    raw, large = _numbered(_p_values(p, [by], value, family_size), [by], value, tie)
    return _running(raw.withColumn("_a", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(value))), large, [by], [value, tie], "holm", False)


def benjamini_hochberg(p: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """Step-up adjustment: running minimum from the end of m p / rank, at most 1."""
    raw, large = _numbered(_p_values(p, [by], value, None), [by], value, tie)
    return _running(raw.withColumn("_a", F.least(F.lit(1.0), F.col(value) * F.col("_m") / F.col("_r"))), large, [by], [value, tie], "bh", True)


def rank_with_ties(rows: DataFrame, by: str, value: str, out: str = "rank_avg", large: list | None = None) -> DataFrame:
    """Average rank of peers; null values rank as null. Large groups (counted if not given) are ranked by way of their distinct values."""
    keys, known = [by], F.col(value).isNotNull()
    large = large_groups(rows, keys) if large is None else large
    if not large:
        order = Window.partitionBy(by).orderBy(F.asc_nulls_last(value))  # first and last place of the peers, by one sort
        return rows.withColumn(out, F.when(known, (F.rank().over(order) + F.count(value).over(order)) / 2))
    ranged = with_ranges(rows.where(known).groupBy(by, value).agg(F.count("*").alias("_c")), keys, value, large)
    upto = F.sum("_c").over(Window.partitionBy(by, "_q").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = _shifted(ranged.withColumn("_u", upto), keys, F.sum("_c"), F.sum)
    ranks = ranks.select(by, value, (F.coalesce("_before", F.lit(0)) + F.col("_u") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out))
    return rows.join(ranks, [by, value], "left").select(*rows.columns, out)


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks; a group with all values of a side tied raises, and is named."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    large = large_groups(pairs, [by])
    ranked = rank_with_ties(rank_with_ties(pairs, by, a, "_ra", large), by, b, "_rb", large)
    flat = F.raise_error(F.concat(F.lit("ranks without variance in group "), F.col(by).cast("string"))).cast("double")
    out = ranked.groupBy(by).agg(F.max("_ra").alias("_a"), F.min("_ra").alias("_b"), F.max("_rb").alias("_c"), F.min("_rb").alias("_d"), F.try_divide(F.covar_pop("_ra", "_rb"), F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))).alias("_r"))
    return out.select(by, F.when((F.col("_a") == F.col("_b")) | (F.col("_c") == F.col("_d")), flat).otherwise(F.col("_r")).alias("rho"))


def order_by_score(rows: DataFrame, by: str, score: str, index: str) -> DataFrame:
    """Stable ascending order: position from 0 by score, then index."""
    out, _ = _numbered(rows, [by], score, index)
    return out.withColumn("position", F.col("_r") - 1).drop("_r", "_m", "_q")


def latest_state(log: DataFrame, key: str, position: str) -> DataFrame:
    """The last line of each key of an append-only log, by aggregation."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), position).alias("_r")).select("_r.*")


def retain(rows: DataFrame, keys: list[str], order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
