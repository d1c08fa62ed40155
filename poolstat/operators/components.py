"""Connected components by alternating stars, over links of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.sources.tables import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> id, component (the smallest id reachable), for every id in a link.

    Each round hangs a node's larger neighbours on its least one, then its smaller ones, until every link leads to a
    component's least id; a round only pre-aggregates by node and joins the least neighbour back, so a hub is never
    gathered. Rounds are written tables; their number grows with the square of the logarithm of the links at most.
    """
    every = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while (state := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != last:
        last = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # every link of `large` leads from the larger to the smaller
        small = large.join(least, "a").select("a", "b", "m")
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = written(hung.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return every.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
