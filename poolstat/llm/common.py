"""Shared helpers: tables, words, written stage tables, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, one of our own on a single machine, and a refusal on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="poolstat-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # stage tables go with the session
    return spark.read.schema(df.schema).parquet(path)


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def space_words(c: Column) -> Column:
    """Words `[^ \\t-\\r]+`; null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (id, component_id): smallest id reachable, for every id in a link.

    Every node takes the name of the least of its closed neighbourhood in a hash order, links are renamed and
    repeated names fall together, until no link is left: an expected number of rounds logarithmic in the longest path.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, names, turn = written(ends.where("a <> b").distinct()), None, 0
    every = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = edges.select("a", rank("b").alias("r")).union(edges.select("b", rank("a")))
        least = both.groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        step = written(least.select("id", F.least("r", rank("id"))["id"].alias("name")))
        a, b = step.select(F.col("id").alias("a"), F.col("name").alias("x")), step.select(F.col("id").alias("b"), F.col("name").alias("y"))
        renamed = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = written(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if names is None:
            names = step
        else:
            next_ = step.select(F.col("id").alias("name"), F.col("name").alias("_n"))
            names = names.join(next_, "name", "left").select("id", F.coalesce("_n", "name").alias("name"))
    if names is None:
        return every.select("id", F.col("id").alias("component_id"))
    names = written(names)
    smallest = names.groupBy("name").agg(F.min("id").alias("component_id"))
    return names.join(smallest, "name").select("id", "component_id")
