"""Parquet tables, the analysis views that stand in for stores and ledgers, and tables written between steps."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag as arm", "l_suppkey % 12 as brief", "l_linenumber as replicate", "l_quantity as response", "l_extendedprice / 1000 as cost"
    )


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a single machine, and a refusal on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="poolstat-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _step(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"


def _left(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    if jvm := getattr(spark, "_jvm", None):  # goes with the session; a Connect session leaves it to the folder's owner
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, so that what is numbered or drawn stays as it is when a task is repeated."""
    path = _step(df.sparkSession)
    df.write.parquet(path)
    return _left(df.sparkSession, path, df.schema)


def written_in_turn(spark: SparkSession, frames: Iterable[DataFrame]) -> DataFrame:
    """`written` of frames of one schema, one after the other into one table; what a frame shuffled is not kept while the next runs."""
    path, kept = _step(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(kept, "false")
    spark.conf.set(kept, "true")
    try:
        for df in frames:
            df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(kept, before)
    return _left(spark, path, df.schema)
