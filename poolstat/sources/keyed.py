"""Bodies of records by key: Parquet in buckets of the key's hash, one folder a put, and a log of the puts that count.

A point read looks at one bucket, and a put compares with the buckets of its own keys only; both are partition filters. A
put's folder counts from the moment its line is in the log, so a put that fails before leaves the store as it was, and
what it left behind is never read. `compact` joins the puts of a store into one by the same step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolstat.errors import PoolstatError, check

from .store import put_plan

SCHEMA = "key string, state string, body string, bucket int"


class Keyed:
    """A store at a path that all tasks share; `buckets` is fixed when the store is first written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def log(self) -> list[dict]:
        """Lines of the log; as many as puts since the store was last compacted, and one."""
        try:
            lines = [r["value"] for r in self.spark.read.text(f"{self.path}/log").collect()]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return [json.loads(x) for x in lines]

    def puts(self) -> list[str]:
        lines = self.log()
        gone = {p for x in lines for p in x["replaces"]}
        check(all(x["buckets"] == self.buckets for x in lines), f"the store has other buckets than {self.buckets}")
        return sorted(x["put"] for x in lines if x["put"] not in gone)

    def read(self) -> DataFrame:
        """key, state, body, bucket of all that counts."""
        folders = [f"{self.path}/bodies/put={p}" for p in self.puts()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/bodies").parquet(*folders).select(*[c.split()[0] for c in SCHEMA.split(", ")])

    def get(self, key: str) -> DataFrame:
        """The record of a key, from its bucket; a key that is not stored is refused."""
        row = self.read().where((F.col("bucket") == self.bucket(F.lit(key))) & (F.col("key") == key)).drop("bucket")
        check(not row.isEmpty(), f"no stored record for {key!r}")
        return row

    def of(self, keys: DataFrame) -> DataFrame:
        """Stored records of keys(key), from their buckets."""
        mine = [r[0] for r in keys.select(self.bucket(F.col("key"))).distinct().collect()]  # as many as buckets at most
        return self.read().where(F.col("bucket").isin(mine)).join(keys.select("key").distinct(), "key", "left_semi").drop("bucket")

    def commit(self, put: str, replaces: list[str]) -> None:
        line = json.dumps({"put": put, "replaces": replaces, "buckets": self.buckets})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/log")

    def write(self, rows: DataFrame, replaces: list[str]) -> None:
        put = uuid.uuid4().hex
        own = rows.select("key", "state", "body").withColumn("bucket", self.bucket(F.col("key")))
        own.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/bodies/put={put}")
        self.commit(put, replaces)

    def put(self, records: DataFrame) -> DataFrame:
        """Add the records(key, state, body) that are new; key and outcome of each. Other content under a stored key is refused, and nothing is written."""
        plan = put_plan(self.of(records).select("key", "body"), records)
        fresh = plan.where("outcome = 'written'")
        told = self.spark.createDataFrame([], "key string, outcome string").union(plan.select("key", "outcome"))
        if not fresh.isEmpty():
            self.write(fresh, [])
        return told

    def compact(self) -> None:
        """Join all puts into one folder."""
        puts = self.puts()
        if len(puts) < 2:
            raise PoolstatError("nothing to compact: fewer than two puts")
        self.write(self.read(), puts)
