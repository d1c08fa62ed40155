"""Hash columns against the plain functions; ids of repeated requests, also by ranges."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from poolstat.functions import documents as D
from poolstat.operators import prefix
from poolstat.operators import requests as R


def test_hash_columns_equal_plain_functions(spark):
    rng = random.Random(1)
    values = [{"arms": {"A": {"label": "x", "_n": rng.random(), "slots": [{"purpose": "p", "m": rng.choice([1, 1.5, 1e21, "é\\n"])}]}}, "promptHash": "p", "engineSha": rng.choice(["a", "b"]), "z": 1} for _ in range(20)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5) for v in values] + ["[1]", "{bad", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.arms_hash(F.col("t")).alias("a"), R.config_hash(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r.a, r.c) for r in got] == [(D.arms_config_hash(v), D.config_hash(v)) for v in values] + [(None, None)] * 3
    judge = spark.createDataFrame([(["m2", "m1", "m2", 'q"\\\\'], "h")], "m array<string>, h string").select(R.judge_hash(F.col("m"), F.col("h"))).first()[0]
    assert judge == D.judge_hash({"a": ["m2", "m1"], "b": ["m2", 'q"\\\\']}, "h")
    shapes = [('{"t": 1, "maxTokens": 5}', None), ('{"t": 1}', 5), ('{"maxTokens": 5, "t": 1}', 5)]
    frame = lambda rows: spark.createDataFrame(rows, "t string, n int").select(R.judge_request_hash(F.col("t"), F.col("n")).alias("h")).collect()
    assert {r.h for r in frame(shapes)} == {D.judge_request_hash({"t": 1}, 5)}
    for bad in (('{"t": 1}', None), ('{"maxTokens": 4}', 5), ('{"maxTokens": 0}', None)):
        with pytest.raises(Exception, match="token bound"):
            frame([bad])


@pytest.mark.parametrize("ranges", [False, True])
def test_content_ids(spark, monkeypatch, ranges):
    """One request is most of the table; keys in any order are one request."""
    if ranges:
        monkeypatch.setattr(prefix, "SPLIT_ROWS", 10)
    rng = random.Random(2)
    rows = [(i, rng.choice(['{"a": 1, "b": 2}'] * 6 + ['{"b":2,"a":1}'] * 3 + ['{"a": %d}' % i])) for i in range(150)]
    got = {r.i: r.custom_id for r in R.content_ids(spark.createDataFrame(rows, "i int, request string").repartition(4), "request", ["i"]).collect()}
    assert got == dict(zip(range(150), D.content_ids([json.loads(t) for _, t in rows])))
    assert max(Counter(v.split("-")[0] for v in got.values()).values()) > 100
