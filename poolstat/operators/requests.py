"""Hashes of configurations and requests as columns, and ids that tell equal requests apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.functions import documents as D
from poolstat.functions.keys import short_hash

from .prefix import numbered


def arms_hash(config: Column) -> Column:
    """Hash of an arms configuration's JSON without what only documents it, at any depth; null where it is no object."""
    return short_hash(D.canonical_arms(config))


def config_hash(config: Column) -> Column:
    return short_hash(D.canonical_config(config))


def judge_hash(models: Column, prompt_hash: Column) -> Column:
    """Hash of a prompt and the distinct models (an array of texts) that judge with it, in order."""
    names = F.transform(F.array_sort(F.array_distinct(models)), lambda m: F.concat(F.lit('"'), F.replace(F.replace(m, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return short_hash(F.concat(F.lit('{"prompt":"'), prompt_hash, F.lit('","models":['), F.array_join(names, ","), F.lit("]}")))


def judge_request_hash(shape: Column, max_tokens: Column) -> Column:
    """Hash of a judge's request with its one token bound; a request without one, or with two that differ, raises."""
    text = D.canonical_judge_request(shape, max_tokens)
    return short_hash(F.when(text.isNull(), F.raise_error(F.lit("a request needs one positive token bound")).cast("string")).otherwise(text))


def content_ids(requests: DataFrame, request: str, order: list[str], out: str = "custom_id") -> DataFrame:
    """requests with an id each: the hash of the request's canonical JSON, and its place among equal ones by `order`.

    One request may be most of the table: places are numbered by ranges beyond a table that windows can hold.
    """
    rows = requests.withColumn("_digest", short_hash(D.canonical_json(F.col(request)), 40))
    rows = numbered(rows, ["_digest"], order, "_place")
    return rows.withColumn(out, F.concat(F.lit("r"), "_digest", F.lit("-"), (F.col("_place") - 1).cast("string"))).drop("_digest", "_place")
