"""Row checks and canonical forms of scores, ledger rows, templates, resume states and abandoned batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.functions.documents import canonical_json
from poolstat.functions.keys import short_hash
from poolstat.functions.text import AXES

from .prefix import numbered


def axes_collapsed(scores: Column) -> Column:
    """Why a judge's score (JSON text) does not keep its axes apart, or null: no object, an axis that is no number, or a
    composite `overallScore` beside equal axes."""
    read = F.from_json(scores, "struct<" + ",".join(f"{a}: double" for a in AXES) + ">")
    every = F.coalesce(F.json_object_keys(scores), F.array().cast("array<string>"))
    lost, same = F.lit(False), F.lit(True)
    for a in AXES:
        lost = lost | read[a].isNull()
        same = same & (read[a] == read[AXES[0]])
    out = F.when(F.json_object_keys(scores).isNull(), "no object").when(lost, "an axis is missing")
    return out.when(same & F.array_contains(every, "overallScore"), "a composite beside the axes")


def kept_apart(rows: DataFrame, scores: str) -> DataFrame:
    """The rows; one whose axes are collapsed raises."""
    why = axes_collapsed(F.col(scores))
    return rows.withColumn(scores, F.when(why.isNotNull(), F.raise_error(F.concat(why, F.lit(": "), F.coalesce(scores, F.lit("null")))).cast("string")).otherwise(F.col(scores)))


def canonical_order(rows: DataFrame, by: list[str], row: str, out: str = "position") -> DataFrame:
    """Place from 0 of each row among its group's by JSON text (`row`), in order of UTF-16 units; equal rows in any order."""
    ordered = numbered(rows.withColumn("_u", F.hex(F.encode(F.coalesce(row, F.lit("")), "UTF-16BE"))), by, ["_u"], "_place")
    return ordered.withColumn(out, F.col("_place") - 1).drop("_u", "_place")


def templates_hash(rows: DataFrame, by: str, name: str, text: str) -> DataFrame:
    """by, hash: of the texts that a template renders to, each under the name of its probe; a set has as many as probes."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(text).alias("t"))))
    return rows.groupBy(by).agg(F.map_from_entries(listed).alias("_m")).select(by, short_hash(canonical_json(F.to_json("_m"))).alias("hash"))


def resume_state(resume: Column) -> Column:
    """struct(replies, outstanding) of a resume record's JSON; what is absent or of another kind is empty."""
    read = F.from_json(resume, "replies map<string,string>, outstanding array<string>")
    return F.struct(
        F.coalesce(read["replies"], F.create_map().cast("map<string,string>")).alias("replies"),
        F.coalesce(read["outstanding"], F.array().cast("array<string>")).alias("outstanding"),
    )


def abandon_prefix(provider: Column, abandoned: Column) -> Column:
    """What leads the detail of a failure that gave up on batches (an array of structs in the order of the fields told); empty without any."""
    told = F.concat(provider, F.lit(": POLL_CEILING_REACHED -- gave up waiting; the API did NOT fail. abandoned_batches="), F.to_json(abandoned), F.lit(" -- "))
    return F.when(F.coalesce(F.size(abandoned), F.lit(0)) > 0, told).otherwise("")
