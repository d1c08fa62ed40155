"""The brief corpus as a table: its constraints and its hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check
from poolstat.functions.keys import short_hash

# Strata with their counts, ways a brief came to be, and the ids of the first registration.
STRATA = {"business": 12, "product": 12, "scientific": 12, "aut": 12}
PROVENANCE = ["authored", "sampled", "verbatim"]
FIRST_IDS = [f"{stem}-{n:02d}" for stem in ("biz", "prod", "sci", "aut") for n in range(1, 7)]


def content_hashes(briefs: DataFrame) -> DataFrame:
    """id, content_hash of each brief's text; an empty text is refused."""
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return briefs.select("id", F.when(empty, F.raise_error(F.lit("a brief without text")).cast("string")).otherwise(short_hash(F.col("text"))).alias("content_hash"))


def corpus_hash(briefs: DataFrame, *by: str) -> DataFrame:
    """Hash of the list of (id, content hash) in order of id."""
    rows = content_hashes(briefs) if not by else content_hashes(briefs).join(briefs.select("id", *by), "id")
    item = F.concat(F.lit('{"id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"contentHash":"'), "content_hash", F.lit('"}'))
    listed = F.array_sort(F.collect_list(F.struct("id", item.alias("j"))))
    return rows.groupBy(*by).agg(short_hash(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]"))).alias("hash"))


def first_corpus_hash(briefs: DataFrame, ids: list[str] = FIRST_IDS) -> DataFrame:
    """The hash over the first registration's briefs, all of which must be there."""
    own = briefs.where(F.col("id").isin(ids))
    n = own.count()
    check(n == len(ids), f"{n} of {len(ids)} briefs of the first registration")
    return corpus_hash(own)


def validated(briefs: DataFrame, strata: dict[str, int] = STRATA) -> DataFrame:
    """briefs(id, text, stratum, provenance, selection, source) unless a constraint is broken: ids, counts, kinds, texts, provenance."""
    n = briefs.groupBy("stratum").count().collect()
    check({r["stratum"]: r["count"] for r in n} == strata, f"strata {dict((r['stratum'], r['count']) for r in n)}, expected {strata}")
    twice = briefs.groupBy("id").count().where("count > 1 or id is null or id = ''")
    check(twice.isEmpty(), f"missing or repeated ids: {[r['id'] for r in twice.limit(5).collect()]}")
    bad = briefs.where(
        (F.trim(F.coalesce("text", F.lit(""))) == "") | ~F.coalesce(F.col("provenance").isin(PROVENANCE), F.lit(False))
        | ((F.col("provenance") == "sampled") & F.col("selection").isNull()) | ((F.col("provenance") == "verbatim") & F.col("source").isNull())
    )
    check(bad.isEmpty(), f"briefs without text, or with unknown or undocumented provenance: {[r['id'] for r in bad.limit(5).collect()]}")
    return briefs
