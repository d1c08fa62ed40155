"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

run(spark, sf_dir) applies STAGES to documents; each stage is written to the shared folder and read again, so a lost
executor repeats one stage at most. No stage but the last two could be SQL, so ORACLE_SQL is None; tests hold the
stages against plain Python. Nulls, repeats, ties, empty tables and clashing columns are as the operators define them:
rows without a doc_id pass language, dedup and mixing as documents of their own; a partly taken document is copied
whole; the last stage returns ids, sizes and shards.
"""

from . import decontaminate, language, minhash, mixing, sharding
from .common import table, written


def known_language(spark, docs, sf_dir):
    return language.keep_known(docs)


def near_dedup(spark, docs, sf_dir):
    return minhash.keep_one(docs)


def no_benchmark(spark, docs, sf_dir):
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    return mixing.apply_mix(docs)


def sharded(spark, docs, sf_dir):
    return sharding.shard(sharding.digest(docs))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
