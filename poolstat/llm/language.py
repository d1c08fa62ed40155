"""Language ID by compression: the language whose zstandard raw-content dictionary makes a text smallest.

Dictionaries come from a bounded sample: SAMPLE_DOCS documents of each language by hash, and of each a piece of
SAMPLE_CHARS characters (more where a language has fewer documents) at a hashed place anywhere in its text. Every text is classified whole.
Defined results: null texts and texts without a letter are `und`, score 0, rejected; with no learned
language everything is `und`; texts whose margin is under MARGIN are rejected but keep their best guess; of equally
small languages the first by name is taken; repeated rows are judged alike; an empty table gives no rows; columns
lang_pred, score and rejected of the input are replaced by `identify`, all columns are kept by `keep_known`.
"""

from __future__ import annotations

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS, PIECE, LEVEL, MARGIN = 96_000, 400, 240, 4096, 9, 0.004
LETTER = regex.compile(r"\p{L}")


def held_out(parts: int, which: int):
    """crc32(doc_id as text) mod parts; null doc_ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == which, F.lit(True))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """SAMPLE_DOCS training texts of each language, by hash order, up to DICT_BYTES together."""
    rows = docs.where(~held_out(5, 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # hash order in each language is a sample that reruns repeat; a first limit by hash keeps the windows small
    share = rows.groupBy("lang").count().withColumn("cut", F.lit(2.0 * SAMPLE_DOCS) / F.col("count"))
    chars = F.greatest(F.lit(SAMPLE_CHARS), F.ceil(DICT_BYTES / F.least(F.col("count"), F.lit(SAMPLE_DOCS)))).cast("int")
    hashed = rows.select("lang", "doc_id", F.xxhash64("doc_id", "lang").alias("h"), "text")
    sample = hashed.join(F.broadcast(share), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("cut"))
    place = 1 + F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.greatest(F.lit(1), F.length("text") - chars + 1))
    sample = sample.select("lang", "doc_id", "h", F.substring("text", place, chars).alias("t"))
    ranked = sample.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))).where(F.col("r") <= SAMPLE_DOCS)
    out: dict[str, bytes] = {}
    for r in ranked.select("lang", "t", "r").orderBy("lang", "r").collect():
        out[r.lang] = (out.get(r.lang, b"") + r.t.lower().encode("utf-8", "replace") + b"\n")[:DICT_BYTES]
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """Adds lang_pred, score and rejected to docs."""
    known = sorted((learn(docs) if dictionaries is None else dictionaries).items())

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(parts: pd.Series) -> pd.DataFrame:
        tools = []
        for _, raw in known:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        out = []
        for text in parts:
            if not text or not known or not LETTER.search(text):
                out.append(("und", 0.0, True))
                continue
            data = text.lower().encode("utf-8", "replace")
            pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            sizes = sorted((sum(len(t.compress(p)) for p in pieces), lang) for t, (lang, _) in zip(tools, known))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
            out.append((sizes[0][1], min(1.0, margin * 5), margin < MARGIN))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    rest = docs.drop("lang_pred", "score", "rejected")
    return rest.select(F.struct("*").alias("row"), guess("text").alias("g")).select("row.*", "g.*")


def op4(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text", "lang")
    return identify(own).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; the others keep all their columns."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return identify(whole, learn(docs)).where("not rejected").select("row.*")
