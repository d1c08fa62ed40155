"""Keys, hashes and the seeded generator as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
CELL = r"^arm=(.+)\|brief=(.+)\|rep=(\d+)\|cfg=(.+)$"
STRICT_CELL = r"^arm=([^|]+)\|brief=([^|]+)\|rep=(\d+)\|cfg=([^|]+)$"


def _multiply(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit values, in 64-bit arithmetic that cannot overflow."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftleft((F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(U32))


def mulberry32_at(seed: Column, index: Column) -> Column:
    """Draw `index` (from 0) in [0, 1) of the mulberry32 stream of `seed`, by its counter form."""
    a = (seed.cast("long") + _multiply((index.cast("long") + 1).bitwiseAND(F.lit(U32)), F.lit(0x6D2B79F5))).bitwiseAND(F.lit(U32))
    t = _multiply(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _multiply(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(U32)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296.0


def mulberry32(state: Column) -> Column:
    """First draw in [0, 1) of the mulberry32 generator at a 32-bit seed."""
    return mulberry32_at(state, F.lit(0))


def _units(text: Column) -> Column:
    """UTF-16 units of a text, as integers."""
    hex_ = F.hex(F.encode(text, "UTF-16BE"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(hex_), F.lit(1)), F.lit(4)), lambda i: F.conv(hex_.substr(i, F.lit(4)), 16, 10).cast("long"))


def fnv1a(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a over UTF-16 units."""
    step = lambda h, u: _multiply(h.bitwiseXOR(u), F.lit(0x01000193))
    return F.when(text == "", F.lit(0x811C9DC5).cast("long")).otherwise(F.aggregate(_units(text), F.lit(0x811C9DC5).cast("long"), step))


def poly31(text: Column) -> Column:
    """Signed 32-bit polynomial hash with base 31 over UTF-16 units."""
    h = F.aggregate(_units(text), F.lit(0).cast("long"), lambda h, u: (h * 31 + u).bitwiseAND(F.lit(U32)))
    h = F.when(text == "", F.lit(0).cast("long")).otherwise(h)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def leg_seed(seed: Column, pool: Column, provider: Column) -> Column:
    """A judging leg's own seed: the run's, crossed with the hash of pool and provider; unsigned."""
    return seed.cast("long").bitwiseXOR(poly31(F.concat_ws("|", pool, provider))).bitwiseAND(F.lit(U32))


def cell_key(arm: Column, brief: Column, replicate: Column, cfg: Column) -> Column:
    """arm=..|brief=..|rep=..|cfg=..; a missing part or a negative replicate raises."""
    bad = (F.coalesce(arm, F.lit("")) == "") | (F.coalesce(brief, F.lit("")) == "") | (F.coalesce(cfg, F.lit("")) == "") | (F.coalesce(replicate, F.lit(-1)) < 0)
    text = F.concat(F.lit("arm="), arm, F.lit("|brief="), brief, F.lit("|rep="), replicate.cast("long").cast("string"), F.lit("|cfg="), cfg)
    return F.when(bad, F.raise_error(F.lit("a cell key needs arm, brief, a replicate from 0 and cfg")).cast("string")).otherwise(text)


def parse_cell_key(key: Column, strict: bool = False) -> Column:
    """struct(arm, brief, replicate, cfg) or null; strict parts hold no bar."""
    pattern = STRICT_CELL if strict else CELL
    part = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(key.rlike(pattern), F.struct(part(1).alias("arm"), part(2).alias("brief"), part(3).cast("long").alias("replicate"), part(4).alias("cfg")))


def is_study_cell_key(key: Column, cfg: Column) -> Column:
    """Whether a key is a study cell of this configuration."""
    return F.coalesce(parse_cell_key(key)["cfg"] == cfg, F.lit(False))


def attempt_key(family: Column, cell: Column, number: Column, compacted: Column | None = None) -> Column:
    plain = F.concat(family, F.lit("|cell="), cell, F.lit("|attempt="), number.cast("string"))
    if compacted is None:
        return plain
    return F.when(compacted, F.concat(family, F.lit("-compacted|cell="), cell, F.lit("|through="), number.cast("string"))).otherwise(plain)


def parse_attempt_key(key: Column, families: list[str]) -> Column:
    """struct(family, cell, through, compacted) or null; the cell reaches to the last delimiter."""
    pattern = r"^(" + "|".join(families) + r")(-compacted)?\|cell=(.*)\|(attempt|through)=(\d+)$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    fits = key.rlike(pattern) & ((part(2) != "") == (part(4) == "through"))
    return F.when(fits, F.struct(part(1).alias("family"), part(3).alias("cell"), part(5).cast("long").alias("through"), (part(2) != "").alias("compacted")))


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def body_file(key: Column) -> Column:
    """Content address of a record's body."""
    return F.concat(short_hash(key, 16), F.lit(".json"))


def validation_key(judge: Column, slice_id: Column, request: Column | None = None) -> Column:
    middle = F.lit("") if request is None else F.when(request.isNull(), "").otherwise(F.concat(F.lit("|req="), request))
    return F.concat(F.lit("judge-validation|judge="), judge, middle, F.lit("|slice="), slice_id)


def judge_scores_key(pool: Column, judge: Column) -> Column:
    return F.concat(F.lit("judge-scores|pool="), pool, F.lit("|judge="), judge)


def phase0_key(prefix: Column, run: Column) -> Column:
    return F.concat(prefix, F.lit("@"), run)
