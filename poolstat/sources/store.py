"""The append-only results store as tables: an index log, JSON bodies, guarded writes; and the text sources beside it.

Layout of a store: `index.jsonl`, one line for each record (last line of a key wins), and `bodies/<address>.json`, one
canonical JSON document for each record, its address a hash of the key. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.errors import ConflictingRecord, PoolstatError, check
from poolstat.functions.documents import canonical_json
from poolstat.functions.keys import body_file
from poolstat.functions.text import normalize_id, normalize_title, strip_mapping_extension, title_line
from poolstat.sources.tables import written

INDEX = "key string, bodyFile string, state string, armId string, briefId string, replicate bigint, cfg string, storedAt string"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The latest line of each key; cfg stays text, whatever it holds."""
    lines = spark.read.text(f"{path}/index.jsonl").where(F.trim("value") != "")
    at = F.monotonically_increasing_id()
    return latest_lines(lines.select(F.from_json("value", INDEX).alias("r"), at.alias("_at")).select("r.*", "_at"), "_at").drop("_at")


def latest_lines(log: DataFrame, position: str) -> DataFrame:
    """The last line of each key, by aggregation: no sort, and partial on each side of the shuffle."""
    own = F.struct(*[c for c in log.columns])
    return log.groupBy("key").agg(F.max_by(own, F.col(position)).alias("_r")).select("_r.*")


def read_bodies(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Each body's JSON text, with its key; with a schema of `result` also that struct."""
    texts = spark.read.text(f"{path}/bodies/*.json", wholetext=True).select(F.col("value").alias("body"))
    out = texts.withColumn("key", F.get_json_object("body", "$.key"))
    return out.withColumn("result", F.from_json(F.get_json_object("body", "$.result"), schema)) if schema else out


def with_bodies(index: DataFrame, bodies: DataFrame) -> DataFrame:
    return index.join(bodies, "key", "left")


def get(index: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """One record; a key that is not stored is refused."""
    row = index.where(F.col("key") == key)
    check(not row.isEmpty(), f"no stored record for {key!r}")
    return with_bodies(row, bodies)


def has(index: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(index.select("key", F.lit(True).alias("stored")), "key", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def validated(records: DataFrame) -> DataFrame:
    """records(key, state, body, ...): a record without key, state or body, or with an amount in its ledger, is refused."""
    amount = F.col("body").rlike(r'"(cost_usd|notional_usd)"\s*:')
    bad = (F.coalesce(F.col("key"), F.lit("")) == "") | F.col("state").isNull() | F.col("body").isNull() | amount
    why = F.concat(F.lit("incomplete record, or one with amounts: "), F.coalesce("key", F.lit("null")))
    return records.withColumn("key", F.when(bad, F.raise_error(why).cast("string")).otherwise(F.col("key")))


def put_plan(stored: DataFrame, records: DataFrame) -> DataFrame:
    """What a put would do to each record: `written`, or `unchanged` where the same content is stored; other content is refused.

    stored(key, body), records(key, state, body, ...), bodies as JSON text, compared in canonical form.
    """
    new = written(validated(records).withColumn("body", canonical_json("body")))  # what comes in is made once, not for each check
    twice = new.groupBy("key").agg(F.count_distinct("body").alias("n")).where("n > 1")
    check(twice.isEmpty(), f"several contents for keys {[r['key'] for r in twice.limit(5).collect()]}", ConflictingRecord)
    old = stored.select("key", canonical_json("body").alias("_old"))
    plan = written(new.dropDuplicates(["key"]).join(old, "key", "left"))
    lost = plan.where(F.col("_old").isNotNull() & (F.col("_old") != F.col("body")))
    check(lost.isEmpty(), f"stored with other content: {[r['key'] for r in lost.limit(5).collect()]}", ConflictingRecord)
    return plan.withColumn("outcome", F.when(F.col("_old").isNull(), "written").otherwise("unchanged")).drop("_old")


def put(spark: SparkSession, path: str, stored: DataFrame, records: DataFrame) -> DataFrame:
    """Append the records that are new to a store kept as Parquet, by configuration; returns the plan."""
    plan = put_plan(stored, records)
    fresh = plan.where("outcome = 'written'").drop("outcome").withColumn("bodyFile", body_file(F.col("key")))
    fresh.write.mode("append").partitionBy(*(["cfg"] if "cfg" in fresh.columns else [])).parquet(path)
    return plan


def remove(index: DataFrame, keys: DataFrame, allow_completed: bool = False) -> DataFrame:
    """The index without `keys`; unknown keys, and completed ones unless allowed, are refused."""
    keys = keys.select("key").distinct()
    unknown = keys.join(index, "key", "left_anti")
    check(unknown.isEmpty(), f"not stored: {[r['key'] for r in unknown.limit(5).collect()]}")
    done = index.join(keys, "key", "left_semi").where("state = 'completed'")
    check(allow_completed or done.isEmpty(), f"completed records: {[r['key'] for r in done.limit(5).collect()]}")
    return index.join(keys, "key", "left_anti")


def is_store(spark: SparkSession, path: str) -> bool:
    """Whether a folder is a store: it has an index log that reads as one."""
    try:
        spark.read.text(f"{path}/index.jsonl").limit(1).collect()
        return True
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def resolve_store(spark: SparkSession, path: str) -> str:
    check(is_store(spark, path), f"{path} is not a store", PoolstatError)
    return path.rstrip("/")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A flat CSV with a header, every field as text, no quoting."""
    return spark.read.csv(path, header=True, quote="").na.fill("")


def read_quoted(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV with quoted fields; a doubled quote is a quote, fields may span lines."""
    return spark.read.csv(path, header=header, quote='"', escape='"', multiLine=True)


def id_titles(rows: DataFrame, position: str) -> DataFrame:
    """rows(id, title, position) of a mapping: a header row, short rows and blank ids are skipped, the last title of an id wins."""
    i, t = F.trim("id"), F.trim("title")
    own = rows.where(F.col("title").isNotNull() & (F.coalesce(i, F.lit("")) != "") & ~((F.lower(i) == "id") & (F.lower(t) == "title")))
    return own.groupBy(i.alias("id")).agg(F.max_by(t, position).alias("title"))


def reviews(spark: SparkSession, path: str, score: str) -> DataFrame:
    """A columnar JSON document (parallel arrays) as one row a review: idea_id, condition, topic, score."""
    raw = spark.read.json(path, multiLine=True)
    zipped = F.explode(F.arrays_zip("idea_id", *[c for c in ("condition", "topic") if c in raw.columns], score)).alias("r")
    check("idea_id" in raw.columns and score in raw.columns, f"no idea_id or {score} array in {path}")
    some = lambda c: F.col(f"r.{c}") if c in raw.columns else F.lit(None).cast("string")
    return raw.select(zipped).select(normalize_id(F.col("r.idea_id")).alias("idea_id"), some("condition").alias("condition"), some("topic").alias("topic"), F.col(f"r.{score}").cast("double").alias("score"))


def ideas_of(rows: DataFrame) -> DataFrame:
    """Reviews by idea: scores in order, one condition and one topic each; a conflict or a score that is no number is refused."""
    bad = rows.where(F.col("score").isNull() | F.isnan("score"))
    check(bad.isEmpty(), f"reviews without a score: {[r['idea_id'] for r in bad.limit(5).collect()]}")
    out = rows.groupBy("idea_id").agg(
        F.count_distinct("condition").alias("_c"), F.count_distinct("topic").alias("_t"), F.first("condition", True).alias("condition"),
        F.first("topic", True).alias("topic"), F.sort_array(F.collect_list("score")).alias("scores"), F.avg("score").alias("mean_score"), F.count("*").alias("n"),
    )
    lost = out.where("_c > 1 or _t > 1")
    check(lost.isEmpty(), f"ideas under several conditions or topics: {[r['idea_id'] for r in lost.limit(5).collect()]}")
    return out.drop("_c", "_t")


def bind_titles(files: DataFrame, titles: DataFrame, ideas: DataFrame, excluded: list[str] = (), by_hand: DataFrame | None = None) -> DataFrame:
    """files(condition, filename, text), titles(id, title), ideas(idea_id, condition, ...) -> one idea for each file.

    A file is bound by hand, by its title line, or by its name, in that order, within its condition. Every file and every
    reviewed idea of the conditions kept must be bound, once.
    """
    ideas = ideas.where(~F.coalesce(F.col("condition").isin(list(excluded)), F.lit(False)))
    known = titles.join(ideas.select(F.col("idea_id").alias("id"), "condition"), "id").select("id", "condition", normalize_title(strip_mapping_extension(F.col("title"))).alias("norm"))
    clash = known.groupBy("condition", "norm").agg(F.count_distinct("id").alias("n")).where("n > 1")
    check(clash.isEmpty(), f"one title, several ideas: {[tuple(r)[:2] for r in clash.limit(5).collect()]}")
    own = files.where(~F.coalesce(F.col("condition").isin(list(excluded)), F.lit(False)))
    own = own.withColumn("_line", normalize_title(title_line(F.col("text")))).withColumn("_name", normalize_title(strip_mapping_extension(F.col("filename"))))
    first = known.select("condition", F.col("norm").alias("_line"), F.col("id").alias("_by_line"))
    second = known.select("condition", F.col("norm").alias("_name"), F.col("id").alias("_by_name"))
    hand = by_hand.select("filename", F.col("id").alias("_by_hand")) if by_hand is not None else own.select("filename").limit(0).withColumn("_by_hand", F.lit(None).cast("string"))
    bound = own.join(hand, "filename", "left").join(first, ["condition", "_line"], "left").join(second, ["condition", "_name"], "left")
    out = bound.select("condition", "filename", "text", F.coalesce("_by_hand", "_by_line", "_by_name").alias("idea_id"))
    loose = out.where("idea_id is null")
    check(loose.isEmpty(), f"files that no idea has: {[r['filename'] for r in loose.limit(5).collect()]}")
    twice = out.groupBy("idea_id").count().where("count > 1")
    check(twice.isEmpty(), f"ideas with several files: {[r['idea_id'] for r in twice.limit(5).collect()]}")
    left = unresolved(ideas, out)
    check(left.isEmpty(), f"reviewed ideas without a file: {[r['idea_id'] for r in left.limit(5).collect()]}")
    return out.join(ideas.drop("condition"), "idea_id")


def unresolved(ideas: DataFrame, bound: DataFrame) -> DataFrame:
    return ideas.select("idea_id").join(bound, "idea_id", "left_anti")


def fixture_vectors(texts: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Frozen vectors of texts; a text without one is refused."""
    lost = texts.join(fixtures, "text", "left_anti")
    check(lost.isEmpty(), f"texts without a vector: {[r['text'][:40] for r in lost.limit(5).collect()]}")
    return texts.join(fixtures, "text")


def sampled_keywords(words: DataFrame, count: int = 12, seed: int = 20260731) -> DataFrame:
    """A reproducible sample: distinct words in code order, drawn without replacement by the seeded generator."""
    from poolstat.operators.vectors import mulberry32_draws, splice_draw

    distinct = words.select("word").where("word is not null").distinct()
    ranked = distinct.withColumn("_i", F.row_number().over(Window.orderBy("word")) - 1)
    n = distinct.count()
    check(0 < count <= n, f"cannot draw {count} of {n} words")
    picked = splice_draw(n, mulberry32_draws(seed, 0, count))
    order = words.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(picked)], "_i int, position int")
    return ranked.join(F.broadcast(order), "_i").select("position", "word")
