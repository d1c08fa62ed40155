"""Thresholds on distances: balanced accuracy, the widest optimal plateau, clean gaps; and distances themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check

from .prefix import running

# The registered distance threshold and its sensitivity band, and the largest diversity of a pool of copies.
REGISTERED_THRESHOLD = 0.23141118234233987
BAND, DUPLICATE_DIVERSITY = 0.05, 0.05


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in [0, 2], of arrays of double; other lengths or a zero vector raise."""
    na, nb = norm(a), norm(b)
    bad = (F.size(a) != F.size(b)) | (na == 0) | (nb == 0)
    return F.when(bad, F.raise_error(F.lit("cosine distance needs two vectors of one length, neither zero")).cast("double")).otherwise(1 - _dot(a, b) / (na * nb))


def l2_normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>")).otherwise(F.transform(v, lambda x: x / n))


def pair_distances(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """pairs(a, b, label) -> with `distance`: each text's vector is looked up once for each side."""
    v = F.col(vector).cast("array<double>")
    left, right = vectors.select(F.col(key).alias("a"), v.alias("_va")), vectors.select(F.col(key).alias("b"), v.alias("_vb"))
    return pairs.join(left, "a").join(right, "b").withColumn("distance", cosine_distance(F.col("_va"), F.col("_vb"))).drop("_va", "_vb")


def accuracy_at(pairs: DataFrame, distance: str, label: str, threshold: float, *by: str) -> DataFrame:
    """Confusion counts and balanced accuracy of `distance < threshold` as a sign of label `same`."""
    near, same = F.col(distance) < threshold, F.col(label) == "same"
    out = pairs.groupBy(*by).agg(F.count_if(same & near).alias("tp"), F.count_if(same & ~near).alias("fn"), F.count_if(~same & ~near).alias("tn"), F.count_if(~same & near).alias("fp"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    out = out.withColumn("sensitivity", rate("tp", "fn")).withColumn("specificity", rate("tn", "fp"))
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def select_threshold(pairs: DataFrame, distance: str, label: str, *by: str) -> DataFrame:
    """The middle of the widest run of best thresholds (the first on ties), of midpoints between distinct distances.

    Distances are first reduced to distinct values with counts; running counts give each midpoint's accuracy, and running
    numbers the islands of best ones. Both go by ranges of values, so a group of any size is spread over tasks.
    """
    per = pairs.groupBy(*by, F.col(distance).alias("_d")).agg(F.count_if(F.col(label) == "same").alias("_s"), F.count_if(F.col(label) != "same").alias("_o"))
    keys = list(by)
    run = running(per, keys, ["_d"], {"_tp": F.col("_s"), "_fp": F.col("_o"), "_i": F.lit(1)}, {"_next": "_d"})
    ba = (F.col("_tp") / F.nullif("_tp_all", F.lit(0)) + (F.col("_fp_all") - F.col("_fp")) / F.nullif("_fp_all", F.lit(0))) / 2
    run = run.select(*keys, ((F.col("_d") + F.col("_next")) / 2).alias("_t"), ba.alias("_ba"), "_i").where("_t is not null")
    most = run.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)]).agg(F.max("_ba").alias("_best"))
    of = F.lit(True)
    for i, c in enumerate(keys):
        of = of & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    best = run.join(most, of) if keys else run.crossJoin(F.broadcast(most))  # one row
    best = running(best.where(F.abs(F.col("_ba") - F.col("_best")) < 1e-9).select(*keys, "_t", "_best", "_i"), keys, ["_t"], {"_k": F.lit(1)})
    best = best.withColumn("_island", F.col("_i") - F.col("_k"))
    spans = best.groupBy(*by, "_island").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.max("_best").alias("balanced_accuracy"))
    widest = F.max_by(F.struct("_a", "_b", "balanced_accuracy"), F.struct(F.col("_b") - F.col("_a"), -F.col("_a")))
    return spans.groupBy(*by).agg(widest.alias("_w")).select(*by, ((F.col("_w._a") + F.col("_w._b")) / 2).alias("threshold"), F.col("_w.balanced_accuracy"))


def gap_threshold(pairs: DataFrame, distance: str, label: str) -> DataFrame:
    """Middle of the gap between the farthest `same` and the nearest other pair; an overlap is refused."""
    out = pairs.agg(F.max(F.when(F.col(label) == "same", F.col(distance))).alias("max_same"), F.min(F.when(F.col(label) != "same", F.col(distance))).alias("min_other"))
    clean = F.when(F.col("max_same") >= F.col("min_other"), F.raise_error(F.lit("distances of same and other pairs overlap")).cast("double"))
    return out.withColumn("threshold", clean.otherwise((F.col("max_same") + F.col("min_other")) / 2))


def band_of_gap(gap: float, band: float = BAND) -> float:
    check(gap > 0, f"a gap is positive, got {gap}")
    return band / gap


def collapse_rate(k: Column, raw: Column) -> Column:
    """1 - k / raw; counts out of order raise."""
    bad = (raw <= 0) | (k < 0) | (k > raw) | k.isNull() | raw.isNull()
    return F.when(bad, F.raise_error(F.lit("collapse rate needs 0 <= k <= raw, raw > 0")).cast("double")).otherwise(1 - k / raw)


def duplicate_verdict(k: Column, diversity: Column) -> Column:
    """A pool of copies passes as one cluster of next to no diversity."""
    return (k == 1) & (diversity < DUPLICATE_DIVERSITY)


def random_verdict(k: Column, n: Column, diversity: Column, high: Column, ordered: Column) -> Column:
    """struct(k_pass, floor, failed) of a pool of unrelated texts; without the control's ordering the floor is inconclusive."""
    k_pass = k >= F.ceil(n * 0.9)
    floor = F.when(~ordered, "inconclusive").when(diversity >= high, "pass").otherwise("fail")
    return F.struct(k_pass.alias("k_pass"), floor.alias("floor"), (~k_pass | (floor == "fail")).alias("failed"))


def ordering_control(pools: DataFrame, name: str, diversity: str) -> DataFrame:
    """One row of the low, average and high pools' diversities, whether they rise strictly, and by how much."""
    own = lambda n: F.max(F.when(F.col(name) == n, F.col(diversity)))
    out = pools.agg(own("low").alias("low"), own("average").alias("average"), own("high").alias("high"))
    return out.withColumn("ordered", (F.col("low") < F.col("average")) & (F.col("average") < F.col("high"))).withColumn("margin", F.col("high") - F.col("low"))
