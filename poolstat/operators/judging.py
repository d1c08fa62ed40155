"""Judges and pools: who may judge what, score frames, gates and their reliability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from poolstat.errors import BiasNotIdentifiable, JudgeScoresUnavailable, check
from poolstat.functions.keys import judge_scores_key, leg_seed
from poolstat.functions.text import AXES
from poolstat.sources.tables import written, written_in_turn

from .prefix import numbered, running
from .pricing import provider_of
from .vectors import mulberry32_draws, mulberry32_of
from .windows import spearman

# The gate's accuracy floor, its smallest number of ideas, and the share of ideas on each side.
ACCURACY_FLOOR, MIN_IDEAS, QUANTILE = 0.561, 20, 0.25
#: scores that are shuffled at once, and halves that a task compares at once; lists shuffled side by side; halves on disk at once
CELLS, COLUMNS, WAVE = 1 << 20, 1 << 13, 1 << 26
#: step of the mulberry32 generator
STEP = np.uint32(0x6D2B79F5)


def generator_providers(slots: Column) -> Column:
    """Distinct providers of an arm's models."""
    return F.array_distinct(F.transform(slots, lambda s: provider_of(s["model"])))


def distinct_judge(candidates: Column, models: Column) -> Column:
    """The first candidate that the arm does not itself use; none raises."""
    free = F.filter(candidates, lambda c: ~F.array_contains(models, c))
    return F.when(F.size(free) > 0, F.get(free, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no judge outside "), F.array_join(models, ","))).cast("string"))


def distinct_evaluator(judge: Column, models: Column) -> Column:
    """The judge, unless it is one of the arm's own models, which raises."""
    return F.when(F.array_contains(models, judge), F.raise_error(F.concat(judge, F.lit(" judges its own pool"))).cast("string")).otherwise(judge)


def judge_matrix(pools: DataFrame, judges: DataFrame, seed: int = 1) -> DataFrame:
    """pools(pool, models) x judges(provider, candidates) -> one leg each with its judge, store key and seed.

    A row for each pool and provider is what is asked for; judges are a handful of providers.
    """
    check(judges.limit(101).count() <= 100, "more than 100 judge providers")
    legs = pools.crossJoin(F.broadcast(judges))
    legs = legs.withColumn("judge", distinct_judge(F.col("candidates"), F.col("models")))
    return legs.withColumn("key", judge_scores_key(F.col("pool"), F.col("judge"))).withColumn("seed", leg_seed(F.lit(seed), F.col("pool"), F.col("provider")))


def open_legs(legs: DataFrame, stored: DataFrame) -> DataFrame:
    """Legs without stored scores."""
    return legs.join(stored.select("key"), "key", "left_anti")


def leg_states(legs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """legs(key, provider, at), outcomes(key, state, kind): a leg after its provider's first payment refusal is skipped, one without an outcome is deferred."""
    own = legs.join(outcomes, "key", "left")
    refused = own.where("kind = 'payment_required'").groupBy("provider").agg(F.min("at").alias("_refused"))
    out = own.join(refused, "provider", "left")
    return out.withColumn("state", F.when(F.col("at") > F.col("_refused"), "skipped").otherwise(F.coalesce("state", F.lit("deferred")))).drop("_refused")


def mean_axis_score(scores: Column) -> Column:
    """Mean over all axes of an array of score structs; no number at all raises."""
    flat = F.filter(F.flatten(F.transform(scores, lambda s: F.array(*[s[a] for a in AXES]))), lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(flat, F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(flat) > 0, total / F.size(flat)).otherwise(F.raise_error(F.lit("a score record without a number")).cast("double"))


def scores_for_axis(scores: Column, axis: str) -> Column:
    check(axis in AXES, f"unknown axis {axis!r}")
    return F.transform(scores, lambda s: F.when(s[axis].isNull(), F.raise_error(F.lit(f"a score without {axis}")).cast("double")).otherwise(s[axis]))


def score_frame(records: DataFrame, pools: DataFrame) -> DataFrame:
    """records(key, pool, judge_provider, scores), pools(pool, arm, generator_providers) -> rows of the judge-score model.

    Records of other pools are ignored; under two judges are refused.
    """
    own = records.join(pools.select("pool", "arm", "generator_providers"), "pool")
    rows = own.select(
        "key", "pool", "arm", "judge_provider", "generator_providers", F.array_contains("generator_providers", F.col("judge_provider")).alias("same_provider"),
        F.col("pool").alias("run"), mean_axis_score(F.col("scores")).alias("response"),
    )
    judges = rows.select("judge_provider").distinct().limit(2).count()
    check(judges > 0, "no stored score belongs to these pools", JudgeScoresUnavailable)
    check(judges > 1, "one judge provider only", JudgeScoresUnavailable)
    return rows


def bias_by_judge(rows: DataFrame) -> DataFrame:
    """Distinct same-provider flags of each judge."""
    return rows.groupBy("judge_provider").agg(F.count_distinct("same_provider").alias("flags"), F.count("*").alias("n"))


def bias_identifiable(rows: DataFrame) -> bool:
    """Whether any judge met pools of its own provider and of others."""
    return not bias_by_judge(rows).where("flags > 1").isEmpty()


def require_bias(rows: DataFrame) -> DataFrame:
    check(bias_identifiable(rows), "the same-provider flag is constant within every judge", BiasNotIdentifiable)
    return rows


def balanced_accuracy(rows: DataFrame, by: list[str], reference: str, evaluator: str, index: str, quantile: float = QUANTILE) -> DataFrame:
    """Agreement on the lowest and highest floor(n * quantile) ideas by reference; ties by index on both rankings; large groups
    are ranked by ranges.

    Groups that round to no idea on a side give no row.
    """
    check(0 < quantile <= 0.5, f"quantile must lie in (0, 0.5], got {quantile}")
    ranked = numbered(rows, by, [reference, index], "_r", "_n").withColumn("_k", F.floor(F.col("_n") * quantile))
    side = F.when(F.col("_r") <= F.col("_k"), 0).when(F.col("_r") > F.col("_n") - F.col("_k"), 1)
    labelled = ranked.withColumn("_y", side).where("_y is not null and _k >= 1")
    labelled = numbered(labelled, by, [evaluator, index], "_place")  # the two ends alone
    guess = (F.col("_place") > F.col("_k")).cast("int")
    hit = labelled.withColumn("_g", guess)
    share = lambda y: F.sum(F.when(F.col("_y") == y, (F.col("_g") == y).cast("double"))) / F.max("_k")
    out = hit.groupBy(*by).agg(F.max("_n").alias("n"), F.max("_k").alias("k"), share(1).alias("sensitivity"), share(0).alias("specificity"))
    return out.withColumn("accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def gate(rows: DataFrame, by: list[str], judge: str, expert: str, index: str, floor: float = ACCURACY_FLOOR, quantile: float = QUANTILE) -> DataFrame:
    """pass or drop by balanced accuracy against experts, with Spearman's rho; fewer ideas than MIN_IDEAS are refused."""
    few = rows.groupBy(*by).count().where(F.col("count") < MIN_IDEAS)
    check(few.isEmpty(), f"fewer than {MIN_IDEAS} ideas in {[tuple(r) for r in few.limit(5).collect()]}")
    acc = balanced_accuracy(rows, by, expert, judge, index, quantile)
    rho = spearman(rows, by[0], judge, expert) if len(by) == 1 else None
    out = acc.withColumn("floor", F.lit(floor)).withColumn("verdict", F.when(F.col("accuracy") >= floor, "pass").otherwise("drop"))
    return out.join(rho, by) if rho is not None else out


def accuracy_floor(config: dict) -> float:
    """The configured floor, or the registered one; anything but a finite number is refused."""
    value = config.get("judge", {}).get("accuracyFloor", ACCURACY_FLOOR)
    check(isinstance(value, (int, float)) and not isinstance(value, bool) and np.isfinite(value), f"accuracy floor is {value!r}")
    return float(value)


def rho_floor(config: dict) -> float:
    """The configured correlation floor, which has no default."""
    value = config.get("judge", {}).get("rhoFloor")
    check(isinstance(value, (int, float)) and not isinstance(value, bool) and np.isfinite(value), f"rho floor is {value!r}")
    return float(value)


def instrument(record_hash: Column, request_hash: Column, record_shape: Column | None = None, shape: Column | None = None) -> Column:
    """match, mismatch or unknown: by the request hash where the record has one, else by its canonical request shape."""
    by_shape = F.lit("unknown") if record_shape is None or shape is None else F.when(record_shape.isNull() | shape.isNull(), "unknown").otherwise(F.when(record_shape == shape, "match").otherwise("mismatch"))
    return F.when(F.coalesce(record_hash, F.lit("")) == "", by_shape).otherwise(F.when(record_hash == request_hash, "match").otherwise("mismatch"))


def licensed(scores: DataFrame, records: DataFrame, judge: str, request_hash: str) -> DataFrame | None:
    """Idea scores a passing validation of this very instrument licenses; None where the judge was dropped.

    records(key, request_hash, verdict): no record, or none of this instrument, is refused.
    """
    own = records.where(F.col("key").startswith(f"judge-validation|judge={judge}|"))
    check(not own.isEmpty(), f"judge {judge} was never validated")
    usable = own.where(instrument(F.col("request_hash"), F.lit(request_hash)) == "match")
    check(not usable.isEmpty(), f"judge {judge} was validated under other requests")
    return None if usable.where("verdict = 'pass'").isEmpty() else scores


def _shuffled(items: list, draws: np.ndarray) -> list:
    """Fisher-Yates from the top down; draw k moves position len - 1 - k."""
    out = list(items)
    for k, u in enumerate(draws):
        i = len(out) - 1 - k
        j = int(u * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def presentation_order(n: int, seed: int) -> list[int]:
    """Seeded order in which n candidates are shown."""
    return _shuffled(list(range(n)), mulberry32_draws(seed, 0, max(0, n - 1)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def presented(sizes: pd.Series, seeds: pd.Series) -> pd.Series:
    return pd.Series([presentation_order(int(n), int(s)) for n, s in zip(sizes, seeds)])


def judge_requests(pools: DataFrame) -> DataFrame:
    """pools(pool, seed, candidates array<string>) -> a request for each candidate in shown order, with its original index."""
    shown = pools.withColumn("_o", presented(F.size("candidates"), F.col("seed"))).select("pool", "candidates", F.posexplode("_o").alias("position", "index"))
    return shown.select("pool", "position", "index", F.concat(F.lit("cand-"), F.col("index").cast("string")).alias("custom_id"), F.get("candidates", F.col("index")).alias("text"))


def unpermuted(scores: DataFrame) -> DataFrame:
    """scores(pool, index, score) -> scores in the pool's own order."""
    return scores.groupBy("pool").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "score"))), lambda s: s["score"]).alias("scores"))


def _accuracy(reference: np.ndarray, evaluator: np.ndarray, k: int) -> float:
    order = np.lexsort((np.arange(len(reference)), reference))
    low, high = order[:k], order[len(reference) - k :]
    named = np.concatenate([low, high])
    guess = named[np.lexsort((named, evaluator[named]))]
    return (np.isin(low, guess[:k]).sum() + np.isin(high, guess[k:]).sum()) / (2 * k)


def _accuracies(reference: np.ndarray, evaluator: np.ndarray, k: int) -> np.ndarray:
    """_accuracy of each row."""
    n = reference.shape[1]
    if not 0 < 2 * k <= n:
        return np.array([_accuracy(a, b, k) for a, b in zip(reference, evaluator)])
    order = np.argsort(reference, axis=1, kind="stable")
    low = np.zeros(reference.shape, dtype=bool)
    np.put_along_axis(low, order[:, :k], True, axis=1)
    named = np.sort(np.concatenate([order[:, :k], order[:, n - k :]], axis=1), axis=1)
    guess = np.argsort(np.take_along_axis(evaluator, named, axis=1), axis=1, kind="stable")[:, :k]
    # as many of the high are guessed low as of the low are guessed high
    return np.take_along_axis(low, np.take_along_axis(named, guess, axis=1), axis=1).sum(axis=1) / k


def _half_means(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the first half and of the rest of each column; the same whatever the order of a half's values."""
    h = len(mixed) // 2
    total = lambda x: np.array([sum(c) for c in x.T.tolist()])
    return total(mixed[:h]) / h, total(mixed[h:]) / (len(mixed) - h)


def _means_of_halves(x: np.ndarray, seed: int, start: int, used: int, splits: int) -> np.ndarray:
    """Two numbers a split: the means of the halves of a list whose sums are not exact."""
    m, out = len(x), []
    for first in range(0, splits, many := max(1, CELLS // m)):
        at = np.uint64(start) + np.uint64(used) * np.arange(first, min(first + many, splits), dtype=np.uint64)
        mixed, column = np.repeat(x[:, None], len(at), axis=1), np.arange(len(at))
        for i in range(m - 1, 0, -1):
            j = (mulberry32_of(seed, at + np.uint64(m - 1 - i)) * (i + 1)).astype(np.int64)
            mixed[i], mixed[j, column] = mixed[j, column], mixed[i].copy()
        out.append(np.stack(_half_means(mixed), axis=1))
    return np.concatenate(out)


def _second_sums(lists: list[np.ndarray], kind: type, seed: np.ndarray, start: np.ndarray, used: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Sums of the second halves of lists, the longest first, in each of `splits`; all are shuffled side by side.

    Lists end in one row, so a step swaps into one row of all. A shuffle settles the last place first, so it is broken off
    where the first half begins: what goes on there changes neither half's sum.
    """
    sizes = np.array([len(x) for x in lists])
    top, count = int(sizes[0]), len(lists) * len(splits)
    x = np.zeros((top, len(lists)), dtype=kind)
    for k, own in enumerate(lists):
        x[top - len(own) :, k] = own
    x = np.repeat(x, len(splits), axis=1)
    flat, at = x.ravel(), start[:, None] + used[:, None] * splits + np.uint64(1)
    state = ((seed[:, None] + at * np.uint64(STEP)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).ravel()
    shift = (np.repeat((top - sizes) * count, len(splits)) + np.arange(count)).astype(np.uint64)
    left, steps, sums = np.repeat(sizes, len(splits)).astype(np.uint64), sizes - sizes // 2, np.zeros(count)
    for t in range(int(steps[0])):
        c = int((steps > t).sum()) * len(splits)
        a = state[:c]
        r = (a ^ a >> np.uint32(15)) * (a | np.uint32(1))
        r ^= r + (r ^ r >> np.uint32(7)) * (r | np.uint32(61))
        r ^= r >> np.uint32(14)
        j = left[:c] * r
        j >>= np.uint64(32)
        j *= np.uint64(count)
        j += shift[:c]
        j = j.view(np.int64)
        sums[:c] += flat[j]
        flat[j] = x[top - 1 - t, :c]
        a += STEP
        left[:c] -= np.uint64(1)
    return sums.reshape(len(lists), len(splits))


def _kind(x: np.ndarray) -> type | None:
    """The narrowest type that holds a list; None where its sums are not exact."""
    if not (np.abs(x).sum() < 1 << 42 and (np.floor(x * 1024) == x * 1024).all()):
        return None
    most = np.abs(x).max() if (np.floor(x) == x).all() else np.inf
    return np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.float64


def _block(n: int, splits: int) -> int:
    """Splits of n ideas that a task compares at once."""
    return max(1, min(splits, CELLS // n))


def _halves(part: pd.DataFrame, splits: int) -> Iterator[pd.DataFrame]:
    """rows(_g, _d, _n, _j, _x, _seed, _start, _used) -> _g, _d, _j, _b, _m, _t, _s: a list's halves in the splits of block _b.

    _s holds the sum of the second half in single or double precision, _m and _t the list's size and sum; or both means
    where sums are not exact.
    """
    part = part.assign(_x=part["_x"].map(lambda x: np.asarray(x, dtype=float)))
    part = part.assign(_kind=part["_x"].map(_kind), _m=part["_x"].map(len), _t=part["_x"].map(np.sum)).sort_values("_m", ascending=False)
    every = np.arange(splits, dtype=np.uint64)

    def packed(own: pd.DataFrame, found: np.ndarray) -> Iterator[pd.DataFrame]:
        own, wide = own[["_g", "_d", "_n", "_j", "_m", "_t"]], found.shape[1] // splits
        for n in own["_n"].unique():
            same, of = own["_n"].to_numpy() == n, _block(int(n), splits)
            for b, k in enumerate(range(0, splits, of)):
                cells = [x.tobytes() for x in found[same, wide * k : wide * (k + of)]]
                yield own[same].drop(columns="_n").assign(_b=b, _s=cells)[["_g", "_d", "_j", "_b", "_m", "_t", "_s"]]

    for kind in (np.int8, np.int16, np.float64):
        same, k = part[part["_kind"] == kind], 0
        while k < len(same):
            m = int(same["_m"].iloc[k])
            many = max(1, min(splits, 4 * CELLS // m))
            own = same.iloc[k : k + max(1, min(COLUMNS, 4 * CELLS // m) // many)]
            seed, start, used = (own[c].to_numpy().astype(np.uint64) for c in ("_seed", "_start", "_used"))
            sums = np.concatenate([_second_sums(own["_x"].to_list(), kind, seed, start, used, every[f : f + many]) for f in range(0, splits, many)], axis=1)
            short = sums.astype(np.float32)
            yield from packed(own, short if (short == sums).all() else sums)
            k += len(own)
    for i in np.flatnonzero(part["_kind"].isna()):
        own = part.iloc[i : i + 1]
        yield from packed(own, _means_of_halves(own["_x"].iloc[0], *(int(own[c].iloc[0]) for c in ("_seed", "_start", "_used")), splits).reshape(1, -1))


def _split_accuracies(lists: DataFrame, splits: int, quantile: float) -> DataFrame:
    """lists(_g, _d, _n, _j, _x, _seed, _start, _used) -> _g, _d, n, _v: mean accuracy over the splits.

    A list is split by itself; a task then holds two numbers for each idea of a block of splits (CELLS of them, or one
    split), and no reviews.
    """
    kinds = dict(lists.dtypes)

    def halves(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from _halves(part.reset_index(drop=True), splits)

    def accuracy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_j", ignore_index=True)
        n, b = len(part), int(part["_b"].iloc[0])
        count = min(_block(n, splits), splits - b * _block(n, splits))
        wide, m, t = part["_s"].map(len).to_numpy() // count, part["_m"].to_numpy()[:, None], part["_t"].to_numpy()[:, None]
        first, second = np.empty((n, count)), np.empty((n, count))
        for bytes_, kind in ((4, np.float32), (8, np.float64), (16, np.float64)):
            if (own := wide == bytes_).any():
                found = np.frombuffer(b"".join(part["_s"][own]), dtype=kind).reshape(int(own.sum()), -1).astype(float)
                if bytes_ == 16:
                    first[own], second[own] = found[:, ::2], found[:, 1::2]
                else:
                    first[own], second[own] = (t[own] - found) / (m[own] // 2), found / (m[own] - m[own] // 2)
        v = _accuracies(np.ascontiguousarray(first.T), np.ascontiguousarray(second.T), int(n * quantile))
        return part[["_g", "_d"]].head(1).assign(n=n, _v=v.sum())

    key = f"_g {kinds['_g']}, _d long"
    rows = lists.select("_g", F.col("_d").cast("long"), "_n", "_j", "_x", "_seed", "_start", "_used").mapInPandas(halves, f"{key}, _j long, _b long, _m long, _t double, _s binary")
    values = rows.groupBy("_g", "_d", "_b").applyInPandas(accuracy, f"{key}, n long, _v double")
    return values.groupBy("_g", "_d").agg(F.max("n").alias("n"), (F.sum("_v") / splits).alias("_v"))


def _listed(reviews: DataFrame, group: str, idea: str, scores: str) -> DataFrame:
    """_id, _g, _j (place from 0 in the order of `idea`), _n, _x, _m (draws a shuffle takes), _start and _used (those before it, and all) of a group's lists."""
    few = reviews.groupBy(group).agg(F.count("*").alias("n"), F.min(F.size(scores)).alias("m")).where(f"n < {MIN_IDEAS} or m < 2")
    check(few.isEmpty(), f"under {MIN_IDEAS} ideas, or an idea with under 2 reviews, in {[r[0] for r in few.limit(5).collect()]}")
    rows = reviews.select(F.col(group).alias("_g"), F.col(idea).isNull().alias("_no"), F.col(idea).alias("_idea"), F.transform(scores, lambda x: x.cast("double")).alias("_x")).withColumn("_m", (F.size("_x") - 1).cast("long"))
    own = running(rows, ["_g"], ["_no", "_idea"], {"_i": F.lit(1).cast("long"), "_used": F.col("_m")})
    return written(own.select(F.monotonically_increasing_id().alias("_id"), "_g", (F.col("_i") - 1).alias("_j"), F.col("_i_all").alias("_n"), "_x", "_m", (F.col("_used") - F.col("_m")).alias("_start"), F.col("_used_all").alias("_used")))


def split_half(reviews: DataFrame, group: str, idea: str, scores: str, splits: int = 100, seed: int = 1, quantile: float = QUANTILE, batch: int = 20) -> DataFrame:
    """reviews(group, idea, scores array) -> group, n, mean accuracy of one half of each idea's reviewers against the other.

    One stream runs over all ideas (in order of `idea`) and splits; split s starts where s times the draws of all ideas end,
    and an idea's draws where those of the ideas before it end, so every idea is split by itself. `batch` is of no account.
    """
    own = _listed(reviews, group, idea, scores).withColumns({"_d": F.lit(0), "_seed": F.lit(seed & 0xFFFFFFFF)})
    tasks = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = _split_accuracies(own.repartition(tasks, "_g", "_j"), splits, quantile)  # few bytes but long tasks: not to be coalesced
    return out.select(F.col("_g").alias(group), "n", F.col("_v").alias("mean_accuracy"))


def interval(reviews: DataFrame, group: str, idea: str, scores: str, draws: int = 2000, splits: int = 200, seed: int = 2, level: float = 0.95, quantile: float = QUANTILE) -> DataFrame:
    """group, n, lower, upper: percentile interval of the split-half accuracy over resampled ideas.

    Two levels: every draw picks n of a group's ideas with replacement, each pick by its own place in the generator's
    stream; then each pick's reviews are split `splits` times by the draw's own stream, pick after pick. A task picks from
    the sizes of a group's lists; reviews join last, and are split where they are joined. Draws are taken in waves of up
    to WAVE halves, or one draw, and a wave leaves one number a draw.
    """
    own = _listed(reviews, group, idea, scores)
    kind, tasks = dict(own.dtypes)["_g"], int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wave = max(1, WAVE // max(1, own.count() * splits))

    def picked(part: pd.DataFrame, wave_end: int) -> pd.DataFrame:
        part = part.sort_values("_j")
        n, ids, m, first, out = len(part), part["_id"].to_numpy(), part["_m"].to_numpy(), int(part["_d"].iloc[0]), []
        for d in range(first, min(first + _block(n, draws), wave_end)):
            pick = (mulberry32_draws(seed, d * n, n) * n).astype(np.int64)
            used = m[pick]
            out.append(pd.DataFrame({"_d": d, "_n": n, "_j": np.arange(n), "_id": ids[pick], "_seed": (seed * 1_000_003 + 1 + d) & 0xFFFFFFFF, "_start": used.cumsum() - used, "_used": used.sum()}))
        out = pd.concat(out, ignore_index=True)
        out.insert(0, "_g", pd.Series([part["_g"].iloc[0]] * len(out), dtype=part["_g"].dtype))
        return out

    def accuracies(first: int) -> DataFrame:
        end = min(first + wave, draws)
        step = F.greatest(F.lit(1), F.least(F.lit(draws), F.floor(F.lit(CELLS) / F.col("_n")))).cast("long")  # _block(n, draws)
        dealt = own.select("_g", "_j", "_m", "_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long"), step)).alias("_d"))
        picks = dealt.groupBy("_g", "_d").applyInPandas(lambda part: picked(part, end), f"_g {kind}, _d long, _n long, _j long, _id long, _seed long, _start long, _used long")
        # few bytes but long tasks: not to be coalesced
        return _split_accuracies(picks.repartition(tasks, "_id").join(own.select("_id", "_x").repartition(tasks, "_id"), "_id"), splits, quantile)

    values = accuracies(0) if wave >= draws else written_in_turn(own.sparkSession, (accuracies(first) for first in range(0, draws, wave)))
    tail = (1 - level) / 2
    low, high = int(tail * draws), max(0, min(draws - 1, int(np.ceil((1 - tail) * draws)) - 1))
    sorted_ = F.sort_array(F.collect_list("_v"))  # `draws` numbers
    return values.groupBy(F.col("_g").alias(group)).agg(F.max("n").alias("n"), sorted_[low].alias("lower"), sorted_[high].alias("upper"))


def split_half_interval(lists: list[list[float]], draws: int = 2000, splits: int = 200, seed: int = 2, level: float = 0.95, spark=None, quantile: float = QUANTILE) -> tuple[float, float]:
    """The interval of one group whose reviews are at hand."""
    check(len(lists) >= MIN_IDEAS, f"{len(lists)} ideas are under {MIN_IDEAS}")
    rows = spark.createDataFrame([(0, i, [float(v) for v in x]) for i, x in enumerate(lists)], "g int, idea int, scores array<double>")
    r = interval(rows, "g", "idea", "scores", draws, splits, seed, level, quantile).first()
    return r["lower"], r["upper"]
