"""Arms as agents: panel geometry, rounds, model sets, mock generation, and what each step asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolstat.errors import check

# Tokens of a mock slot, the smallest request bounds and the tokens an idea takes.
MOCK_TOKENS = (500, 300)
MIN_BY_EFFORT = {"max": 45523}


def panel_geometry(own: Column, shared: Column, fields: tuple[str, ...] = ("size", "ideasPerAgent", "maxRounds", "sharing")) -> Column:
    """An arm's panel fields, each from its own override or else the shared one."""
    return F.struct(*[F.coalesce(own[f], shared[f]).alias(f) for f in fields])


def agents(arms: DataFrame, ideas: str) -> DataFrame:
    """arms(arm, mode, slots, ideas) -> one row an agent; a solo arm has one, from its first slot, and no panel override.

    A slot's persona (its `k` where it has none) names the agent, with its place in a panel.
    """
    rows = arms.select("arm", "mode", F.col(ideas).alias("ideas"), F.posexplode("slots").alias("at", "slot")).where("mode <> 'solo' or at = 0")
    name = F.concat(F.lit("k"), F.col("slot.k").cast("string"), F.lit("#"), F.col("at").cast("string"))
    return rows.select("arm", F.when(F.col("mode") == "solo", "solo").otherwise(name).alias("agent"), F.col("slot.model").alias("model"), F.col("slot.effort").alias("effort"), "ideas")


def uniform(agent_rows: DataFrame, **spec: str) -> DataFrame:
    """Agents of an arm without personas: the given fields for all, models and efforts kept."""
    check(not {"model", "effort"} & set(spec), "a uniform persona does not change models or efforts")
    return agent_rows.withColumns({k: F.lit(v) for k, v in spec.items()})


def rounds(limit: Column, sharing: Column) -> Column:
    """A struct a round; all but the first share. Null without sharing or rounds."""
    n = F.greatest(F.coalesce(F.floor(limit), F.lit(0)), F.lit(0)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.when(i > 0, sharing).alias("sharing")))
    return F.when(sharing.isNotNull() & (n > 0), steps)


def resolved_models(slots: Column) -> Column:
    """Map of persona to model; a persona that came before gets #n, n the keys before it."""
    before = lambda s, i: F.size(F.filter(F.slice(slots, 1, i), lambda t: t["persona"] == s["persona"])) > 0
    keyed = F.transform(slots, lambda s, i: F.struct(F.concat(s["persona"], F.when((i > 0) & before(s, F.greatest(i, F.lit(1))), F.concat(F.lit("#"), i.cast("string"))).otherwise("")).alias("key"), s["model"].alias("value")))
    return F.map_from_entries(keyed)


def mock_completions(arms: DataFrame) -> DataFrame:
    """Deterministic offline generation: fixed tokens a slot, summed by model, and two named ideas."""
    rows = arms.select("arm", F.explode("slots").alias("slot"))
    out = rows.groupBy("arm", F.col("slot.model").alias("model")).agg((F.count("*") * MOCK_TOKENS[0]).alias("input_tokens"), (F.count("*") * MOCK_TOKENS[1]).alias("output_tokens"))
    return out.withColumn("candidates", F.array(*[F.concat(F.lit(f"mock-idea-{i}-"), F.col("arm").cast("string")) for i in (1, 2)]))


def mock_scores(candidates: DataFrame, originality: float = 5.0, feasibility: float = 4.0) -> DataFrame:
    """The deterministic judge: one score for all."""
    return candidates.withColumn("originality", F.lit(originality)).withColumn("feasibility", F.lit(feasibility))


def request_floor(effort: Column, base: int = 0) -> Column:
    out = F.lit(base)
    for level, least in MIN_BY_EFFORT.items():
        out = F.when(F.coalesce(effort, F.lit("high")) == level, F.lit(max(base, least))).otherwise(out)
    return out


def tokens_per_idea(model: Column, effort: Column, rates: dict[str, dict[str | None, int]], usual: int) -> Column:
    """By model and effort, else the model's rate for any effort (key None), else its largest, else the usual one."""
    out = F.lit(usual)
    for name, by in rates.items():
        own = F.lit(by.get(None, max(by.values())))
        for level, rate in by.items():
            own = own if level is None else F.when(F.coalesce(effort, F.lit("high")) == level, rate).otherwise(own)
        out = F.when(model == name, own).otherwise(out)
    return out


def cell_max_tokens(bounds: Column, requested: Column) -> Column:
    """The largest bound of a cell's agents, never under what a request asks for."""
    return F.greatest(F.array_max(bounds), F.coalesce(requested, F.lit(0)))


def judge_legs(matrix: DataFrame, cells: DataFrame, size: int, ideas: int, rounds_: int) -> DataFrame:
    """Legs with their expected candidates: what a solo arm asks for, else the panel's size x ideas x rounds."""
    n = F.when((F.col("mode") == "solo") & F.col("wanted").isNotNull(), F.col("wanted")).otherwise(size * ideas * rounds_)
    return matrix.join(cells, "pool").select("pool", "provider", "judge", n.alias("candidates"))


def texts_once(pairs: DataFrame) -> DataFrame:
    """Each text of pairs once, for embedding; pairs look both up again (`thresholds.pair_distances`)."""
    return pairs.select(F.col("a").alias("text")).union(pairs.select("b")).distinct()


def deidentified(pools: DataFrame, text: str = "text") -> DataFrame:
    """A judge's view of a pool: pool, index and text, nothing of arms, models or personas; empty texts are refused."""
    bad = F.coalesce(F.trim(text), F.lit("")) == ""
    return pools.select("pool", "index", F.when(bad, F.raise_error(F.lit("a candidate without text")).cast("string")).otherwise(F.col(text)).alias("text"))


def payload(brief: Column, texts: Column) -> Column:
    return F.struct(brief.alias("brief"), F.transform(texts, lambda t: F.struct(t.alias("text"))).alias("candidates"))


def pilot_slice(cells: DataFrame, briefs: list[str], replicate: int = 1) -> DataFrame:
    return cells.where(F.col("brief").isin(briefs) & (F.col("replicate") == replicate))


def pilot_report(scores: DataFrame, by: str) -> DataFrame:
    """Mean originality and feasibility of each arm or persona; refused replies are counted apart."""
    return scores.groupBy(by).agg(
        F.avg("originality").alias("originality"), F.avg("feasibility").alias("feasibility"), F.count_if("refused").alias("refused"), (100 * F.avg(F.col("refused").cast("double"))).alias("refused_percent"), F.count("*").alias("n"),
    )
