"""Prunes of small stores: selectors, salvage, retention, crash-left states, dated rates, and what everything is worth."""

import pytest
from pyspark.sql import functions as F

from poolstat.errors import PoolstatError
from poolstat.functions.keys import parse_cell_key
from poolstat.operators import ledger, pruning
from poolstat.operators.pricing import price_rows

RECORD = "key string, state string, kind string, cfg string, stored_at string, pruned_from array<string>"
LINES = "key string, at int, cell_key string, timestamp string, billing_mode string, pricing_regime string, model string, input_tokens long, output_tokens long"
RATE = "model string, rate_in double, rate_out double, intro_until string, intro_in double, intro_out double, batch_discount double"
CELL = "arm=A|brief=b1|rep=0|cfg=c1"


class Store:
    def __init__(self, spark):
        self.spark, self.records, self.lines = spark, [], []
        self.rates = spark.createDataFrame([("claude-1", 3.0, 15.0, None, None, None, 0.5), ("gpt-1", 1.0, 2.0, None, None, None, 0.5), ("claude-d", 3.0, 15.0, "2026-09-01", 1.0, 5.0, 0.5)], RATE)

    def put(self, key, state="failed", kind="rate_limited", stored_at="t1", tokens=(1000, 500), pruned_from=None, model="claude-1", timestamp="2026-08-01"):
        self.records.append((key, state, kind if state == "failed" else None, "c1", stored_at, pruned_from))
        for m in (model if isinstance(model, list) else [model] if tokens else []):
            self.lines.append((key, 0, CELL, timestamp, "api", "batch", m, *tokens))
        return key

    def attempt(self, n, family="generation-attempt", compacted=False, **more):
        return self.put(f"{family}{'-compacted' if compacted else ''}|cell={CELL}|{'through' if compacted else 'attempt'}={n}", **more)

    def frames(self):
        return self.spark.createDataFrame(self.records, RECORD), self.spark.createDataFrame(self.lines, LINES)

    def prune(self, **how):
        out = pruning.prune(*self.frames(), self.rates, **how)
        self.records = [tuple(r) for r in out.records.select("key", "state", "kind", "cfg", "stored_at", "pruned_from").collect()]
        self.lines = [tuple(r) for r in out.lines.select(*[c.split()[0] for c in LINES.split(", ")]).withColumns({t: F.col(t).cast("long") for t in ("input_tokens", "output_tokens")}).collect()]
        return out

    def keys(self):
        return sorted(r[0] for r in self.records)

    def spend(self):
        return price_rows(self.frames()[1], self.rates, batch=True).first()["total_usd"]


@pytest.fixture
def store(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # few rows, many steps
    yield Store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_eviction_salvages_spend_out_of_sight_of_plans(store):
    key, before = store.put(CELL), store.spend()
    out = store.prune(kinds=["rate_limited"])
    assert store.keys() == [f"pruned-cell|cell={key}|attempt=0"] and store.spend() == pytest.approx(before) and before > 0
    assert out.records.where(parse_cell_key(F.col("key")).isNotNull()).isEmpty()
    assert store.records[0][1:3] == ("failed", "rate_limited") and store.records[0][5] == ["t1"]


def test_interrupted_salvage_converges(store):
    """The salvage is written, the cell still there: the cell goes, and its second count with it."""
    key = store.put(CELL)
    one = store.spend()
    store.put(f"pruned-cell|cell={key}|attempt=0", pruned_from=["t1"])
    assert store.spend() == pytest.approx(2 * one)
    out = store.prune(kinds=["rate_limited"])
    assert store.keys() == [f"pruned-cell|cell={key}|attempt=0"] and store.spend() == pytest.approx(one) and out.duplicates.count() == 1


def test_a_second_failure_is_a_second_spend(store):
    key = store.put(CELL)
    one = store.spend()
    store.prune(kinds=["rate_limited"])
    store.put(CELL, stored_at="t2")
    store.prune(kinds=["rate_limited"])
    assert store.keys() == [f"pruned-cell|cell={key}|attempt={n}" for n in (0, 1)] and store.spend() == pytest.approx(2 * one)


def test_salvage_survives_folds(store):
    """Identities outlive a fold, and numbers go on behind it."""
    for n in range(4):
        store.put(CELL, stored_at=f"t{n}")
        store.prune(kinds=["transient"], keep=2)
    one = 1000 / 1e6 * 3 * 0.5 + 500 / 1e6 * 15 * 0.5
    assert store.spend() == pytest.approx(4 * one) and len(store.keys()) == 4  # the last salvage came behind its plan
    store.put(CELL, stored_at="t0")  # left by a crash: known to the compacted record
    store.prune(kinds=["transient"], keep=2)
    assert store.keys() == [f"pruned-cell-compacted|cell={CELL}|through=1"] + [f"pruned-cell|cell={CELL}|attempt={n}" for n in (2, 3)]
    assert next(r[5] for r in store.records if "compacted" in r[0]) == ["t0", "t1"] and store.spend() == pytest.approx(4 * one)


def test_completed_cells_are_refused(store):
    key, before = store.put(CELL, "completed"), None
    before = store.spend()
    out = store.prune(cfg="c1", states=["completed"])
    assert [(r.key, r.action) for r in out.plan.collect()] == [(key, "refuse")] and store.keys() == [key]
    assert [r.action for r in pruning.prune_plan(store.frames()[0], cfg="c1").collect()] == ["keep"]
    store.prune(cfg="c1", states=["completed"], allow_completed=True)
    assert key not in store.keys() and store.spend() == pytest.approx(before) and store.records[0][2] == "harness_error"


def test_selectors(store):
    for brief, kind in (("b1", "empty_pool"), ("b2", "parse_failure"), ("b3", "refusal"), ("b4", "rate_limited"), ("b5", "timeout"), ("b6", "payment_required")):
        store.put(f"arm=A|brief={brief}|rep=0|cfg=c1", kind=kind)
    store.put("arm=B|brief=b4|rep=0|cfg=c2", kind="rate_limited")
    left = lambda **how: sorted(r.key[4:14] for r in pruning.prune_plan(store.frames()[0], **how).where("action = 'evict'").collect())
    assert left() == [] and left(cfg="c1") == ["A|brief=b4", "A|brief=b5", "A|brief=b6"] and left(kinds=["intrinsic"]) == ["A|brief=b1", "A|brief=b2", "A|brief=b3"]
    assert left(arms=["B"]) == ["B|brief=b4"] and left(briefs=["b4"]) == ["A|brief=b4", "B|brief=b4"] and left(arms=["A"], kinds=["timeout"]) == ["A|brief=b5"]


def test_compaction_bounds_records_and_rows(store):
    for n in range(12):
        store.attempt(n)
    for n in range(6):
        store.attempt(n, "judge-call", state="completed", model="gpt-1")
    before = store.spend()
    store.prune()
    assert len(store.keys()) == 12 and store.spend() == pytest.approx(before)
    lines = [x for x in store.lines if x[0] == f"generation-attempt-compacted|cell={CELL}|through=6"]
    assert len(lines) == 1 and lines[0][-2:] == (7000, 3500)
    assert next(r[1] for r in store.records if r[0] == f"judge-call-compacted|cell={CELL}|through=0") == "completed"
    assert pruning.prune_plan(store.frames()[0]).where("action <> 'keep'").isEmpty()  # a compacted record alone is not folded again


def test_second_prune_does_not_count_twice(store):
    for n in range(8):
        store.attempt(n)
    store.prune(keep=2)
    keys = store.frames()[0]
    assert ledger.next_attempt(ledger.attempts(keys)).first()["next_attempt"] == 8
    for n in range(8, 13):
        store.attempt(n)
    before = store.spend()
    store.prune(keep=2)
    assert store.spend() == pytest.approx(before) and store.keys() == [f"generation-attempt-compacted|cell={CELL}|through=10"] + [f"generation-attempt|cell={CELL}|attempt={n}" for n in (11, 12)]


def test_crash_between_compaction_and_removal(store):
    """Raw attempts beside the compacted record that covers them: their spend is told twice, and a prune repairs it."""
    for n in range(10):
        store.attempt(n)
    once = store.spend()
    store.attempt(7, compacted=True, tokens=(8000, 4000))
    assert store.spend() > once
    out = store.prune(keep=2)
    assert store.spend() == pytest.approx(once) and out.duplicates.count() == 8
    assert store.keys() == [f"generation-attempt-compacted|cell={CELL}|through=7"] + [f"generation-attempt|cell={CELL}|attempt={n}" for n in (8, 9)]


def test_dated_rates_are_not_folded_across(store):
    for n in range(4):
        store.attempt(n, model="claude-d", timestamp="2026-08-01" if n < 2 else "2026-10-01")
    for n in range(4):
        store.attempt(n, "metrics-attempt", model="claude-d", timestamp="2026-08-01")
    before = store.spend()
    store.prune(keep=1)
    rows = [x for x in store.lines if "compacted" in x[0]]
    assert store.spend() == pytest.approx(before) and sorted(x[0].split("-")[0] for x in rows) == ["generation"] * 3 + ["metrics"]


def test_models_of_one_row_stay_together(store):
    for n in range(4):
        store.attempt(n, model=["claude-1", "gpt-1"] if n % 2 else "claude-1")
    before = store.spend()
    store.prune(keep=1)
    rows = sorted((x[1], x[6], x[7]) for x in store.lines if "compacted" in x[0])
    assert rows == [(0, "claude-1", 2000), (1, "claude-1", 1000), (1, "gpt-1", 1000)] and store.spend() == pytest.approx(before)


def test_drift_is_refused(store, monkeypatch):
    """The check is on in every state: a fold that loses a row, also where a compacted record goes."""
    for n in range(6):
        store.attempt(n)
    store.attempt(1, compacted=True, tokens=(2000, 1000))
    real = pruning.folded
    monkeypatch.setattr(pruning, "folded", lambda lines, rates: real(lines, rates).withColumn("input_tokens", F.col("input_tokens") - 1))
    with pytest.raises(PoolstatError, match="would change the ledger"):
        store.prune(keep=2)
    monkeypatch.setattr(pruning, "folded", real)
    for n in range(3):
        store.attempt(n, "batch-replay", tokens=None)
    store.prune(keep=2)
    assert [k for k in store.keys() if k.startswith("batch-replay")] == [f"batch-replay|cell={CELL}|attempt=2"]
    store.attempt(1, "batch-replay")
    with pytest.raises(PoolstatError, match="replay record"):
        store.prune(keep=2)
    with pytest.raises(PoolstatError, match="positive"):
        pruning.prune_plan(store.frames()[0], keep=0)
