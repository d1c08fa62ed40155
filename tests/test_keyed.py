"""Keyed bodies: pruned reads and puts, failed puts, compaction."""

import re

import pytest

from poolstat.errors import ConflictingRecord, PoolstatError
from poolstat.sources.keyed import Keyed

RECORD = "key string, state string, body string"


def records(spark, keys, body='{"n": %d}'):
    return spark.createDataFrame([(f"k{i}", "completed", body % i) for i in keys], RECORD)


def test_reads_prune_to_a_bucket(spark, tmp_path):
    store = Keyed(spark, str(tmp_path / "s"), 8)
    assert store.read().collect() == []
    with pytest.raises(PoolstatError, match="no stored record"):
        store.get("k1")
    store.put(records(spark, range(40)))
    row = store.get("k7")
    assert row.first().body == '{"n":7}'
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+\)?", plan)
    few = store.of(records(spark, [1, 2]))
    assert sorted(r.key for r in few.collect()) == ["k1", "k2"] and re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", few._jdf.queryExecution().optimizedPlan().toString() + few._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(PoolstatError, match="other buckets"):
        Keyed(spark, str(tmp_path / "s"), 16).puts()


def test_puts_are_all_or_nothing(spark, tmp_path, monkeypatch):
    store = Keyed(spark, str(tmp_path / "s"), 4)
    assert {r.outcome for r in store.put(records(spark, range(10))).collect()} == {"written"}
    before = sorted(map(tuple, store.read().collect()))
    with monkeypatch.context() as m:
        m.setattr(Keyed, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.put(records(spark, range(5, 20)))
    assert sorted(map(tuple, store.read().collect())) == before  # bodies are there, the log has no line of them
    with pytest.raises(ConflictingRecord):
        store.put(records(spark, [3, 30], '{"m": %d}'))
    assert sorted(map(tuple, store.read().collect())) == before
    store.put(records(spark, range(5, 20), '{ "n" : %d }'))  # five are there with the same content
    assert sorted(r.key for r in store.read().collect()) == sorted(f"k{i}" for i in range(20))
    puts = store.puts()
    store.compact()
    assert len(puts) == 2 and len(store.puts()) == 1 and store.read().count() == 20 and store.get("k19").first().body == '{"n":19}'
    with pytest.raises(PoolstatError, match="nothing to compact"):
        store.compact()
