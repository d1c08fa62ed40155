"""Admission by a tree of summaries against the sequential decisions."""

import random
from decimal import Decimal

import numpy as np
import pytest

from poolstat.operators import admission


def sequential(rows, ceiling, prior, places=6):
    """rows(order, usd) in order -> flags and spent, in exact units."""
    spent, out = admission.units(prior, places), []
    for _, usd in rows:
        fits = usd is not None and usd < 1e12 and spent + admission.units(usd, places) <= admission.units(ceiling, places)
        spent += admission.units(usd, places) if fits else 0
        out.append((fits, float(Decimal(spent) / 10**places)))
    return out


CASES = {
    "even": lambda r: r.choice([0.5, 1.0, 2.25, 30.0]),
    "wide": lambda r: round(10 ** r.uniform(-6, 4), 6),
    "zero and huge": lambda r: r.choice([0.0, 0.0, 1e-6, 3.0, 1e9, 1e300, float("inf"), float("nan"), None]),
    "tiny": lambda r: r.choice([1e-6, 2e-6, 3e-6]),
    "halving": lambda r: 2.0 ** -r.randrange(12) + r.choice([0, 0.001]),
}


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Several ranges, few tasks a step."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("ceiling,prior,case", [(c, p, k) for c, p in ((100.0, 0.0), (7.000001, 2.0)) for k in CASES] + [(5.0, 5.0, "zero and huge"), (4.0, 5.0, "zero and huge")])
def test_equals_sequential(spark, monkeypatch, case, ceiling, prior):
    """Blocks of 8 rows, nodes of 4 blocks; every third row shares its place in the plan with others."""
    monkeypatch.setattr(admission, "LEVELS", (3, 5, 34))
    r = random.Random(case + str(ceiling))
    rows = [(i // 3, CASES[case](r), f"n{i}") for i in range(700)]
    got = admission.admitted(spark.createDataFrame(rows, "i long, usd double, name string").repartition(5), "i", "usd", ceiling, prior)
    # rows of one place go by amount (null first, NaN last), equal ones in any order: their flags are compared as a run
    got = sorted(got.collect(), key=lambda x: (x.i, x.usd is not None, x.usd != x.usd, x.usd or 0, -x.admitted, x.spent))
    rows.sort(key=lambda x: (x[0], x[1] is not None, x[1] != x[1], x[1] or 0))
    want = sequential([x[:2] for x in rows], ceiling, prior)
    assert [(x.i, x.admitted) for x in got] == [(x[0], w[0]) for x, w in zip(rows, want)]
    assert np.allclose([x.spent for x in got], [w[1] for w in want], rtol=0, atol=1e-9)


def test_joined_summaries_are_the_wholes():
    rng = np.random.default_rng(1)
    costs = np.where(rng.random(300) < 0.1, -1, rng.integers(0, 2 ** rng.integers(1, 40, 300)))
    whole = admission.block_summary(costs)
    parts = [admission.block_summary(costs[a:b]) for a, b in [(0, 50), (50, 51), (51, 51), (51, 200), (200, 300)]]
    sums, least = admission.joined(parts)
    assert (list(sums), list(least)) == (list(whole[0]), list(whole[1]))
    assert admission.joined([admission.joined(parts[:2]), admission.joined(parts[2:])]) == (sums, least)


def test_few_blocks_are_opened(spark, monkeypatch):
    """What is looked at row by row grows with the budget's bits, not with the rows; and the plan sends no table to one task."""
    monkeypatch.setattr(admission, "LEVELS", (4, 8, 40))
    seen, skipped = [], admission.skipped
    monkeypatch.setattr(admission, "skipped", lambda *a: seen.append(skipped(*a)) or seen[-1])
    df = spark.range(20_000).selectExpr("id as i", "1.0 + id % 97 as usd")
    out = admission.admitted(df, "i", "usd", 3000.0)
    assert sum(x is None for x in seen) < 3 * 50
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    rows = out.orderBy("i").collect()
    assert [(x.admitted, x.spent) for x in rows] == sequential([(x.i, x.usd) for x in rows], 3000.0, 0.0)


def test_negative_and_empty(spark):
    assert admission.admitted(spark.createDataFrame([], "i long, usd double"), "i", "usd", 5.0).collect() == []
    with pytest.raises(Exception, match="negative"):
        admission.admitted(spark.createDataFrame([(1, -2.0)], "i long, usd double"), "i", "usd", 5.0).collect()
