"""Reservations as a stream, in any batches and order, equal the book kept in one go."""

import random

from poolstat.streaming import reservations as R

EVENTS = R.EVENT + ", file int"


def log(rng, runs=3, n=40):
    out = []
    for run in range(runs):
        open_, seq = [], 0
        for k in range(n):
            kind = rng.choice(["ask", "ask", "spend", "settle"]) if open_ else "ask"
            cell = f"c{k}" if kind == "ask" else rng.choice(open_)
            shares = [(p, round(rng.uniform(0, 3), 2)) for p in rng.sample(["a", "b", "x"], rng.randrange(1, 3))] if kind != "settle" else None
            open_ += [cell] if kind == "ask" else []
            out.append((f"r{run}", seq, kind, cell, shares))
            seq += 1
    return out


def plain(events, total, ceilings):
    """Sums over the whole list of events before each ask."""
    rows = []
    for run in sorted({e[0] for e in events}):
        own = sorted(e for e in events if e[0] == run)
        held, spent = {}, []
        for _, seq, kind, cell, shares in own:
            shares, outcome = shares or [], "spent"
            if kind == "ask":
                usd = lambda p, have: sum(u for q, u in have if p in (None, q))
                now = spent + [s for h in held.values() for s in h]
                over = [p for p in sorted({q for q, _ in shares}) if p in ceilings and usd(p, shares) > 0 and usd(p, now) + usd(p, shares) > ceilings[p] + 1e-12]
                outcome = f"budget_exceeded:{over[0]}" if over else "budget_exceeded" if usd(None, now) + usd(None, shares) > total + 1e-12 else "admitted"
                if outcome == "admitted":
                    held[cell] = shares
            elif kind == "spend":
                spent += shares
            else:
                outcome = "settled" if held.pop(cell, None) is not None else "idle"
            rows.append((run, seq, kind, cell, outcome, round(sum(u for _, u in spent), 6), round(sum(u for h in held.values() for _, u in h), 6)))
    return sorted(rows)


def told(df):
    return sorted((*tuple(r)[:5], round(r.spent, 6), round(r.held, 6)) for r in df.collect())


def test_stream_in_random_batches_equals_one_book(spark, tmp_path):
    rng = random.Random(5)
    events, ceilings = log(rng), {"a": 14.0, "b": 11.0}
    want = plain(events, 30.0, ceilings)
    assert {w[4] for w in want} >= {"admitted", "spent", "settled", "budget_exceeded:a"}
    frame = lambda rows: spark.createDataFrame(rows, R.EVENT)
    assert told(R.booked(frame(events), 30.0, ceilings)) == want
    shuffled = events + rng.sample(events, 20)  # repeats too
    rng.shuffle(shuffled)
    cuts = sorted(rng.sample(range(1, len(shuffled)), 5))
    parts = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(shuffled)])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = lambda: spark.readStream.schema(R.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        for k, part in enumerate(parts):
            frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            if k in (2, 5):  # a stop after three files, and a restart from the checkpoint
                R.drained(R.reserve(source(), 30.0, ceilings), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert told(R.rows_of(str(tmp_path), spark)) == want
