"""Replay records by a stream: any file order within the watermark, restarts, expiry, late replies."""

import random
from datetime import datetime, timedelta


from poolstat.streaming import replays as R
from poolstat.streaming.reservations import drained

DAY = 86_400_000
EVENT = "cell string, batch string, kind string, at timestamp"


def plain(events, retention):
    """Each batch's events by themselves, day by day."""
    out = set()
    for cell, batch in {(e[0], e[1]) for e in events}:
        held = None
        own = sorted((at, R.KINDS.index(kind)) for c, b, kind, at in events if (c, b) == (cell, batch))
        for at, kind in [*own, (None, None)]:
            if held is not None and (at is None or at - held > timedelta(days=retention)):
                out.add((cell, batch, "expire", held + timedelta(days=retention), "expired"))
                held = None
            if at is None:
                break
            took = held is not None
            out.add((cell, batch, R.KINDS[kind], at, [("again" if took else "held"), ("replayed" if took else "late"), ("retired" if took else "idle")][kind]))
            held = (held if took else at) if kind == 0 else None
    return out


def test_settle_in_steps_equals_one():
    """Cut anywhere, the same rows come out."""
    rng = random.Random(3)
    for _ in range(50):
        events = sorted((rng.randrange(30) * DAY, rng.randrange(3), rng.choice("ab")) for _ in range(12))
        whole, _ = R.settle(events, {}, 10**15, 5 * DAY)
        held, left, rows = {}, [], []
        for cut in sorted(rng.sample(range(31), 4)) + [10**6]:
            got, left = R.settle(left + [e for e in events if e[0] <= cut * DAY], held, cut * DAY, 5 * DAY)
            events = [e for e in events if e[0] > cut * DAY]
            rows += got
        assert rows == whole


def test_stream_equals_plain(spark, tmp_path):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    events, rows = [], []
    for k in range(60):
        cell, batch, at = f"c{k % 4}", f"b{k}", rng.randrange(60)
        own = [("submit", at)] + [("reply", at + rng.choice([0, 2, 9, 10, 11, 25])) for _ in range(rng.randrange(3))] + [("retire", at + rng.randrange(1, 20))] * (k % 3 == 0)
        events += [(cell, batch, kind, start + timedelta(days=d)) for kind, d in own]
    events = sorted(set(events), key=lambda e: (e[3].toordinal() + rng.uniform(-2, 2)))  # files up to four days out of order
    events.append(("c0", "end", "submit", start + timedelta(days=200)))  # takes the watermark past all others
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        source = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        step = -(-len(events) // 5)
        for k in range(5):
            spark.createDataFrame(events[k * step : (k + 1) * step], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            if k in (2, 4):  # a stop, and a restart from the checkpoint
                drained(R.replays(source(), 10, "5 days"), str(tmp_path))
        rows = spark.read.schema(R.ROW).parquet(f"{tmp_path}/rows").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {(r.cell, r.batch, r.kind, r.at, r.outcome) for r in rows}
    want = {w for w in plain(events, 10) if w[1] != "end"}
    assert got == want and len(rows) == len(got)
    assert {w[4] for w in want} >= {"held", "replayed", "late", "retired", "idle", "expired"}
