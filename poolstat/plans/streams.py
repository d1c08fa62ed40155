"""Queries of keyed state: the same events as a table and as a stream."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolstat.sources.tables import shared_dir, table, written
from poolstat.streaming import replays as RP
from poolstat.streaming import reservations as RE

#: Each order asks for its price, in thousands, under its status; two orders later every third one pays four fifths, and all settle.
_ORDERS = "'r' || (o_custkey % 25) as run, cast(o_orderkey as {text}) as cell, o_orderstatus as provider, floor(o_totalprice / 1000) as usd, o_orderkey"
TOTAL, CEILINGS = 4000.0, {"F": 1500.0}


def _events(s, d):
    own = table(s, d, "orders").selectExpr(*_ORDERS.format(text="string").split(", "))
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("o_orderkey")) - 1)
    step = lambda kind, pos, usd: F.struct(F.lit(kind).alias("kind"), F.expr(pos).alias("pos"), F.expr(usd).cast("double").alias("usd"))
    steps = own.select("run", "cell", "provider", "o_orderkey", F.explode(F.array(step("ask", "3 * k", "usd"), step("spend", "3 * k + 7", "floor(usd * 4 / 5)"), step("settle", "3 * k + 8", "0"))).alias("e"))
    steps = steps.where("e.kind <> 'spend' or o_orderkey % 3 = 0").withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy("e.pos")) - 1)
    shares = F.when(F.col("e.kind") != "settle", F.array(F.struct("provider", F.col("e.usd").alias("usd"))))
    return steps.select("run", F.col("seq").cast("long").alias("seq"), "e.kind", "cell", shares.alias("shares"))


def _streamed(s, d):
    """The events as files in no order, read a few at a time."""
    source = _files(s, _events(s, d).repartition(6, F.pmod(F.xxhash64("run", "seq"), F.lit(6))), 2)
    return _drained(s, RE.reserve(source, TOTAL, CEILINGS), RE.ROW)


def _files(s, rows, at_once):
    """A table written as files, read back as a stream."""
    files = written(rows)
    return s.readStream.schema(files.schema).option("maxFilesPerTrigger", at_once).parquet(files.inputFiles()[0].rsplit("/", 1)[0])


def _drained(s, stream, schema):
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    RE.drained(stream, folder)
    return RE.rows_of(folder, s, schema)


_BATCHES = "'n' || c_nationkey as cell, 'b' || c_custkey as batch, c_custkey % 200 as sent, c_custkey % 200 + cast(floor(abs(c_acctbal)) as int) % 120 as answered, c_custkey % 7 = 0 as retires"
RETENTION, DAYS, START = 60, 1000, 19_723  # days; the first is 2024-01-01


def _replayed(s, d):
    """Batches of customers: sent on some day, answered up to 120 days later, every seventh retired on its fortieth day."""
    own = table(s, d, "customer").selectExpr(*_BATCHES.split(", "))
    event = lambda kind, day: F.struct(F.lit(kind).alias("kind"), day.cast("int").alias("day"))
    retire = F.when(F.col("retires"), event("retire", F.col("sent") + 40))
    rows = own.select("cell", "batch", F.explode(F.filter(F.array(event("submit", F.col("sent")), event("reply", F.col("answered")), retire), lambda e: e.isNotNull())).alias("e")).select("cell", "batch", "e.*")
    last = own.agg(F.max("cell").alias("cell")).select("cell", F.lit("end").alias("batch"), F.lit("submit").alias("kind"), F.lit(DAYS).alias("day"))  # takes the watermark past all others
    rows = rows.union(last).withColumn("at", F.timestamp_seconds((F.col("day") + START).cast("long") * 86400))
    source = _files(s, rows.repartitionByRange(4, "day"), 4)
    out = _drained(s, RP.replays(source, RETENTION, "400 days"), RP.ROW).where("batch <> 'end'")
    return out.select("cell", "batch", "kind", (F.unix_seconds("at") / 86400 - START).cast("int").alias("day"), "outcome")


REPLAYED = f"""with o as (select {_BATCHES} from customer),
 t as (select *, retires and sent + 40 < answered as gone, answered - sent > {RETENTION} as old from o)
 select cell, batch, 'submit' kind, sent as day, 'held' outcome from t union all select cell, batch, 'reply', answered, case when gone or old then 'late' else 'replayed' end from t
 union all select cell, batch, 'retire', sent + 40, case when answered <= sent + 40 then 'idle' else 'retired' end from t where retires
 union all select cell, batch, 'expire', sent + {RETENTION}, 'expired' from t where old and not gone"""


def _book_sql() -> str:
    """One state a run: sums spent, holds, and the rows so far."""
    held = "coalesce(list_sum(list_transform(a.holds, lambda h: h.usd)), 0)"
    held_f = "coalesce(list_sum(list_transform(list_filter(a.holds, lambda h: h.p = 'F'), lambda h: h.usd)), 0)"
    over_f = f"(b.p = 'F' and b.usd > 0 and a.f + {held_f} + b.usd > {CEILINGS['F']})"
    over = f"(a.spent + {held} + b.usd > {TOTAL})"
    asked = f"case when {over_f} then 'budget_exceeded:F' when {over} then 'budget_exceeded' else 'admitted' end"
    outcome = f"case b.kind when 'ask' then {asked} when 'spend' then 'spent' else case when len(list_filter(a.holds, lambda h: h.cell = b.cell)) > 0 then 'settled' else 'idle' end end"
    holds = f"case when b.kind = 'settle' then list_filter(a.holds, lambda h: h.cell <> b.cell) when b.kind = 'ask' and not {over_f} and not {over} then list_append(a.holds, {{'cell': b.cell, 'p': b.p, 'usd': b.usd}}) else a.holds end"
    spent = "a.spent + case when b.kind = 'spend' then b.usd else 0 end"
    state = "{{'kind': {kind}, 'cell': {cell}, 'p': {p}, 'usd': {usd}, 'spent': {spent}, 'f': {f}, 'holds': {holds}, 'out': {out}}}"
    no_holds, no_rows = "[]::struct(cell varchar, p varchar, usd double)[]", "[]::struct(outcome varchar, spent double, held double)[]"
    event = state.format(kind="kind", cell="cell", p="provider", usd="usd::double", spent="0::double", f="0::double", holds=no_holds, out=no_rows)
    first = state.format(kind="''", cell="''", p="''", usd="0::double", spent="0::double", f="0::double", holds=no_holds, out=no_rows)
    now = f"coalesce(list_sum(list_transform({holds}, lambda h: h.usd)), 0)"
    row = f"list_append(a.out, {{'outcome': {outcome}, 'spent': ({spent})::double, 'held': ({now})::double}})"
    after = state.format(kind="''", cell="''", p="''", usd="0::double", spent=f"({spent})::double", f="(a.f + case when b.kind = 'spend' and b.p = 'F' then b.usd else 0 end)::double", holds=holds, out=row)
    return f"""with o as (select *, row_number() over (partition by run order by o_orderkey) - 1 as k from (select {_ORDERS.format(text="varchar")} from orders)),
 e as (select run, cell, provider, 'ask' as kind, 3 * k as pos, usd from o union all select run, cell, provider, 'spend', 3 * k + 7, floor(usd * 4 / 5) from o where o_orderkey % 3 = 0 union all select run, cell, provider, 'settle', 3 * k + 8, 0 from o),
 n as (select *, row_number() over (partition by run order by pos) - 1 as seq from e),
 r as (select run, list_reduce(list_prepend({first}, list({event} order by seq)), lambda a, b: {after}).out as out from n group by run)
select n.run, n.seq, kind, cell, out[seq + 1].outcome outcome, out[seq + 1].spent spent, out[seq + 1].held held from n join r on n.run = r.run"""


QUERIES = {
    "reservation_ledger": (lambda s, d: RE.booked(_events(s, d), TOTAL, CEILINGS), _book_sql()),
    "reservation_stream": (_streamed, _book_sql()),
    "replay_stream": (_replayed, REPLAYED),
}
