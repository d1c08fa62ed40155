"""In-flight reservations: a run's asks, settlements and releases as a stream with keyed state.

Events: run, seq (gapless from 0 in a run), kind, cell, shares (provider and usd). `ask` wants its projected shares
admitted: beside what is spent and held already they must pass neither the run's ceiling nor that of a provider the cell
spends under. An admitted ask is held; `spend` adds what was really paid, and says nothing about what is held; `settle`
gives the hold back, and does nothing where there is none. Every event gives one row: its outcome and the run's book after
it. Events that come before their turn wait, repeats are passed over, so files may arrive in any order and any batches.

A run's book is one key's state, as each decision needs all before it; runs are spread over tasks. Events that wait lie in
the state store by blocks of their numbers; a task holds HELD new ones and one block, however long the run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "run string, seq long, kind string, cell string, shares array<struct<provider: string, usd: double>>"
ROW = "run string, seq long, kind string, cell string, outcome string, spent double, held double"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
#: numbers in a block of waiting events; events that are held before they go to their blocks
BLOCK, HELD = 4096, 100_000


class Book:
    """A run's state: the next event, what is spent and held by provider, holds by cell, and events that wait."""

    def __init__(self, total: float | None, ceilings: dict[str, float], next_: int = 0, spent=None, holds=None):
        self.total, self.ceilings, self.next = total, ceilings, next_
        self.spent: dict[str, float] = spent or {}
        self.holds: dict[str, dict[str, float]] = holds or {}

    def held(self, provider: str | None = None) -> float:
        return sum(usd for shares in self.holds.values() for p, usd in shares.items() if provider in (None, p))

    def tripped(self, shares: dict[str, float]) -> str | None:
        for p, usd in shares.items():
            if usd > 0 and p in self.ceilings and self.spent.get(p, 0.0) + self.held(p) + usd > self.ceilings[p]:
                return f"budget_exceeded:{p}"
        if self.total is not None and sum(self.spent.values()) + self.held() + sum(shares.values()) > self.total:
            return "budget_exceeded"
        return None

    def take(self, kind: str, cell: str, shares: dict[str, float]) -> str:
        self.next += 1
        if kind == "ask":
            if cell in self.holds:
                return "held"
            if refused := self.tripped(shares):
                return refused
            self.holds[cell] = shares
            return "admitted"
        if kind == "spend":
            for p, usd in shares.items():
                self.spent[p] = self.spent.get(p, 0.0) + usd
            return "spent"
        if kind == "settle":
            return "idle" if self.holds.pop(cell, None) is None else "settled"
        raise ValueError(f"unknown event {kind!r}")

    def row(self, run: str, seq: int, kind: str, cell: str, outcome: str) -> tuple:
        return run, seq, kind, cell, outcome, sum(self.spent.values()), self.held()


def summed(shares) -> dict[str, float]:
    out: dict[str, float] = {}
    for s in shares if shares is not None else ():
        out[s["provider"]] = out.get(s["provider"], 0.0) + s["usd"]
    return dict(sorted(out.items()))


class Reservations(StatefulProcessor):
    def __init__(self, total: float | None, ceilings: dict[str, float]):
        self.total, self.ceilings = total, ceilings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.spent = handle.getMapState("spent", "provider string", "usd double")
        self.holds = handle.getMapState("holds", "cell string", "providers array<string>, usd array<double>")
        self.pieces = handle.getMapState("pieces", "block long", "n int")
        self.waiting = handle.getMapState("waiting", "block long, piece int", "events string")

    def wait(self, events: list[list]) -> None:
        """Put events(seq, kind, cell, shares) into their blocks, a piece for each; nothing is read but the number of pieces."""
        for block, own in groupby(sorted(events, key=lambda e: e[0]), key=lambda e: e[0] // BLOCK):
            n = self.pieces.getValue((block,))[0] if self.pieces.containsKey((block,)) else 0
            self.waiting.updateValue((block, n), (json.dumps(list(own)),))
            self.pieces.updateValue((block,), (n + 1,))

    def turns(self, book: Book) -> Iterator[list[list]]:
        """Events of the block whose turn it is, in order, as long as the book comes to a block's end."""
        while self.pieces.containsKey((block := book.next // BLOCK,)):
            n = self.pieces.getValue((block,))[0]
            yield sorted((e for k in range(n) for e in json.loads(self.waiting.getValue((block, k))[0])), key=lambda e: e[0])
            if book.next // BLOCK == block:
                return  # its next event is yet to come
            for k in range(n):
                self.waiting.removeKey((block, k))
            self.pieces.removeKey((block,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self.next.get()
        spent = {k[0]: v[0] for k, v in self.spent.iterator()}
        holds = {k[0]: dict(zip(v[0], v[1])) for k, v in self.holds.iterator()}
        book, new = Book(self.total, self.ceilings, got[0] if got else 0, dict(spent), {c: dict(s) for c, s in holds.items()}), []
        for part in rows:
            for seq, kind, cell, shares in zip(part["seq"], part["kind"], part["cell"], part["shares"]):
                if seq >= book.next:
                    new.append([int(seq), kind, cell, list(summed(shares).items())])
            if len(new) >= HELD:
                self.wait(new)
                new = []
        self.wait(new)
        for events in self.turns(book):
            out = [book.row(key[0], seq, kind, cell, book.take(kind, cell, dict(shares))) for seq, kind, cell, shares in events if seq == book.next]
            yield pd.DataFrame(out, columns=COLUMNS)
        self.next.update((book.next,))
        for p, usd in book.spent.items():
            if spent.get(p) != usd:
                self.spent.updateValue((p,), (usd,))
        for c in set(holds) - set(book.holds):
            self.holds.removeKey((c,))
        for c in set(book.holds) - set(holds):
            self.holds.updateValue((c,), (list(book.holds[c]), list(book.holds[c].values())))

    def close(self) -> None:
        pass


def reserve(events: DataFrame, total: float | None = None, ceilings: dict[str, float] | None = None) -> DataFrame:
    """Stream of events -> stream of rows, appended; needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    keyed = events.select("run", "seq", "kind", "cell", "shares").groupBy("run")
    return keyed.transformWithStateInPandas(Reservations(total, ceilings or {}), ROW, "append", "none")


def booked(events: DataFrame, total: float | None = None, ceilings: dict[str, float] | None = None) -> DataFrame:
    """The same rows of a table of events that is all there: sorted by run and number, and read once; a task holds one book."""

    def book(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = object(), Book(None, {})
        for part in parts:
            out = []
            for run, seq, kind, cell, shares in zip(part["run"], part["seq"], part["kind"], part["cell"], part["shares"]):
                if run != own:
                    own, state = run, Book(total, ceilings or {})
                if seq == state.next:  # not a repeat, nor behind a gap
                    out.append(state.row(run, seq, kind, cell, state.take(kind, cell, summed(shares))))
            yield pd.DataFrame(out, columns=COLUMNS)

    rows = events.where("seq is not null").select("run", "seq", "kind", "cell", "shares")
    return rows.repartition("run").sortWithinPartitions("run", "seq").mapInPandas(book, ROW)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, folder: str) -> None:
    """Run a stream over all that is there, into Parquet under `folder`, its checkpoint beside it; a restart goes on from there."""
    spark = stream.sparkSession
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def rows_of(folder: str, spark, schema: str = ROW) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/rows")
