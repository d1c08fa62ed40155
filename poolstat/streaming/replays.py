"""Replay records with a retention age, as a stream with keyed state and timers.

Events: cell, batch, kind, at. `submit` leaves a record of a batch's handle; `reply` replays it, once, while it is not
older than the retention; `retire` takes it away; a record that nobody took expires. Events take effect in the order of
their times (submit before reply before retire before expiry at one time) once the watermark has passed them, so files may
come in any order within the watermark's delay, and a restart goes on from the checkpoint. An event behind the watermark is
dropped. Batches do not touch each other, so state is keyed by a hash of cell and batch in PARTS parts, few cells as many
alike. Outcomes: held (again, if the batch is held already), replayed, late (a reply to nothing that is held: expired,
taken, retired or never sent), retired, idle (nothing to retire), expired.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KINDS = ("submit", "reply", "retire", "expire")
ROW = "cell string, batch string, kind string, at timestamp, outcome string"
#: keys of the state; a part's records are read and written whole in each of its steps
PARTS = 256
STEP = "cell string, batch string, kind string, ms long, outcome string"
COLUMNS = [c.split()[0] for c in STEP.split(", ")]


def settle(events: list[tuple[int, int, str]], held: dict, until: int, retention: int) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str]]]:
    """(rows, events left): what events (time, place of the kind, batch) up to `until` come to, in order; `held` is kept up to date."""
    rows, todo = [], list(events)
    heapify(todo)
    while todo and todo[0][0] <= until:
        at, kind, batch = heappop(todo)
        if kind == 0:
            outcome = "again" if batch in held else "held"
            if outcome == "held":
                held[batch] = at
                heappush(todo, (at + retention + 1, 3, batch))
        elif kind == 3:
            if held.get(batch, at) + retention + 1 != at:
                continue  # it was taken, or is another record by now
            del held[batch]
            at, outcome = at - 1, "expired"
        elif batch in held:
            del held[batch]
            outcome = "replayed" if kind == 1 else "retired"
        else:
            outcome = "late" if kind == 1 else "idle"
        rows.append((at, kind, batch, outcome))
    return rows, sorted(todo)


def named(cell: str | None, batch: str | None) -> tuple:
    """A batch of a cell as a tuple that sorts, nulls too."""
    return cell is not None, cell or "", batch is not None, batch or ""


def plain(name: tuple) -> tuple[str | None, str | None]:
    return name[1] if name[0] else None, name[3] if name[2] else None


class Replays(StatefulProcessor):
    def __init__(self, retention: int):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, kind int, cell string, batch string")
        self.held = handle.getListState("held", "cell string, batch string, at long")

    def step(self, more: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting = [(int(a), int(k), named(c, b)) for a, k, c, b in self.waiting.get()] + more
        held = {named(c, b): int(at) for c, b, at in self.held.get()}
        was = dict(held)
        rows, left = settle(waiting, held, watermark, self.retention)
        if held != was:
            self.held.put([(*plain(n), at) for n, at in held.items()]) if held else self.held.clear()
        if more or rows:
            self.waiting.put([(a, k, *plain(n)) for a, k, n in left]) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(max(left[0][0], watermark + 1))
        yield pd.DataFrame([(*plain(n), KINDS[k], a, o) for a, k, n, o in rows], columns=COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        more = [(int(ms), KINDS.index(kind), named(cell, batch)) for part in rows for ms, kind, cell, batch in zip(part["ms"], part["kind"], part["cell"], part["batch"])]
        yield from self.step(more, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.step([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def replays(events: DataFrame, retention: int, late: str = "1 day") -> DataFrame:
    """Stream of events(cell, batch, kind, at) -> stream of rows; retention in days. Needs the RocksDB state store."""
    part = F.pmod(F.xxhash64("cell", "batch"), F.lit(PARTS)).cast("int").alias("part")
    keyed = events.select(part, "cell", "batch", "kind", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late).groupBy("part")
    out = keyed.transformWithStateInPandas(Replays(retention * 86_400_000), STEP, "append", "EventTime")
    return out.select("cell", "batch", "kind", F.timestamp_millis("ms").alias("at"), "outcome")
