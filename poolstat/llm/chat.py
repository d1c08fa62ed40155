"""Chat formatting by minimum-cost role repair: dynamic programming over a legal-turn automaton.

Legal: an optional system turn, then user and assistant in turn, user first, assistant last.
A turn may merge into the one before it (same final role), be relabelled, or follow an empty insertion.
Control marks inside a text are escaped with a backslash (`unescaped` takes it away), so no text can open a turn.

Defined results: null or unknown roles cost a relabel to anything; null text renders empty; every row with a null
conv_id is a conversation of its own; ties go to the earlier option; repeated rows are turns of their own; turns are
ordered by turn, role, text, nulls first; an empty table gives no rows; other columns are ignored. A conversation is
rendered whole, so one task holds it and its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE, RELABEL, INSERT = 1, 2, 3
ROLES = ("system", "user", "assistant")
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, bool, list[str]]]]:
    """Cost, and for each turn its final role, whether it merges, and roles inserted before it."""
    best: dict = {None: 0}
    back: list[dict] = []
    for role in roles:
        now: dict = {}
        step: dict = {}
        for state, cost in best.items():
            options = [(state, True, [], MERGE)] if state else []
            for a in NEXT[state]:
                options.append((a, False, [], 0))
                options += [(b, False, [a], INSERT) for b in NEXT[a]]
            for to, merged, added, price in options:
                c = cost + price + (RELABEL if to != role else 0)
                if to not in now or c < now[to]:
                    now[to], step[to] = c, (state, merged, added)
        best = now
        back.append(step)
    closed = {s: c + (0 if s == "assistant" else INSERT if s == "user" else 2 * INSERT) for s, c in best.items() if s}
    if not closed:
        return 0, []
    state = min(closed, key=lambda s: (closed[s], ROLES.index(s)))
    total, out = closed[state], []
    for step in reversed(back):
        before, merged, added = step[state]
        out.append((state, merged, added))
        state = before
    return total, out[::-1]


def escaped(text: str | None) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text or "")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(roles: list[str | None], texts: list[str | None]) -> tuple[int, str, str]:
    cost, plan = repair(roles)
    turns: list[list] = []
    for (role, merged, added), text in zip(plan, texts):
        turns += [[a, []] for a in added]
        if merged:
            turns[-1][1].append(escaped(text))
        else:
            turns.append([role, [escaped(text)]])
    while turns and turns[-1][0] != "assistant":
        turns.append([NEXT[turns[-1][0]][0], []])
    body = "".join(f"<|{r}|>\n" + "\n".join(t) + "<|end|>\n" for r, t in turns)
    return cost, ",".join(r for r, _ in turns), body


def format_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, n_turns, cost, roles, rendered.

    Rows stream through sorted partitions; a task holds one conversation at a time.
    """
    schema = "conv_id long, n_turns long, cost long, roles string, rendered string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, roles, texts, out, held = (), [], [], [], 0

        def close():
            if key:
                cost, seq, body = render(roles, texts)
                out.append((key[0], len(roles), cost, seq, body))
            return sum(map(len, (x for x in texts if x)))

        for part in parts:
            for c, own, r, t in zip(part["conv_id"].astype(object), part["own"], part["role"], part["text"]):
                k = (None if pd.isna(c) else int(c), own)
                if k != key:
                    held += close()
                    key, roles, texts = k, [], []
                    if held > 4_000_000:
                        yield pd.DataFrame(out, columns=schema_names).astype({"conv_id": "Int64"})
                        out, held = [], 0
                roles.append(None if r is None else r)
                texts.append(None if t is None else t)
        close()
        yield pd.DataFrame(out, columns=schema_names).astype({"conv_id": "Int64"})

    schema_names = ["conv_id", "n_turns", "cost", "roles", "rendered"]
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)  # rows without a conversation are dealt apart
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), own.alias("own"), "turn", "role", "text")
    return rows.repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "turn", "role", "text").mapInPandas(run, schema)
