"""Chat histories kept compact as their turns arrive: the last rounds and a summary of what came before, a state a conversation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators.conversation import BUDGET, ROUNDS

COLUMNS = ["conv_id", "turn", "role", "text"]


def compacted(stream: DataFrame, budget: int = BUDGET, rounds: int = ROUNDS, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text): in each batch the compact histories of the conversations that it has turns of (conv_id, turn, role, text).

    As conversation.compact() over all turns so far: all of them while they fit the budget, then the last 2 * rounds by (turn, role, text)
    behind a summary of the others at turn -1. Whatever order turns come in, others are only counted, so the state of a long
    conversation is a few turns and three numbers. With idle_ms a conversation without news for so long is
    dropped; a stream that should end by itself (availableNow) has none, since timers keep it running.
    """
    keep = 2 * rounds
    rows = stream.select("conv_id", "turn", "role", "text", X.token_estimate(F.coalesce("text", F.lit(""))).alias("cost"))

    def order(t: list) -> list:
        return [(v is not None, v or ("" if i else 0)) for i, v in enumerate(t)]

    def add(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({c: pd.Series(dtype="object") for c in COLUMNS})
            return
        n, chars, cost, held = state.get if state.exists else (0, 0, 0, "[]")
        kept = json.loads(held)
        for frame in frames:
            cost += int(frame["cost"].sum())
            kept += [[None if pd.isna(v) else v for v in t] for t in zip(frame["turn"].tolist(), frame["role"], frame["text"], strict=True)]
        if cost > budget:
            kept.sort(key=order)
            gone, kept = kept[: max(0, len(kept) - keep)], kept[-keep:]
            n, chars = n + len(gone), chars + sum(len(t[2] or "") for t in gone)
        state.update((n, chars, cost, json.dumps(kept)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        own = [(key[0], *t) for t in kept]
        if n:
            own.append((key[0], -1, "user", f"Earlier turns: {n}, characters: {chars}"))
        yield pd.DataFrame(own, columns=COLUMNS)

    state = "n long, chars long, cost long, turns string"
    return rows.groupBy("conv_id").applyInPandasWithState(add, "conv_id long, turn long, role string, text string", state, "update", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def last_states(updates: DataFrame) -> DataFrame:
    """Each conversation's rows in the last batch that had any of it; updates as jobs.run_updates() writes them (with batch)."""
    last = updates.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["conv_id", "batch"]).drop("batch")
