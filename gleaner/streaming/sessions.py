"""Search sessions online: the batch rules, row by row, per user."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.searchlog import REPHRASE_SECONDS

OUTPUT = "user {user}, q string, start_t double, start_seq bigint, n_acted bigint, first_acted {id}"
OUTPUT_COLUMNS = ["user", "q", "start_t", "start_seq", "n_acted", "first_acted"]
STATE = "open string, waiting string"
DAY = 86400.0


def _held(value):
    return None if value is None or value != value else value


def _whole(value):
    return None if _held(value) is None else int(value)


def _closed(user, session: dict) -> dict:
    acted = session["acted"]
    return {"user": user, "q": session["q"], "start_t": session["t"], "start_seq": session["seq"],
            "n_acted": len(acted), "first_acted": acted[0] if acted else None}


def sessionize_stream(
    events: DataFrame, gap: float = REPHRASE_SECONDS, delay: str = "10 minutes", idle: float = DAY
) -> DataFrame:
    """(user, q, start_t, start_seq, n_acted, first_acted) of sessions that are over.

    Events (ts, user, t, seq, type, q, id) wait until the watermark has passed them and are then taken in
    (t, seq) order. A session is over when the user's next one starts, or when nothing came for `idle` seconds.
    Events behind the watermark are dropped by Spark and show in the query's progress.
    """
    user_type, id_type = (events.schema[c].dataType.simpleString() for c in ("user", "id"))
    columns = ["t", "seq", "type", "q", "id"]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else (None, "[]")
        session = json.loads(stored[0]) if stored[0] else None
        waiting = json.loads(stored[1])
        if not state.hasTimedOut:
            for pdf in batches:
                # column by column: a frame's own methods cost more than the few rows that a user has
                cells = [pdf[c].tolist() for c in columns]
                waiting += [[float(t), int(seq), _held(kind), _held(q), i if isinstance(i, str) else _whole(i)]
                            for t, seq, kind, q, i in zip(*cells, strict=True)]
        now = state.getCurrentWatermarkMs() / 1000.0
        waiting.sort(key=lambda e: (e[0], e[1]))
        over = []
        split = sum(1 for e in waiting if e[0] < now)
        for t, seq, kind, q, item in waiting[:split]:
            if session and t - session["last"] >= idle:
                over.append(_closed(key[0], session))
                session = None
            if kind == "search":
                if session and session["q"] == q and t - session["t"] < gap:
                    session["last"] = t
                    continue
                if session:
                    over.append(_closed(key[0], session))
                session = {"q": q, "t": t, "seq": seq, "acted": [], "last": t}
            elif session and session["q"] == q:
                session["last"] = t
                if item not in session["acted"]:
                    session["acted"].append(item)
        waiting = waiting[split:]
        if session and not waiting and now - session["last"] >= idle:
            over.append(_closed(key[0], session))
            session = None
        if session or waiting:
            state.update((json.dumps(session) if session else None, json.dumps(waiting)))
            due = [waiting[0][0]] if waiting else []
            due += [session["last"] + idle] if session else []
            state.setTimeoutTimestamp(max(int(min(due) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame({c: pd.Series([row[c] for row in over], dtype=object) for c in OUTPUT_COLUMNS})

    keyed = events.withWatermark("ts", delay).select("ts", "user", *columns)
    return keyed.groupBy("user").applyInPandasWithState(
        advance, OUTPUT.format(user=user_type, id=id_type), STATE, "append", GroupStateTimeout.EventTimeTimeout)
