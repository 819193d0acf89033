"""Search logs: what was searched, what was then acted on, and what that says about the search.

A session starts with a search. The same query again within `gap` of that start is the same search shown
again; an act belongs to the last session of its user if it has the same query. Whether a search starts a
session depends on where the last one started, so the log is read in order: every task scans one range of it,
and what one range hands to the next is a single row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordering import PART, POS, neighbours, stable_sorted

# What counts as acting on a result, where it was shown, and the limits of a valid record.
ACTIONS = ("open", "copy", "save", "share", "like", "album")
SECTIONS = ("matches", "maybe")
REPHRASE_SECONDS = 180.0
MAX_QUERY, MAX_RANK = 200, 10000


def valid_actions(acts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Acts that can be recorded: query trimmed, an out-of-range rank or unknown section as null."""
    q = F.regexp_replace("q", "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    ok = (q != "") & (F.length("q") <= MAX_QUERY) & F.col("action").isin(*ACTIONS)
    rank = F.when((F.col("rank") > 0) & (F.col("rank") < MAX_RANK), F.col("rank"))
    section = F.when(F.col("section").isin(*SECTIONS), F.col("section"))
    good = acts.filter(ok).withColumns({"q": q, "rank": rank, "section": section})
    return good if known is None else good.join(known.select("id"), "id", "left_semi")


class Open(NamedTuple):
    """The session a range of the log starts in: its user, query, and where it began."""

    user: object
    q: object
    t: float
    seq: int


def scan_sessions(
    user: np.ndarray, q: np.ndarray, t: np.ndarray, seq: np.ndarray, search: np.ndarray, gap: float, state: Open | None
) -> tuple[np.ndarray, np.ndarray, Open | None, bool]:
    """For rows in (user, t, seq) order: the session each belongs to (-1 none, -2 the one carried in, else the
    row that starts it), a mask of session starts, what to carry on, and whether that depends on `state`."""
    at = np.nonzero(search)[0]
    starts = np.zeros(len(t), dtype=bool)
    if len(at) == 0:
        last = np.full(len(t), -1)
        anchor_of = np.zeros(0, dtype=int)
        decided, carry = False, state
    else:
        su, sq, st = user[at], q[at], t[at]
        breaks = np.ones(len(at), dtype=bool)
        breaks[1:] = (su[1:] != su[:-1]) | (sq[1:] != sq[:-1]) | (st[1:] - st[:-1] >= gap)
        decided = bool(breaks[1:].any())
        if state is not None and su[0] == state.user and sq[0] == state.q:
            breaks[0] = st[0] - state.t >= gap
        anchors = breaks.copy()
        edges = np.append(np.nonzero(breaks)[0], len(at))
        runs = list(zip(edges[:-1], edges[1:]))
        if not breaks[0]:
            runs.insert(0, (0, edges[0]))
        for lo, hi in runs:
            from_t = st[lo] if breaks[lo] else state.t
            nxt = lo
            while st[hi - 1] - from_t >= gap:  # the same query goes on for longer than one session
                nxt += int(np.argmax(st[nxt:hi] - from_t >= gap))
                anchors[nxt] = True
                from_t = st[nxt]
        starts[at[anchors]] = True
        place = np.where(anchors, np.arange(len(at)), -1)
        anchor = np.maximum.accumulate(place)
        anchor_of = np.where(anchor >= 0, at[np.maximum(anchor, 0)], -2)
        last = np.cumsum(search) - 1
        end = anchor_of[-1]
        carry = Open(su[-1], sq[-1], float(t[end]), int(seq[end])) if end >= 0 else Open(su[-1], sq[-1], state.t, state.seq)
    owner = np.full(len(t), -1)
    known = last >= 0
    if known.any():
        rows = at[last[known]]
        same = (user[known] == user[rows]) & (q[known] == q[rows])
        owner[known] = np.where(same, anchor_of[last[known]], -1)
    if state is not None and (~known).any():
        early = np.nonzero(~known)[0]
        owner[early] = np.where((user[early] == state.user) & (q[early] == state.q), -2, -1)
    return owner, starts, carry, decided


def _columns(batch: pa.RecordBatch):
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    search = np.asarray([x == "search" for x in batch.column("type").to_pylist()], dtype=bool)
    return get("user"), get("q"), get("t"), get("seq"), search


def _boundaries(rows: DataFrame, gap: float) -> dict[int, Open | None]:
    """The session each range starts in. A range is scanned again only when it holds nothing but one query of
    one user at short distances, so that where its sessions start depends on the range before."""
    types = {c: rows.schema[c].dataType.simpleString() for c in ("user", "q")}
    schema = f"part int, decided boolean, user {types['user']}, q {types['q']}, t double, seq bigint, searched boolean"

    def summarise(known: dict[int, Open | None]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, state, decided, searched = None, None, False, False
            for b in batches:
                if b.num_rows == 0:
                    continue
                if part is None:
                    part = b.column(PART)[0].as_py()
                    state = known.get(part)
                cols = _columns(b)
                before = state
                _, _, state, inside = scan_sessions(*cols, gap, state)
                if cols[4].any():
                    if searched and before is not None:
                        first = int(np.argmax(cols[4]))
                        inside = inside or cols[0][first] != before.user or cols[1][first] != before.q or cols[2][first] - last_t >= gap
                    searched, last_t = True, cols[2][np.nonzero(cols[4])[0][-1]]
                decided = decided or inside
            if part is not None:
                s = state or Open(None, None, None, None)
                yield pa.RecordBatch.from_pylist(
                    [{"part": part, "decided": decided, "user": s.user, "q": s.q, "t": s.t, "seq": s.seq, "searched": searched}],
                    schema=_arrow(schema))

        return run

    slim = rows.select("user", "q", "t", "seq", "type", PART)
    found = {r["part"]: r for r in slim.mapInArrow(summarise({}), schema).collect()}  # one row per task
    into: dict[int, Open | None] = {}
    carry: Open | None = None
    for part in sorted(found):
        into[part] = carry
        r = found[part]
        if not r["searched"]:
            continue
        if not r["decided"] and carry is not None:
            again = slim.filter(F.col(PART) == part).mapInArrow(summarise({part: carry}), schema).collect()
            r = again[0]
        carry = Open(r["user"], r["q"], r["t"], r["seq"])
    return into


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(p.split(" ")[0], kinds[p.split(" ")[1]]) for p in schema.split(", ")])


def attach_sessions(events: DataFrame, gap: float = REPHRASE_SECONDS) -> DataFrame:
    """Events (user, t, seq, type, q, …) with the start of their session (null for an act that has none)."""
    rows = stable_sorted(events.withColumns({"t": F.col("t").cast("double"), "seq": F.col("seq").cast("bigint")}), ["user"], [F.col("t"), F.col("seq")])
    into = _boundaries(rows, gap)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, started = None, False
        for b in batches:
            if b.num_rows and not started:
                state, started = into.get(b.column(PART)[0].as_py()), True
            user, q, t, seq, search = _columns(b)
            came = state
            owner, starts, state, _ = scan_sessions(user, q, t, seq, search, gap, state)
            inside, carried = owner >= 0, owner == -2
            at = np.maximum(owner, 0)
            start_t = np.where(carried, came.t if came else 0.0, t[at] if len(t) else 0.0)
            start_seq = np.where(carried, came.seq if came else 0, seq[at] if len(t) else 0)
            none = ~(inside | carried)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(start_t.astype(float), mask=none), pa.array(start_seq.astype(np.int64), mask=none), pa.array(starts)],
                names=[*b.schema.names, "start_t", "start_seq", "is_start"],
            )

    done = rows.mapInArrow(attach, f"{schema}, start_t double, start_seq bigint, is_start boolean")
    return done.drop(PART, POS)


KEY = ["user", "start_t", "start_seq"]


def session_acts(attached: DataFrame) -> DataFrame:
    """(user, start_t, start_seq, id, t, seq): the distinct items acted on in each session, where first."""
    acts = attached.filter((F.col("type") == "act") & F.col("start_t").isNotNull())
    return acts.groupBy(*KEY, "id").agg(F.min(F.struct("t", "seq")).alias("_f")).select(*KEY, "id", "_f.t", "_f.seq")


def sessions(attached: DataFrame) -> DataFrame:
    """One row per session: query, what it showed, how many items were acted on and which first."""
    shown = [c for c in ("matches", "maybe") if c in attached.columns]
    began = attached.filter("is_start").select("user", F.col("t").alias("start_t"), F.col("seq").alias("start_seq"), "q", *shown)
    acted = session_acts(attached).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_acted"), F.min_by("id", F.struct("t", "seq")).alias("first_acted")
    )
    return began.join(acted, KEY, "left").withColumn("n_acted", F.coalesce("n_acted", F.lit(0)))


def with_next(rows: DataFrame, gap: float = REPHRASE_SECONDS) -> DataFrame:
    """Add `rephrased`: nothing was acted on, and the user's next session soon after found something."""
    n = neighbours(
        rows, ["user"], [F.col("start_t"), F.col("start_seq")],
        lead={"next_t": "start_t", "next_acted": "n_acted", "next_first": "first_acted"},
    )
    soon = (F.col("n_acted") == 0) & (F.col("next_acted") > 0) & (F.col("next_t") - F.col("start_t") < gap)
    return n.withColumn("rephrased", F.coalesce(soon, F.lit(False)))


def search_summary(rows: DataFrame) -> DataFrame:
    """Counts only: how many searches found what they were for, and where it was. Takes `with_next` rows."""
    found = F.col("n_acted") > 0
    first = F.col("first_acted")
    in_matches = found & F.coalesce(F.array_contains("matches", first), F.lit(False))
    top = F.get(F.concat("matches", "maybe"), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(found).alias("found"),
        F.count_if(found & top.eqNullSafe(first)).alias("found_first"),
        F.count_if(in_matches).alias("found_in_matches"), F.count_if(found & ~in_matches).alias("found_in_maybe"),
        F.count_if("rephrased").alias("missed_then_rephrased"), F.count_if(~found).alias("nothing_acted"),
    )


def wanted_items(attached: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, id, place): what each wording was for, and the order its items come in."""
    acted = session_acts(attached).join(rows.select(*KEY, "q"), KEY).select(
        F.col("q").alias("query"), "id", F.struct(F.lit(0).alias("phase"), "start_t", "start_seq", "user", "t", "seq").alias("place"))
    missed = rows.filter("rephrased").select(
        F.col("q").alias("query"), F.col("next_first").alias("id"),
        F.struct(F.lit(1).alias("phase"), "start_t", "start_seq", "user", F.col("start_t").alias("t"), F.col("start_seq").alias("seq")).alias("place"))
    return acted.unionByName(missed).groupBy("query", "id").agg(F.min("place").alias("place"))


def export_queries(wanted: DataFrame, relpaths: DataFrame) -> DataFrame:
    """(query, expected): the files each wording was for, `;` between them; nothing for unknown items."""
    named = wanted.join(relpaths.select("id", "relpath"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("place", "id", "relpath")))
    return named.groupBy("query").agg(F.array_join(F.transform(ordered, lambda x: x["relpath"]), ";").alias("expected"))


def write_queries(exported: DataFrame, path: str) -> None:
    exported.select("query", "expected").write.mode("overwrite").option("header", True).csv(path)
