"""Session filters kept up to date as turns arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold(bag: dict, change: dict | None) -> dict:
    """One turn's filters onto the bag: None clears, lists add, anything else replaces."""
    out = dict(bag)
    for key, value in (change or {}).items():
        held = out.pop(key, None) if value is None else out.get(key)
        if isinstance(value, list) and isinstance(held, list):
            out[key] = held + [v for i, v in enumerate(value) if v not in held and v not in value[:i]]
        elif value is not None:
            out[key] = value
    return out


def note(events: dict, turn: int, change: dict | None) -> None:
    """One turn into a session's events, whatever turns came before it.

    ``events`` holds per key the last turn that was not a list, with its value, and the lists of
    later turns. Only these decide the bag; what an earlier or repeated turn adds is void.
    """
    for key, value in (change or {}).items():
        held = events.setdefault(key, {"reset": None, "value": None, "lists": {}})
        if held["reset"] is not None and turn <= held["reset"]:
            continue
        if isinstance(value, list):
            held["lists"][str(turn)] = value
        else:
            held["reset"], held["value"] = turn, value
            held["lists"] = {t: v for t, v in held["lists"].items() if int(t) > turn}


def in_force(events: dict) -> dict:
    """The bag that folding the turns in order would give."""
    bag: dict = {}
    for key, held in events.items():
        bag = fold(bag, {key: held["value"]})
        for turn in sorted(held["lists"], key=int):
            bag = fold(bag, {key: held["lists"][turn]})
    return bag


def accumulate_stream(turns: DataFrame, session: str = "session_id", turn: str = "turn_idx", filters: str = "filters") -> DataFrame:
    """Streaming ``(session_id, turn_idx, filters)``: the JSON bag in force after each micro-batch.

    Turns may arrive in any order and more than once; the result is that of the batch form,
    ``operators.sessions.merge_filters``. State per session is, for each key, the last turn that
    set or cleared it and the lists added since, so it grows with the filters in force and not with
    the session; a task holds one session's turns of one micro-batch, whose size the source limits.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, -1)
        for frame in frames:
            for idx, change in frame[[turn, filters]].itertuples(index=False, name=None):
                note(events, int(idx), json.loads(change) if change else None)
                last = max(last, int(idx))
        state.update((json.dumps(events), last))
        yield pd.DataFrame({session: [key[0]], turn: [last], filters: [json.dumps(in_force(events), sort_keys=True)]})

    narrow = turns.select(F.col(session).cast("string"), F.col(turn).cast("bigint"), F.col(filters).cast("string"))
    return narrow.groupBy(session).applyInPandasWithState(
        step,
        outputStructType=f"{session} string, {turn} bigint, {filters} string",
        stateStructType="events string, last bigint",
        outputMode="update",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def note_compact(held: dict, turn: int, value) -> None:
    """One turn's value for one key into its compact state; see :func:`accumulate_with_lifetime`."""
    if held["reset"] is not None and turn <= held["reset"]:
        return
    if isinstance(value, list):
        held["lists"][str(turn)] = value
        return
    held["reset"], held["value"] = turn, value
    held["lists"] = {t: v for t, v in held["lists"].items() if int(t) > turn}
    if held["first"] and held["first"][0] <= turn:
        held["first"] = None
    held["items"] = [x for x in held["items"] if x[0] > turn]


def compact(held: dict, settled: int) -> None:
    """Folds the lists of turns up to ``settled`` into the opening list and the first mention of each further item."""
    old = sorted((int(t) for t in held["lists"] if int(t) <= settled))
    for turn in old:
        value = held["lists"].pop(str(turn))
        if held["first"] is None:
            held["first"] = [turn, value]
            continue
        if turn < held["first"][0]:
            held["first"], (turn, value) = [turn, value], held["first"]
        held["items"] += [[turn, pos, item] for pos, item in enumerate(value)]
    known: list = []
    for entry in sorted(held["items"], key=lambda x: x[:2]):
        if entry[2] not in held["first"][1] and all(entry[2] != k[2] for k in known):
            known.append(entry)
    held["items"] = known


def bag_of(states: dict) -> dict:
    """The bag that folding the turns in order would give."""
    bag: dict = {}
    for key, held in states.items():
        bag = fold(bag, {key: held["value"]})
        if held["first"]:
            lists = [(int(t), v) for t, v in held["lists"].items()] + [(held["first"][0], held["first"][1])]
            lists += [(turn, [item]) for turn, _, item in held["items"]]
        else:
            lists = [(int(t), v) for t, v in held["lists"].items()]
        for _, value in sorted(lists, key=lambda x: x[0]):
            bag = fold(bag, {key: value})
    return bag


class LastingFilters(StatefulProcessor):
    """Map state per filter key, and the newest turn; both expire after their lifetime."""

    def __init__(self, session: str, turn: str, filters: str, disorder: int, lifetime_ms: int | None):
        self.session, self.turn, self.filters, self.disorder, self.lifetime_ms = session, turn, filters, disorder, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "held string", self.lifetime_ms)
        self.last = handle.getValueState("last", "turn bigint", self.lifetime_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states = {k[0]: json.loads(v[0]) for k, v in self.keys.iterator()}
        last = self.last.get()[0] if self.last.exists() else -1
        for frame in rows:
            for idx, change in frame[[self.turn, self.filters]].itertuples(index=False, name=None):
                for name, value in (json.loads(change) if change else {}).items():
                    held = states.setdefault(name, {"reset": None, "value": None, "first": None, "items": [], "lists": {}})
                    note_compact(held, int(idx), value)
                last = max(last, int(idx))
        for name, held in states.items():
            compact(held, last - self.disorder)
            self.keys.updateValue((name,), (json.dumps(held),))
        self.last.update((last,))
        yield pd.DataFrame({self.session: [key[0]], self.turn: [last], self.filters: [json.dumps(bag_of(states), sort_keys=True)]})

    def close(self) -> None:
        pass


def accumulate_with_lifetime(
    turns: DataFrame, session: str = "session_id", turn: str = "turn_idx", filters: str = "filters", *, disorder: int = 64, lifetime_ms: int | None = None
) -> DataFrame:
    """Like :func:`accumulate_stream`, with bounded state: per session and key the last reset, the list that opens the key, the first mention of each
    further item, and the lists of the last ``disorder`` turns as they are.

    Lists may come in any order and however late. A turn that clears or sets a key may come up to ``disorder`` turns late, else an item that was
    named both before and after it may be lost. State that was not touched for ``lifetime_ms`` is dropped. Streams need the RocksDB
    state store (:func:`.ingest.state_on_disk`); a run that is to end (``availableNow``) with a lifetime also needs
    ``spark.sql.streaming.noDataMicroBatches.enabled=false``, as clocks would else keep it going.
    """
    narrow = turns.select(F.col(session).cast("string"), F.col(turn).cast("bigint"), F.col(filters).cast("string"))
    return narrow.groupBy(session).transformWithStateInPandas(
        statefulProcessor=LastingFilters(session, turn, filters, disorder, lifetime_ms),
        outputStructType=f"{session} string, {turn} bigint, {filters} string",
        outputMode="Update",
        timeMode="ProcessingTime" if lifetime_ms else "None",
    )
