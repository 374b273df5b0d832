"""The cycle as a stateful stream: each entity's course in keyed state, driven by event time.

Triggers wait in state until the watermark (in milliseconds) has reached them and are then taken in time order,
so a course does not depend on how triggers are dealt to files or micro-batches, as long as
none is later than the watermark allows; later ones are dropped by the engine. Timers of
event time bring an entity back when its oldest waiting trigger is due.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessel.operators.cycle import OUTPUT, Course, Settings, _name, summarised


def _packed(kind: str, e: Any, found: Any) -> bytes:
    """A trigger as it waits: its vector's bytes and four numbers."""
    e = None if e is None else np.asarray(e)
    return pickle.dumps((kind, None if e is None else e.tobytes(), None if e is None else e.dtype.str, None if found is None else tuple(map(float, found))), 5)


def _opened(held: bytes) -> tuple:
    kind, e, dtype, found = pickle.loads(held)
    return kind, None if e is None else np.frombuffer(e, dtype), found


class CourseProcessor(StatefulProcessor):
    """Holds a course and its waiting triggers; gives what the course does once the watermark has passed."""

    def __init__(self, settings: Settings, entity: str) -> None:
        self.settings, self.entity = settings, entity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.course = handle.getValueState("course", "held binary")
        self.waiting = handle.getListState("waiting", "at double, nth bigint, trigger binary")

    def _advance(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Take what is due of the waiting triggers and the given ones; the rest waits on."""
        held = self.course.get()
        course = Course(self.settings, _name(key[0]), **(pickle.loads(held[0]) if held else {}))
        triggers = sorted([*((r[0], r[1], bytes(r[2])) for r in self.waiting.get()), *rows], key=lambda r: r[:2])
        due = [r for r in triggers if int(r[0] * 1000) <= watermark]
        rest = triggers[len(due) :]
        out: list[tuple] = []
        for at, _, trigger in due:
            out += course.take(at, *_opened(trigger))
        if due:
            # the clock runs to the last trigger taken, as in a table
            out += course.upto(course.now)
            self.course.update((pickle.dumps({k: getattr(course, k) for k in Course.FIELDS}),))
        if due or rows:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(int(rest[0][0] * 1000) + 1)
        if out:
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            frame = pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*out, strict=True), strict=True)})
            frame.insert(0, self.entity, key[0])
            yield frame

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [
            (float(at), int(nth), _packed(kind, e, found))
            for frame in rows
            for at, nth, kind, e, found in zip(*(frame[c].tolist() for c in ("at", "nth", "kind", "e", "found")), strict=True)
        ]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_cycles(triggers: DataFrame, settings: Settings, late: str = "0 seconds", entity: str = "user_id") -> DataFrame:
    """cycles() over a stream of triggers (entity, ts, at, nth, kind, e, context or found), ts being at as a timestamp.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    kind = triggers.schema[entity].dataType.simpleString()
    if "found" not in triggers.columns:
        triggers = summarised(triggers, settings.validate())
    dealt = triggers.select(entity, "ts", "at", "nth", "kind", "e", "found").withWatermark("ts", late).groupBy(entity)
    return dealt.transformWithStateInPandas(CourseProcessor(settings.validate(), entity), f"{entity} {kind}, {OUTPUT}", "Append", "EventTime")
