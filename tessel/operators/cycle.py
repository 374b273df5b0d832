"""The semiotic cycle: how a state of eight dimensions meets a trigger, and what follows from it.

One entity's course is an ordered state machine (`Course`): it takes triggers in time order
and, between them, its own clock's ticks: autonomous cycles, which rest while a conversation
lasts, and vigilance checks. `cycles` runs it over a table as an ordered fold; the streaming
form (`tessel.streaming.cycles`) runs the same machine in keyed state.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessel.operators.fold import ordered_fold

# The dimensions in order, what each weighs in a dissonance, and how fast each moves.
DIMENSIONS = ("firstness", "secondness", "thirdness", "dispositions", "orientations", "engagements", "pertinences", "valeurs")
DISSONANCE_WEIGHTS = (0.15, 0.25, 0.20, 0.10, 0.10, 0.05, 0.05, 0.10)
LEARNING_RATES = (0.1, 0.2, 0.05, 0.1, 0.08, 0.03, 0.15, 0.02)
# Weights of tenacity, authority, a priori and science in a change of belief.
FIXATION_WEIGHTS = (0.05, 0.25, 0.25, 0.45)

_FIRST, _SECOND, _THIRD, _ORIENTATIONS, _VALUES = 0, 1, 2, 4, 7


@dataclass
class Settings:
    """What a course depends on; vectors have one width. reference: the tensor that drift is measured against, or None for no vigilance."""

    start: np.ndarray
    reference: np.ndarray | None = None
    articles: np.ndarray | None = None  # one vector an article, critical ones named by `critical`
    critical: tuple[int, ...] = ()
    anchors: np.ndarray | None = None
    themes: np.ndarray | None = None  # inputs of autonomous cycles
    fixation: tuple[float, float, float, float] = FIXATION_WEIGHTS
    delta_max: float = 0.001
    shock: float = 0.3
    speak: float = 0.6
    hard_negative: float = 0.1
    cumulative: float = 0.01
    per_cycle: float = 0.002
    per_dimension: float = 0.05
    critical_multiplier: float = 2.0
    every: float | None = None  # seconds between autonomous cycles
    vigilance: float | None = None  # seconds between vigilance checks
    hold: float = 0.0  # seconds that a conversation lasts after a user's trigger
    weights: tuple[float, ...] = field(default=DISSONANCE_WEIGHTS)
    rates: tuple[float, ...] = field(default=LEARNING_RATES)

    def validate(self) -> Settings:
        """self, if its ranges hold; a ValueError names the first that does not."""
        rules = {
            "fixation weights must sum to 1": abs(sum(self.fixation) - 1) < 0.01,
            "dissonance weights must sum to 1": abs(sum(self.weights) - 1) < 0.01,
            "cumulative must lie between 0 and 1": 0 < self.cumulative < 1,
            "per_cycle must lie between 0 and 1": 0 < self.per_cycle < 1,
            "per_dimension must lie between 0 and 1": 0 < self.per_dimension < 1,
            "critical_multiplier must exceed 1": self.critical_multiplier > 1,
            "delta_max must be positive": self.delta_max > 0,
            "intervals must be positive": all(x is None or x > 0 for x in (self.every, self.vigilance)) and self.hold >= 0,
            "autonomous cycles need themes": self.every is None or (self.themes is not None and len(self.themes) > 0),
            "tensors must have eight dimensions": len(self.start) == 8 and (self.reference is None or len(self.reference) == 8),
        }
        for name, holds in rules.items():
            if not holds:
                raise ValueError(name)
        return self


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.array(x, float), where=size > 0)


def cosines(rows: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Cosine of each row with e; 0 where either is zero."""
    size = np.linalg.norm(rows, axis=1) * np.linalg.norm(e)
    return np.divide(rows @ e, size, out=np.zeros(len(rows)), where=size > 0)


#: What a cycle needs of what retrieval found for an input, whatever the state: rows, hard negatives, the nearest one's cosine, the mean proof.
Found = tuple[float, float, float, float]


def found(e: np.ndarray | None, context, s: Settings) -> Found | None:
    """The summary of an input's context; None without one."""
    if e is None or not len(e) or context is None or not len(context):
        return None
    e, context = unit(np.asarray(e, float)), np.array([np.asarray(c, float) for c in context])
    near = cosines(context, e)
    proof = context @ e / (np.linalg.norm(context, axis=1) + 1e-8)
    return float(len(context)), float((near < s.hard_negative).sum()), float(near.max()), float(proof.mean())


def summarised(df: DataFrame, s: Settings) -> DataFrame:
    """df with `found` in place of `context`: four numbers instead of vectors, so that they are all that is shuffled and held."""
    kept = [f for f in df.schema.fields if f.name != "context"]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "found array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = zip(part.column(place("e")).to_pylist(), part.column(place("context")).to_pylist(), strict=True)
                out = pa.array([found(e, c, s) for e, c in rows], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(place(f.name)) for f in kept), out], names=[*(f.name for f in kept), "found"])

    return df.mapInArrow(run, shape)


_ONES = np.ones(8)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class Course:
    """One entity's state over its triggers and its clock. All its parts are plain values, so it can be stored between micro-batches."""

    FIELDS = ("x", "checked", "cumulative", "state_id", "impacts", "begun", "autonomous", "checks", "talks", "now")

    def __init__(self, s: Settings, name: str = "", **held) -> None:
        self.s, self.name = s, name
        self.x, self.checked = np.array(s.start, float), None
        self.cumulative, self.state_id, self.impacts = 0.0, 0, 0
        self.begun, self.autonomous, self.checks, self.now = None, 0, 0, None
        self.talks: list[float] = []  # conversations that may still last
        for k, v in held.items():
            setattr(self, k, v)
        self._weights, self._rates = np.array(s.weights, float), np.array(s.rates, float)
        self._weight = float(self._weights.sum())
        self._articles = 0 if s.articles is None else len(s.articles)
        rules = [np.asarray(m, float) for m in (s.articles, s.anchors) if m is not None and len(m)]
        self._rules = np.vstack(rules) if rules else None
        self._far = None if s.reference is None else np.linalg.norm(s.reference, axis=1)
        self._sizes = _lengths(self.x)

    def drift(self) -> str:
        """Check the state against the reference and the state checked before: ok, warning or critical."""
        s, x = self.s, self.x
        moved = 0.0
        if self.checked is not None:
            size, step = math.sqrt(np.vdot(self.checked, self.checked)), x - self.checked
            moved = math.sqrt(np.vdot(step, step)) / (size if size > 0 else 1.0)
            self.cumulative += moved
        self.checked = x  # states are replaced, never changed
        size = self._sizes * self._far
        far = 1 - np.divide(np.einsum("ij,ij->i", x, s.reference), size, out=np.zeros(8), where=size > 0)
        if self.cumulative > s.cumulative * s.critical_multiplier:
            return "critical"
        if self.cumulative > s.cumulative or int((far > s.per_dimension).sum()) > 2 or moved > s.per_cycle:
            return "warning"
        return "ok"

    def reset(self) -> None:
        """Back to the first state, with no drift."""
        self.x, self.checked, self.cumulative, self.state_id, self.impacts = np.array(self.s.start, float), None, 0.0, 0, 0
        self._sizes = _lengths(self.x)

    def dissonance(self, near: np.ndarray, context: Found | None, there: bool) -> tuple[float, int]:
        """The total tension between an input and the state, given the state's products with it and what retrieval found, and the number of hard negatives."""
        size = self._sizes
        cosine = near / size if size.min() > 0 else np.divide(near, size, out=np.zeros(8), where=size > 0)
        total = self._weight - float(self._weights @ cosine) if there else self._weight
        if context is None:
            return total + 0.1, 0
        n, hard, top, _ = context
        return total + 0.2 * hard / n + 0.1 * (1 - top if top < 0.3 else 0.0), int(hard)

    def change(self, e: np.ndarray, near: list[float], context: Found | None) -> float:
        """The size of the change of belief by the four methods of fixation, at most delta_max. Each draws the input to one dimension by a share."""
        s, shares = self.s, [0.0] * 8
        tenacity, authority, apriori, science = s.fixation
        if near[_THIRD] > 0.8:
            shares[_THIRD] += tenacity * 0.1
        if self._articles:
            said = (self._rules @ e).tolist()
            aligned, anchored = said[: self._articles], said[self._articles :]
            broken = [i for i, v in enumerate(aligned) if v < 0.3]
            if broken:
                shares[_VALUES] -= authority * (0.3 if any(i in s.critical for i in broken) else 0.1)
            elif sum(aligned) / len(aligned) > 0.7:
                shares[_VALUES] += authority * 0.2
            elif anchored and sum(anchored) / len(anchored) > 0.6:
                shares[_THIRD] += authority * 0.15
        coherence = (near[_FIRST] + near[_THIRD] + near[_ORIENTATIONS] + near[_VALUES]) / 4
        shares[_THIRD] += apriori * (coherence * 0.15 if coherence > 0.5 else 0.05)
        if context is None:
            shares[_SECOND] += science * 0.05
        elif context[3] > 0.3:
            shares[_THIRD] += science * (0.3 if context[3] > 0.6 else 0.15)
        else:
            shares[_SECOND] += science * 0.1
        delta = sum(shares) * e - np.array(shares) @ self.x
        return min(math.sqrt(delta @ delta), s.delta_max)

    def cycle(self, at: float, kind: str, e: np.ndarray, context: Found | None) -> tuple:
        s, e = self.s, np.asarray(e, float)
        length = math.sqrt(e @ e)
        e = e / length if length > 0 else e
        near = self.x @ e
        total, hard = self.dissonance(near, context, length > 0)
        shock = total > s.shock
        self.impacts += shock
        size = self.change(e, near.tolist(), context)
        x = self.x + (self._rates * size)[:, None] * (e - self.x)
        sizes = _lengths(x)
        if sizes.min() > 0:
            self.x, self._sizes = x / sizes[:, None], _ONES
        else:
            self.x = unit(x)
            self._sizes = _lengths(self.x)
        self.state_id += 1
        if kind == "user":
            reason = "conversation_mode"
        elif total > s.speak:
            reason = "high_dissonance_discovery"
        else:
            level = self.drift() if s.reference is not None else "ok"
            reason = f"drift_alert_{level}" if level != "ok" else "multiple_contradictions" if hard >= 3 else "silent_processing"
        return (at, kind, self.state_id, total, hard, self.impacts if shock else None, size, size > 0.0005, reason != "silent_processing", reason)

    def _tick(self, at: float) -> list[tuple]:
        """What the clock does at one of its own times; a check comes before a cycle."""
        out, s = [], self.s
        if s.vigilance and at == self.begun + (self.checks + 1) * s.vigilance:
            self.checks += 1
            if s.reference is not None and (level := self.drift()) != "ok":
                out.append((at, "vigilance", self.state_id, None, None, None, None, None, level == "critical", f"drift_alert_{level}"))
        if s.every and at == self.begun + (self.autonomous + 1) * s.every:
            self.autonomous += 1
            self.talks = [t for t in self.talks if at < t + s.hold]
            if not any(t <= at for t in self.talks):
                theme = zlib.crc32(f"{self.name}:{self.autonomous}".encode()) % len(s.themes)
                out.append(self.cycle(at, "internal", s.themes[theme], None))
        return out

    def upto(self, at: float) -> list[tuple]:
        """All that the clock does up to and at a time."""
        out, s = [], self.s
        while self.begun is not None:
            due = [self.begun + (n + 1) * step for n, step in ((self.checks, s.vigilance), (self.autonomous, s.every)) if step]
            if not due or min(due) > at:
                break
            out += self._tick(min(due))
        return out

    def take(self, at: float, kind: str, e, context: Found | None) -> list[tuple]:
        """A trigger, after what the clock did before it. Kind `reset` returns to the first state; a trigger without input is skipped."""
        if self.begun is None:
            self.begun = at
        out = self.upto(math.nextafter(at, -math.inf))
        self.now = at
        if kind == "user" and self.s.every:
            self.talks.append(at)
        if kind == "reset":
            self.reset()
        elif e is not None and len(e):
            out.append(self.cycle(at, kind, e, context if context is not None and len(context) else None))
        return out


#: What a course gives: at (seconds), kind, state_id, total, hard_negatives, impact_id, magnitude, thought, speaks, reason.
OUTPUT = "at double, kind string, state_id bigint, total double, hard_negatives bigint, impact_id bigint, magnitude double, thought boolean, speaks boolean, reason string"


def cycles(triggers: DataFrame, settings: Settings, entity: str = "user_id") -> DataFrame:
    """Every cycle and alert of each entity's course over triggers (entity, at, nth, kind, e, context, or `found` in its place as `summarised` gives it).

    at is in seconds; triggers of one time go by nth. e is the input's vector (a trigger
    without one gives no cycle), context the vectors that retrieval found, or null. The
    clock stops at an entity's last trigger. Entities are independent; one entity's course
    is sequential, and its task holds one state.
    """
    s = settings.validate()
    schema = f"{entity} {triggers.schema[entity].dataType.simpleString()}, {OUTPUT}"

    def step(course: Course | None, row: dict) -> tuple[Course, list[tuple]]:
        course = course or Course(s, _name(row[entity]))
        return course, [(row[entity], *r) for r in course.take(row["at"], row["kind"], row["e"], row["found"])]

    def finish(key: tuple, course: Course) -> list[tuple]:
        return [(*key, *r) for r in course.upto(course.now)]

    if "found" not in triggers.columns:
        triggers = summarised(triggers.select(entity, "at", "nth", "kind", "e", "context"), s)
    return ordered_fold(triggers.select(entity, "at", "nth", "kind", "e", "found"), [entity], ["at", "nth"], schema, step, finish)


def _name(key) -> str:
    return "" if key is None or key != key else str(key)
