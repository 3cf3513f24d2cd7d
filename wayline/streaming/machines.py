"""Per-session recurrences as pure steps, run over batches or streams.

A machine is ``start()`` and ``step(state, row) -> (state, output)`` on plain
tuples. ``over_batch`` folds it over the ordered rows of each session in one
grouped Arrow pass; ``over_stream`` keeps its state between micro-batches. Both
give the same rows for the same input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

State = tuple[Any, ...]
Step = Callable[[State, tuple], tuple[State, tuple]]


def over_batch(df: DataFrame, key: str, order: list[str], columns: list[str], start: State, step: Step, schema: str) -> DataFrame:
    """Folds step over each session's rows (columns), one output row each: the key, then step's output."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        state, out = start, []
        for row in zip(*(t[c].to_pylist() for c in columns), strict=True):
            state, made = step(state, row)
            out.append(made)
        return pa.table([t[key].combine_chunks(), *map(pa.array, zip(*out, strict=True))], names=names)

    return df.select(*dict.fromkeys([key, *order, *columns])).groupBy(key).applyInArrow(run, schema)


def over_stream(df: DataFrame, key: str, order: list[str], columns: list[str], start: State, step: Step, schema: str, state_schema: str) -> DataFrame:
    """As over_batch, over a stream whose sessions arrive in order; the state is kept for each session."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else start
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for row in pdf[columns].itertuples(index=False, name=None):
            state, made = step(state, row)
            out.append((k[0], *made))
        held.update(state)
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return df.select(*dict.fromkeys([key, *order, *columns])).groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ positioning quality

#: Ages (in the unit of t) after which a good state degrades and any state is lost, and the accuracy of a good fix.
GNSS_START: State = ("LOST", 0, None)


def gnss_aged(state: State, t: float, degraded_after: float, lost_after: float) -> State:
    """What the age of the last fix does: a good state degrades, any state is lost."""
    name, streak, last = state
    age = math.inf if last is None else t - last
    if age > lost_after:
        return "LOST", 0 if name != "LOST" else streak, last
    if name == "GOOD" and age > degraded_after:
        return "DEGRADED", 0, last
    return state


def gnss_fixed(state: State, t: float, good: bool) -> State:
    """What a fix does: three good ones after a loss, two after a bad one, make a good state."""
    name, streak, _ = state
    if name == "LOST":
        return "RECOVERING", int(good), t
    if not good:
        return "DEGRADED", 0, t
    if name == "GOOD":
        return name, streak, t
    streak += 1
    return ("GOOD", 0, t) if streak >= (3 if name == "RECOVERING" else 2) else (name, streak, t)


def gnss_step(degraded_after: float, lost_after: float, good_accuracy: float) -> Step:
    """GOOD, DEGRADED, LOST and RECOVERING by the age and accuracy of fixes (event_id, t, accuracy)."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        event_id, t, accuracy = row
        if state[2] is not None:
            state = gnss_aged(state, t, degraded_after, lost_after)
        state = gnss_fixed(state, t, accuracy <= good_accuracy)
        return state, (event_id, state[0], state[1])

    return step


RESET_START: State = (0,)


def reset_step(limit: int) -> Step:
    """A reset after so many rejected fixes in a row (event_id, rejected)."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        streak = state[0] + 1 if row[1] else 0
        reset = streak >= limit
        return (0 if reset else streak,), (row[0], streak, reset)

    return step


SMOOTH_START: State = (None, 0.0, 0.0)


def smoother_step(jump: float, least_rate: float, horizon: float) -> Step:
    """An output (event_id, t, x) that takes up jumps in an offset and glides it to zero."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        last, offset, rate = state
        event_id, t, x = row
        if last is not None:
            t0, x0 = last
            dt = t - t0
            size = max(0.0, abs(offset) - rate * dt)
            offset = size if offset > 0 else -size
            if abs(x - x0) > jump:
                offset += x0 - x
                rate = max(least_rate, abs(offset) / horizon)
        return ((t, x), offset, rate), (event_id, x + offset)

    return step


SHOCK_START: State = (None, 0)


def shock_step(threshold: float, weight: float, warmup: int) -> Step:
    """Bins (bin, hi, lo, mean) against an exponential mean of those before: bin, peak, suppressed, shock."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        base, n = state
        at, hi, lo, mean = row
        if base is None:
            return (mean, 1), (at, None, None, False)
        peak = max(abs(hi - base), abs(lo - base))
        shock = n >= warmup and peak > threshold
        return (base + weight * (mean - base), n + 1), (at, peak, abs(mean - base) < threshold, shock)

    return step


RATE_START: State = (None, None, None, 0.0)


def rate_step(period: float) -> Step:
    """At most one emission a period, with the way since the last one (event_id, t, x, y): event_id, emitted, travelled."""

    def step(state: State, row: tuple) -> tuple[State, tuple]:
        last, px, py, way = state
        event_id, t, x, y = row
        if px is not None:
            way += math.hypot(x - px, y - py)
        if last is not None and t - last < period:
            return (last, x, y, way), (event_id, False, None)
        return (t, x, y, 0.0), (event_id, True, None if last is None else way)

    return step
