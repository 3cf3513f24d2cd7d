"""A session as one ordered stream of tagged events: sensor channels, fixes of several providers, a switch for outages.

``EventLoop`` is the only reader of its session's events. Channels meet in bins
of BIN_S seconds, closed by the first event past their end; a bin in which a
needed channel is missing gives no sample and is counted. Fixes wait until the
next sample. A switch withholds fixes whose own time is after it. Snapshots come
at most every SNAPSHOT_S seconds of event time. Events that cannot be (values out
of full scale, times going back on their channel, fixes before their time,
unknown tags) are counted by reason and change nothing.

``run_events`` folds the loop over a table, ``run_events_stream`` over a stream;
both give the same rows.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wayline.operators import validity
from wayline.streaming.inertial import Fix, Noise, Sample
from wayline.streaming.navigator import Engine, Options

BIN_S, SNAPSHOT_S = 0.1, 0.2
CHANNELS = ("ACCEL", "GYRO", "GRAVITY")
#: What an event's row holds: x, y, z of a sensor; of a fix lat, lon, h, accuracy, speed, course and its own time; on of a switch.
EVENT_SCHEMA = "session_id long, t double, tag string, x double, y double, z double, fix_t double, accuracy double, speed double, course double, provider string, on boolean"
COLUMNS = [c.strip().split(" ")[0] for c in EVENT_SCHEMA.split(",")][1:]


class Snapshot(NamedTuple):
    t: float
    mode: str
    lat: float | None
    lon: float | None
    sigma: float | None
    gnss_state: str
    provider: str | None
    n_samples: int
    n_withheld: int
    n_refused: int


SNAPSHOT_SCHEMA = "t double, mode string, lat double, lon double, sigma double, gnss_state string, provider string, n_samples long, n_withheld long, n_refused long"


class EventLoop:
    def __init__(self, noise: Noise | None = None, options: Options | None = None, mount: np.ndarray | None = None, providers: tuple[str, ...] | None = None):
        self.engine = Engine(noise, options, mount)
        self.providers = providers
        self.sums: dict[str, tuple[np.ndarray, int]] = {}
        self.bin: int | None = None
        self.last: dict[str, float] = {}
        self.waiting: list[Fix] = []
        self.since: float | None = None
        self.counts, self.refused = Counter(), Counter()
        self.shown, self.provider, self.output = -math.inf, None, None

    def handle(self, event: tuple) -> Snapshot | None:
        """One event (COLUMNS); a snapshot if it is time for one."""
        t, tag = event[0], event[1]
        if t is None or not math.isfinite(t):
            self.refused["time"] += 1
            return None
        self._close(t)
        reason = self._sensor(t, tag, event) if tag in CHANNELS else self._fix(t, event) if tag == "FIX" else self._switch(t, event) if tag == "OUTAGE" else "unknown tag"
        if reason:
            self.refused[reason] += 1
        if t - self.shown < SNAPSHOT_S - 1e-9:
            return None
        self.shown = t
        o = self.output
        place = (None, None, None) if o is None else (o.lat, o.lon, o.sigma)
        return Snapshot(t, self.engine.mode, *place, o.gnss_state if o is not None else "LOST", self.provider, self.counts["samples"], self.counts["withheld"], sum(self.refused.values()))

    def _sensor(self, t: float, tag: str, event: tuple) -> str | None:
        if t < self.last.get(tag, -math.inf):
            return "time going back"
        v = np.array([np.nan if x is None else x for x in event[2:5]], float)
        size = float(np.linalg.norm(v))
        if not np.isfinite(v).all():
            return "not finite"
        if tag != "GYRO" and size > validity.MOST_FORCE or tag == "GYRO" and float(np.abs(v).max()) > validity.MOST_RATE:
            return "out of scale"
        self.last[tag] = t
        total, n = self.sums.get(tag, (np.zeros(3), 0))
        self.sums[tag] = (total + v, n + 1)
        return None

    def _fix(self, t: float, event: tuple) -> str | None:
        lat, lon, h, own, accuracy, speed, course, provider = event[2:10]
        if self.providers is not None and provider not in self.providers:
            return "provider"
        if lat is None or lon is None or abs(lat) > math.pi / 2 or abs(lon) > math.pi or accuracy is None or not accuracy > 0 or own is None:
            return "fix"
        if own > t:
            return "fix before its time"
        if self.since is not None and own >= self.since:
            self.counts["withheld"] += 1
            return None
        both = speed is not None and course is not None and 0 <= speed <= validity.MOST_SPEED
        self.waiting.append(Fix(own, t, np.array([lon, lat, h or 0.0]), accuracy, speed if both else None, course if both else None))
        self.provider = provider
        return None

    def _switch(self, t: float, event: tuple) -> None:
        self.since = t if event[10] else None

    def _close(self, t: float) -> None:
        """Closes the bin that t is past, and gives its means to the engine."""
        k = math.floor(t / BIN_S + 1e-9)
        if self.bin is not None and k > self.bin and self.sums:
            end = (self.bin + 1) * BIN_S
            if "ACCEL" in self.sums and "GYRO" in self.sums:
                mean = {c: total / n for c, (total, n) in self.sums.items()}
                ready = [f for f in self.waiting if f.received <= end + 1e-9]
                self.waiting = [f for f in self.waiting if f.received > end + 1e-9]
                self.counts["samples"] += 1
                out = self.engine.sample(Sample(end, mean["ACCEL"], mean["GYRO"]), mean.get("GRAVITY", np.zeros(3)), ready)
                self.output = out if out is not None else self.output
            else:
                self.counts["incomplete"] += 1
            self.sums = {}
        self.bin = k if self.bin is None else max(self.bin, k)


def _plain(row: tuple) -> tuple:
    return tuple(None if x is None or x != x else x for x in row)


def looped(loop: EventLoop, rows: Iterator[tuple]) -> Iterator[Snapshot]:
    for r in rows:
        out = loop.handle(_plain(r))
        if out is not None:
            yield out


def run_events(df: DataFrame, options: Options | None = None, mount: np.ndarray | None = None, providers: tuple[str, ...] | None = None) -> DataFrame:
    """session_id and SNAPSHOT_SCHEMA for events (EVENT_SCHEMA, and seq, the order in which they came) of each session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        out = pd.DataFrame(list(looped(EventLoop(None, options, mount, providers), pdf[COLUMNS].itertuples(index=False, name=None))), columns=Snapshot._fields)
        out.insert(0, "session_id", pdf["session_id"].iloc[0])
        return out

    return df.select("session_id", "seq", *COLUMNS).groupBy("session_id").applyInPandas(run, f"session_id long, {SNAPSHOT_SCHEMA}")


def run_events_stream(df: DataFrame, options: Options | None = None, mount: np.ndarray | None = None, providers: tuple[str, ...] | None = None) -> DataFrame:
    """run_events over a stream whose sessions arrive in order of seq; the loop is the session's state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        loop = pickle.loads(held.get[0]) if held.exists else EventLoop(None, options, mount, providers)
        pdf = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = pd.DataFrame(list(looped(loop, pdf[COLUMNS].itertuples(index=False, name=None))), columns=Snapshot._fields)
        held.update((pickle.dumps(loop),))
        out.insert(0, "session_id", k[0])
        yield out

    return df.select("session_id", "seq", *COLUMNS).groupBy("session_id").applyInPandasWithState(run, f"session_id long, {SNAPSHOT_SCHEMA}", "loop binary", "append", GroupStateTimeout.NoTimeout)


def live(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Events as they arrive in a folder of JSON lines, at most per_trigger files a micro-batch: the bound of what waits unread in memory."""
    return spark.readStream.schema(f"{EVENT_SCHEMA}, seq long").option("maxFilesPerTrigger", per_trigger).json(path)


def channel(events: DataFrame, *tags: str) -> DataFrame:
    """The events of some tags: the sensors, or the fixes of a provider's stream."""
    return events.where(events["tag"].isin(*tags))


def tagged(drive: pd.DataFrame) -> pd.DataFrame:
    """The rows of a session's samples and fixes as events, in order: what a phone would send."""
    out = []
    for r in drive.itertuples(index=False):
        none = (None,) * 7
        for tag, name in (("ACCEL", "acc"), ("GYRO", "gyro"), ("GRAVITY", "grav")):
            out.append((r.session_id, r.t, tag, getattr(r, f"{name}_x"), getattr(r, f"{name}_y"), getattr(r, f"{name}_z"), *none[:4], None, None))
        if r.fix_t == r.fix_t and r.fix_t is not None:
            out.append((r.session_id, r.t, "FIX", r.fix_lat, r.fix_lon, r.fix_h, r.fix_t, r.fix_acc, r.fix_speed, r.fix_course, "gps", None))
    df = pd.DataFrame(out, columns=["session_id", *COLUMNS])
    df["seq"] = np.arange(len(df))
    return df
