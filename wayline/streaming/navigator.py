"""Navigation of a session: one step of fusion, the search for the heading, and both over tables and streams.

A ``Navigator`` carries one filter: sample in, window of samples for models,
propagation, fixes by their quality and after recovery, speed, straightness,
stillness, smoothed output. An ``Engine`` waits for a moving fix, starts a
navigator for each of eight headings, and after COMPARED_S seconds keeps the one
that the fixes contradict least. ``navigate`` runs an engine over each session of
a table, ``navigate_stream`` over a stream, with the engine as the session's
state; both give the same rows.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayline.streaming import earth, machines
from wayline.streaming.inertial import CovarianceError, Filter, Fix, Noise, Sample, blended_force
from wayline.streaming.recovery import Recovery, Smoother

#: Headings tried, seconds they are compared, the speed that starts them, the most that one fix counts, the cost of a reset (fixed values).
HEADINGS, COMPARED_S, START_SPEED, NIS_CAP, RESET_COST = 8, 120.0, 5.0, 50.0, 50.0
#: Quality of fixes: seconds until a good state degrades and any is lost, metres of a good fix, refused fixes until a reset.
DEGRADED_S, LOST_S, GOOD_M, REFUSALS = 12.0, 25.0, 10.0, 3


class Policy(NamedTuple):
    use_gnss: bool
    noise: float
    use_speed: bool
    use_straight: bool


POLICIES = {"GOOD": Policy(True, 1.0, False, True), "DEGRADED": Policy(True, 2.0, True, True), "LOST": Policy(False, 1.0, True, True), "RECOVERING": Policy(True, 3.0, True, True)}
PASS_THROUGH = Policy(True, 1.0, False, True)


@dataclass(frozen=True)
class Options:
    """Switches of an arm of comparison, and thresholds."""

    speed: bool = True
    accel: bool = False
    straight: bool = True
    straight_needs_speed: bool = True
    states: bool = True
    recovery: bool = True
    every: int = 1
    speed_least: float = 1.0
    speed_sigma: float = 0.5
    speed_interval_s: float = 1.0
    sample_s: float = 0.1
    accel_sigma: float = 1.04
    still_std: float = 0.08
    still_norm: float = 0.1
    still_rate: float = 0.02
    still_speed: float = 1.0
    #: Samples of a window of a model, seconds between them at most.
    window: int = 20
    window_gap_s: float = 0.15


#: A model takes a window [samples, 9] of accelerometer, gravity and gyro rows and gives a mean and a variance.
Model = Callable[[np.ndarray], tuple[float, float]]


@dataclass
class Window:
    """The newest samples without a gap."""

    size: int
    gap_s: float
    times: deque = field(default_factory=deque)
    rows: deque = field(default_factory=deque)

    def push(self, t: float, row: np.ndarray) -> None:
        if self.times and not 0 < t - self.times[-1] <= self.gap_s:
            self.times.clear()
            self.rows.clear()
        self.times.append(t)
        self.rows.append(row)
        if len(self.times) > self.size:
            self.times.popleft()
            self.rows.popleft()

    @property
    def ready(self) -> bool:
        return len(self.times) == self.size


class Navigator:
    def __init__(self, f: Filter, options: Options, mount: np.ndarray | None = None, lateral: bool = False, models: dict[str, Model] | None = None):
        self.filter, self.options, self.models = f, options, models or {}
        self.mount, self.lateral = np.eye(3) if mount is None else mount, lateral and mount is not None
        self.quality: machines.State = machines.GNSS_START
        self.recovery = Recovery() if options.recovery else None
        self.tracked, self.streak, self.resets = False, 0, 0
        self.smoother, self.counts = Smoother(), Counter()
        self.window = Window(options.window, options.window_gap_s)
        self.norms: deque = deque(maxlen=10)
        self.before: tuple[Sample, float] | None = None
        self.n = 0
        self.predicted: dict[str, tuple[float, float]] = {}
        self.fresh, self.speed_t, self.fix_speed = False, -math.inf, None
        self.nis_sum, self.nis_n = 0.0, 0

    def score(self) -> float:
        """Mean of capped innovations and a cost for each reset; without a fix nothing speaks for a heading."""
        return (self.nis_sum / self.nis_n if self.nis_n else math.inf) + RESET_COST * self.resets

    @property
    def policy(self) -> Policy:
        return POLICIES[self.quality[0]] if self.options.states else PASS_THROUGH

    def step(self, sample: Sample, gravity: np.ndarray, fixes: list[Fix], observer: Callable[[Navigator], None] | None = None) -> None:
        """One sample and the fixes received since the one before; an observer sees the navigator after it, and must not change it."""
        self.window.push(sample.t, np.concatenate([sample.accel, gravity, sample.gyro]))
        self.n += 1
        if self.models and self.window.ready and self.n % self.options.every == 0:
            self._predict()
        held, self.before = self.before, sample
        if held is None:
            return
        dt = sample.t - held.t
        if dt <= 0:
            self.counts["skipped"] += 1
            return
        accel, o = held.accel, self.options
        if o.accel and "accel" in self.predicted:
            accel, done = blended_force(self.filter.state, accel, *self.predicted["accel"], o.accel_sigma**2)
            self.counts["accel_blends"] += done
        self.filter.propagate(replace(held, accel=accel), dt)
        self.smoother.mark(self.filter.state.place)
        self._take_fixes(sample.t, fixes)
        self._take_speed(sample.t)
        self._constrain(sample)
        self.smoother.absorb(self.filter.state.place, dt)
        if observer is not None:
            observer(self)

    def _predict(self) -> None:
        rows = np.array(self.window.rows)
        for name, model in self.models.items():
            self.predicted[name] = model(rows)
            self.counts[f"{name}_predictions"] += 1
        self.fresh = "speed" in self.models

    def _take_fixes(self, t: float, fixes: list[Fix]) -> None:
        if self.options.states:
            self.quality = machines.gnss_aged(self.quality, t, DEGRADED_S, LOST_S)
            if self.quality[0] != "LOST":
                self.tracked = True
            elif self.recovery is not None and self.tracked:  # a loss, not the start
                self.recovery.lost()
        for fix in fixes:
            self.fix_speed = fix.speed if fix.speed is not None else self.fix_speed
            ready, confirmed = self.recovery.offered(fix, self.filter) if self.recovery is not None and self.options.states else ([fix], False)
            for one in ready:
                self._fuse(t, one, confirmed)

    def _fuse(self, t: float, fix: Fix, confirmed: bool) -> None:
        lost = self.options.states and self.quality[0] == "LOST"
        policy = POLICIES["RECOVERING"] if lost else self.policy
        graded = fix if self.recovery is None else self.recovery.graded_fix(fix)
        graded = replace(graded, accuracy=graded.accuracy * policy.noise)
        if confirmed:
            self.recovery.admit(self.filter, graded)
        ok, nis = self.filter.fix(graded)
        self.nis_sum, self.nis_n = self.nis_sum + (min(nis, NIS_CAP) if ok else NIS_CAP), self.nis_n + 1
        self.counts["gnss_accepted" if ok else "gnss_rejected"] += 1
        self.streak = 0 if ok else self.streak + 1
        if self.streak >= REFUSALS:
            self.filter.start_anew(fix)
            self.streak, self.resets = 0, self.resets + 1
        if self.options.states:
            self.quality = machines.gnss_fixed(self.quality, t, ok and fix.accuracy <= GOOD_M)

    def _take_speed(self, t: float) -> None:
        o = self.options
        if not (o.speed and self.policy.use_speed and self.fresh and "speed" in self.predicted and t - self.speed_t >= o.speed_interval_s - 1e-9):
            return
        mean, var = self.predicted["speed"]
        self.fresh, self.speed_t = False, t
        terms = self.filter.speed_terms(mean, o.speed_least)
        if terms is None:
            self.counts["speed_low"] += 1
            return
        shared = max(1.0, o.window * o.sample_s / o.speed_interval_s)  # windows overlap: their errors are not independent
        ok, _ = self.filter.update(*terms, [[max(var, o.speed_sigma**2) * shared]])
        self.counts["speed_accepted" if ok else "speed_rejected"] += 1

    def _constrain(self, sample: Sample) -> None:
        o, rate = self.options, float(sample.gyro[2])
        if o.straight and self.policy.use_straight and (o.speed or not o.straight_needs_speed):
            speed = float(np.hypot(*self.filter.state.velocity[:2]))
            self.counts[f"straight_{self.filter.straight(self.mount, self.lateral, speed * rate)}"] += 1
        norm = float(np.linalg.norm(sample.accel))
        self.norms.append(norm)
        hint = self.predicted["speed"][0] if "speed" in self.predicted else self.fix_speed
        quiet = len(self.norms) == 10 and np.std(self.norms) < o.still_std and abs(norm - earth_norm(self.filter)) < o.still_norm and abs(rate) < o.still_rate
        if quiet and hint is not None and hint < o.still_speed:
            self.filter.still()
            self.filter.level(sample.accel)
            self.counts["still"] += 1


def earth_norm(f: Filter) -> float:
    return -float(earth.gravity(f.state.place[1], f.state.place[2])[2])


class Output(NamedTuple):
    t: float
    mode: str
    lat: float
    lon: float
    height: float
    smooth_lat: float
    smooth_lon: float
    sigma: float
    gnss_state: str
    v_east: float
    v_north: float
    accepted: int
    rejected: int
    resets: int


OUTPUT_SCHEMA = "t double, mode string, lat double, lon double, height double, smooth_lat double, smooth_lon double, sigma double, gnss_state string, v_east double, v_north double, accepted long, rejected long, resets long"


class Engine:
    """WAITING until a moving fix, ALIGNING over the headings, then NAVIGATING with the best. A given mount has one heading."""

    def __init__(self, noise: Noise | None = None, options: Options | None = None, mount: np.ndarray | None = None, models: dict[str, Model] | None = None):
        self.noise, self.options, self.mount, self.models = noise or Noise(), options or Options(), mount, models
        self.mode, self.tilt_source = "WAITING", "given" if mount is not None else None
        self.tried: list[Navigator] = []
        self.accel_sum, self.gravity_sum, self.n = np.zeros(3), np.zeros(3), 0
        self.first: Fix | None = None
        self.began = 0.0

    def tilt(self) -> np.ndarray:
        """Body to level, from what is seen so far: fifty rows of the accelerometer, before that the gravity channel."""
        source = self.accel_sum if self.n >= 50 or not self.gravity_sum.any() else self.gravity_sum
        self.tilt_source = "accelerometer" if source is self.accel_sum else "gravity"
        return earth.level(source)

    def _start(self, t: float) -> None:
        known = self.mount is not None
        mount = self.mount if known else self.tilt()
        fix = self.first
        yaw = math.pi / 2 - fix.course
        for k in range(1 if known else HEADINGS):
            attitude = earth.turn(yaw + 2 * math.pi * k / HEADINGS) @ mount
            f = Filter.start(t, fix.place, np.append(fix.velocity, 0.0), attitude, self.noise, fix.accuracy, math.radians(5 if known else 25))
            self.tried.append(Navigator(f, self.options, mount, known, self.models))
        self.mode, self.began = "ALIGNING", t

    def sample(self, sample: Sample, gravity: np.ndarray, fixes: list[Fix] = (), observer=None) -> Output | None:
        """One sample and the fixes received since the one before; None while waiting."""
        if self.mode == "WAITING":
            self.accel_sum, self.gravity_sum, self.n = self.accel_sum + sample.accel, self.gravity_sum + gravity, self.n + 1
            moving = (f for f in fixes if f.speed is not None and f.speed > START_SPEED and f.course is not None)
            self.first = self.first or next(moving, None)
            if self.first is None or sample.t < self.first.received - 1e-9:
                return None
            self._start(sample.t)
            fixes = [f for f in fixes if f.received > sample.t + 1e-9]
        for one in list(self.tried):
            try:
                one.step(sample, gravity, list(fixes), observer)
            except CovarianceError:
                self.tried.remove(one)
        if not self.tried:  # every filter diverged: wait for a moving fix again
            self.mode, self.first = "WAITING", None
            return None
        if self.mode == "ALIGNING" and sample.t >= self.began + COMPARED_S:
            self.tried, self.mode = [min(self.tried, key=Navigator.score)], "NAVIGATING"
        return self.output()

    @property
    def best(self) -> Navigator | None:
        return self.tried[0] if self.tried else None

    def output(self) -> Output:
        nav = self.tried[0]
        s, p, c = nav.filter.state, nav.filter.covariance, nav.counts
        smooth = nav.smoother.output(s.place)
        return Output(s.t, self.mode, s.place[1], s.place[0], s.place[2], smooth[1], smooth[0], math.sqrt(p[0, 0] + p[1, 1]), nav.quality[0], s.velocity[0], s.velocity[1], c["gnss_accepted"], c["gnss_rejected"], nav.resets)


# ------------------------------------------------------------------ tables and streams

#: What a row of a session holds: a sample, and a fix where one was received since the row before.
COLUMNS = ["t", "acc_x", "acc_y", "acc_z", "grav_x", "grav_y", "grav_z", "gyro_x", "gyro_y", "gyro_z", "fix_t", "fix_lat", "fix_lon", "fix_h", "fix_acc", "fix_speed", "fix_course"]


def _value(x) -> float | None:
    return None if x is None or x != x else float(x)


def stepped(engine: Engine, rows: Iterator[tuple]) -> Iterator[Output]:
    """Rows of COLUMNS, in order, to outputs; a row whose sample is not finite is passed over."""
    for r in rows:
        t, *v = map(_value, r)
        if t is None or any(x is None for x in v[0:3]) or any(x is None for x in v[6:9]):
            continue
        gravity = np.array(v[3:6], float) if None not in v[3:6] else np.zeros(3)
        fixes = []
        if v[9] is not None and v[10] is not None and v[11] is not None and v[13] is not None:
            fixes = [Fix(v[9], t, np.array([v[11], v[10], v[12] or 0.0]), v[13], v[14], v[15])]
        out = engine.sample(Sample(t, np.array(v[0:3]), np.array(v[6:9])), gravity, fixes)
        if out is not None:
            yield out


def navigate(df: DataFrame, key: str, noise: Noise | None = None, arms: dict[str, Options] | None = None, mount: np.ndarray | None = None) -> DataFrame:
    """key, arm and OUTPUT_SCHEMA for each session of df (key, COLUMNS) and each arm of options; mount: a known one of all sessions.

    With several arms a session is one task an arm: df carries a column arm, as ``with_arms`` makes it.
    """
    arms = arms or {"default": Options()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["arm"].iloc[0]
        pdf = pdf.sort_values("t", kind="stable")
        out = pd.DataFrame(list(stepped(Engine(noise, arms[name], mount), pdf[COLUMNS].itertuples(index=False, name=None))), columns=Output._fields)
        out.insert(0, "arm", name)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    rows = df if "arm" in df.columns else with_arms(df, list(arms))
    return rows.select(key, "arm", *COLUMNS).groupBy(key, "arm").applyInPandas(run, f"{key} long, arm string, {OUTPUT_SCHEMA}")


def with_arms(df: DataFrame, arms: list[str]) -> DataFrame:
    """Each row once for each arm."""
    from pyspark.sql import functions as F

    return df.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))


def navigate_stream(df: DataFrame, key: str, noise: Noise | None = None, options: Options | None = None) -> DataFrame:
    """navigate over a stream whose sessions arrive in order of t; the engine is the session's state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        engine = pickle.loads(held.get[0]) if held.exists else Engine(noise, options)
        pdf = pd.concat(list(parts)).sort_values("t", kind="stable")
        out = pd.DataFrame(list(stepped(engine, pdf[COLUMNS].itertuples(index=False, name=None))), columns=Output._fields)
        held.update((pickle.dumps(engine),))
        out.insert(0, key, k[0])
        yield out

    return df.select(key, *COLUMNS).groupBy(key).applyInPandasWithState(run, f"{key} long, {OUTPUT_SCHEMA}", "engine binary", "append", GroupStateTimeout.NoTimeout)
