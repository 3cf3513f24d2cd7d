"""Return of fixes after an outage: hold, confirm, let in gently; and an output without jumps.

After a loss fixes are held until two in a row tell the same displacement as dead
reckoning between their times, within what accuracies, drift, speed and heading
uncertainty allow. All held fixes are then given back, the first ones with larger
noise; a confirmed fix that its gate would refuse for its position makes the
position covariance grow, no more than needed. Holding ends after TIMEOUT_S.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np

from wayline.streaming import earth
from wayline.streaming.inertial import GATES, Filter, Fix

#: Fixes that must agree, tolerance in sigmas, drift (share of the way, metres), seconds between fixes, factors of variance, growth, seconds of holding.
CONFIRM, SIGMAS, DRIFT, DRIFT_M, APART_S, SCHEDULE, MOST_GROWTH, TIMEOUT_S = 2, 3.0, 0.05, 3.0, 14.0, (9.0, 4.0, 2.0), 100.0, 30.0


@dataclass(frozen=True)
class Held:
    fix: Fix
    reckoned: np.ndarray
    velocity_var: float
    yaw_var: float


@dataclass
class Recovery:
    phase: str = "normal"
    held: list[Held] = field(default_factory=list)
    graded: int = 0
    since: float | None = None
    counts: Counter = field(default_factory=Counter)

    def lost(self) -> None:
        if self.phase != "confirming":
            self.phase, self.held, self.graded, self.since = "confirming", [], 0, None
            self.counts["outages"] += 1

    def offered(self, fix: Fix, f: Filter) -> tuple[list[Fix], bool]:
        """The fixes to take in now, in time order, and whether they were just confirmed."""
        if self.phase != "confirming":
            return [fix], False
        if self.since is None:
            self.since = fix.received
        elif fix.received - self.since >= TIMEOUT_S:
            self.phase, self.held = "gradual", []
            self.counts["timeouts"] += 1
            return [fix], False
        own = Held(fix, f.at(fix.t).place, float(f.covariance[3, 3] + f.covariance[4, 4]), float(f.covariance[8, 8]))
        if self.held and not agree(self.held[-1], own):
            self.held = [own]
            self.counts["inconsistent"] += 1
            return [], False
        self.held.append(own)
        if len(self.held) < CONFIRM:
            self.counts["held"] += 1
            return [], False
        out, self.held, self.phase = [x.fix for x in self.held], [], "gradual"
        self.counts["confirmed"] += 1
        return out, True

    def graded_fix(self, fix: Fix) -> Fix:
        """The fix with the noise that the schedule asks for."""
        if self.phase != "gradual":
            return fix
        k, self.graded = self.graded, self.graded + 1
        if k >= len(SCHEDULE):
            self.phase = "normal"
            return fix
        self.counts["graded"] += 1
        return replace(fix, accuracy=fix.accuracy * math.sqrt(SCHEDULE[k]))

    def admit(self, f: Filter, fix: Fix) -> None:
        """Lets a confirmed fix pass its gate by a larger position covariance, if the position is what it fails on."""
        nu, h, r = f.fix_terms(fix)
        gate = GATES[len(nu) - 1]
        if f.nis(nu, h, r) <= gate:
            return
        position = f.nis(nu[:3], h[:3], r[:3, :3])
        if position <= GATES[2]:
            self.counts["inflation_not_position"] += 1
            return
        p = inflated(f, nu, h, r, min(MOST_GROWTH, 1.05 * position / GATES[2]), gate)
        if p is None:
            self.counts["inflation_refused"] += 1
            return
        f.set(p)
        self.counts["inflations"] += 1


def agree(a: Held, b: Held) -> bool:
    """Whether two fixes tell the displacement that dead reckoning tells: the vectors are compared, not their lengths."""
    dt = b.fix.t - a.fix.t
    if dt > APART_S:
        return False
    reckoned = earth.apart(b.reckoned, a.reckoned)[:2]
    way = float(np.linalg.norm(reckoned))
    var = a.fix.accuracy**2 + b.fix.accuracy**2 + (DRIFT * way + DRIFT_M) ** 2 + b.velocity_var * dt * dt + way * way * b.yaw_var
    return float(np.linalg.norm(earth.apart(b.fix.place, a.fix.place)[:2] - reckoned)) <= SIGMAS * math.sqrt(var)


def inflated(f: Filter, nu: np.ndarray, h: np.ndarray, r: np.ndarray, factor: float, gate: float) -> np.ndarray | None:
    """The covariance with position rows and columns scaled by the root of a factor, doubled until the gate passes; None beyond MOST_GROWTH."""
    while True:
        d = np.ones(15)
        d[:3] = math.sqrt(factor)
        p = f.covariance * np.outer(d, d)
        if f.nis(nu, h, r, p) <= gate:
            return p
        if factor >= MOST_GROWTH:
            return None
        factor = min(MOST_GROWTH, 2 * factor)


@dataclass
class Smoother:
    """An output that takes up corrections in an offset and glides it to nought: at rate, or within blend seconds."""

    rate: float = 15.0
    blend: float = 10.0
    offset: np.ndarray = field(default_factory=lambda: np.zeros(3))
    glide: float = 15.0
    before: np.ndarray | None = None

    def mark(self, place: np.ndarray) -> None:
        """Before a step's corrections."""
        self.before = place

    def absorb(self, place: np.ndarray, dt: float) -> None:
        """After them."""
        if self.before is not None:
            jump, self.before = earth.apart(place, self.before), None
            if jump.any():
                self.offset = self.offset - jump
                self.glide = max(self.rate, float(np.linalg.norm(self.offset)) / self.blend)
        size = float(np.linalg.norm(self.offset))
        if size > 0:
            self.offset = self.offset * (size - min(size, self.glide * dt)) / size

    def output(self, place: np.ndarray) -> np.ndarray:
        return earth.moved(place, self.offset)
