"""Putting an engine together from what is there, and saying what is not: a part that is missing or wrong is left out, visibly.

Without a noise report there is no filter: only the last fix is shown. A model
whose hash is not that of its card is refused. More than one road bundle is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from wayline.streaming import machines
from wayline.streaming.inertial import Fix, Noise
from wayline.streaming.navigator import DEGRADED_S, GOOD_M, LOST_S, Engine, Model, Options


class GnssOnly:
    """The state of the fixes and the last of them; no position at all once they are lost."""

    def __init__(self) -> None:
        self.quality: machines.State = machines.GNSS_START
        self.last: Fix | None = None

    def time(self, t: float) -> None:
        self.quality = machines.gnss_aged(self.quality, t, DEGRADED_S, LOST_S)

    def fix(self, fix: Fix) -> None:
        self.time(fix.received)
        self.quality = machines.gnss_fixed(self.quality, fix.received, fix.accuracy <= GOOD_M)
        self.last = fix

    def position(self) -> tuple[float, float] | None:
        return None if self.last is None or self.quality[0] == "LOST" else (float(self.last.place[1]), float(self.last.place[0]))


@dataclass
class Assembly:
    engine: Engine | GnssOnly
    roads: bytes | None = None
    notes: list[str] = field(default_factory=list)


def assembled(report: dict | None, models: dict[str, tuple[bytes, str, Callable[[bytes], Model]]] | None = None, bundles: list[bytes] | None = None, options: Options | None = None) -> Assembly:
    """models: name to (bytes, the card's SHA-256, loader)."""
    notes, kept = [], {}
    for name, (data, sha256, load) in (models or {}).items():
        if hashlib.sha256(data).hexdigest() != sha256:
            notes.append(f"model {name} refused: not the one of its card")
        else:
            kept[name] = load(data)
    roads = bundles[0] if bundles and len(bundles) == 1 else None
    if bundles and len(bundles) > 1:
        notes.append(f"{len(bundles)} road bundles: none is used")
    try:
        noise = Noise.of(report) if report is not None else None
    except KeyError as e:
        noise = None
        notes.append(f"noise report without {e}")
    if noise is None:
        return Assembly(GnssOnly(), roads, [*notes, "no noise report: fixes only"])
    return Assembly(Engine(noise, options, models=kept), roads, notes)
