"""Vectors and rotations that know their frames; combining what does not fit raises while the plan is made.

The frame is a tag on the Python side: nothing of it is in the data, and the
column expressions are those of plain quaternions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions import geodesy as geo
from wayline.functions import quaternion as q

#: Frames of vectors; the device is the body.
BODY, DEVICE, VEHICLE, ENU, NED, ECEF = "body", "body", "vehicle", "enu", "ned", "ecef"
_VECTOR_FRAMES = frozenset((BODY, VEHICLE, ENU, NED, ECEF))


class FrameError(ValueError):
    """Quantities of different frames, or a frame that has no vectors."""


def _check(*frames: str) -> None:
    wrong = [f for f in frames if f not in _VECTOR_FRAMES]
    if wrong:
        raise FrameError(f"not frames of vectors: {wrong}")


@dataclass(frozen=True)
class Framed:
    """struct<x,y,z> expressed in a frame."""

    v: Column
    frame: str

    def __post_init__(self) -> None:
        _check(self.frame)

    def _with(self, other: Framed, sign: int) -> Framed:
        if not isinstance(other, Framed):
            raise TypeError("give the other vector a frame")
        if other.frame != self.frame:
            raise FrameError(f"{other.frame} and {self.frame} do not add")
        return Framed(q.vec(*(self.v[n] + sign * other.v[n] for n in "xyz")), self.frame)

    def __add__(self, other: Framed) -> Framed:
        return self._with(other, 1)

    def __sub__(self, other: Framed) -> Framed:
        return self._with(other, -1)


@dataclass(frozen=True)
class Rotation:
    """x in target = rotation of x in source, as a unit quaternion; another norm raises where it is applied."""

    q: Column
    source: str
    target: str

    def __post_init__(self) -> None:
        _check(self.source, self.target)

    @staticmethod
    def identity(frame: str) -> Rotation:
        return Rotation(q.quat(1.0, 0.0, 0.0, 0.0), frame, frame)

    @staticmethod
    def of_matrix(m: Column, source: str, target: str) -> Rotation:
        return Rotation(q.from_matrix(m), source, target)

    @property
    def matrix(self) -> Column:
        return q.matrix(self.unit)

    @property
    def unit(self) -> Column:
        bad = F.raise_error(F.lit("a rotation needs a unit quaternion"))
        return F.when(q.is_unit(self.q, 1e-6), self.q).otherwise(bad.cast("struct<w:double,x:double,y:double,z:double>"))

    def inverse(self) -> Rotation:
        return Rotation(q.conjugate(self.q), self.target, self.source)

    def apply(self, v: Framed) -> Framed:
        if not isinstance(v, Framed):
            raise TypeError("give the vector a frame")
        if v.frame != self.source:
            raise FrameError(f"a rotation of {self.source} does not turn a vector in {v.frame}")
        return Framed(q.rotated(self.unit, v.v), self.target)

    def __matmul__(self, other: Rotation) -> Rotation:
        """First other, then this one."""
        if not isinstance(other, Rotation):
            raise TypeError("only rotations compose")
        if other.target != self.source:
            raise FrameError(f"{other.target} is not {self.source}")
        return Rotation(q.product(self.q, other.q), other.source, self.target)


def attitude(c: Column) -> Rotation:
    """The rotation of an attitude: body to east-north-up."""
    return Rotation(c, BODY, ENU)


def mounting(c: Column) -> Rotation:
    """The rotation of a mounting: body to vehicle. It comes from a calibration."""
    return Rotation(c, BODY, VEHICLE)


def enu_of_ecef(lat: Column, lon: Column) -> Rotation:
    return Rotation.of_matrix(geo.enu_matrix(lat, lon), ECEF, ENU)


def ned_of_enu() -> Rotation:
    """Half a turn about the diagonal of north and east."""
    h = 0.5**0.5
    return Rotation(q.quat(0.0, h, h, 0.0), ENU, NED)


def from_ned(v: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    """struct<lat,lon,h> of a place that is north, east and down of an origin."""
    return geo.from_enu(geo.enu_ned(v), lat0, lon0, h0)
