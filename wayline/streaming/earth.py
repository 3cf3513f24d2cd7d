"""The rotating ellipsoid in numpy: radii, rates, gravity, small rotations.

All but rotation_vector, level and turn take one place or many: numbers or
arrays of one length, vectors on the last axis, matrices on the last two.
"""

from __future__ import annotations

import math

import numpy as np

from wayline.functions.geodesy import A, E2, EARTH_RATE, FREE_AIR, GRAVITY_EQUATOR, GRAVITY_K


def _lib(x):
    """The module whose functions take x: one number or many."""
    return math if isinstance(x, float) else np


def vector(x, y, z) -> np.ndarray:
    """A vector of three numbers, or the vectors of arrays of one length."""
    if isinstance(x, float) and isinstance(y, float) and isinstance(z, float):
        return np.array([x, y, z])
    return np.stack(np.broadcast_arrays(x, y, z), -1)


def parts(v: np.ndarray):
    """The three numbers of a vector, or those of many vectors as three arrays."""
    return v.tolist() if v.ndim == 1 else v.T


def wrapped(angle):
    """An angle less its whole turns."""
    if isinstance(angle, float):
        return math.remainder(angle, 2 * math.pi)
    return angle - 2 * math.pi * np.rint(angle / (2 * math.pi))


def radii(lat):
    """Radii of curvature along the meridian and across it."""
    w = 1 - E2 * _lib(lat).sin(lat) ** 2
    return A * (1 - E2) / w**1.5, A / _lib(w).sqrt(w)


def gravity(lat, h) -> np.ndarray:
    s = _lib(lat).sin(lat) ** 2
    return vector(0.0, 0.0, FREE_AIR * h - GRAVITY_EQUATOR * (1 + GRAVITY_K * s) / _lib(s).sqrt(1 - E2 * s))


def earth_rate(lat) -> np.ndarray:
    return EARTH_RATE * vector(0.0, _lib(lat).cos(lat), _lib(lat).sin(lat))


def transport_rate(lat, h, v: np.ndarray) -> np.ndarray:
    m, n = radii(lat)
    east, north, _ = parts(v)
    return vector(-north / (m + h), east / (n + h), east * _lib(lat).tan(lat) / (n + h))


def scale(lat, h) -> np.ndarray:
    """Metres east, north and up of a radian of longitude, of latitude, and of a metre."""
    m, n = radii(lat)
    return vector((n + h) * _lib(lat).cos(lat), m + h, 1.0)


def moved(place: np.ndarray, metres: np.ndarray) -> np.ndarray:
    """A place (lon, lat, h) moved by metres east, north and up."""
    _, lat, h = parts(place)
    out = place + metres / scale(lat, h)
    out.T[0] = wrapped(out.T[0])
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres east, north and up from a place b to a place a, with the radii at b."""
    _, lat, h = parts(b)
    d = a - b
    d.T[0] = wrapped(d.T[0])
    return d * scale(lat, h)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (a0, a1, a2), (b0, b1, b2) = parts(a), parts(b)
    return vector(a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0)


def skew(v: np.ndarray) -> np.ndarray:
    x, y, z = parts(v)
    if v.ndim == 1:
        return np.array([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])
    o = np.zeros_like(x)
    return np.array([[o, -z, y], [z, o, -x], [-y, x, o]]).transpose(2, 0, 1)


def rotation(v: np.ndarray) -> np.ndarray:
    """The matrix of a rotation vector."""
    k = skew(v)
    if v.ndim == 1:
        a = float(np.linalg.norm(v))
        s, c = (1.0, 0.5) if a < 1e-8 else (math.sin(a) / a, (1 - math.cos(a)) / (a * a))
    else:
        a = np.linalg.norm(v, axis=-1)[:, None, None]
        small, b = a < 1e-8, np.where(a < 1e-8, 1.0, a)
        s, c = np.where(small, 1.0, np.sin(b) / b), np.where(small, 0.5, (1 - np.cos(b)) / (b * b))
    return np.eye(3) + s * k + c * (k @ k)


def rotation_vector(m: np.ndarray) -> np.ndarray:
    """The vector of a rotation matrix, its angle in [0, pi)."""
    s = np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]) / 2
    size = float(np.linalg.norm(s))
    a = math.atan2(size, (np.trace(m) - 1) / 2)
    return s if size < 1e-12 else s * (a / size)


def level(up: np.ndarray) -> np.ndarray:
    """The least rotation that takes a direction to up; straight down turns about x."""
    u = up / np.linalg.norm(up)
    axis = np.array([u[1], -u[0], 0.0])
    s = float(np.linalg.norm(axis))
    if s < 1e-12:
        return np.eye(3) if u[2] > 0 else np.diag([1.0, -1.0, -1.0])
    return rotation(axis / s * math.atan2(s, u[2]))


def turn(yaw: float) -> np.ndarray:
    return rotation(np.array([0.0, 0.0, yaw]))
