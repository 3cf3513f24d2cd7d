"""Quaternion and rotation expressions over struct<w,x,y,z> and struct<x,y,z> columns.

All are built-in expressions: they stay in generated code and push down.
Quaternions are [w, x, y, z]; a product applies its right factor first.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def bound(f):
    """f with its column arguments evaluated once, however often f's expression names them.

    A tree of nested expressions doubles at each use; a lambda variable does not.
    """

    @functools.wraps(f)
    def g(*args):
        named = {f"a{i}": a for i, a in enumerate(args) if isinstance(a, Column)}
        once = F.struct(*(a.alias(n) for n, a in named.items()))
        return F.transform(F.array(once), lambda s: f(*(s[f"a{i}"] if isinstance(a, Column) else a for i, a in enumerate(args))))[0]

    return g


def quat(w, x, y, z) -> Column:
    return F.struct(*(c.cast("double").alias(n) if isinstance(c, Column) else F.lit(float(c)).alias(n) for n, c in zip("wxyz", (w, x, y, z))))


def vec(x, y, z) -> Column:
    return F.struct(*(c.cast("double").alias(n) if isinstance(c, Column) else F.lit(float(c)).alias(n) for n, c in zip("xyz", (x, y, z))))


def norm(q: Column) -> Column:
    return F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z)


def vec_norm(v: Column) -> Column:
    return F.sqrt(v.x * v.x + v.y * v.y + v.z * v.z)


def scaled(q: Column, s) -> Column:
    return quat(q.w * s, q.x * s, q.y * s, q.z * s)


@bound
def normalized(q: Column) -> Column:
    """Unit quaternion; a zero one raises."""
    n = norm(q)
    return scaled(q, 1 / F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero quaternion")).cast("double")))


def is_unit(q: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(norm(q) - 1) <= tolerance


def canonical(q: Column) -> Column:
    """The sign with w >= 0."""
    s = F.when(q.w < 0, -1.0).otherwise(1.0)
    return scaled(q, s)


def conjugate(q: Column) -> Column:
    return quat(q.w, -q.x, -q.y, -q.z)


def inverse(q: Column) -> Column:
    n = q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z
    return quat(q.w / n, -q.x / n, -q.y / n, -q.z / n)


@bound
def product(a: Column, b: Column) -> Column:
    return quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


@bound
def rotated(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q."""
    u = vec(q.x, q.y, q.z)
    t = cross(u, v)
    t = vec(2 * t.x, 2 * t.y, 2 * t.z)
    c = cross(u, t)
    return vec(v.x + q.w * t.x + c.x, v.y + q.w * t.y + c.y, v.z + q.w * t.z + c.z)


@bound
def matrix(q: Column) -> Column:
    """The rotation as an array of 9, row by row."""
    w, x, y, z = q.w, q.x, q.y, q.z
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


@bound
def from_matrix(m: Column) -> Column:
    """The quaternion of a rotation matrix, by the greatest of trace and diagonal."""
    e = lambda i, j: m[3 * i + j]
    trace = e(0, 0) + e(1, 1) + e(2, 2)
    root = lambda v: 2 * F.sqrt(F.greatest(v, F.lit(1e-300)))
    s0, s1, s2, s3 = root(1 + trace), root(1 + e(0, 0) - e(1, 1) - e(2, 2)), root(1 + e(1, 1) - e(0, 0) - e(2, 2)), root(1 + e(2, 2) - e(0, 0) - e(1, 1))
    a = quat(s0 / 4, (e(2, 1) - e(1, 2)) / s0, (e(0, 2) - e(2, 0)) / s0, (e(1, 0) - e(0, 1)) / s0)
    b = quat((e(2, 1) - e(1, 2)) / s1, s1 / 4, (e(0, 1) + e(1, 0)) / s1, (e(0, 2) + e(2, 0)) / s1)
    c = quat((e(0, 2) - e(2, 0)) / s2, (e(0, 1) + e(1, 0)) / s2, s2 / 4, (e(1, 2) + e(2, 1)) / s2)
    d = quat((e(1, 0) - e(0, 1)) / s3, (e(0, 2) + e(2, 0)) / s3, (e(1, 2) + e(2, 1)) / s3, s3 / 4)
    top = F.greatest(trace, e(0, 0), e(1, 1), e(2, 2))
    return F.when(trace == top, a).when(e(0, 0) == top, b).when(e(1, 1) == top, c).otherwise(d)


@bound
def exponential(v: Column) -> Column:
    """The rotation by the vector v (axis times angle); a series below a millionth of a radian."""
    a = vec_norm(v)
    half = a / 2
    k = F.when(a < 1e-6, F.lit(0.5) - a * a / 48).otherwise(F.sin(half) / F.when(a < 1e-6, F.lit(1.0)).otherwise(a))
    return quat(F.cos(half), v.x * k, v.y * k, v.z * k)


@bound
def logarithm(q: Column) -> Column:
    """The rotation vector of a unit quaternion, its angle in [0, pi]."""
    c = canonical(q)
    s = F.sqrt(c.x * c.x + c.y * c.y + c.z * c.z)
    k = F.when(s < 1e-9, F.lit(2.0)).otherwise(2 * F.atan2(s, c.w) / F.when(s < 1e-9, F.lit(1.0)).otherwise(s))
    return vec(c.x * k, c.y * k, c.z * k)


@bound
def from_axis_angle(axis: Column, angle: Column) -> Column:
    n = vec_norm(axis)
    k = F.sin(angle / 2) / F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero axis")).cast("double"))
    return quat(F.cos(angle / 2), axis.x * k, axis.y * k, axis.z * k)


def integrated(q: Column, rate: Column, dt: Column) -> Column:
    """q after turning at a body rate for dt seconds; dt below zero raises."""
    t = F.when(dt >= 0, dt).otherwise(F.raise_error(F.lit("negative dt")).cast("double"))
    return product(q, exponential(vec(rate.x * t, rate.y * t, rate.z * t)))


def quat_dot(a: Column, b: Column) -> Column:
    return a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z


@bound
def slerp(a: Column, b: Column, t: Column) -> Column:
    """The shorter way from a to b; nearly parallel ones are mixed and normalised."""
    d = quat_dot(a, b)
    s = F.when(d < 0, -1.0).otherwise(1.0)
    c = F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(c)
    safe = F.when(F.sin(angle) > 1e-9, F.sin(angle)).otherwise(F.lit(1.0))
    near = c > 0.9995
    p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / safe)
    r = F.when(near, t).otherwise(F.sin(t * angle) / safe) * s
    m = quat(a.w * p + b.w * r, a.x * p + b.x * r, a.y * p + b.y * r, a.z * p + b.z * r)
    return scaled(m, 1 / norm(m))


def angle_between(a: Column, b: Column) -> Column:
    return 2 * F.acos(F.least(F.abs(quat_dot(a, b)), F.lit(1.0)))


@bound
def from_euler(yaw: Column, pitch: Column, roll: Column) -> Column:
    cy, sy, cp, sp, cr, sr = (f(a / 2) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    return quat(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


@bound
def to_euler(q: Column) -> Column:
    """struct<yaw,pitch,roll>; at gimbal lock roll is 0 and yaw takes all."""
    s = F.greatest(F.least(2 * (q.w * q.y - q.z * q.x), F.lit(1.0)), F.lit(-1.0))
    lock = F.abs(s) > 1 - 1e-12
    yaw = F.when(lock, -F.signum(s) * 2 * F.atan2(q.x, q.w)).otherwise(F.atan2(2 * (q.w * q.z + q.x * q.y), 1 - 2 * (q.y * q.y + q.z * q.z)))
    roll = F.when(lock, F.lit(0.0)).otherwise(F.atan2(2 * (q.w * q.x + q.y * q.z), 1 - 2 * (q.x * q.x + q.y * q.y)))
    return F.struct(yaw.alias("yaw"), F.asin(s).alias("pitch"), roll.alias("roll"))


def wrapped(a: Column) -> Column:
    """An angle in (-pi, pi]."""
    return PI - F.pmod(PI - a, F.lit(2 * PI))


def wrapped_low(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + PI, F.lit(2 * PI)) - PI


def heading(yaw: Column) -> Column:
    """Clockwise from north, in [0, 2 pi), of a yaw from east."""
    return F.pmod(PI / 2 - yaw, F.lit(2 * PI))


def skew(v: Column) -> Column:
    o = F.lit(0.0)
    return F.array(o, -v.z, v.y, v.z, o, -v.x, -v.y, v.x, o)


def unskew(m: Column) -> Column:
    return vec(m[7], m[2], m[3])


def rot_x(a: Column) -> Column:
    o, e = F.lit(0.0), F.lit(1.0)
    return F.array(e, o, o, o, F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a))


def rot_y(a: Column) -> Column:
    o, e = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(a), o, F.sin(a), o, e, o, -F.sin(a), o, F.cos(a))


def rot_z(a: Column) -> Column:
    o, e = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a), o, o, o, e)


@bound
def mat_mul(a: Column, b: Column) -> Column:
    return F.array(*(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)))


@bound
def mat_vec(m: Column, v: Column) -> Column:
    return vec(*(m[3 * i] * v.x + m[3 * i + 1] * v.y + m[3 * i + 2] * v.z for i in range(3)))


def mat_t(m: Column) -> Column:
    return F.array(*(m[3 * j + i] for i in range(3) for j in range(3)))


def from_euler_matrix(yaw: Column, pitch: Column, roll: Column) -> Column:
    return mat_mul(mat_mul(rot_z(yaw), rot_y(pitch)), rot_x(roll))


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


@bound
def is_rotation(m: Column, tolerance: float = 1e-9) -> Column:
    p = mat_mul(m, mat_t(m))
    near = F.lit(True)
    for i in range(9):
        near = near & (F.abs(p[i] - (1.0 if i % 4 == 0 else 0.0)) <= tolerance)
    return near & (F.abs(determinant(m) - 1) <= tolerance)


@bound
def rotation_angle(m: Column) -> Column:
    return F.acos(F.greatest(F.least((m[0] + m[4] + m[8] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))


@bound
def levelling(up: Column) -> Column:
    """The least rotation that takes a direction to +z; straight down turns about x."""
    n = vec_norm(up)
    u = vec(up.x / n, up.y / n, up.z / n)
    w = 1 + u.z
    return F.when(w < 1e-12, quat(0.0, 1.0, 0.0, 0.0)).otherwise(normalized(quat(F.greatest(w, F.lit(1e-12)), u.y, -u.x, 0.0)))


def mapped(v: Column, places: tuple[int | None, int | None, int | None]) -> Column:
    """Raw columns as axes: for each axis the signed place (1, 2 or 3) it is read from; None: not measured, null.

    A place that is used twice raises.
    """
    used = [abs(p) for p in places if p is not None]
    if len(set(used)) != len(used) or not set(used) <= {1, 2, 3}:
        raise ValueError(f"not a signed partial permutation: {places}")
    axis = lambda p: F.lit(None).cast("double") if p is None else v["xyz"[abs(p) - 1]] * (1 if p > 0 else -1)
    return vec(*map(axis, places))
