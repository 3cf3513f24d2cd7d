"""Geodesy expressions on the WGS84 ellipsoid; angles in radians, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions.quaternion import bound, mat_t, mat_vec, vec

# Fixed values of WGS84 and of normal gravity.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B, E2 = A * (1 - FLATTENING), FLATTENING * (2 - FLATTENING)
EARTH_RATE, GRAVITY_EQUATOR, GRAVITY_K, FREE_AIR, G0 = 7.292115e-5, 9.7803253359, 1.93185265241e-3, 3.086e-6, 9.80665


def meridian_radius(lat: Column) -> Column:
    return A * (1 - E2) / F.pow(1 - E2 * F.pow(F.sin(lat), 2), 1.5)


def prime_vertical(lat: Column) -> Column:
    return A / F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))


@bound
def to_ecef(lat: Column, lon: Column, h: Column) -> Column:
    n = prime_vertical(lat)
    return vec((n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + h) * F.sin(lat))


@bound
def from_ecef(p: Column) -> Column:
    """struct<lat,lon,h> of a point, in closed form; within 50 km of the centre it raises."""
    r = F.hypot(p.x, p.y)
    far = F.sqrt(r * r + p.z * p.z)
    r = F.when(far >= 50_000, r).otherwise(F.raise_error(F.lit("too near the centre of the earth")).cast("double"))
    f = 54 * B * B * p.z * p.z
    g = r * r + (1 - E2) * p.z * p.z - E2 * (A * A - B * B)
    return _with_root(p, r, f, g, E2 * E2 * f * r * r / (g * g * g))


@bound
def _with_root(p: Column, r: Column, f: Column, g: Column, c: Column) -> Column:
    return _with_k(p, r, f, g, F.cbrt(1 + c + F.sqrt(c * c + 2 * c)))


@bound
def _with_k(p: Column, r: Column, f: Column, g: Column, s: Column) -> Column:
    k = s + 1 + 1 / s
    return _with_q(p, r, f / (3 * k * k * g * g))


@bound
def _with_q(p: Column, r: Column, q0: Column) -> Column:
    return _with_r0(p, r, q0, F.sqrt(1 + 2 * E2 * E2 * q0))


@bound
def _with_r0(p: Column, r: Column, q0: Column, q: Column) -> Column:
    inside = 0.5 * A * A * (1 + 1 / q) - q0 * (1 - E2) * p.z * p.z / (q * (1 + q)) - 0.5 * q0 * r * r
    return _geodetic(p, r, r - E2 * (-q0 * E2 * r / (1 + q) + F.sqrt(F.greatest(inside, F.lit(0.0)))))


@bound
def _geodetic(p: Column, r: Column, d: Column) -> Column:
    u, v = F.sqrt(d * d + p.z * p.z), F.sqrt(d * d + (1 - E2) * p.z * p.z)
    z0 = B * B * p.z / (A * v)
    return F.struct(F.atan2(p.z + (A * A - B * B) / (B * B) * z0, r).alias("lat"), F.atan2(p.y, p.x).alias("lon"), (u * (1 - B * B / (A * v))).alias("h"))


def enu_matrix(lat: Column, lon: Column) -> Column:
    """Rows east, north and up, in earth-fixed axes."""
    sa, ca, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return F.array(-so, co, F.lit(0.0), -sa * co, -sa * so, ca, ca * co, ca * so, sa)


@bound
def ecef_to_enu(p: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    o = to_ecef(lat0, lon0, h0)
    return mat_vec(enu_matrix(lat0, lon0), vec(p.x - o.x, p.y - o.y, p.z - o.z))


@bound
def enu_to_ecef(v: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    o, d = to_ecef(lat0, lon0, h0), mat_vec(mat_t(enu_matrix(lat0, lon0)), v)
    return vec(o.x + d.x, o.y + d.y, o.z + d.z)


def to_enu(lat: Column, lon: Column, h: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    return ecef_to_enu(to_ecef(lat, lon, h), lat0, lon0, h0)


def from_enu(v: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    return from_ecef(enu_to_ecef(v, lat0, lon0, h0))


@bound
def enu_ned(v: Column) -> Column:
    """Swaps east-north-up and north-east-down; its own inverse."""
    return vec(v.y, v.x, -v.z)


def gravity(lat: Column, h: Column) -> Column:
    """Normal gravity on the ellipsoid, less the free-air gradient."""
    s2 = F.pow(F.sin(lat), 2)
    return GRAVITY_EQUATOR * (1 + GRAVITY_K * s2) / F.sqrt(1 - E2 * s2) - FREE_AIR * h


def earth_rate_enu(lat: Column) -> Column:
    return vec(F.lit(0.0), EARTH_RATE * F.cos(lat), EARTH_RATE * F.sin(lat))


def transport_rate_enu(lat: Column, h: Column, v: Column) -> Column:
    return vec(-v.y / (meridian_radius(lat) + h), v.x / (prime_vertical(lat) + h), v.x * F.tan(lat) / (prime_vertical(lat) + h))


def local_delta(lat: Column, lon: Column, lat0: Column, lon0: Column, h: Column) -> Column:
    """East and north metres of a small step."""
    return F.struct(((lon - lon0) * (prime_vertical(lat0) + h) * F.cos(lat0)).alias("e"), ((lat - lat0) * (meridian_radius(lat0) + h)).alias("n"))


def moved(lat: Column, lon: Column, h: Column, east: Column, north: Column) -> Column:
    return F.struct((lat + north / (meridian_radius(lat) + h)).alias("lat"), (lon + east / ((prime_vertical(lat) + h) * F.cos(lat))).alias("lon"))


@bound
def along_cross(east: Column, north: Column, course: Column) -> Column:
    """An error along and across a course (clockwise from north)."""
    return F.struct((east * F.sin(course) + north * F.cos(course)).alias("along"), (east * F.cos(course) - north * F.sin(course)).alias("across"))


def course_velocity(speed: Column, course: Column) -> Column:
    return F.struct((speed * F.sin(course)).alias("e"), (speed * F.cos(course)).alias("n"))


def equirectangular(lat_deg: Column, lon_deg: Column, lat0_deg: Column, lon0_deg: Column) -> Column:
    m = math.pi / 180 * A
    return F.struct(((lon_deg - lon0_deg) * m * F.cos(F.radians(lat0_deg))).alias("x"), ((lat_deg - lat0_deg) * m).alias("y"))


def circle_probability(radius: Column, sigma: Column) -> Column:
    """Share of a round normal error within a radius."""
    return 1 - F.exp(-radius * radius / (2 * sigma * sigma))


#: 68 % of a round normal error is within this many sigmas.
RADIUS_68 = math.sqrt(-2 * math.log(1 - 0.68))


@bound
def course_and_sigma(ve: Column, vn: Column, var_e: Column, cov: Column, var_n: Column) -> Column:
    """struct<course,sigma,speed>: direction from east, its sigma to first order, horizontal speed; under 1 mm/s it is 0 and pi."""
    s2 = ve * ve + vn * vn
    var = (vn * vn * var_e - 2 * vn * ve * cov + ve * ve * var_n) / (s2 * s2)
    slow = F.sqrt(s2) < 1e-3
    return F.struct(F.when(slow, 0.0).otherwise(F.atan2(vn, ve)).alias("course"), F.when(slow, math.pi).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sigma"), F.sqrt(s2).alias("speed"))
