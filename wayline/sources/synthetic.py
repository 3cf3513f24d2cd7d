"""A seeded synthetic fleet: exact inertial samples of drives on the ellipsoid, biases, noise, fixes with dropouts.

A drive is a level vehicle on a circle, or weaving, at a steady speed; size,
speed, place and heading depend on the session. Specific force and turn rate follow from the motion, with
Coriolis, earth and transport rate; the phone may be turned in the vehicle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wayline.streaming import earth

SCHEMA = "session_id long, t double, acc_x double, acc_y double, acc_z double, grav_x double, grav_y double, grav_z double, gyro_x double, gyro_y double, gyro_z double, fix_t double, fix_lat double, fix_lon double, fix_h double, fix_acc double, fix_speed double, fix_course double, true_lat double, true_lon double, true_speed double, true_yaw double"
RATE = 10


def drive(session_id: int, seconds: int, noise: float = 0.05, dropout: float = 0.1, seed: int = 20250, accel_bias: float = 0.0, gyro_bias: float = 0.0, mount_yaw: float = 0.0, delay: float = 0.0, weave: float = 0.0) -> pd.DataFrame:
    """RATE samples a second; a fix a second, known delay seconds after its time; weave: seconds of a wave of its turn rate."""
    r = np.random.default_rng([seed, session_id])
    n = seconds * RATE
    t = np.arange(n) / RATE
    speed, rate = 6 + r.random() * 12, (0.02 + 0.06 * r.random()) * r.choice([-1, 1])
    yaw0, lat0, lon0, h = r.uniform(-np.pi, np.pi), np.radians(r.uniform(-60, 60)), np.radians(r.uniform(-179, 179)), 100.0
    rates = rate * (np.cos(2 * np.pi * t / weave) if weave else np.ones(n))
    yaw = yaw0 + np.append(0, np.cumsum(rates[:-1])) / RATE
    v = speed * np.stack([np.cos(yaw), np.sin(yaw), np.zeros(n)], 1)
    place = np.empty((n, 3))
    place[0] = lon0, lat0, h
    for k in range(1, n):  # the mean velocity of a step of a circle is its chord
        half = (yaw[k] - yaw[k - 1]) / 2
        chord = speed / RATE * np.sinc(half / np.pi) * np.array([np.cos(yaw[k] - half), np.sin(yaw[k] - half), 0.0])
        place[k] = earth.moved(place[k - 1], chord)
    turn = earth.turn(mount_yaw)
    accel, gyro, gravity = np.empty((n, 3)), np.empty((n, 3)), np.empty((n, 3))
    for k in range(n):
        mid = yaw[k] + rates[k] / RATE / 2  # a sample holds until the next one
        to_body = turn @ earth.turn(mid).T
        spin, ride = earth.earth_rate(place[k, 1]), earth.transport_rate(place[k, 1], h, v[k])
        force = speed * rates[k] * np.array([-np.sin(mid), np.cos(mid), 0.0]) + earth.cross(2 * spin + ride, v[k]) - earth.gravity(place[k, 1], h)
        accel[k], gyro[k], gravity[k] = to_body @ force, to_body @ (spin + ride) + [0, 0, rates[k]], to_body @ -earth.gravity(place[k, 1], h)
    accel += accel_bias + r.normal(0, noise, (n, 3))
    gyro += gyro_bias + r.normal(0, noise / 100, (n, 3))
    at = np.arange(n) - round(delay * RATE)  # the sample whose place a fix tells
    seen = (np.arange(n) % RATE == 0) & (at >= 0) & (r.random(n) >= dropout)
    at = np.maximum(at, 0)
    off = r.normal(0, 20 * noise, (n, 3)) * [1, 1, 0]
    fix = np.array([earth.moved(place[at[k]], off[k]) for k in range(n)])
    only = lambda x: np.where(seen, x, np.nan)
    return pd.DataFrame(
        {"session_id": session_id, "t": t} | {f"{name}_{a}": x[:, i] for name, x in (("acc", accel), ("grav", gravity), ("gyro", gyro)) for i, a in enumerate("xyz")}
        | {"fix_t": only(t[at]), "fix_lat": only(fix[:, 1]), "fix_lon": only(fix[:, 0]), "fix_h": only(fix[:, 2]), "fix_acc": only(3.0), "fix_speed": only(speed), "fix_course": only(np.pi / 2 - yaw[at])}
        | {"true_lat": place[:, 1], "true_lon": place[:, 0], "true_speed": speed, "true_yaw": yaw}
    )


def fleet(spark: SparkSession, sessions: int, seconds: int = 60, noise: float = 0.05, dropout: float = 0.1, seed: int = 20250) -> DataFrame:
    """Drives of many sessions, each made where its task runs; the same for the same seed. A fix that is not there is null."""

    def run(parts):
        for pdf in parts:
            for i in pdf["id"]:
                one = drive(int(i), seconds, noise, dropout, seed)
                yield one.astype(object).where(one.notna(), None)

    return spark.range(sessions).mapInPandas(run, SCHEMA)
