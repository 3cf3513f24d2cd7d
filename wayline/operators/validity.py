"""What makes a sample, a fix or a column unfit, as expressions that name the first fault; null for a good one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full scale of force (16 g), turn rate, magnetic field; heights and speeds that can be.
MOST_FORCE, MOST_RATE, MOST_FIELD_UT, MOST_HEIGHT, MOST_SPEED = 16 * 9.80665, 35.0, 2000.0, 20_000.0, 100.0


def finite(*c: Column) -> Column:
    out = F.lit(True)
    for x in c:
        out = out & F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))
    return out


def channel_fault(channel: Column, x: Column, y: Column, z: Column) -> Column:
    size, most = F.sqrt(x * x + y * y + z * z), F.greatest(F.abs(x), F.abs(y), F.abs(z))
    return (
        F.when(~F.coalesce(channel.isin("ACCEL", "GRAVITY", "GYRO", "MAG"), F.lit(False)), "unknown channel").when(~finite(x, y, z), "not finite")
        .when(channel.isin("ACCEL", "GRAVITY") & (size > MOST_FORCE), "specific force").when((channel == "GYRO") & (most > MOST_RATE), "turn rate").when((channel == "MAG") & (size > MOST_FIELD_UT), "magnetic field")
    )


def fix_fault(lat: Column, lon: Column, h: Column, accuracy: Column, t: Column, received: Column, speed: Column, course: Column) -> Column:
    """Angles in radians, lengths in metres; speed and course both null for a fix without velocity."""
    return (
        F.when(~finite(lat) | (F.abs(lat) > math.pi / 2), "latitude").when(~finite(lon) | (F.abs(lon) > math.pi), "longitude").when(~finite(h) | (F.abs(h) > MOST_HEIGHT), "height")
        .when(~finite(accuracy) | (accuracy <= 0), "accuracy").when(received < t, "received before its time").when(speed.isNull() != course.isNull(), "speed and course apart")
        .when(speed.isNotNull() & (~finite(speed, course) | (speed < 0) | (speed > MOST_SPEED)), "speed")
    )


def outage_shown(state: Column, mode: Column, simulated: Column, running: Column) -> Column:
    return running & (simulated | ((state == "LOST") & (mode != "WAITING")))


def allowed_as(column: str) -> str:
    """input, target or neither: truth and the vehicle's bus are never inputs, and a coordinate is nothing to regress."""
    if any(x in column for x in ("lat", "lon")) and "long_accel" not in column and not column.startswith(("gt_lat_accel",)):
        return "neither"
    return "target" if column.startswith(("gt_", "wheel", "can_", "vbox")) else "input"
