"""The channels of a model's input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions import quaternion as q

#: Names of the channels, in order (fixed values).
NAMES = ("acc_x", "acc_y", "acc_z", "grav_x", "grav_y", "grav_z", "gyro_x", "gyro_y", "gyro_z", "f_norm", "f_vertical", "f_horizontal", "w_vertical")


@q.bound
def channels(force: Column, gravity: Column, rate: Column, force_scale: Column, rate_scale: Column) -> Column:
    """array of 13: the three vectors by their scales, the force's size, its part along gravity and across it, and the turn rate about it."""
    size = q.vec_norm(gravity)
    size = F.when(size > 0, size).otherwise(1.0)
    along = q.dot(force, gravity) / size
    across = q.vec_norm(q.cross(force, gravity)) / size
    plain = [*(force[n] / force_scale for n in "xyz"), *(gravity[n] / force_scale for n in "xyz"), *(rate[n] / rate_scale for n in "xyz")]
    return F.array(*plain, q.vec_norm(force) / force_scale - 1, along / force_scale - 1, across / force_scale, q.dot(rate, gravity) / size / rate_scale)
