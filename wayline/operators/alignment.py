"""Mounting of a phone in its vehicle: level from the mean force, heading from turns and braking that fixes tell.

Everything is sums by session: the mean force levels, central differences of
fixes give the vehicle's acceleration, a range join gives the level acceleration
of the phone over the same span, and one closed form (a plane Procrustes fit)
turns one into the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import quaternion as q
from wayline.operators import sequence as seq

#: Rows and m/s2 of a mean force, m/s and seconds of a difference, rows of a span, and what an estimate must reach.
LEAST_ROWS, LEAST_FORCE, LEAST_SPEED, MOST_GAP_S, SPAN_ROWS = 10, 5.0, 3.0, 2.5, 5
LEAST_N, LEAST_R2, SCALES = 30, 0.3, (0.5, 1.5)

Keys = list[str]


def up_direction(df: DataFrame, by: Keys, x: str, y: str, z: str) -> DataFrame:
    """by and up, the unit mean direction of finite rows; null with under LEAST_ROWS of them, or a mean under LEAST_FORCE."""
    fine = [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c) for c in (x, y, z)]
    rows = df.where(fine[0] & fine[1] & fine[2]) if by else df
    m = rows.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.count("*").alias("n"))
    size = F.sqrt(F.expr("mx*mx + my*my + mz*mz"))
    ok = (F.col("n") >= LEAST_ROWS) & (size >= LEAST_FORCE)
    return m.select(*by, F.when(ok, q.vec(F.col("mx") / size, F.col("my") / size, F.col("mz") / size)).alias("up"))


def vehicle_acceleration(fixes: DataFrame, by: Keys, order: Keys, t: str, speed: str, course: str, least_speed: float = LEAST_SPEED, most_gap: float = MOST_GAP_S, keep: Keys = ()) -> DataFrame:
    """by, keep, t, the times before and after, and a_long, a_lat (left) of each inner fix: central differences, the course unwrapped.

    Left out are spans over two gaps, and fixes with one under the least speed among the three. course: clockwise, radians.
    """
    w = seq.rows(by, order)
    turned = seq.unwrapped(fixes, by, order, course, 2 * math.pi, "_course")
    before, after = lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)
    dt = after(t) - before(t)
    slowest = F.least(before(speed), F.col(speed), after(speed))
    out = turned.withColumn("_dt", dt).withColumn("_slow", slowest).withColumn("t0", before(t)).withColumn("t1", after(t))
    out = out.withColumn("a_long", (after(speed) - before(speed)) / F.nullif(dt, F.lit(0.0))).withColumn("a_lat", F.col(speed) * -(after("_course") - before("_course")) / F.nullif(dt, F.lit(0.0)))
    inner = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    return out.where(inner & (F.col("_dt") > 0) & (F.col("_dt") <= 2 * most_gap) & (F.col("_slow") >= least_speed)).select(*by, *keep, F.col(t).alias("t"), "t0", "t1", "a_long", "a_lat")


def levelled_means(imu: DataFrame, spans: DataFrame, by: Keys, t: str, x: str, y: str, cell: float) -> DataFrame:
    """spans (by, t, t0, t1, ...) with the means of x and y over t0 <= time < t1, null under SPAN_ROWS rows; cells of time make it an equi-join."""
    cut = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("t0") / cell), F.floor(F.col("t1") / cell))))
    rows = imu.select(*by, F.col(t).alias("_t"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(t) / cell).alias("_cell"))
    inside = (F.col("_t") >= F.col("t0")) & (F.col("_t") < F.col("t1"))
    met = cut.join(rows, [*by, "_cell"], "left").groupBy(*spans.columns).agg(F.count(F.when(inside, F.col("_x"))).alias("_n"), F.avg(F.when(inside, F.col("_x"))).alias("_mx"), F.avg(F.when(inside, F.col("_y"))).alias("_my"))
    enough = F.col("_n") >= SPAN_ROWS
    return met.select(*spans.columns, F.when(enough, F.col("_mx")).alias("x"), F.when(enough, F.col("_my")).alias("y"))


def fit_yaw(pairs: DataFrame, by: Keys) -> DataFrame:
    """by, yaw, scale, r2 and n of the turn that takes (a_long, a_lat) to (x, y); groups of under three pairs are left out."""
    p = pairs.where("x IS NOT NULL AND y IS NOT NULL AND a_long IS NOT NULL AND a_lat IS NOT NULL")
    s = lambda e: F.sum(F.expr(e))
    g = p.groupBy(*by).agg(s("a_long*y - a_lat*x").alias("c"), s("a_long*x + a_lat*y").alias("d"), s("a_long*a_long + a_lat*a_lat").alias("b"), s("x*x + y*y").alias("a"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where("n >= 3")
    length = F.hypot("c", "d")
    # with the best turn, sum |A - s R B|^2 = a - 2 s |(c, d)| + s^2 b
    scale = length / F.col("b")
    left = F.col("a") - length * length / F.col("b")
    spread = F.col("a") - F.col("n") * (F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    return g.select(*by, F.atan2("c", "d").alias("yaw"), scale.alias("scale"), (1 - left / spread).alias("r2"), "n")


def acceptable(n: Column, r2: Column, scale: Column) -> Column:
    return (n >= LEAST_N) & (r2 >= LEAST_R2) & (scale >= SCALES[0]) & (scale <= SCALES[1])


def mounting(imu: DataFrame, fixes: DataFrame, by: Keys, most_gap: float = MOST_GAP_S) -> DataFrame:
    """The whole alignment: by, tilt, yaw, scale, r2, n, acceptable, and mount, the rotation from phone to vehicle.

    imu: by, t, x, y, z (specific force); fixes: by, t, speed, course. A session that cannot be levelled has nulls.
    """
    up = up_direction(imu, by, "x", "y", "z")
    level = imu.join(up, by).withColumn("_l", q.rotated(q.levelling(F.col("up")), q.vec(F.col("x"), F.col("y"), F.col("z")))).where("up IS NOT NULL")
    level = level.select(*by, "t", F.col("_l.x").alias("lx"), F.col("_l.y").alias("ly"))
    spans = vehicle_acceleration(fixes, by, ["t"], "t", "speed", "course", most_gap=most_gap)
    fit = fit_yaw(levelled_means(level, spans, by, "t", "lx", "ly", 2 * most_gap), by)
    out = up.join(fit, by, "left")
    turn = q.from_axis_angle(q.vec(0.0, 0.0, 1.0), -F.col("yaw"))
    mount = F.when(F.col("yaw").isNotNull() & F.col("up").isNotNull(), q.product(turn, q.levelling(F.col("up"))))
    return out.select(*by, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("up.z")))).alias("tilt"), "yaw", "scale", "r2", "n", F.coalesce(acceptable(F.col("n"), F.col("r2"), F.col("scale")), F.lit(False)).alias("acceptable"), mount.alias("mount"))


def summary(estimates: DataFrame, reference: DataFrame, by: Keys) -> DataFrame:
    """One row: sessions, acceptable ones, and median, 90th percentile and maximum of their heading's distance to a reference (by, yaw)."""
    off = F.abs(q.wrapped(F.col("yaw") - F.col("_yaw")))
    both = estimates.join(reference.select(*by, F.col("yaw").alias("_yaw")), by, "left").withColumn("off", F.when(F.col("acceptable"), off))
    from wayline.operators import ranks

    p = ranks.percentiles(both.select("off", F.lit(1).alias("one")), ["one"], {"median": ("off", 0.5), "p90": ("off", 0.9), "most": ("off", 1.0)})
    n = both.agg(F.count("*").alias("n_sessions"), F.count_if("acceptable").alias("n_acceptable"), F.lit(1).alias("one"))
    return n.join(p.drop("n"), "one").drop("one")
