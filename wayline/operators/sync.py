"""One table of a session from two logs: the phone's rows on a corrected clock, and the vehicle's as truth.

The phone table holds session_id, row_idx, t_us (null allowed) and the columns
of SENSORS and FIX; the vehicle table session_id, row_idx, t_us and those of
VEHICLE. ``alignment`` has a row a session: status, correction_us, and delay_us,
the measured delay of its fixes (null: the pooled one). All times are whole
microseconds. Rows without a time and exact copies of a row (all columns but
row_idx) go; order is by time, then row_idx.

The whole is one plan: one exchange removes the copies, one (by session) serves
the fixes, the join in time and the segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators import joins
from wayline.operators import sequence as seq

#: The join's tolerance, the gap that starts a segment, and what counts as standing still.
TOLERANCE_US, BREAK_US, STILL_GPS_MPS, STILL_CAN_MPS = 60_000, 1_000_000, 0.3, 0.05
VERIFIED = "time_join_verified"

#: The columns that go over as they are, with their units.
SENSORS = {f"{kind}_{axis}_{unit}": text for kind, unit, text in (("acc", "mps2", "m/s^2"), ("gyro", "radps", "rad/s"), ("mag", "uT", "uT"), ("grav", "mps2", "m/s^2")) for axis in "xyz"} | {f"orient_{a}_deg": "deg" for a in ("azimuth", "pitch", "roll")}
#: The phone's held fix; a new one is there where one of the first six changes.
FIX = {"lat_deg": "deg WGS84", "lon_deg": "deg WGS84", "alt_m": "m", "speed_mps": "m/s", "accuracy_m": "m", "bearing_deg": "deg", "sats_used": "count", "sats_visible": "count"}
#: The vehicle's columns and their names in the result.
VEHICLE = {
    "vbox_lat_deg": ("gt_lat_deg", "deg WGS84"), "vbox_lon_deg": ("gt_lon_deg", "deg WGS84"), "vbox_height_raw": ("gt_height_msl_m", "m above MSL"), "vbox_speed_mps": ("gt_speed_mps", "m/s"), "vbox_heading_deg": ("gt_heading_deg", "deg"),
    "vbox_vvel_raw": ("gt_vvel_mps", "m/s"), "vbox_sats": ("gt_sats", "count"), "can_speed_mps": ("gt_can_speed_mps", "m/s"), "yaw_rate_radps": ("gt_yaw_rate_radps", "rad/s"), "steering_angle_deg": ("gt_steering_deg", "deg"),
    "can_long_accel_mps2": ("gt_long_accel_mps2", "m/s^2"), "can_lat_accel_mps2": ("gt_lat_accel_mps2", "m/s^2"), "brake_on": ("gt_brake_on", "0/1"),
}
REAR = ("wheel_speed_rl_raw", "wheel_speed_rr_raw")
WHEELS = ("wheel_speed_fl_raw", "wheel_speed_fr_raw", *REAR)

UNITS = {
    "session_id": "id", "segment_id": "id", "t_us": "us UTC, corrected clock", "t_raw_us": "us UTC, phone clock", "dt_s": "s, null where a segment starts", "alignment_verified": "bool", "gt_valid": "bool", **SENSORS,
    **{f"ph_gnss_{n}": u for n, u in FIX.items()}, "ph_gnss_new_fix": "bool", "ph_gnss_epoch_us": "us UTC that the held fix describes", "ph_gnss_fix_age_s": "s", **dict(VEHICLE.values()), "gt_wheel_speed_mps": "m/s, mean of the rear wheels", "gt_stationary": "bool",
}


def prepared(phone: DataFrame) -> DataFrame:
    """Rows with a time, the first of exact copies by row_idx."""
    same = [c for c in phone.columns if c != "row_idx"]
    return phone.where("t_us IS NOT NULL").groupBy(*same).agg(F.min("row_idx").alias("row_idx"))


def accounting(phone: DataFrame) -> DataFrame:
    """One row a session: rows in, without a time, exact copies dropped, out of order, of a time that was there before."""
    kept = prepared(phone)
    w = seq.rows(["session_id"], ["row_idx"])
    place = seq.rows(["session_id"], ["t_us", "row_idx"])
    kept = kept.select("session_id", F.row_number().over(w).alias("a"), F.row_number().over(place).alias("b"), (F.col("t_us") == F.lag("t_us").over(place)).alias("again"))
    kept = kept.groupBy("session_id").agg(F.count("*").alias("n_out"), F.count_if(F.col("a") != F.col("b")).alias("n_reordered"), F.count_if("again").alias("n_same_time"))
    raw = phone.groupBy("session_id").agg(F.count("*").alias("n_in"), F.count_if(F.col("t_us").isNull()).alias("n_no_time"))
    out = raw.join(kept, "session_id", "left").na.fill(0, ["n_out", "n_reordered", "n_same_time"])
    return out.withColumn("n_copies", F.col("n_in") - F.col("n_no_time") - F.col("n_out"))


def wheel_speed(columns: tuple[str, ...], raw_per_kmh: float) -> Column:
    """Mean of the wheels that have a value, in m/s."""
    there = [F.col(c).isNotNull().cast("int") for c in columns]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return total / F.nullif(sum(there, F.lit(0)), F.lit(0)) / (3.6 * raw_per_kmh)


def synced(phone: DataFrame, vehicle: DataFrame, alignment: DataFrame, wheel_raw_per_kmh: float, pooled_delay_us: int | None, tolerance_us: int = TOLERANCE_US, break_us: int = BREAK_US, cut_us: int | None = None) -> DataFrame:
    """The session table: the columns of UNITS, and row_idx. A session that alignment lacks keeps its clock and pooled delay.

    cut_us splits the join in time of long sessions over several tasks.
    """
    p = prepared(phone).join(alignment, "session_id", "left")
    verified = F.coalesce(F.col("status") == VERIFIED, F.lit(False))
    p = p.withColumn("alignment_verified", verified).withColumnRenamed("t_us", "t_raw_us")
    p = p.withColumn("t_us", F.col("t_raw_us") + F.when(verified, F.coalesce("correction_us", F.lit(0))).otherwise(0).cast("long"))
    # both bounded at nought: a fix cannot be told before it is
    p = p.withColumn("_delay", F.greatest(F.coalesce(F.col("delay_us"), F.lit(pooled_delay_us).cast("long")), F.lit(0).cast("long"))).withColumn("_delay", F.when(F.col("delay_us").isNull() & F.lit(pooled_delay_us is None), None).otherwise(F.col("_delay")))
    by, order = ["session_id"], ["t_us", "row_idx"]
    right = vehicle.withColumnRenamed("row_idx", "vehicle_row").where("t_us IS NOT NULL")
    values = ["vehicle_row", *VEHICLE, *WHEELS]
    j = joins.asof(p, right, by, "t_us", "row_idx", "vehicle_row", values, "nearest", tolerance_us, cut_us)
    j = seq.changed(j, by, order, list(FIX)[:6], "ph_gnss_new_fix")
    j = seq.filled(j, by, order, F.when(F.col("ph_gnss_new_fix"), F.col("t_us")), "_appeared")
    j = seq.segments(j, by, order, "t_us", break_us)
    matched = F.col("r_vehicle_row").isNotNull()
    wheels = [f"r_{c}" for c in WHEELS]
    still = (F.col("r_vbox_speed_mps") <= STILL_GPS_MPS) & (F.abs("r_can_speed_mps") <= STILL_CAN_MPS) & (F.greatest(*(F.abs(c) for c in wheels)) == 0)
    epoch = F.col("_appeared") - F.col("_delay")
    made = {
        "dt_s": F.col("dt_us") / F.lit(1e6), "gt_valid": matched, "ph_gnss_epoch_us": epoch, "ph_gnss_fix_age_s": (F.col("t_us") - epoch) / F.lit(1e6), "gt_wheel_speed_mps": wheel_speed(tuple(f"r_{c}" for c in REAR), wheel_raw_per_kmh), "gt_stationary": matched & F.coalesce(still, F.lit(False)),
        **{f"ph_gnss_{n}": F.col(n) for n in FIX}, **{new: F.col(f"r_{old}") for old, (new, _) in VEHICLE.items()},
    }
    return j.select("row_idx", *(made.get(n, F.col(n)).alias(n, metadata={"unit": u}) for n, u in UNITS.items()))
