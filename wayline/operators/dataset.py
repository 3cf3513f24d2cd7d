"""The preparation of a data set as one chain of lazy tables: sync, gate, split, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import splits, sync


class GateError(ValueError):
    """Rows that are not accounted for, or times that cannot be."""


def prepared(phone: DataFrame, vehicle: DataFrame, alignment: DataFrame, sessions: DataFrame, wheel_raw_per_kmh: float, channels: list[str], tolerance_us: int = sync.TOLERANCE_US, break_us: int = sync.BREAK_US) -> dict[str, DataFrame]:
    """synced, accounting, gate, splits and statistics of a data set; sessions: session_id, driver, drive_id, hours.

    The pooled delay, one number of all sessions, is the only barrier between the
    passes; all else is lazy.
    """
    pooled = alignment.where("delay_us IS NOT NULL").agg(F.percentile("delay_us", 0.5)).head()[0]
    table = sync.synced(phone, vehicle, alignment, wheel_raw_per_kmh, None if pooled is None else int(pooled), tolerance_us, break_us)
    accounting = sync.accounting(phone)
    kept = table.groupBy("session_id").agg(F.count("*").alias("n_rows"), F.count_if((F.col("dt_s") <= 0) | (F.col("dt_s") > break_us / 1e6)).alias("n_bad_dt"))
    gate = accounting.join(kept, "session_id", "left").na.fill(0, ["n_rows", "n_bad_dt"])
    gate = gate.withColumn("passes", (F.col("n_rows") == F.col("n_in") - F.col("n_no_time") - F.col("n_copies")) & (F.col("n_bad_dt") == 0))
    assigned = splits.assign(sessions)
    train = table.join(assigned.where("split = 'train'").select("session_id"), "session_id", "left_semi")
    stats = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in channels))).alias("v")).groupBy("v.channel").agg(F.avg("v.x").alias("mean"), F.stddev_pop("v.x").alias("std"), F.count("v.x").alias("n"))
    return {"synced": table, "accounting": accounting, "gate": gate, "splits": assigned, "statistics": stats}


def checked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables, if every session passes the gate and no drive or test driver lies in two splits; else it raises and names them."""
    bad = [r[0] for r in tables["gate"].where("NOT passes").select("session_id").limit(20).collect()]
    leaks = [tuple(r) for r in splits.leaks(tables["splits"]).limit(20).collect()]
    if bad or leaks:
        raise GateError(f"sessions that fail: {bad}; leaks: {leaks}")
    return tables
