"""Splits of recorded drives by driver and date, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def nearest_subset(hours: dict[str, float], share: float, within: tuple[float, float]) -> tuple[str, ...]:
    """The drivers whose hours together are nearest to a share of all, and within limits; empty if no subset is.

    Hours count in whole minutes. For each sum that can be reached the first
    subset by names is kept, so the work follows drivers times minutes, not the
    number of subsets. At least one driver stays out.
    """
    minutes = {x: round(h * 60) for x, h in sorted(hours.items())}
    whole = sum(minutes.values())
    best: dict[int, tuple[str, ...]] = {0: ()}
    for x, m in minutes.items():
        for total, names in list(best.items()):
            new = (*names, x)
            if total + m <= within[1] * whole and len(new) < len(minutes) and new < best.get(total + m, ("\uffff",)):
                best[total + m] = new
    fit = [(abs(t - share * whole), names) for t, names in best.items() if names and within[0] * whole <= t]
    return min(fit, default=(0, ()))[1]


def assign(sessions: DataFrame, share: float = 0.2, within: tuple[float, float] = (0.1, 0.35), validation: float = 0.15, seed: int = 20250) -> DataFrame:
    """sessions (session_id, driver, drive_id, hours) with their split.

    The test split holds whole drivers: the subset whose hours are nearest to the
    share, and none where no subset is within the limits. Of the rest, drives in
    a seeded order go to validation until it has its share; every driver keeps a
    drive for training. One row a driver is collected.
    """
    totals = sessions.groupBy("driver").agg(F.sum("hours").alias("hours")).orderBy("driver").collect()
    test = nearest_subset({r.driver: r.hours for r in totals}, share, within)
    drives = sessions.where(~F.col("driver").isin(list(test)) if test else F.lit(True)).groupBy("driver", "drive_id").agg(F.sum("hours").alias("hours"))
    from pyspark.sql import Window

    order = F.xxhash64("drive_id", F.lit(seed))
    in_driver = Window.partitionBy("driver").orderBy(order, "drive_id")
    ranked = drives.withColumn("place", F.row_number().over(in_driver)).withColumn("so_far", F.sum("hours").over(in_driver.rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("hours").over(Window.partitionBy("driver"))).withColumn("n", F.count("*").over(Window.partitionBy("driver")))
    chosen = ranked.where((F.col("place") < F.col("n")) & (F.col("so_far") - F.col("hours") / 2 <= validation * F.col("of"))).select("drive_id", F.lit(True).alias("in_validation"))
    split = F.when(F.col("driver").isin(list(test)), "test").when(F.col("in_validation"), "val").otherwise("train") if test else F.when(F.col("in_validation"), "val").otherwise("train")
    return sessions.join(chosen, "drive_id", "left").withColumn("split", split).drop("in_validation")


def only(df: DataFrame, train: DataFrame, key: str = "session_id") -> DataFrame:
    """df, if all its sessions are in train (key); else it raises and names some of those that are not."""
    out = [r[0] for r in df.select(key).distinct().join(train.select(key), key, "left_anti").orderBy(key).limit(10).collect()]
    if out:
        raise ValueError(f"not in training: {out}")
    return df


def leaks(assigned: DataFrame) -> DataFrame:
    """Drives that lie in more than one split, and test drivers met elsewhere."""
    spans = assigned.groupBy("drive_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("drive in several splits").alias("kind"), F.col("drive_id").cast("string").alias("name"))
    drivers = assigned.groupBy("driver").agg(F.bool_or(F.col("split") == "test").alias("t"), F.bool_or(F.col("split") != "test").alias("o")).where("t AND o")
    return spans.unionByName(drivers.select(F.lit("test driver elsewhere").alias("kind"), F.col("driver").cast("string").alias("name")))
