"""Judgements on samples, fixes and boxes, each with its reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import validity
from wayline.plans.catalog import query
from wayline.plans.q_navigation import _FORMULAS
from wayline.plans.tables import events, table
from wayline.sources import maps

_V = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 400 AS x, CAST(embedding[2] AS DOUBLE) * 400 AS y, CAST(embedding[3] AS DOUBLE) * 400 AS z, CASE vec_id % 5 WHEN 0 THEN 'ACCEL' WHEN 1 THEN 'GYRO' WHEN 2 THEN 'MAG' WHEN 3 THEN 'GRAVITY' ELSE 'LIGHT' END AS channel FROM embeddings)"


@query("channel_validation", f"WITH {_V} SELECT vec_id, CASE WHEN channel = 'LIGHT' THEN 'unknown channel' WHEN vec_id % 11 = 0 THEN 'not finite' WHEN channel IN ('ACCEL', 'GRAVITY') AND sqrt(x*x + y*y + z*z) > 156.9064 THEN 'specific force' WHEN channel = 'GYRO' AND greatest(abs(x), abs(y), abs(z)) > 35 THEN 'turn rate' WHEN channel = 'MAG' AND sqrt(x*x + y*y + z*z) * 20 > 2000 THEN 'magnetic field' END AS fault FROM v")
def channel_validation(spark, d):
    """Vectors of sensor channels: finite, and within full scale (16 g, 35 rad/s on an axis, 2 mT)."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double") * 400
    channel = F.element_at(F.array(*map(F.lit, ("ACCEL", "GYRO", "MAG", "GRAVITY", "LIGHT"))), (F.col("vec_id") % 5 + 1).cast("int"))
    v = e.select("vec_id", channel.alias("channel"), *(at(i).alias(n) for i, n in enumerate("xyz")))
    scale = F.when(F.col("channel") == "MAG", 20.0).otherwise(1.0)
    x = F.when(F.col("vec_id") % 11 == 0, float("nan")).otherwise(F.col("x") * scale)
    return v.select("vec_id", validity.channel_fault(F.col("channel"), x, F.col("y") * scale, F.col("z") * scale).alias("fault"))


@query("fix_faults", f"WITH c AS (SELECT c_custkey, {', '.join(f'CAST({f} AS DOUBLE) AS {n}' for n, f in _FORMULAS.items())}, c_acctbal * 4 AS h FROM customer) SELECT c_custkey, CASE WHEN abs(de / 9) > pi() / 2 THEN 'latitude' WHEN abs(dn / 4) > pi() THEN 'longitude' WHEN abs(h) > 20000 THEN 'height' WHEN acc - 3 <= 0 THEN 'accuracy' WHEN fx > 2 THEN 'received before its time' WHEN (c_custkey % 6 = 0) <> (c_custkey % 4 = 0) THEN 'speed and course apart' WHEN c_custkey % 6 > 0 AND (ve < 0 OR ve > 100) THEN 'speed' END AS fault FROM c")
def fix_faults(spark, d):
    """Fixes in radians and metres: the first of seven faults. Speed is null for every sixth, course for every fourth."""
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_acctbal * 4 AS h", *(f"CAST({f} AS DOUBLE) AS {n}" for n, f in _FORMULAS.items()))
    k = F.col("c_custkey")
    speed, course = F.when(k % 6 > 0, F.col("ve")), F.when(k % 4 > 0, F.lit(1.0))
    return c.select("c_custkey", validity.fix_fault(F.col("de") / 9, F.col("dn") / 4, F.col("h"), F.col("acc") - 3, F.lit(0.0), F.when(F.col("fx") > 2, -1.0).otherwise(1.0), speed, course).alias("fault"))


@query("box_faults", f"WITH b AS (SELECT c_custkey, c_custkey * 37 % 200 - 100.0 AS s, c_custkey * 91 % 380 - 190.0 AS w, (c_custkey % 9) / 10.0 - 0.1 AS dn, (c_custkey % 7) / 8.0 AS de FROM customer) SELECT c_custkey, CASE WHEN NOT (s >= -90 AND dn > 0 AND s + dn <= 90) THEN 'latitudes' WHEN NOT (w >= -180 AND de > 0 AND w + de <= 180) THEN 'longitudes' WHEN greatest(dn, de) > {maps.MOST_SIDE} THEN 'too large' END AS fault FROM b")
def box_faults(spark, d):
    k = F.col("c_custkey")
    s, w = (k * 37 % 200 - 100).cast("double"), (k * 91 % 380 - 190).cast("double")
    # sides are whole eighths and tenths: none lies near the least side
    dn, de = k % 9 / 10.0 - 0.1, k % 7 / 8.0
    fault = maps.box_fault(F.lit(0.0), F.lit(0.0), dn, de)
    whole = F.when(~((s >= -90) & (dn > 0) & (s + dn <= 90)), "latitudes").when(~((w >= -180) & (de > 0) & (w + de <= 180)), "longitudes").otherwise(fault)
    return table(spark, d, "customer").select("c_custkey", whole.alias("fault"))


@query("gnss_out_shown", "WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k % 5 > 0 AND (k % 7 = 0 OR event_type = 'error' AND value > 20) AS shown FROM e")
def gnss_out_shown(spark, d):
    """Whether an outage is shown: while running, a simulated one, or a lost state once the engine has started."""
    e = events(spark, d)
    state, mode = F.when(F.col("event_type") == "error", "LOST").otherwise("GOOD"), F.when(F.col("value") > 20, "NAVIGATING").otherwise("WAITING")
    return e.select("event_id", validity.outage_shown(state, mode, F.col("k") % 7 == 0, F.col("k") % 5 > 0).alias("shown"))


@query("roles_and_targets", "SELECT 'gt_speed_mps' AS name, 'target' AS allowed_as UNION ALL SELECT 'acc_x_mps2', 'input' UNION ALL SELECT 'gt_lat_deg', 'neither' UNION ALL SELECT 'ph_gnss_lon_deg', 'neither'")
def roles_and_targets(spark, d):
    """What a column may be for a model: truth is never an input, a coordinate never a target."""
    names = ("gt_speed_mps", "acc_x_mps2", "gt_lat_deg", "ph_gnss_lon_deg")
    return spark.createDataFrame([(n, validity.allowed_as(n)) for n in names], "name string, allowed_as string")
