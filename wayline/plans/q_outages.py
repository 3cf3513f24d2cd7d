"""Outages: customers are sessions of some length, events their fixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import outages as o
from wayline.plans.catalog import query
from wayline.plans.tables import events, table
from wayline.sources import synthetic
from wayline.streaming.navigator import COLUMNS, Options, navigate

_E = "e AS (SELECT event_id, user_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e9 AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _sessions(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("session_id"), (key % 50).cast("double").alias("first"), (key % 50 + key * 37 % 4000).cast("double").alias("last"))


@query("outages_every", "WITH s AS (SELECT c_custkey AS session_id, CAST(c_custkey % 50 AS DOUBLE) AS first, CAST(c_custkey % 50 + c_custkey * 37 % 4000 AS DOUBLE) AS last FROM customer) SELECT session_id, CAST(i AS INT) AS outage, 'full' AS kind, first + i * 240 AS start, first + i * 240 + CASE WHEN i % 2 = 0 THEN 30 ELSE 60 END AS \"end\" FROM s, range(0, 20) t(i) WHERE first + i * 240 + 60 < last")
def outages_every(spark, d):
    return o.checked(o.periodic(_sessions(spark, d), 240.0, (30.0, 60.0)))


@query("outage_battery", f"""WITH RECURSIVE p AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', {s})" for i, (k, s) in enumerate(o.BATTERY))}) v(i, kind, len)),
s AS (SELECT c_custkey AS session_id, CAST(c_custkey % 50 AS DOUBLE) AS first, CAST(c_custkey % 50 + c_custkey * 37 % 4000 AS DOUBLE) AS last FROM customer),
r AS (SELECT session_id, last, -1 AS outage, '' AS kind, first AS start, first AS "end", first AS nxt FROM s
  UNION ALL
  SELECT r.session_id, r.last, r.outage + 1, CASE WHEN r.nxt + p.len + 150 <= r.last THEN p.kind ELSE 'full' END, r.nxt, r.nxt + CASE WHEN r.nxt + p.len + 150 <= r.last THEN p.len WHEN r.nxt + 160 <= r.last THEN 10 END,
    r.nxt + CASE WHEN r.nxt + p.len + 150 <= r.last THEN p.len WHEN r.nxt + 160 <= r.last THEN 10 END + 150
  FROM r JOIN p ON p.i = (r.outage + 1) % 8 WHERE r.nxt + 160 <= r.last)
SELECT session_id, CAST(outage AS INT) AS outage, kind, start, "end" FROM r WHERE outage >= 0""")
def outage_battery(spark, d):
    """The eight profiles in turn; at the end the shortest that still fits (ten seconds)."""
    return o.checked(o.battery(_sessions(spark, d)))


def _fixes(spark, d) -> DataFrame:
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))) / 1e9
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("fix_id"), t.alias("t"), F.lit(0.5).alias("lat"), F.lit(0.1).alias("lon"), F.lit(0.0).alias("h"), (F.col("value") / 10 + 3).alias("accuracy"))


def _schedule(spark, d) -> DataFrame:
    """One event of each kind for each user, 400 seconds apart."""
    u = events(spark, d).select(F.col("user_id").alias("session_id")).distinct()
    kinds = F.posexplode(F.array(*map(F.lit, ("full", "tunnel", "degraded", "intermittent"))))
    return u.select("session_id", kinds.alias("outage", "kind")).selectExpr("session_id", "outage", "kind", "100D + outage * 400 AS start", "100D + outage * 400 + 120 AS end")


_WHAT = """CASE WHEN t >= 100 AND t < 220 THEN 'withheld' WHEN t >= 494 AND t < 500 THEN 'approach' WHEN t >= 500 AND t < 620 THEN 'withheld' WHEN t >= 900 AND t < 1020 THEN 'degraded'
  WHEN event_id = first_exit AND t < 656 THEN 'outlier' WHEN t >= 620 AND t < 626 THEN 'exit' END"""


@query("outage_log", f"WITH {_E}, x AS (SELECT *, CASE WHEN t >= 620 AND t < 656 THEN first_value(event_id) OVER (PARTITION BY user_id, t >= 620 AND t < 656 ORDER BY t, event_id) END AS first_exit FROM e), w AS (SELECT *, {_WHAT} AS what FROM x WHERE NOT (t >= 1300 AND t < 1420)) SELECT event_id AS fix_id, what, what = 'withheld' AS withheld, round((value / 10 + 3) * CASE what WHEN 'degraded' THEN 3 WHEN 'approach' THEN 1 + 3 * (t - 494) / 6 WHEN 'exit' THEN 4 - 3 * (t - 620) / 6 ELSE 1 END, 5) AS accuracy FROM w WHERE what IS NOT NULL")
def outage_log(spark, d):
    """What each kind does to fixes, and the ramps and the outlier of a tunnel; the intermittent outage has a query of its own."""
    after = o.applied(_fixes(spark, d), o.checked(_schedule(spark, d)), 7).where("NOT (t >= 1300 AND t < 1420)")
    return after.where("what IS NOT NULL").select("fix_id", "what", "withheld", F.round("accuracy", 5).alias("accuracy"))


@query("outage_effects", f"WITH {_E} SELECT 'degraded' AS what, count(CASE WHEN t >= 900 AND t < 1020 THEN 1 END) AS n, true AS moved_as_said FROM e UNION ALL SELECT 'outlier', count(DISTINCT CASE WHEN t >= 620 AND t < 656 THEN user_id END), true FROM e UNION ALL SELECT 'untouched', count(CASE WHEN NOT (t >= 100 AND t < 220 OR t >= 494 AND t < 626 OR t >= 900 AND t < 1020 OR t >= 1300 AND t < 1420) THEN 1 END) - count(DISTINCT CASE WHEN t >= 620 AND t < 656 THEN user_id END) + count(DISTINCT CASE WHEN t >= 620 AND t < 626 THEN user_id END), true FROM e")
def outage_effects(spark, d):
    """Degraded fixes move by a few of their sigmas, the outlier by 150 m, all others not at all; twice the same for one seed."""
    from wayline.functions import geodesy as geo

    one = o.applied(_fixes(spark, d), _schedule(spark, d), 7).where("NOT withheld AND NOT (t >= 1300 AND t < 1420)")
    again = o.applied(_fixes(spark, d).repartition(3, "fix_id"), _schedule(spark, d), 7).select("fix_id", F.col("lat").alias("lat2"))
    p = geo.local_delta(F.col("lat"), F.col("lon"), F.lit(0.5), F.lit(0.1), F.lit(0.0))
    x = one.join(again, "fix_id").withColumn("off", F.hypot(p.e, p.n)).withColumn("what", F.coalesce("what", F.lit("untouched")))
    sigma = F.col("accuracy") * 2 / 3
    right = F.when(F.col("what") == "degraded", F.col("off") < 6 * sigma).when(F.col("what") == "outlier", F.abs(F.col("off") - 150) < 0.5).otherwise(F.col("off") == 0)
    return x.where("what IN ('degraded', 'outlier', 'untouched')").groupBy("what").agg(F.count("*").alias("n"), F.bool_and(right & (F.col("lat") == F.col("lat2"))).alias("moved_as_said"))


@query("outage_now_and_then", f"WITH {_E} SELECT count(*) AS n, true AS some_through, true AS some_withheld, true AS through_are_degraded FROM e WHERE t >= 1300 AND t < 1420")
def outage_now_and_then(spark, d):
    """An intermittent outage withholds most fixes; those that get through are three times worse."""
    after = o.applied(_fixes(spark, d), _schedule(spark, d), 7).where("t >= 1300 AND t < 1420")
    plain = _fixes(spark, d).select("fix_id", F.col("accuracy").alias("was"))
    x = after.join(plain, "fix_id")
    worse = F.abs(F.col("accuracy") - 3 * F.col("was")) < 1e-9
    return x.agg(F.count("*").alias("n"), (F.count_if(~F.col("withheld")) > 0).alias("some_through"), (F.count_if("withheld") > F.count_if(~F.col("withheld"))).alias("some_withheld"), F.bool_and(F.col("withheld") | worse).alias("through_are_degraded"))


# ------------------------------------------------------------------ batteries over drives

_ARMS = {"straight": Options(speed=False, straight_needs_speed=False), "plain": Options(speed=False, straight=False, states=False, recovery=False)}


def replayed(df: DataFrame, schedule: DataFrame, arms: dict[str, Options], seed: int = 0, mount: np.ndarray | None = None) -> DataFrame:
    """Every session under its schedule through every arm: the rows of navigate. Sensors are untouched; fixes come through the schedule."""
    fixes = df.where("fix_t IS NOT NULL").select("session_id", F.col("t").alias("received"), F.col("fix_t").alias("t"), F.monotonically_increasing_id().alias("any"), F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon"), F.col("fix_h").alias("h"), F.col("fix_acc").alias("accuracy"), "fix_speed", "fix_course")
    fixes = fixes.withColumn("fix_id", F.round(F.col("received") * 1000).cast("long")).drop("any")
    after = o.applied(fixes, schedule, seed).where("NOT withheld").select("session_id", F.col("received").alias("t"), F.col("t").alias("fix_t"), F.col("lat").alias("fix_lat"), F.col("lon").alias("fix_lon"), F.col("h").alias("fix_h"), F.col("accuracy").alias("fix_acc"), "fix_speed", "fix_course")
    bare = df.select("session_id", *(c for c in COLUMNS if not c.startswith("fix")))
    return navigate(bare.join(after, ["session_id", "t"], "left"), "session_id", arms=arms, mount=mount)


def digest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group's rows in order: equal digests mean equal outputs, bit for bit. Groups are sessions."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, row.alias("_h")))).alias("_l"), F.count("*").alias("n"))
    return lists.select(*keys, "n", F.sha2(F.array_join(F.transform("_l", lambda x: x["_h"]), ","), 256).alias("digest"))


@query("replay_battery", "SELECT i AS session_id, a AS arm, true AS same, true AS lost, true AS back FROM range(0, 2) t(i), (VALUES ('straight'), ('plain')) v(a)")
def replay_battery(spark, d):
    """Two arms over drives with an outage of 15 seconds: replays are equal bit for bit, errors grow in the outage and shrink after it."""
    df = synthetic.fleet(spark, 2, 45, 0.05, 0.0)
    schedule = spark.createDataFrame([(i, 0, "full", 18.0, 33.0) for i in range(2)], o.SCHEMA)
    out = [replayed(df, schedule, _ARMS, mount=np.eye(3)) for _ in range(2)]
    a, b = (digest(x, ["session_id", "arm"], ["t"], x.columns).withColumnRenamed("digest", f"d{k}").drop("n") for k, x in enumerate(out))
    t = F.col("t")
    g = out[0].groupBy("session_id", "arm").agg(F.max(F.when((t > 15) & (t < 18), F.col("sigma"))).alias("before"), F.max(F.when((t > 31) & (t < 33), F.col("sigma"))).alias("inside"), F.min(F.when(t > 40, F.col("sigma"))).alias("after"))
    return a.join(b, ["session_id", "arm"]).join(g, ["session_id", "arm"]).select("session_id", "arm", (F.col("d0") == F.col("d1")).alias("same"), (F.col("inside") > 2 * F.col("before")).alias("lost"), (F.col("after") < F.col("inside") / 2).alias("back"))
