"""The central query: views and purchases play the phone's log of a user, clicks and errors the vehicle's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import sync
from wayline.plans.catalog import query
from wayline.plans.tables import events

HOUR, DAY = 3_600_000_000, 86_400_000_000
TOLERANCE, BREAK, POOLED, WHEEL = 6 * HOUR, 5 * DAY, 2 * HOUR, 1.25
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

# every column is a plain formula of value and k, the same in both languages
_SENSOR = {n: f"(value * {i + 1} + k) / 8" for i, n in enumerate(sync.SENSORS)}
_FIX = {n: f"floor(k / 25) * {i + 1} + floor(value / 60)" if i < 6 else f"k % {i + 3}" for i, n in enumerate(sync.FIX)}
_VEHICLE = {n: f"(value * {i + 2} - k) / 16" for i, n in enumerate(sync.VEHICLE)} | {"vbox_speed_mps": "(k % 4) / 8", "can_speed_mps": "(k % 3) / 64"}
_WHEEL = {n: f"CASE WHEN k % {i + 5} > 2 THEN NULL ELSE (k % {i + 2}) * 0.5 END" for i, n in enumerate(sync.WHEELS)}


def _cols(formulas: dict[str, str], sql: bool) -> list[str]:
    return [f"CAST({f.replace('value', 'CAST(value AS DOUBLE)') if sql else f} AS DOUBLE) AS {n}" for n, f in formulas.items()]


def phone(spark, d) -> DataFrame:
    """Rows of a user; some have no time, and each eleventh is there twice."""
    e = events(spark, d).where("event_type IN ('view', 'purchase')")
    rows = e.selectExpr("user_id AS session_id", "event_id * 2 AS row_idx", "CASE WHEN event_id % 13 > 0 THEN t_us END AS t_us", *_cols(_SENSOR | _FIX, False), "event_id")
    return rows.unionByName(rows.where("event_id % 11 = 0").withColumn("row_idx", F.col("row_idx") + 1)).drop("event_id")


def vehicle(spark, d) -> DataFrame:
    e = events(spark, d).where("event_type IN ('click', 'error')")
    return e.selectExpr("user_id AS session_id", "event_id AS row_idx", "t_us", *_cols(_VEHICLE | _WHEEL, False))


def alignment(spark, d) -> DataFrame:
    """Every fourth user is not verified, every fifth has no delay of its own; one in seven is not there at all."""
    u = events(spark, d).select("user_id").distinct().where("user_id % 7 > 0")
    return u.selectExpr("user_id AS session_id", f"CASE WHEN user_id % 4 = 0 THEN 'weak' ELSE '{sync.VERIFIED}' END AS status", f"CAST((user_id % 9 - 4) * {HOUR} AS BIGINT) AS correction_us", f"CAST(CASE WHEN user_id % 5 > 0 THEN (user_id % 6 - 1) * {HOUR} END AS BIGINT) AS delay_us")


def _oracle() -> str:
    near = f"(SELECT v.row_idx FROM v WHERE v.session_id = t.session_id ORDER BY abs(v.t_us - t.t_us), CASE WHEN v.t_us <= t.t_us THEN 0 ELSE 1 END, CASE WHEN v.t_us <= t.t_us THEN -v.row_idx ELSE v.row_idx END LIMIT 1)"
    change = " OR ".join(f"{n} IS DISTINCT FROM lag({n}) OVER o" for n in list(sync.FIX)[:6])
    gt = ", ".join(f"v.{old} AS {new}" for old, (new, _) in sync.VEHICLE.items())
    wheels = ", ".join(f"abs(v.{w})" for w in sync.WHEELS)
    left, right = (f"v.{w}" for w in sync.REAR)
    out = ["row_idx", *(f"f.{n} AS ph_gnss_{n}" if (n := c.removeprefix("ph_gnss_")) in sync.FIX else c for c in sync.UNITS)]
    return f"""WITH {_E},
r AS (SELECT event_id, user_id AS session_id, event_id * 2 AS row_idx, CASE WHEN event_id % 13 > 0 THEN t_us END AS t_raw_us, {", ".join(_cols(_SENSOR | _FIX, True))} FROM e WHERE event_type IN ('view', 'purchase')),
v AS (SELECT user_id AS session_id, event_id AS row_idx, t_us, {", ".join(_cols(_VEHICLE | _WHEEL, True))} FROM e WHERE event_type IN ('click', 'error')),
p AS (SELECT *, session_id % 7 > 0 AND session_id % 4 > 0 AS alignment_verified, greatest(0, CASE WHEN session_id % 7 > 0 AND session_id % 5 > 0 THEN (session_id % 6 - 1) * {HOUR} ELSE {POOLED} END) AS delay FROM r WHERE t_raw_us IS NOT NULL),
t AS (SELECT *, t_raw_us + CASE WHEN alignment_verified THEN (session_id % 9 - 4) * {HOUR} ELSE 0 END AS t_us FROM p),
m AS (SELECT t.*, {near} AS mid, row_number() OVER o = 1 OR {change} AS ph_gnss_new_fix, t_us - lag(t_us) OVER o AS dt FROM t WINDOW o AS (PARTITION BY session_id ORDER BY t_us, row_idx)),
f AS (SELECT *, max(CASE WHEN ph_gnss_new_fix THEN t_us END) OVER o AS appeared, CAST(sum(CASE WHEN dt IS NULL OR dt > {BREAK} THEN 1 ELSE 0 END) OVER o AS BIGINT) - 1 AS segment_id FROM m WINDOW o AS (PARTITION BY session_id ORDER BY t_us, row_idx ROWS UNBOUNDED PRECEDING)),
g AS (SELECT f.row_idx AS frow, v.row_idx IS NOT NULL AS gt_valid, {gt}, (coalesce({left}, 0) + coalesce({right}, 0)) / nullif(({left} IS NOT NULL)::INT + ({right} IS NOT NULL)::INT, 0) / {3.6 * WHEEL!r} AS gt_wheel_speed_mps,
  coalesce(v.row_idx IS NOT NULL AND v.vbox_speed_mps <= 0.3 AND abs(v.can_speed_mps) <= 0.05 AND greatest({wheels}) = 0, false) AS gt_stationary FROM f LEFT JOIN v ON v.session_id = f.session_id AND v.row_idx = f.mid AND abs(v.t_us - f.t_us) <= {TOLERANCE}),
h AS (SELECT *, CASE WHEN dt <= {BREAK} THEN dt / 1e6 END AS dt_s, appeared - delay AS ph_gnss_epoch_us, (t_us - (appeared - delay)) / 1e6 AS ph_gnss_fix_age_s FROM f)
SELECT {", ".join(out)} FROM h f JOIN g ON g.frow = f.row_idx"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@query("synced_table", f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in set(sync.SENSORS) | {f'ph_gnss_{n}' for n in sync.FIX} | {n for n, _ in sync.VEHICLE.values()} | {'dt_s', 'ph_gnss_fix_age_s', 'gt_wheel_speed_mps'} else c for c in ['row_idx', *sync.UNITS])} FROM ({_oracle()})")
def synced_table(spark, d):
    """The whole table of 46 columns: corrected clock, held fix, nearest truth, standing still, segments."""
    return _rounded(sync.synced(phone(spark, d), vehicle(spark, d), alignment(spark, d), WHEEL, POOLED, TOLERANCE, BREAK))


@query("synced_table_cut", f"SELECT row_idx, gt_valid, round(gt_speed_mps, 6) AS gt_speed_mps, segment_id FROM ({_oracle()})")
def synced_table_cut(spark, d):
    """The same with each session's join split into parts of ten days."""
    out = sync.synced(phone(spark, d), vehicle(spark, d), alignment(spark, d), WHEEL, POOLED, TOLERANCE, BREAK, 10 * DAY)
    return _rounded(out.select("row_idx", "gt_valid", "gt_speed_mps", "segment_id"))


@query("sync_accounting", f"WITH {_E}, r AS (SELECT user_id AS session_id, event_id, event_id % 13 = 0 AS none, t_us, event_id % 11 = 0 AS twice FROM e WHERE event_type IN ('view', 'purchase')), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS b, t_us = lag(t_us) OVER (PARTITION BY session_id ORDER BY t_us, event_id) AS again FROM r WHERE NOT none), k AS (SELECT session_id, count(*) AS n_out, count(CASE WHEN a <> b THEN 1 END) AS n_reordered, count(CASE WHEN again THEN 1 END) AS n_same_time FROM o GROUP BY 1), i AS (SELECT session_id, CAST(sum(1 + twice::INT) AS BIGINT) AS n_in, CAST(sum(CASE WHEN none THEN 1 + twice::INT ELSE 0 END) AS BIGINT) AS n_no_time FROM r GROUP BY 1) SELECT session_id, n_in, n_no_time, coalesce(n_out, 0) AS n_out, coalesce(n_reordered, 0) AS n_reordered, coalesce(n_same_time, 0) AS n_same_time, n_in - n_no_time - coalesce(n_out, 0) AS n_copies FROM i LEFT JOIN k USING (session_id)")
def sync_accounting(spark, d):
    return sync.accounting(phone(spark, d))
