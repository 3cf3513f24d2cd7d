"""Recurrences over a user's events, in event order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.plans.catalog import query
from wayline.plans.tables import events
from wayline.streaming import machines as m

HOUR = 3_600_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_N = f"{_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS n, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS age FROM e)"
_AGED = f"CASE WHEN o.age > {25 * HOUR} THEN 'LOST' WHEN r.state = 'GOOD' AND o.age > {12 * HOUR} THEN 'DEGRADED' ELSE r.state END"
_STREAK = f"CASE WHEN o.age > {25 * HOUR} OR (r.state = 'GOOD' AND o.age > {12 * HOUR}) THEN 0 ELSE r.streak END"
_GOOD = "o.k <= 50"


@query(
    "gnss_state",
    f"""WITH RECURSIVE {_N}, r AS (
  SELECT user_id, event_id, n, 'RECOVERING' AS state, CASE WHEN k <= 50 THEN 1 ELSE 0 END AS streak FROM o WHERE n = 1
  UNION ALL
  SELECT q.user_id, q.event_id, q.n,
    CASE q.s WHEN 'LOST' THEN 'RECOVERING' WHEN 'RECOVERING' THEN CASE WHEN NOT q.good THEN 'DEGRADED' WHEN q.c >= 2 THEN 'GOOD' ELSE 'RECOVERING' END WHEN 'DEGRADED' THEN CASE WHEN q.good AND q.c >= 1 THEN 'GOOD' ELSE 'DEGRADED' END ELSE CASE WHEN q.good THEN 'GOOD' ELSE 'DEGRADED' END END,
    CASE q.s WHEN 'LOST' THEN CASE WHEN q.good THEN 1 ELSE 0 END WHEN 'RECOVERING' THEN CASE WHEN q.good AND q.c < 2 THEN q.c + 1 ELSE 0 END WHEN 'DEGRADED' THEN CASE WHEN q.good AND q.c < 1 THEN q.c + 1 ELSE 0 END ELSE CASE WHEN q.good THEN q.c ELSE 0 END END
  FROM (SELECT o.user_id, o.event_id, o.n, {_GOOD} AS good, {_AGED} AS s, {_STREAK} AS c FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) q)
SELECT user_id, event_id, state, CAST(streak AS BIGINT) AS streak FROM r""",
)
def gnss_state(spark, d):
    step = m.gnss_step(12 * HOUR, 25 * HOUR, 50)
    return m.over_batch(events(spark, d), "user_id", ["t_us", "event_id"], ["event_id", "t_us", "k"], m.GNSS_START, step, "user_id long, event_id long, state string, streak long")


@query("timestamp_guard", f"WITH {_E}, a AS (SELECT *, t_us + k * {HOUR} AS t FROM e), g AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a) SELECT event_id, CASE WHEN seen IS NULL THEN 'first' WHEN t < seen THEN 'backwards' WHEN t = seen THEN 'duplicate' WHEN t - seen > {24 * HOUR} THEN 'gap' ELSE 'ok' END AS kind, CASE WHEN t > seen THEN t - seen END AS dt_us FROM g")
def timestamp_guard(spark, d):
    """The clock is the greatest time so far: backward and repeated samples do not move it."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, d).withColumn("t", F.col("t_us") + F.col("k") * HOUR).withColumn("seen", F.max("t").over(w))
    step = F.col("t") - F.col("seen")
    kind = F.when(step.isNull(), "first").when(step < 0, "backwards").when(step == 0, "duplicate").when(step > 24 * HOUR, "gap").otherwise("ok")
    return e.select("event_id", kind.alias("kind"), F.when(step > 0, step).alias("dt_us"))


@query("rejection_resets", f"WITH {_N}, x AS (SELECT *, k > 40 AS rejected FROM o), i AS (SELECT *, sum(CASE WHEN rejected THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM x), c AS (SELECT *, CAST(sum(CASE WHEN rejected THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM i) SELECT user_id, event_id, CASE WHEN run = 0 THEN 0 ELSE (run - 1) % 3 + 1 END AS streak, run > 0 AND run % 3 = 0 AS reset FROM c")
def rejection_resets(spark, d):
    """Runs of rejected fixes counted in threes, by windows alone."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, d).withColumn("rejected", F.col("k") > 40).withColumn("island", F.sum((~F.col("rejected")).cast("int")).over(w))
    run = F.sum(F.col("rejected").cast("long")).over(Window.partitionBy("user_id", "island").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("run", run)
    return e.select("user_id", "event_id", F.when(F.col("run") == 0, 0).otherwise((F.col("run") - 1) % 3 + 1).alias("streak"), ((F.col("run") > 0) & (F.col("run") % 3 == 0)).alias("reset"))


_TO = "q.o1 + CASE WHEN abs(q.x - q.x0) > 10 THEN q.x0 - q.x ELSE 0 END"


@query(
    "output_smoother",
    f"""WITH RECURSIVE {_N}, s AS (SELECT user_id, event_id, n, t_us / {HOUR}e0 AS t, value AS x FROM o), r AS (
  SELECT user_id, event_id, n, t, x, 0e0 AS off, 0e0 AS rate FROM s WHERE n = 1
  UNION ALL
  SELECT q.user_id, q.event_id, q.n, q.t, q.x, {_TO}, CASE WHEN abs(q.x - q.x0) > 10 THEN greatest(0.5e0, abs({_TO}) / 10) ELSE q.rate END
  FROM (SELECT s.*, r.x AS x0, r.rate, CASE WHEN r.off > 0 THEN 1 ELSE -1 END * greatest(0e0, abs(r.off) - r.rate * (s.t - r.t)) AS o1 FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1) q)
SELECT user_id, event_id, round(x + off, 6) AS smooth FROM r""",
)
def output_smoother(spark, d):
    e = events(spark, d).withColumn("t", F.col("t_us") / HOUR)
    return m.over_batch(e, "user_id", ["t", "event_id"], ["event_id", "t", "value"], m.SMOOTH_START, m.smoother_step(10.0, 0.5, 10.0), "user_id long, event_id long, smooth double").withColumn("smooth", F.round("smooth", 6))
