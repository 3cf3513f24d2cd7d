"""Mounting, audits across logs and diagnostics: users play sessions, value, k and constants the axes."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.functions import quaternion as q
from wayline.operators import alignment as al
from wayline.operators import joins, ranks
from wayline.operators import sequence as seq
from wayline.plans.catalog import query
from wayline.plans.q_joins import _E as _SIDES
from wayline.plans.q_joins import _NEAREST
from wayline.plans.tables import events, table
from wayline.sources import synthetic

HOUR, DAY = 3_600_000_000, 86_400_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_O = "(PARTITION BY user_id ORDER BY t_us, event_id{})"


@query("up_direction", f"WITH {_E}, m AS (SELECT user_id, avg(value / 10) AS x, avg((k - 50) / 10e0) AS y, count(*) AS n FROM e WHERE value < 60 GROUP BY 1), s AS (SELECT *, sqrt(x*x + y*y + 9.0) AS size FROM m) SELECT user_id, CASE WHEN n >= 10 AND size >= 5 THEN round(x / size, 6) END AS x, CASE WHEN n >= 10 AND size >= 5 THEN round(3.0e0 / size, 6) END AS z FROM s")
def up_direction(spark, d):
    """Mean force directions; too few rows or too small a force give null. Rows that are not finite count nowhere."""
    e = events(spark, d).select("user_id", F.when(F.col("value") < 60, F.col("value") / 10).otherwise(float("nan")).alias("x"), ((F.col("k") - 50) / 10.0).alias("y"), F.lit(3.0).alias("z"))
    return al.up_direction(e, ["user_id"], "x", "y", "z").select("user_id", F.round("up.x", 6).alias("x"), F.round("up.z", 6).alias("z"))


@query("vehicle_acceleration", f"WITH {_E}, t AS (SELECT *, t_us / 3600e6 AS t, k * 0.05e0 AS c FROM e), u AS (SELECT *, coalesce(-round_even((c - lag(c) OVER w) / {2 * math.pi!r}, 0), 0) AS turn FROM t WINDOW w AS {_O.format('')}), v AS (SELECT *, c + {2 * math.pi!r} * sum(turn) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')} AS b FROM u), x AS (SELECT *, lead(t) OVER w - lag(t) OVER w AS dt, least(lag(value) OVER w, value, lead(value) OVER w) AS slow, lead(value) OVER w - lag(value) OVER w AS dv, lead(b) OVER w - lag(b) OVER w AS db, lag(t) OVER w IS NOT NULL AND lead(t) OVER w IS NOT NULL AS inner_ FROM v WINDOW w AS {_O.format('')}) SELECT event_id, round(dv / dt, 6) AS a_long, round(-value * db / dt, 6) AS a_lat FROM x WHERE inner_ AND dt > 0 AND dt <= 40 AND slow >= 3")
def vehicle_acceleration(spark, d):
    e = events(spark, d).withColumn("t", F.col("t_us") / F.lit(3600e6)).withColumn("course", F.col("k") * 0.05)
    out = al.vehicle_acceleration(e, ["user_id"], ["t_us", "event_id"], "t", "value", "course", most_gap=20.0, keep=["event_id"])
    return out.select("event_id", F.round("a_long", 6).alias("a_long"), F.round("a_lat", 6).alias("a_lat"))


_PAIRS = "v AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b FROM embeddings), g AS (SELECT label, atan2(sum(a*y - b*x), sum(a*x + b*y)) AS yaw, sqrt(pow(sum(a*y - b*x), 2) + pow(sum(a*x + b*y), 2)) / sum(a*a + b*b) AS scale, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM v GROUP BY 1), r AS (SELECT v.label, sum(pow(x - scale * (cos(yaw)*a - sin(yaw)*b), 2) + pow(y - scale * (sin(yaw)*a + cos(yaw)*b), 2)) AS rest, sum(pow(x - mx, 2) + pow(y - my, 2)) AS spread FROM v JOIN g ON g.label = v.label GROUP BY 1)"


@query("yaw_fit", f"WITH {_PAIRS} SELECT g.label, round(yaw, 6) AS yaw, round(scale, 6) AS scale, round(1 - rest / spread, 6) AS r2, n, n >= 30 AND 1 - rest / spread >= 0.3 AND scale BETWEEN 0.5 AND 1.5 AS acceptable FROM g JOIN r ON r.label = g.label WHERE n >= 3")
def yaw_fit(spark, d):
    """The fit by sums alone; the oracle computes residuals row by row."""
    c = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, d, "embeddings").select("label", c(0).alias("x"), c(1).alias("y"), c(2).alias("a_long"), c(3).alias("a_lat"))
    f = al.fit_yaw(p, ["label"])
    return f.select("label", *(F.round(n, 6).alias(n) for n in ("yaw", "scale", "r2")), "n", al.acceptable(F.col("n"), F.col("r2"), F.col("scale")).alias("acceptable"))


def _turned_fleet(spark, n: int):
    """Weaving drives of a phone turned by 0.3 rad times the session's number: on a steady circle the turn would look like tilt."""

    def run(parts):
        for pdf in parts:
            for i in pdf["id"]:
                one = synthetic.drive(int(i), 70, 0.02, 0.0, mount_yaw=0.3 * int(i), weave=20.0)
                yield one[["session_id", "t", "acc_x", "acc_y", "acc_z", "fix_t", "fix_speed", "fix_course"]].astype(object).where(lambda x: x.notna(), None)

    return spark.range(n).mapInPandas(run, "session_id long, t double, acc_x double, acc_y double, acc_z double, fix_t double, fix_speed double, fix_course double")


def _mounts(spark, n: int):
    df = _turned_fleet(spark, n)
    imu = df.select("session_id", "t", F.col("acc_x").alias("x"), F.col("acc_y").alias("y"), F.col("acc_z").alias("z"))
    fixes = df.where("fix_t IS NOT NULL").select("session_id", F.col("fix_t").alias("t"), F.col("fix_speed").alias("speed"), F.col("fix_course").alias("course"))
    return al.mounting(imu, fixes, ["session_id"])


@query("mounting_of_fleet", "SELECT i AS session_id, true AS found, true AS acceptable, true AS level FROM range(0, 5) t(i)")
def mounting_of_fleet(spark, d):
    """The whole alignment of synthetic drives finds the turn of each phone within a twentieth of a radian."""
    m = _mounts(spark, 5)
    off = F.abs(q.wrapped(F.col("yaw") - F.col("session_id") * 0.3))
    return m.select("session_id", (off < 0.05).alias("found"), "acceptable", (F.col("tilt") < 0.02).alias("level"))


@query("mounting_summary", "SELECT 5::BIGINT AS n_sessions, 5::BIGINT AS n_acceptable, true AS ordered, true AS small")
def mounting_summary(spark, d):
    """Their distances to the truth, summed up."""
    truth = spark.range(5).select(F.col("id").alias("session_id"), (F.col("id") * 0.3).alias("yaw"))
    s = al.summary(_mounts(spark, 5), truth, ["session_id"])
    return s.select("n_sessions", "n_acceptable", ((F.col("median") <= F.col("p90")) & (F.col("p90") <= F.col("most"))).alias("ordered"), (F.col("most") < 0.05).alias("small"))


@query("pair_audit", f"WITH {_SIDES}, m AS (SELECT l.*, {_NEAREST} AS mid FROM l), j AS (SELECT m.user_id, m.value, r.t_us - m.t_us AS off, r.value AS rv, abs(r.t_us - m.t_us) <= {6 * HOUR} AS near FROM m LEFT JOIN r ON r.event_id = m.mid) SELECT user_id, count(*) AS n, count(CASE WHEN near THEN 1 END) AS n_matched, round(median(off) / 1e6, 3) AS median_off_s, round(quantile_cont(off, 0.95) / 1e6, 3) AS p95_off_s, CASE WHEN count(rv) = 0 THEN 'no truth' WHEN 2 * count(CASE WHEN near THEN 1 END) >= count(*) THEN 'time_join_verified' ELSE 'weak' END AS status, count(CASE WHEN value < 15 THEN 1 END) AS n_still FROM j GROUP BY 1")
def pair_audit(spark, d):
    """Two logs of a user against each other: matches, percentiles of the clock's offset, a status, rows at rest."""
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t_us", "value")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", "t_us", "value")
    j = joins.asof(left, right, ["user_id"], "t_us", "event_id", "rid", ["value"], "nearest").withColumn("off", F.col("match_at") - F.col("t_us"))
    near = F.abs("off") <= 6 * HOUR
    g = j.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(near).alias("n_matched"), F.count("r_value").alias("n_truth"), F.round(F.percentile("off", 0.5) / 1e6, 3).alias("median_off_s"), F.round(F.percentile("off", 0.95) / 1e6, 3).alias("p95_off_s"), F.count_if(F.col("value") < 15).alias("n_still"))
    status = F.when(F.col("n_truth") == 0, "no truth").when(2 * F.col("n_matched") >= F.col("n"), "time_join_verified").otherwise("weak")
    return g.select("user_id", "n", "n_matched", "median_off_s", "p95_off_s", status.alias("status"), "n_still")


_TURNS = {"+x": "value", "-x": "-value", "null": "0"}


@query("tilt_hypotheses", f"WITH {_E}, r AS (SELECT *, lead(value) OVER w AS nv, lead(k) OVER w AS nk, lead(t_us) OVER w - t_us AS dt FROM e WINDOW w AS {_O.format('')}), p AS (SELECT event_id, dt / 864e8 AS days, atan2(k, 100e0) AS a, atan2(nk, 100e0) AS b, value / 100 AS rate FROM r WHERE dt BETWEEN {HOUR} AND {3 * DAY}), h AS (SELECT 'plus' AS name, event_id, abs(a + rate * days - b) AS err FROM p UNION ALL SELECT 'minus', event_id, abs(a - rate * days - b) FROM p UNION ALL SELECT 'null', event_id, abs(a - b) FROM p) SELECT h.name, round(median(h.err), 6) AS median, round(avg(h.err), 6) AS mean, round(quantile_cont(h.err, 0.9), 6) AS p90, round(avg(CASE WHEN h.err < n.err THEN 1.0 ELSE 0.0 END), 6) AS beats_null FROM h JOIN h n ON n.event_id = h.event_id AND n.name = 'null' GROUP BY 1")
def tilt_hypotheses(spark, d):
    """Which sign of a turn rate predicts the tilt at the next stop, against none at all: errors of each hypothesis in one pass."""
    w = seq.rows(["user_id"], ["t_us", "event_id"])
    dt = F.lead("t_us").over(w) - F.col("t_us")
    p = events(spark, d).withColumn("dt", dt).withColumn("b", F.atan2(F.lead("k").over(w).cast("double"), F.lit(100.0))).where(F.col("dt").between(HOUR, 3 * DAY))
    turned = F.col("value") / 100 * (F.col("dt") / F.lit(864e8))
    a = F.atan2(F.col("k").cast("double"), F.lit(100.0))
    none = F.abs(a - F.col("b"))
    h = p.select(none.alias("none"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.abs(a + s * turned - F.col("b")).alias("err")) for n, s in (("plus", 1), ("minus", -1), ("null", 0))))).alias("h"))
    h = h.select("h.name", "h.err", (F.col("h.err") < F.col("none")).cast("double").alias("beats"))
    t = ranks.percentiles(h, ["name"], {"median": ("err", 0.5), "p90": ("err", 0.9)})
    g = h.groupBy("name").agg(F.round(F.avg("err"), 6).alias("mean"), F.round(F.avg("beats"), 6).alias("beats_null"))
    return t.join(g, "name").select("name", F.round("median", 6).alias("median"), "mean", F.round("p90", 6).alias("p90"), "beats_null")


@query("evaluated", "WITH e AS (SELECT event_type, (value - 50) / 10 AS y, (CAST(json_extract_string(props, '$.k') AS BIGINT) - 50) / 20.0 AS m, greatest(-8, least(6, (event_id % 30) / 4.0 - 2)) AS lv FROM events), x AS (SELECT event_type, abs(y - m) AS a, (y - m) * (y - m) AS s, exp(lv) AS v, lv, abs(y) AS base FROM e) SELECT event_type, round(avg(a), 6) AS mae, round(sqrt(avg(s)), 6) AS rmse, round(avg(0.5 * (s / v + lv)), 6) AS nll, round(avg(CASE WHEN s <= v THEN 1.0 ELSE 0.0 END), 6) AS in_1, round(avg(sqrt(v)), 6) AS sigma, count(*) AS n FROM x GROUP BY 1")
def evaluated(spark, d):
    """Scores of a table of predictions: error, likelihood, coverage, mean sigma, rows."""
    e = events(spark, d).select("event_type", ((F.col("value") - 50) / 10).alias("y"), ((F.col("k") - 50) / 20.0).alias("mean"), F.greatest(F.lit(-8.0), F.least(F.lit(6.0), F.col("event_id") % 30 / 4.0 - 2)).alias("log_var"))
    s, v = F.pow(F.col("y") - F.col("mean"), 2), F.exp("log_var")
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.groupBy("event_type").agg(r(F.avg(F.abs(F.col("y") - F.col("mean"))), "mae"), r(F.sqrt(F.avg(s)), "rmse"), r(F.avg(0.5 * (s / v + F.col("log_var"))), "nll"), r(F.avg((s <= v).cast("double")), "in_1"), r(F.avg(F.sqrt(v)), "sigma"), F.count("*").alias("n"))


@query("reference_error", "WITH m AS (SELECT avg(value) AS mu FROM events WHERE user_id % 5 > 0) SELECT round(avg(abs(value - mu)), 6) AS mae, count(*) AS n FROM events, m WHERE user_id % 5 = 0")
def reference_error(spark, d):
    """Error of the training mean as the only prediction, on held-out users."""
    e = events(spark, d).select("value", (F.col("user_id") % 5 == 0).alias("held"))
    mu = e.where("NOT held").agg(F.avg("value").alias("mu"))
    return e.where("held").join(F.broadcast(mu)).agg(F.round(F.avg(F.abs(F.col("value") - F.col("mu"))), 6).alias("mae"), F.count("*").alias("n"))


@query("shocks", f"WITH RECURSIVE {_E}, b AS (SELECT user_id, t_us // {DAY} AS bin, max(value) AS hi, min(value) AS lo, avg(value) AS mean FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bin) AS n FROM b), r AS (SELECT user_id, bin, n, hi, lo, mean, mean AS base, CAST(NULL AS DOUBLE) AS before FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.bin, o.n, o.hi, o.lo, o.mean, r.base + 0.1 * (o.mean - r.base), r.base FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1), p AS (SELECT *, greatest(abs(hi - before), abs(lo - before)) AS peak, abs(mean - before) AS averaged FROM r WHERE n > 10) SELECT user_id, bin, round(peak, 6) AS peak, averaged < 40 AS suppressed FROM p WHERE peak > 40")
def shocks(spark, d):
    """Bins whose extreme is far from an exponential mean of the bins before; suppressed where their own mean is not."""
    from wayline.streaming import machines as m

    bins = events(spark, d).groupBy("user_id", F.floor(F.col("t_us") / DAY).alias("bin")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mean"))
    out = m.over_batch(bins, "user_id", ["bin"], ["bin", "hi", "lo", "mean"], m.SHOCK_START, m.shock_step(40.0, 0.1, 10), "user_id long, bin long, peak double, suppressed boolean, shock boolean")
    return out.where("shock").select("user_id", "bin", F.round("peak", 6).alias("peak"), "suppressed")


@query("history_lookup", f"WITH {_E}, x AS (SELECT *, t_us - k * {HOUR} AS epoch FROM e WHERE event_type = 'purchase') SELECT x.event_id, (SELECT e.event_id FROM e WHERE e.user_id = x.user_id AND e.t_us <= x.t_us AND e.t_us >= x.t_us - {2 * DAY} ORDER BY abs(e.t_us - x.epoch), e.t_us, CASE WHEN e.t_us <= x.epoch THEN -e.event_id ELSE e.event_id END LIMIT 1) AS state_id FROM x")
def history_lookup(spark, d):
    """For each delayed fix the state nearest to its time, among those of the two days before it came."""
    e = events(spark, d)
    fixes = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t_us").alias("received"), (F.col("t_us") - F.col("k") * HOUR).alias("epoch"))
    states = e.select(F.col("event_id").alias("sid"), "user_id", "t_us")
    return joins.history(fixes, states, ["user_id"], "epoch", "received", "t_us", "event_id", "sid", ["sid"], 2 * DAY).select("event_id", F.col("r_sid").alias("state_id"))


@query("retained", f"WITH {_E}, r AS (SELECT event_id, t_us >= max(t_us) OVER (PARTITION BY user_id) - {2 * DAY} AS by_time, row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) <= 5 AS by_count FROM e) SELECT event_id, by_time, by_count FROM r WHERE by_time OR by_count")
def retained(spark, d):
    """What a bounded history keeps: two days, or five rows."""
    newest = F.max("t_us").over(Window.partitionBy("user_id"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t_us"), F.desc("event_id")))
    out = events(spark, d).select("event_id", (F.col("t_us") >= newest - 2 * DAY).alias("by_time"), (place <= 5).alias("by_count"))
    return out.where("by_time OR by_count")
