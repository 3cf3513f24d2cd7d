"""Reports and selections over results: noise figures, calibrations, scores of events and arms, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import joins, ranks, splits
from wayline.operators import sequence as seq
from wayline.plans.catalog import query
from wayline.plans.q_aggregates import allan_dev
from wayline.plans.q_joins import _AFTER, _BEFORE, _sides
from wayline.plans.q_joins import _E as _LR
from wayline.plans.tables import events, table

BY, ORDER = ["user_id"], ["t_us", "event_id"]
HOUR, DAY = 3_600_000_000, 86_400_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_O = "(PARTITION BY user_id ORDER BY t_us, event_id{})"
_A = f"WITH {_E}, t AS (SELECT user_id, event_id, t_us, sum(value) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')} AS theta FROM e), d AS (" + " UNION ALL ".join(f"SELECT user_id, {m} AS m, theta, lead(theta, {m}) OVER w AS a, lead(theta, {2 * m}) OVER w AS b FROM t WINDOW w AS {_O.format('')}" for m in (1, 2, 3, 5)) + "), v AS (SELECT user_id, m * 0.6 AS tau, round(sqrt(avg(pow(b - 2 * a + theta, 2)) / (2 * m * m)), 6) AS adev FROM d WHERE b IS NOT NULL GROUP BY user_id, m HAVING count(*) >= 10)"


@query("noise_figures", f"{_A}, p AS (SELECT user_id, max_by(tau, tau) FILTER (WHERE tau <= 1) AS t0, max_by(adev, tau) FILTER (WHERE tau <= 1) AS a0, min_by(tau, tau) FILTER (WHERE tau >= 1) AS t1, min_by(adev, tau) FILTER (WHERE tau >= 1) AS a1, min(adev) AS least, min_by(tau, (adev, tau)) AS least_tau FROM v GROUP BY 1) SELECT user_id, round(exp(ln(a0) + (ln(a1) - ln(a0)) * (0 - ln(t0)) / (ln(t1) - ln(t0))), 5) AS density, round(least / 0.664, 5) AS instability, round(CAST(least_tau AS DOUBLE), 5) AS at_tau FROM p WHERE t0 IS NOT NULL AND t1 IS NOT NULL")
def noise_figures(spark, d):
    """White-noise density at 1 s, between the two deviations around it in logs, and bias instability: the least, by 0.664."""
    v = allan_dev(spark, d).withColumn("tau", F.col("m") * 0.6)
    at = lambda f, c, cond: f(F.when(cond, F.col(c)), F.when(cond, F.col("tau")))
    low, high = F.col("tau") <= 1, F.col("tau") >= 1
    p = v.groupBy("user_id").agg(at(F.max_by, "tau", low).alias("t0"), at(F.max_by, "adev", low).alias("a0"), at(F.min_by, "tau", high).alias("t1"), at(F.min_by, "adev", high).alias("a1"), F.min("adev").alias("least"), F.min(F.struct("adev", "tau"))["tau"].alias("least_tau"))
    density = F.exp(F.ln("a0") - (F.ln("a1") - F.ln("a0")) * F.ln("t0") / (F.ln("t1") - F.ln("t0")))
    return p.where("t0 IS NOT NULL AND t1 IS NOT NULL").select("user_id", F.round(density, 5).alias("density"), F.round(F.col("least") / 0.664, 5).alias("instability"), F.round("least_tau", 5).alias("at_tau"))


@query("window_ready", f"WITH {_E}, d AS (SELECT *, t_us - lag(t_us) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(CASE WHEN dt > 0 AND dt <= {5 * DAY} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM d) SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) >= 3 AS ready FROM s")
def window_ready(spark, d):
    """In order of arrival: a window of three samples is cleared by a gap, and by a time that does not rise."""
    w = seq.rows(BY, ["event_id"])
    dt = F.col("t_us") - F.lag("t_us").over(w)
    e = events(spark, d).withColumn("_new", ~F.coalesce((dt > 0) & (dt <= 5 * DAY), F.lit(False)))
    e = e.withColumn("run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("event_id", (F.row_number().over(seq.rows([*BY, "run"], ["event_id"])) >= 3).alias("ready"))


@query("interp_finite", f"WITH {_LR.replace('r AS (SELECT * FROM e WHERE', 'r AS (SELECT * FROM e WHERE value >= 10 AND')}, m AS (SELECT l.*, {_BEFORE} AS b, {_AFTER} AS a FROM l) SELECT m.event_id, round(CASE WHEN x.value IS NULL THEN y.value WHEN y.value IS NULL OR y.t_us = x.t_us THEN x.value ELSE x.value + (y.value - x.value) * CAST(m.t_us - x.t_us AS DOUBLE) / (y.t_us - x.t_us) END, 6) AS value FROM m LEFT JOIN r x ON x.event_id = m.b LEFT JOIN r y ON y.event_id = m.a")
def interp_finite(spark, d):
    """Interpolation over the finite truth rows only; here values under 10 play those that are not."""
    left, right = _sides(spark, d)
    right = right.withColumn("value", F.when(F.col("value") < 10, float("nan")).otherwise(F.col("value"))).where(~F.isnan("value"))
    return joins.interpolated(left.drop("value"), right, BY, "t_us", "event_id", "rid", "value").select("event_id", F.round("r_value", 6).alias("value"))


@query("copies_compared", "WITH g AS (SELECT o_custkey AS session, o_orderkey % 2 AS copy, sha256(string_agg(CAST(CAST(round(o_totalprice) AS BIGINT) % 2 AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.session, a.n AS n_first, b.n AS n_second, a.digest = b.digest AS same FROM g a JOIN g b ON a.session = b.session AND a.copy = 0 AND b.copy = 1")
def copies_compared(spark, d):
    """The two copies of a session side by side: rows and whether their digests agree."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 2).alias("copy"), "o_orderkey", (F.round("o_totalprice").cast("long") % 2).cast("string").alias("x"))
    g = o.groupBy("session", "copy").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "x"))).alias("l"), F.count("*").alias("n"))
    g = g.withColumn("digest", F.sha2(F.array_join(F.transform("l", lambda x: x["x"]), ","), 256))
    one = lambda c, k: F.max(F.when(F.col("copy") == k, F.col(c)))
    both = g.groupBy("session").agg(one("n", 0).alias("n_first"), one("n", 1).alias("n_second"), (one("digest", 0) == one("digest", 1)).alias("same"))
    return both.where("n_first IS NOT NULL AND n_second IS NOT NULL")


@query("train_only", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_custkey % 3 = 0")
def train_only(spark, d):
    """Statistics of sessions that are all in training; one that is not would raise."""
    train = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session_id"))
    use = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("session_id"), "o_totalprice")
    return splits.only(use, train).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


_CLEAN = "value > 5 AND k % 10 < 8 AND k >= 10"


@query("ratio_gate", f"WITH {_E}, c AS (SELECT user_id, value / (value + (k - 50) / 100e0) AS ratio FROM e WHERE {_CLEAN}), s AS (SELECT user_id, median(ratio) AS m, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_rows, round(median(m), 6) AS median, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 6) AS iqr, median(m) BETWEEN 0.95 AND 1.05 AS passes FROM s")
def ratio_gate(spark, d):
    """Median over sessions of their median ratio on clean rows, its spread, and the gate from 0.95 to 1.05."""
    ratio = F.col("value") / (F.col("value") + (F.col("k") - 50) / 100)
    c = events(spark, d).where(_CLEAN).select("user_id", ratio.alias("ratio"))
    s = c.groupBy("user_id").agg(F.percentile("ratio", 0.5).alias("m"), F.count("*").alias("rows")).where("rows >= 5")
    p = ranks.percentiles(s, [], {"median": ("m", 0.5), "q1": ("m", 0.25), "q3": ("m", 0.75)})
    n = s.agg(F.sum("rows").alias("n_rows"))
    return p.join(F.broadcast(n)).select(F.col("n").alias("n_sessions"), "n_rows", F.round("median", 6).alias("median"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"), F.col("median").between(0.95, 1.05).alias("passes"))


@query("speed_calibration", f"WITH {_E}, c AS (SELECT user_id, value, value / (value + (k - 50) / 100e0) AS ratio FROM e WHERE {_CLEAN}), p AS (SELECT median(ratio) AS k FROM c) SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n, round(median(ratio), 6) AS median_ratio, round(quantile_cont(abs(value / ratio * k - value), 0.95), 6) AS p95 FROM c, p GROUP BY 1")
def speed_calibration(spark, d):
    """The pooled ratio, and by bins of speed the ratio's median and the 95th percentile of what is left after it."""
    other = F.col("value") + (F.col("k") - 50) / 100
    c = events(spark, d).where(_CLEAN).select(F.floor(F.col("value") / 10).alias("bin"), "value", other.alias("other"), (F.col("value") / other).alias("ratio"))
    pooled = ranks.percentiles(c, [], {"pooled": ("ratio", 0.5)}).select("pooled")
    c = c.join(F.broadcast(pooled)).withColumn("rest", F.abs(F.col("other") * F.col("pooled") - F.col("value")))
    return ranks.percentiles(c, ["bin"], {"m": ("ratio", 0.5), "p": ("rest", 0.95)}).select("bin", "n", F.round("m", 6).alias("median_ratio"), F.round("p", 6).alias("p95"))


# ------------------------------------------------------------------ scores of events, arms and epochs

_EV = f"o AS (SELECT event_id AS outage_id, user_id, t_us AS a, k % 3 AS kind, coalesce(lead(t_us) OVER {_O.format('')}, 9000000000000000000) AS b FROM e WHERE event_type = 'error'), x AS (SELECT o.*, e.event_id, e.t_us, e.value, e.value - lag(e.value) OVER (PARTITION BY outage_id ORDER BY e.t_us, e.event_id) AS step FROM o JOIN e ON e.user_id = o.user_id AND e.t_us > a AND e.t_us < b), s AS (SELECT outage_id, any_value(kind) AS kind, min_by(value, (t_us, event_id)) AS end_error, max(abs(step)) AS max_jump, min_by(value, (t_us, event_id)) FILTER (WHERE t_us >= a + {DAY}) AS after_1, min_by(value, (t_us, event_id)) FILTER (WHERE t_us >= a + {3 * DAY}) AS after_3, min(CASE WHEN value < 20 THEN t_us - a END) AS reconverged_us, coalesce(max(CASE WHEN step > 60 THEN 1 ELSE 0 END), 0) = 1 AS wrong_jump FROM x GROUP BY 1)"


def _scores(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    bad = F.col("event_type") == "error"
    e = events(spark, d).withColumn("o", F.last(F.when(bad, F.struct(F.col("event_id").alias("id"), F.col("t_us").alias("a"), (F.col("k") % 3).alias("kind"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = e.where(~bad & F.col("o").isNotNull()).where(F.col("t_us") > F.col("o.a")).select(F.col("o.id").alias("outage_id"), F.col("o.a").alias("a"), F.col("o.kind").alias("kind"), "event_id", "t_us", "value")
    step = F.col("value") - F.lag("value").over(Window.partitionBy("outage_id").orderBy("t_us", "event_id"))
    x = x.withColumn("step", step)
    at = F.struct("t_us", "event_id")
    first = lambda cond: F.min_by(F.when(cond, F.col("value")), F.when(cond, at))
    after = lambda n: first(F.col("t_us") >= F.col("a") + n * DAY)
    return x.groupBy("outage_id").agg(F.first("kind").alias("kind"), F.min_by("value", at).alias("end_error"), F.max(F.abs("step")).alias("max_jump"), after(1).alias("after_1"), after(3).alias("after_3"), F.min(F.when(F.col("value") < 20, F.col("t_us") - F.col("a"))).alias("reconverged_us"), (F.coalesce(F.max(F.when(F.col("step") > 60, 1).otherwise(0)), F.lit(0)) == 1).alias("wrong_jump"))


@query("event_scores", f"WITH {_E}, {_EV} SELECT outage_id, end_error, max_jump, after_1, after_3, reconverged_us, wrong_jump FROM s")
def event_scores(spark, d):
    """For each outage what comes after it, up to the next: the first error, jumps, errors a day and three days on, time to under 20, a jump away."""
    return _scores(spark, d).drop("kind")


@query("event_summary", f"WITH {_E}, {_EV} SELECT kind, count(*) AS n, round(median(end_error), 6) AS p50, round(quantile_cont(end_error, 0.9), 6) AS p90, max(max_jump) AS max_jump, count(CASE WHEN wrong_jump THEN 1 END) AS n_wrong, count(*) - count(reconverged_us) AS n_never FROM s GROUP BY 1")
def event_summary(spark, d):
    """The scores by kind of outage."""
    s = _scores(spark, d)
    p = ranks.percentiles(s, ["kind"], {"p50": ("end_error", 0.5), "p90": ("end_error", 0.9)})
    g = s.groupBy("kind").agg(F.max("max_jump").alias("max_jump"), F.count_if("wrong_jump").alias("n_wrong"), F.count_if(F.col("reconverged_us").isNull()).alias("n_never"))
    return p.join(g, "kind").select("kind", "n", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "max_jump", "n_wrong", "n_never")


@query("arm_summary", f"WITH {_E}, m AS (SELECT event_type AS arm, user_id, median(value) AS m FROM e GROUP BY 1, 2), p AS (SELECT event_type AS arm, count(*) AS n, median(value) AS p50, quantile_cont(value, 0.95) AS p95, avg(CASE WHEN abs(value - 30) <= 2 * (5 + k / 2e0) THEN 1.0 ELSE 0.0 END) AS in_2, avg(least(value, 50)) AS nis, CAST(sum(k) AS BIGINT) AS counter FROM e GROUP BY 1), q AS (SELECT arm, median(m) AS mm FROM m GROUP BY 1) SELECT p.arm, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(mm, 6) AS median_of_medians, round(in_2, 6) AS in_2, round(nis, 6) AS nis, counter FROM p JOIN q ON p.arm = q.arm")
def arm_summary(spark, d):
    """An arm over all sessions: pooled percentiles, the median of session medians, coverage of two sigmas, mean capped innovation, counters."""
    e = events(spark, d).withColumnRenamed("event_type", "arm")
    p = ranks.percentiles(e, ["arm"], {"p50": ("value", 0.5), "p95": ("value", 0.95)})
    m = e.groupBy("arm", "user_id").agg(F.percentile("value", 0.5).alias("m"))
    q = ranks.percentiles(m, ["arm"], {"mm": ("m", 0.5)}).drop("n")
    inside = F.abs(F.col("value") - 30) <= 2 * (5 + F.col("k") / 2)
    g = e.groupBy("arm").agg(F.round(F.avg(inside.cast("double")), 6).alias("in_2"), F.round(F.avg(F.least(F.col("value"), F.lit(50.0))), 6).alias("nis"), F.sum("k").alias("counter"))
    return p.join(q, "arm").join(g, "arm").select("arm", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("mm", 6).alias("median_of_medians"), "in_2", "nis", "counter")


@query("epoch_scores", f"WITH {_E}, s AS (SELECT CASE WHEN event_type = 'error' THEN 'outage' ELSE 'aided' END AS role, value AS before, abs(value - k) AS after, k / 100e0 AS confidence, abs(value - k) < 20 AS correct FROM e) SELECT role, CASE WHEN before < 10 THEN '0-10' WHEN before < 50 THEN '10-50' ELSE '50+' END AS band, least(9, CAST(floor(confidence * 10) AS BIGINT)) AS bin, count(*) AS n, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, count(CASE WHEN after < before THEN 1 END) AS n_better, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS correct, round(avg(confidence), 6) AS confidence FROM s GROUP BY ALL")
def epoch_scores(spark, d):
    """A matcher's epochs against the truth: by role, band of the error before, and left-closed bin of confidence."""
    e = events(spark, d)
    after = F.abs(F.col("value") - F.col("k"))
    role = F.when(F.col("event_type") == "error", "outage").otherwise("aided")
    band = F.when(F.col("value") < 10, "0-10").when(F.col("value") < 50, "10-50").otherwise("50+")
    s = e.select(role.alias("role"), band.alias("band"), F.least(F.lit(9), F.floor(F.col("k") / 100 * 10)).cast("long").alias("bin"), F.col("value").alias("before"), after.alias("after"), (F.col("k") / 100).alias("confidence"))
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return s.groupBy("role", "band", "bin").agg(F.count("*").alias("n"), r("before", "mean_before"), r("after", "mean_after"), F.count_if(F.col("after") < F.col("before")).alias("n_better"), r((F.col("after") < 20).cast("double"), "correct"), r("confidence", "confidence"))


@query("selected", "WITH c AS (SELECT p_brand, p_partkey, p_retailprice AS mae, p_size AS params, p_partkey % 17 + 1 AS latency FROM part), a AS (SELECT *, min(mae) OVER (PARTITION BY p_brand) AS best FROM c), b AS (SELECT *, min(latency) OVER (PARTITION BY p_brand) AS fast FROM a WHERE mae <= best * 1.03) SELECT p_brand, p_partkey, mae, latency, params FROM b WHERE latency <= fast * 1.1 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY params, mae, p_partkey) = 1")
def selected(spark, d):
    """The best error, then what is within 3 % of it, then within 10 % of the least latency among those, then the fewest parameters, then the error."""
    c = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("mae"), F.col("p_size").alias("params"), (F.col("p_partkey") % 17 + 1).alias("latency"))
    within = lambda df, name, factor: df.join(df.groupBy("p_brand").agg(F.min(name).alias("_least")), "p_brand").where(F.col(name) <= F.col("_least") * factor).drop("_least")
    near = within(within(c, "mae", 1.03), "latency", 1.1)
    return seq.top_k(near, ["p_brand"], [F.col("params"), F.col("mae"), F.col("p_partkey")], 1).select("p_brand", "p_partkey", "mae", "latency", "params")


@query("rates_in_full", f"WITH {_E}, d AS (SELECT *, t_us - lag(t_us) OVER {_O.format('')} AS dt FROM e) SELECT a.event_id, count(*) AS n, round(median(b.dt) / 1e6, 7) AS median_s, count(CASE WHEN b.dt > {12 * HOUR} THEN 1 END) AS n_gaps FROM d a JOIN d b ON a.user_id = b.user_id AND b.t_us BETWEEN a.t_us - {2 * DAY} AND a.t_us GROUP BY 1")
def rates_in_full(spark, d):
    """Over the trailing two days of each event: events, median step, gaps."""
    e = seq.with_dt(events(spark, d), BY, ORDER, "t_us", "dt")
    w = Window.partitionBy("user_id").orderBy("t_us").rangeBetween(-2 * DAY, 0)
    e = e.withColumn("n", F.count("*").over(w)).withColumn("n_gaps", F.count_if(F.col("dt") > 12 * HOUR).over(w)).withColumn("l", F.sort_array(F.collect_list("dt").over(w)))
    size = F.size("l")
    middle = (F.col("l")[((size - 1) / 2).cast("int")] + F.col("l")[(size / 2).cast("int")]) / 2
    return e.select("event_id", "n", F.round(F.when(size > 0, middle) / 1e6, 7).alias("median_s"), "n_gaps")


@query("cells_apart", "WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_quantity END AS x, CASE WHEN l_partkey % 50 = 0 OR l_partkey % 997 = 1 THEN NULL ELSE l_quantity + l_tax END AS y FROM lineitem) SELECT l_suppkey % 10 AS part, CASE WHEN bool_or((x IS NULL) <> (y IS NULL)) THEN 'infinity'::DOUBLE ELSE round(max(abs(x - y)), 6) END AS apart FROM a GROUP BY 1")
def cells_apart(spark, d):
    """The greatest difference of two columns' cells: both missing are equal, one missing is infinitely far."""
    n = table(spark, d, "lineitem")
    nan = float("nan")
    x = F.when(F.col("l_partkey") % 50 == 0, nan).otherwise(F.col("l_quantity"))
    y = F.when((F.col("l_partkey") % 50 == 0) | (F.col("l_partkey") % 997 == 1), nan).otherwise(F.col("l_quantity") + F.col("l_tax"))
    apart = F.when(F.isnan("x") & F.isnan("y"), None).when(F.isnan("x") | F.isnan("y"), float("inf")).otherwise(F.abs(F.col("x") - F.col("y")))
    worst = n.select((F.col("l_suppkey") % 10).alias("part"), x.alias("x"), y.alias("y")).groupBy("part").agg(F.max(apart).alias("apart"))
    return worst.select("part", F.round("apart", 6).alias("apart"))


# ------------------------------------------------------------------ replay units and switches


@query("replay_units", f"WITH {_E}, d AS (SELECT *, t_us - lag(t_us) OVER {_O.format('')} AS dt FROM e), s AS (SELECT *, CAST(sum(CASE WHEN dt IS NULL OR dt > {DAY} THEN 1 ELSE 0 END) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')} AS BIGINT) - 1 AS segment_id FROM d) SELECT user_id, segment_id, count(*) AS n, min(t_us) AS start_us, max(t_us) AS end_us FROM s GROUP BY ALL HAVING max(t_us) - min(t_us) >= {DAY}")
def replay_units(spark, d):
    """Segments of a day or more, each a unit of replay."""
    s = seq.segments(events(spark, d), BY, ORDER, "t_us", DAY)
    u = s.groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    return u.where(F.col("end_us") - F.col("start_us") >= DAY)


@query("fix_rows", f"WITH {_E}, c AS (SELECT *, row_number() OVER w = 1 OR k // 30 IS DISTINCT FROM lag(k // 30) OVER w AS new FROM e WINDOW w AS {_O.format('')}) SELECT event_id, t_us - k * 1000000 AS epoch_us, CASE WHEN value BETWEEN 5 AND 80 AND k % 4 > 0 THEN value END AS speed, CASE WHEN value BETWEEN 5 AND 80 AND k % 4 > 0 THEN k END AS course FROM c WHERE new AND event_type <> 'error' AND k > 3")
def fix_rows(spark, d):
    """A held fix to its one row: where it is new, its time is known and its accuracy good; a velocity that cannot be is dropped as a pair."""
    e = seq.changed(events(spark, d).withColumn("kk", F.floor(F.col("k") / 30)), BY, ORDER, ["kk"], "new")
    ok = F.col("value").between(5, 80) & (F.col("k") % 4 > 0)
    return e.where("new AND event_type <> 'error' AND k > 3").select("event_id", (F.col("t_us") - F.col("k") * 1_000_000).alias("epoch_us"), F.when(ok, F.col("value")).alias("speed"), F.when(ok, F.col("k")).alias("course"))


@query("switched_outage", f"WITH {_E}, s AS (SELECT *, last_value(CASE WHEN event_type IN ('error', 'click') THEN event_type END IGNORE NULLS) OVER w AS switch, last_value(CASE WHEN event_type IN ('error', 'click') THEN t_us END IGNORE NULLS) OVER w AS since FROM e WINDOW w AS {_O.format(' ROWS UNBOUNDED PRECEDING')}) SELECT event_id, coalesce(switch = 'error' AND t_us - k * 60000000 >= since, false) AS withheld FROM s WHERE event_type NOT IN ('error', 'click')")
def switched_outage(spark, d):
    """A switch in a running session (error: on, click: off) withholds the fixes whose time is after it, not those still on their way."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("event_type").isin("error", "click")
    e = events(spark, d).withColumn("s", F.last(F.when(mark, F.struct("event_type", "t_us")), ignorenulls=True).over(w))
    off = (F.col("s.event_type") == "error") & (F.col("t_us") - F.col("k") * 60_000_000 >= F.col("s.t_us"))
    return e.where(~mark).select("event_id", F.coalesce(off, F.lit(False)).alias("withheld"))


@query("violations", "SELECT 'quantity out of range' AS rule, count(*) AS n FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 45 UNION ALL SELECT 'orphan line', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'missing price', count(*) FROM lineitem WHERE l_extendedprice IS NULL")
def violations(spark, d):
    """Rules of a gate, each with the number of rows that break it."""
    n = table(spark, d, "lineitem")
    plain = n.agg(F.count_if(~F.col("l_quantity").between(1, 45)).alias("quantity out of range"), F.count_if(F.col("l_extendedprice").isNull()).alias("missing price"))
    one = plain.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in plain.columns))).alias("x")).select("x.*")
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    orphans = n.join(keys, "l_orderkey", "left_anti").agg(F.lit("orphan line").alias("rule"), F.count("*").alias("n"))
    again = n.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.lit("repeated key").alias("rule"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return one.unionByName(orphans).unionByName(again)
