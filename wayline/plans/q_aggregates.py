"""Aggregates: correlations, calibrations, grid searches, audits, scores, selections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import ranks
from wayline.operators import sequence as seq
from wayline.plans.catalog import query
from wayline.plans.tables import events, table

BY, ORDER = ["user_id"], ["t_us", "event_id"]
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("corr_guarded", f"WITH {_E} SELECT user_id, round(CASE WHEN count(*) >= 50 AND stddev_pop(value) > 0 AND stddev_pop(k) > 0 THEN corr(value, k) END, 6) AS r FROM e GROUP BY user_id")
def corr_guarded(spark, d):
    ok = (F.count("*") >= 50) & (F.stddev_pop("value") > 0) & (F.stddev_pop("k") > 0)
    return events(spark, d).groupBy("user_id").agg(F.round(F.when(ok, F.corr("value", F.col("k").cast("double"))), 6).alias("r"))


@query("slope_origin", f"WITH {_E} SELECT event_type, round(CASE WHEN count(*) >= 50 THEN sum(value * k) / sum(value * value) END, 6) AS slope FROM e GROUP BY event_type")
def slope_origin(spark, d):
    v, k = F.col("value"), F.col("k")
    return events(spark, d).groupBy("event_type").agg(F.round(F.when(F.count("*") >= 50, F.sum(v * k) / F.sum(v * v)), 6).alias("slope"))


@query("axis_scan", "WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS x, corr(l_quantity, l_discount) AS y, corr(l_quantity, l_tax) AS z FROM lineitem GROUP BY 1) SELECT l_returnflag, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'x' WHEN abs(y) >= abs(z) THEN 'y' ELSE 'z' END AS best, CAST(sign(CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END) AS DOUBLE) AS sign FROM c")
def axis_scan(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*(F.corr("l_quantity", v).alias(n) for n, v in (("x", "l_extendedprice"), ("y", "l_discount"), ("z", "l_tax"))))
    top = F.greatest(*(F.abs(n) for n in "xyz"))
    best = F.when(F.abs("x") == top, "x").when(F.abs("y") == top, "y").otherwise("z")
    value = F.when(best == "x", F.col("x")).when(best == "y", F.col("y")).otherwise(F.col("z"))
    return c.select("l_returnflag", *(F.round(n, 6).alias(n) for n in "xyz"), best.alias("best"), F.signum(value).alias("sign"))


@query("xcorr_lag", f"WITH {_E}, r AS (SELECT user_id, value, k, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS n FROM e), g AS (SELECT a.user_id, b.n - a.n AS lag, corr(a.value, b.k) AS r FROM r a JOIN r b ON a.user_id = b.user_id AND abs(b.n - a.n) <= 5 GROUP BY ALL HAVING count(*) >= 20) SELECT user_id, lag, round(r, 6) AS r FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, lag) = 1")
def xcorr_lag(spark, d):
    """The lag of up to five rows of greatest correlation: leads of one exchange, no self-join."""
    w = seq.rows(BY, ORDER)
    pairs = events(spark, d).select("user_id", "value", F.array(*(F.struct(F.lit(lag).cast("long").alias("lag"), F.lead("k", lag).over(w).cast("double").alias("k")) for lag in range(-5, 6))).alias("p"))
    long = pairs.select("user_id", "value", F.inline("p")).where("k IS NOT NULL")
    r = long.groupBy("user_id", "lag").agg(F.corr("value", "k").alias("r"), F.count("*").alias("n")).where("n >= 20")
    return seq.top_k(r, BY, [F.round("r", 9).desc(), F.col("lag")], 1).select("user_id", "lag", F.round("r", 6).alias("r"))


_BINS = [(0, 10), (10, 20), (20, 30), (30, 40), (40, 50)]


@query("binned_calibration", "WITH b AS (SELECT CASE " + " ".join(f"WHEN l_quantity > {a} AND l_quantity <= {b} THEN '({a}, {b}]'" for a, b in _BINS) + " END AS bin, l_extendedprice / l_quantity AS ratio FROM lineitem) SELECT bin, count(*) AS n, round(median(ratio), 4) AS median_ratio, round(quantile_cont(abs(ratio - 1500), 0.95), 4) AS p95 FROM b WHERE bin IS NOT NULL GROUP BY bin")
def binned_calibration(spark, d):
    q = F.col("l_quantity")
    name = F.coalesce(*(F.when((q > a) & (q <= b), f"({a}, {b}]") for a, b in _BINS))
    df = table(spark, d, "lineitem").select(name.alias("bin"), (F.col("l_extendedprice") / q).alias("ratio")).where("bin IS NOT NULL")
    df = df.withColumn("off", F.abs(F.col("ratio") - 1500))
    p = ranks.percentiles(df, ["bin"], {"median_ratio": ("ratio", 0.5), "p95": ("off", 0.95)})
    return p.select("bin", "n", F.round("median_ratio", 4).alias("median_ratio"), F.round("p95", 4).alias("p95"))


@query("delay_grid_search", f"WITH {_E}, g AS (SELECT i - 20 AS step, user_id, median(abs(value - k - (i - 20))) AS err, count(*) AS n FROM e CROSS JOIN range(0, 50) t(i) GROUP BY ALL) SELECT user_id, step, round(err, 6) AS err FROM g WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(err, 9), step) = 1")
def delay_grid_search(spark, d):
    """One pass a user over the differences; the grid is never expanded into rows."""

    def run(t: pa.Table) -> pa.Table:
        x = t["x"].to_numpy()
        if len(x) < 20:
            return pa.table({"user_id": pa.array([], pa.int64()), "step": pa.array([], pa.int64()), "err": pa.array([], pa.float64())})
        err = np.array([np.median(np.abs(x - step)) for step in range(-20, 30)])
        best = int(np.round(err, 9).argmin())
        return pa.table({"user_id": t["user_id"][:1], "step": pa.array([best - 20], pa.int64()), "err": [float(err[best])]})

    x = (F.col("value") - F.col("k")).alias("x")
    return events(spark, d).select("user_id", x).groupBy("user_id").applyInArrow(run, "user_id long, step long, err double").withColumn("err", F.round("err", 6))


@query("norm_stats", "SELECT round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, i AS channel FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i")
def norm_stats(spark, d):
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy(F.col("channel").cast("long").alias("channel")).agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("std"))


@query("weighted_mean", "WITH g AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1) SELECT round(sum(m * n) / sum(n), 2) AS mean, CAST(sum(n) AS BIGINT) AS n FROM g")
def weighted_mean(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    return g.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 2).alias("mean"), F.sum("n").alias("n"))


@query("vote_mode", f"WITH {_E}, g AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, event_type AS winner, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def vote_mode(spark, d):
    g = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return seq.top_k(g, BY, [F.desc("n"), F.col("event_type")], 1).select("user_id", F.col("event_type").alias("winner"), "n")


@query("distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


_M = (1, 2, 3, 5)


@query("allan_dev", f"WITH {_E}, t AS (SELECT user_id, event_id, t_us, sum(value) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS theta FROM e) SELECT user_id, m, round(sqrt(avg(pow(b - 2 * a + theta, 2)) / (2 * m * m)), 6) AS adev FROM (" + " UNION ALL ".join(f"SELECT user_id, CAST({m} AS BIGINT) AS m, theta, lead(theta, {m}) OVER w AS a, lead(theta, {2 * m}) OVER w AS b FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)" for m in _M) + ") WHERE b IS NOT NULL GROUP BY user_id, m HAVING count(*) >= 10")
def allan_dev(spark, d):
    w = seq.rows(BY, ORDER)
    t = events(spark, d).withColumn("theta", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    diff = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), (F.lead("theta", 2 * m).over(w) - 2 * F.lead("theta", m).over(w) + F.col("theta")).alias("dd")) for m in _M))
    g = t.select("user_id", diff.alias("p")).select("user_id", F.inline("p")).where("dd IS NOT NULL").groupBy("user_id", "m")
    return g.agg(F.sqrt(F.avg(F.col("dd") * F.col("dd")) / (2 * F.col("m") * F.col("m"))).alias("a"), F.count("*").alias("n")).where("n >= 10").select("user_id", "m", F.round("a", 6).alias("adev"))


@query("difference_std", f"WITH {_E}, x AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS dv FROM e) SELECT user_id, round(stddev_pop(dv) / sqrt(2), 6) AS density FROM x GROUP BY user_id")
def difference_std(spark, d):
    df = events(spark, d).withColumn("dv", F.col("value") - F.lag("value").over(seq.rows(BY, ORDER)))
    return df.groupBy("user_id").agg(F.round(F.stddev_pop("dv") / F.sqrt(F.lit(2.0)), 6).alias("density"))


@query("procrustes_yaw", "WITH v AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS bx, CAST(embedding[4] AS DOUBLE) AS by_ FROM embeddings) SELECT label, round(atan2(sum(bx*ay - by_*ax), sum(bx*ax + by_*ay)), 6) AS yaw, round(sqrt(pow(sum(bx*ay - by_*ax), 2) + pow(sum(bx*ax + by_*ay), 2)) / sum(bx*bx + by_*by_), 6) AS scale, count(*) AS n FROM v GROUP BY label HAVING count(*) >= 3")
def procrustes_yaw(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    v = table(spark, d, "embeddings").select("label", e(0).alias("ax"), e(1).alias("ay"), e(2).alias("bx"), e(3).alias("by"))
    cross, dot = F.sum(F.expr("bx*ay - by*ax")), F.sum(F.expr("bx*ax + by*ay"))
    return v.groupBy("label").agg(F.round(F.atan2(cross, dot), 6).alias("yaw"), F.round(F.hypot(cross, dot) / F.sum(F.expr("bx*bx + by*by")), 6).alias("scale"), F.count("*").alias("n")).where("n >= 3")


@query("median_of_medians", f"WITH {_E}, g AS (SELECT user_id, median(value) AS m FROM e GROUP BY user_id HAVING count(*) >= 5) SELECT round(median(m), 6) AS median, round(quantile_cont(m, 0.25), 6) AS q1, round(quantile_cont(m, 0.75), 6) AS q3, count(*) AS n FROM g")
def median_of_medians(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.percentile("value", 0.5).alias("m"), F.count("*").alias("c")).where("c >= 5")
    p = ranks.percentiles(g, [], {"median": ("m", 0.5), "q1": ("m", 0.25), "q3": ("m", 0.75)})
    return p.select(*(F.round(n, 6).alias(n) for n in ("median", "q1", "q3")), "n")


@query("calibration_table", f"WITH {_E}, x AS (SELECT (value - 30) / 20 AS z, value - 30 AS err, event_type FROM e) SELECT event_type, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(err), 6) AS bias, round(avg(CASE WHEN abs(z) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS in_1, round(avg(CASE WHEN abs(z) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS in_2, round(quantile_cont(abs(err), 0.95), 6) AS p95, round(stddev_pop(z), 6) AS z_std FROM x GROUP BY event_type")
def calibration_table(spark, d):
    x = events(spark, d).select("event_type", ((F.col("value") - 30) / 20).alias("z"), (F.col("value") - 30).alias("err"))
    share = lambda k: F.avg((F.abs("z") <= k).cast("double"))
    got = {"mae": F.avg(F.abs("err")), "rmse": F.sqrt(F.avg(F.col("err") * F.col("err"))), "bias": F.avg("err"), "in_1": share(1), "in_2": share(2), "z_std": F.stddev_pop("z")}
    table_ = x.groupBy("event_type").agg(*(F.round(c, 6).alias(n) for n, c in got.items()))
    p = ranks.percentiles(x.select("event_type", F.abs("err").alias("off")), ["event_type"], {"p95": ("off", 0.95)})
    return table_.join(p.select("event_type", F.round("p95", 6).alias("p95")), "event_type")


@query("ence", f"WITH {_E}, x AS (SELECT value - 30 AS err, 5.0 + k AS sigma FROM e), p AS (SELECT quantile_cont(sigma, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS l FROM x), q AS (SELECT i - 1 AS i, l[i] AS lo FROM p, range(1, 12) t(i)), b AS (SELECT a.i, a.lo AS lo, c.lo AS hi FROM q a JOIN q c ON c.i = a.i + 1), g AS (SELECT b.i, sqrt(avg(err * err)) AS rmse, avg(sigma) AS s, count(*) AS n FROM b JOIN x ON sigma >= lo AND sigma <= hi GROUP BY b.i HAVING count(*) >= 10) SELECT round(avg(abs(rmse - s) / s), 6) AS ence, count(*) AS bins FROM g")
def ence(spark, d):
    """Edge rows count in both of their decile bins; ten edges are collected into one row, never the data."""
    x = events(spark, d).select((F.col("value") - 30).alias("err"), (F.col("k") + 5.0).alias("sigma"))
    edges = ranks.percentiles(x, [], {f"p{i}": ("sigma", i / 10) for i in range(11)}).select(F.array(*(f"p{i}" for i in range(11))).alias("p"))
    bins = edges.select(F.posexplode(F.arrays_zip(F.slice("p", 1, 10).alias("lo"), F.slice("p", 2, 10).alias("hi"))).alias("i", "b")).select("i", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    g = x.join(F.broadcast(bins), F.expr("sigma >= lo AND sigma <= hi")).groupBy("i").agg(F.sqrt(F.avg(F.expr("err * err"))).alias("rmse"), F.avg("sigma").alias("s"), F.count("*").alias("n")).where("n >= 10")
    return g.agg(F.round(F.avg(F.abs(F.col("rmse") - F.col("s")) / F.col("s")), 6).alias("ence"), F.count("*").alias("bins"))


@query("select_with_ties", "WITH c AS (SELECT p_brand, p_partkey, p_retailprice AS mae, p_size AS params FROM part), b AS (SELECT *, min(mae) OVER (PARTITION BY p_brand) AS best FROM c) SELECT p_brand, p_partkey, mae, params FROM b WHERE mae <= best * 1.03 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY params, mae, p_partkey) = 1")
def select_with_ties(spark, d):
    c = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("mae"), F.col("p_size").alias("params"))
    best = c.groupBy("p_brand").agg(F.min("mae").alias("best"))
    near = c.join(best, "p_brand").where("mae <= best * 1.03")
    return seq.top_k(near, ["p_brand"], [F.col("params"), F.col("mae"), F.col("p_partkey")], 1).select("p_brand", "p_partkey", "mae", "params")


@query("content_digest", "WITH a AS (SELECT source, doc_id // 1024 AS b, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1, 2), b AS (SELECT source, b // 1024 AS c, sha256(string_agg(h, ',' ORDER BY b)) AS h, sum(n) AS n FROM a GROUP BY 1, 2) SELECT source, sha256(string_agg(h, ',' ORDER BY c)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY source")
def content_digest(spark, d):
    """Order-sensitive digest of a group: of ranges of 1,024 ids, then of 1,024 such digests, then of those; no row gathers a group."""
    g = table(spark, d, "documents").select("source", F.col("doc_id").alias("at"), F.sha2("text", 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for last in (False, False, True):
        keys = ["source"] if last else ["source", F.floor(F.col("at") / 1024).alias("up")]
        lists = F.sort_array(F.collect_list(F.struct("at", "h"))).alias("l")
        g = g.groupBy(*keys).agg(lists, F.sum("n").alias("n"))
        digest = F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ","), 256)
        g = g.select("source", digest.alias("digest"), "n") if last else g.select("source", F.col("up").alias("at"), digest.alias("h"), "n")
    return g


@query("max_abs_difference", "SELECT max(greatest(abs(a.l_quantity - b.o_totalprice / 10000), abs(a.l_tax - 0.05))) AS worst FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey")
def max_abs_difference(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, d, "lineitem").join(o, "l_orderkey").agg(F.max(F.greatest(F.abs(F.col("l_quantity") - F.col("o_totalprice") / 10000), F.abs(F.col("l_tax") - 0.05))).alias("worst"))


@query("fleet_rollup", "WITH s AS (SELECT c_nationkey, count(*) AS n, CAST(sum(o_totalprice * 100) AS BIGINT) AS cents, median(o_totalprice) AS med FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT n_regionkey, CAST(sum(n) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS cents, round(median(med), 4) AS median_of_medians, min(med) AS lo, max(med) AS hi FROM s JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def fleet_rollup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, d, "orders").join(c, "o_custkey").select("c_nationkey", "o_totalprice")
    sums = o.groupBy("c_nationkey").agg(F.round(F.sum(F.col("o_totalprice") * 100)).cast("long").alias("cents"))
    s = ranks.percentiles(o, ["c_nationkey"], {"med": ("o_totalprice", 0.5)}).join(sums, "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return s.join(n, "c_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.round(F.percentile("med", 0.5), 4).alias("median_of_medians"), F.min("med").alias("lo"), F.max("med").alias("hi"))


@query("split_leak_audit", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_leak_audit(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@query("pooled_and_grouped", "SELECT coalesce(l_returnflag, 'all') AS arm, count(*) AS n, round(median(l_quantity), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(avg(CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def pooled_and_grouped(spark, d):
    """Each arm and all together in one pass."""
    x = table(spark, d, "lineitem").select(F.explode(F.array("l_returnflag", F.lit("all"))).alias("arm"), "l_quantity")
    p = ranks.percentiles(x, ["arm"], {"p50": ("l_quantity", 0.5), "p95": ("l_quantity", 0.95)})
    share = x.groupBy("arm").agg(F.round(F.avg((F.col("l_quantity") <= 25).cast("double")), 6).alias("share"))
    return p.join(share, "arm").select("arm", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "share")


@query("phone_audit", f"WITH {_E} SELECT user_id, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value), 6) AS std, max(value) AS top, max_by(event_type, (value, event_id)) AS top_channel, count(CASE WHEN value > 90 THEN 1 END) AS n_high FROM e GROUP BY user_id")
def phone_audit(spark, d):
    g = events(spark, d).groupBy("user_id")
    return g.agg(F.round(F.percentile("value", 0.01), 6).alias("p01"), F.round(F.percentile("value", 0.99), 6).alias("p99"), F.round(F.stddev_pop("value"), 6).alias("std"), F.max("value").alias("top"), F.max_by("event_type", F.struct("value", "event_id")).alias("top_channel"), F.count_if(F.col("value") > 90).alias("n_high"))


@query("band_table", "SELECT CASE WHEN l_quantity < 10 THEN '0-10' WHEN l_quantity < 25 THEN '10-25' ELSE '25+' END AS band, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2")
def band_table(spark, d):
    band = F.when(F.col("l_quantity") < 10, "0-10").when(F.col("l_quantity") < 25, "10-25").otherwise("25+")
    return table(spark, d, "lineitem").groupBy(band.alias("band"), "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("gate_row_accounting", "SELECT (SELECT count(*) FROM lineitem) AS n_in, (SELECT count(*) FROM lineitem WHERE l_quantity > 45) AS n_dropped, (SELECT count(*) FROM lineitem WHERE l_quantity <= 45) AS n_out, (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1) AS n_range")
def gate_row_accounting(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.count("*").alias("n_in"), F.count_if(q > 45).alias("n_dropped"), F.count_if(q <= 45).alias("n_out"), F.count_if(~F.col("l_discount").between(0, 0.1)).alias("n_range"))
