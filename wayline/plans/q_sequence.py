"""Queries over ordered rows: events play the sensor stream, user_id the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators import ranks
from wayline.operators import sequence as seq
from wayline.plans.catalog import query
from wayline.plans.tables import events, table

BY, ORDER = ["user_id"], ["t_us", "event_id"]
HOUR, DAY = 3_600_000_000, 86_400_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_SEG = f"""{_E}, d AS (SELECT *, t_us - lag(t_us) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN dt IS NULL OR dt > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS segment_id,
  CASE WHEN dt <= {6 * HOUR} THEN dt END AS dt_us FROM d)"""
_W = "(PARTITION BY user_id ORDER BY t_us, event_id{})"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return seq.segments(events(spark, d), BY, ORDER, "t_us", 6 * HOUR)


@query("segment_audit", f"WITH {_SEG} SELECT user_id, segment_id, count(*) AS n, max(t_us) - min(t_us) AS duration_us, round(median(value), 6) AS median_value FROM s GROUP BY ALL")
def segment_audit(spark, d):
    g = _segments(spark, d).groupBy("user_id", "segment_id")
    return g.agg(F.count("*").alias("n"), (F.max("t_us") - F.min("t_us")).alias("duration_us"), F.round(F.percentile("value", 0.5), 6).alias("median_value"))


_EDGES = [60, 600, 3600, 21600, 86400, 259200]


@query("dt_histogram", f"WITH {_SEG} SELECT user_id, " + ", ".join(f"count(CASE WHEN dt >= {a * 10**6} AND dt < {b * 10**6} THEN 1 END) AS bin_{i}" for i, (a, b) in enumerate(zip([0, *_EDGES], [*_EDGES, 10**9]))) + ", median(dt) AS median_dt, round(quantile_cont(dt, 0.99), 2) AS p99_dt, min(dt) AS min_dt, max(dt) AS max_dt, count(CASE WHEN dt = 0 THEN 1 END) AS n_duplicate FROM s GROUP BY user_id")
def dt_histogram(spark, d):
    df = seq.with_dt(events(spark, d), BY, ORDER, "t_us", "dt")
    bins = [F.count_if((F.col("dt") >= a * 10**6) & (F.col("dt") < b * 10**6)).alias(f"bin_{i}") for i, (a, b) in enumerate(zip([0, *_EDGES], [*_EDGES, 10**9]))]
    return df.groupBy("user_id").agg(*bins, F.percentile("dt", 0.5).alias("median_dt"), F.round(F.percentile("dt", 0.99), 2).alias("p99_dt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.count_if(F.col("dt") == 0).alias("n_duplicate"))


@query("recorded_duration", f"WITH {_SEG} SELECT user_id, CAST(sum(CASE WHEN dt > 0 AND dt <= {6 * HOUR} THEN dt END) AS BIGINT) AS recorded_us FROM s GROUP BY user_id")
def recorded_duration(spark, d):
    df = seq.with_dt(events(spark, d), BY, ORDER, "t_us", "dt")
    return df.groupBy("user_id").agg(F.sum(F.when((F.col("dt") > 0) & (F.col("dt") <= 6 * HOUR), F.col("dt"))).alias("recorded_us"))


@query("null_counts", f"WITH {_SEG} SELECT count(*) AS n, count(*) - count(dt) AS null_dt, count(*) - count(dt_us) AS null_dt_us, count(*) - count(value) AS null_value FROM s")
def null_counts(spark, d):
    df = seq.with_dt(_segments(spark, d), BY, ORDER, "t_us", "dt")
    return df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("dt", "dt_us", "value")))


@query("change_flags", f"WITH {_E} SELECT event_id, user_id, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w OR k // 50 IS DISTINCT FROM lag(k // 50) OVER w AS changed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)")
def change_flags(spark, d):
    df = events(spark, d).withColumn("kk", F.floor(F.col("k") / 50))
    return seq.changed(df, BY, ORDER, ["event_type", "kk"]).select("event_id", "user_id", "changed")


@query("ffill_age", f"WITH {_E} SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER v AS last_value, t_us - last_value(CASE WHEN event_type = 'click' THEN t_us END IGNORE NULLS) OVER v AS age_us FROM e WINDOW v AS {_W.format(' ROWS UNBOUNDED PRECEDING')}")
def ffill_age(spark, d):
    new = F.col("event_type") == "click"
    df = seq.filled(events(spark, d), BY, ORDER, F.when(new, F.col("value")), "last_value")
    df = seq.filled(df, BY, ORDER, F.when(new, F.col("t_us")), "fix_us")
    return df.select("event_id", "last_value", (F.col("t_us") - F.col("fix_us")).alias("age_us"))


@query("smooth_centered", f"WITH {_E} SELECT event_id, round(avg(value) OVER {_W.format(' ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING')}, 6) AS smooth FROM e")
def smooth_centered(spark, d):
    return seq.smoothed(events(spark, d), BY, ORDER, "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("rolling_std", f"WITH {_E} SELECT event_id, round(CASE WHEN count(value) OVER w = 10 THEN stddev_samp(value) OVER w END, 6) AS std, round(CASE WHEN count(value) OVER w = 10 THEN stddev_pop(value) OVER w END, 6) AS std_pop FROM e WINDOW w AS {_W.format(' ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')}")
def rolling_std(spark, d):
    df = seq.trailing_std(events(spark, d), BY, ORDER, "value")
    df = seq.trailing_std(df, BY, ORDER, "value", population=True, out="std_pop")
    return df.select("event_id", F.round("std", 6).alias("std"), F.round("std_pop", 6).alias("std_pop"))


@query("still_flags", f"WITH {_E} SELECT event_id, coalesce(count(value) OVER w = 10 AND stddev_pop(value) OVER w < 20 AND abs(k - 50) < 20, false) AS still FROM e WINDOW w AS {_W.format(' ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')}")
def still_flags(spark, d):
    df = seq.trailing_std(events(spark, d), BY, ORDER, "value", population=True)
    return df.select("event_id", F.coalesce((F.col("std") < 20) & (F.abs(F.col("k") - 50) < 20), F.lit(False)).alias("still"))


@query("central_diff", f"WITH {_SEG} SELECT event_id, round(CASE WHEN lead(segment_id, 2) OVER w = lag(segment_id, 2) OVER w AND lead(t_us, 2) OVER w <> lag(t_us, 2) OVER w THEN (lead(value, 2) OVER w - lag(value, 2) OVER w) / ((lead(t_us, 2) OVER w - lag(t_us, 2) OVER w) / 1e6) END, 9) AS rate FROM s WINDOW w AS {_W.format('')}")
def central_diff(spark, d):
    return seq.central_difference(_segments(spark, d), BY, ORDER, "value", "t_us", 2, "segment_id").select("event_id", F.round("rate", 9).alias("rate"))


@query("hop_windows", f"WITH {_SEG}, r AS (SELECT *, row_number() OVER v - 1 AS row, CAST(count(CASE WHEN dt > {6 * HOUR} OR k < 5 THEN 1 END) OVER {_W.format(' ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')} AS BIGINT) AS n_bad FROM s WINDOW v AS {_W.format('')}) SELECT event_id, row, n_bad FROM r WHERE row >= 9 AND (row - 9) % 5 = 0")
def hop_windows(spark, d):
    df = seq.with_dt(events(spark, d), BY, ORDER, "t_us", "dt")
    bad = (F.col("dt") > 6 * HOUR) | (F.col("k") < 5)
    return seq.hops(df, BY, ORDER, 10, 5, F.coalesce(bad, F.lit(False))).select("event_id", "row", "n_bad")


@query("window_tensors", f"WITH {_E}, r AS (SELECT *, row_number() OVER v - 1 AS row, list(value) OVER {_W.format(' ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS l FROM e WINDOW v AS {_W.format('')}) SELECT event_id, array_to_string(list_transform(l, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS window_values FROM r WHERE row >= 4 AND row % 5 = 4")
def window_tensors(spark, d):
    w = seq.rows(BY, ORDER)
    df = events(spark, d).withColumn("row", F.row_number().over(w) - 1).withColumn("l", F.collect_list("value").over(w.rowsBetween(-4, 0)))
    text = F.array_join(F.transform("l", lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return df.where("row >= 4 AND row % 5 = 4").select("event_id", text.alias("window_values"))


@query("stop_runs", f"WITH {_E}, r AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY user_id, value < 15 ORDER BY t_us, event_id) AS g FROM e WINDOW w AS {_W.format('')}) SELECT user_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM r WHERE value < 15 GROUP BY user_id, g HAVING count(*) >= 3")
def stop_runs(spark, d):
    df = seq.islands(events(spark, d), BY, ORDER, F.col("value") < 15).where("flag")
    return df.groupBy("user_id", "run").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n")).where("n >= 3").drop("run")


@query("stop_pairs", f"WITH {_E}, r AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY user_id, value < 15 ORDER BY t_us, event_id) AS g FROM e WINDOW w AS {_W.format('')}), s AS (SELECT user_id, min(t_us) AS a, max(t_us) AS b FROM r WHERE value < 15 GROUP BY user_id, g HAVING count(*) >= 2), p AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS next_a FROM s) SELECT user_id, b AS stop_end_us, next_a - b AS apart_us FROM p WHERE next_a - b BETWEEN {HOUR} AND {7 * DAY}")
def stop_pairs(spark, d):
    df = seq.islands(events(spark, d), BY, ORDER, F.col("value") < 15).where("flag").groupBy("user_id", "run")
    runs = df.agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.count("*").alias("n")).where("n >= 2")
    apart = F.lead("a").over(Window.partitionBy("user_id").orderBy("a")) - F.col("b")
    return runs.withColumn("apart_us", apart).where(F.col("apart_us").between(HOUR, 7 * DAY)).select("user_id", F.col("b").alias("stop_end_us"), "apart_us")


@query("tod_unwrap", f"WITH {_E}, x AS (SELECT *, (t_us % {DAY}) / 1e6 AS tod FROM e), y AS (SELECT *, CASE WHEN tod - lag(tod) OVER w < -43200 THEN 1 ELSE 0 END AS wrap FROM x WINDOW w AS {_W.format('')}) SELECT event_id, round(tod + 86400 * sum(wrap) OVER {_W.format(' ROWS UNBOUNDED PRECEDING')}, 6) AS tod_s FROM y")
def tod_unwrap(spark, d):
    df = events(spark, d).withColumn("tod", (F.col("t_us") % DAY) / F.lit(1e6))
    return seq.day_unwrapped(df, BY, ORDER, "tod", "tod_s").select("event_id", F.round("tod_s", 6).alias("tod_s"))


@query("phase_unwrap", f"WITH {_E}, x AS (SELECT *, k * 3.5e0 AS a FROM e), y AS (SELECT *, coalesce(-round_even((a - lag(a) OVER w) / 360e0, 0), 0) AS turn FROM x WINDOW w AS {_W.format('')}) SELECT event_id, round(a + 360e0 * sum(turn) OVER {_W.format(' ROWS UNBOUNDED PRECEDING')}, 6) AS angle_deg FROM y")
def phase_unwrap(spark, d):
    """Steps of 3.5 degrees: none is exactly half a turn, where rounding would decide."""
    df = events(spark, d).withColumn("a", F.col("k") * 3.5)
    return seq.unwrapped(df, BY, ORDER, "a", 360.0, "angle_deg").select("event_id", F.round("angle_deg", 6).alias("angle_deg"))


@query("running_max_gap", f"WITH {_E} SELECT event_id, t_us - max(t_us + k * {HOUR}) OVER {_W.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS gap FROM e")
def running_max_gap(spark, d):
    df = events(spark, d).withColumn("end_us", F.col("t_us") + F.col("k") * HOUR)
    return seq.gap_to_running_end(df, BY, ORDER, "t_us", "end_us").select("event_id", "gap")


@query("path_length", f"WITH {_E}, y AS (SELECT *, coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2)), 0) AS step FROM e WINDOW w AS {_W.format('')}) SELECT event_id, round(sum(step) OVER {_W.format(' ROWS UNBOUNDED PRECEDING')}, 5) AS travelled FROM y")
def path_length(spark, d):
    return seq.path_length(events(spark, d), BY, ORDER, "value", "k").select("event_id", F.round("travelled", 5).alias("travelled"))


@query("emission_distance", f"WITH {_E}, y AS (SELECT *, t_us // {DAY} AS emission, coalesce(abs(k - lag(k) OVER w), 0) AS step FROM e WINDOW w AS {_W.format('')}) SELECT user_id, emission, CAST(sum(step) AS BIGINT) AS distance FROM y GROUP BY ALL")
def emission_distance(spark, d):
    step = F.coalesce(F.abs(F.col("k") - F.lag("k").over(seq.rows(BY, ORDER))), F.lit(0))
    return events(spark, d).withColumn("step", step).groupBy("user_id", F.floor(F.col("t_us") / DAY).alias("emission")).agg(F.sum("step").alias("distance"))


@query("track_runs", f"WITH {_E}, y AS (SELECT *, row_number() OVER w = 1 OR (event_type = 'error') <> lag(event_type = 'error') OVER w AS start FROM e WINDOW w AS {_W.format('')}), z AS (SELECT *, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) OVER {_W.format(' ROWS UNBOUNDED PRECEDING')} AS BIGINT) - 1 AS run FROM y), g AS (SELECT user_id, run, bool_or(event_type = 'error') AS flag, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM z GROUP BY ALL) SELECT *, lag(end_us) OVER (PARTITION BY user_id ORDER BY run) AS previous_end_us FROM g")
def track_runs(spark, d):
    df = seq.islands(events(spark, d), BY, ORDER, F.col("event_type") == "error").groupBy("user_id", "run")
    runs = df.agg(F.bool_or("flag").alias("flag"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n"))
    return runs.withColumn("previous_end_us", F.lag("end_us").over(Window.partitionBy("user_id").orderBy("run")))


@query("jump_check", f"WITH {_E} SELECT event_id, round(abs((value - lag(value) OVER w) - k * (t_us - lag(t_us) OVER w) / 1e12), 6) AS jump FROM e WINDOW w AS {_W.format('')}")
def jump_check(spark, d):
    w = seq.rows(BY, ORDER)
    dt = (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(1e12)
    return events(spark, d).select("event_id", F.round(F.abs(F.col("value") - F.lag("value").over(w) - F.col("k") * dt), 6).alias("jump"))


@query("shifted", f"WITH {_E} SELECT event_id, lead(value, 3) OVER w AS ahead, lag(value, 3) OVER w AS behind FROM e WINDOW w AS {_W.format('')}")
def shifted(spark, d):
    w = seq.rows(BY, ORDER)
    return events(spark, d).select("event_id", F.lead("value", 3).over(w).alias("ahead"), F.lag("value", 3).over(w).alias("behind"))


_CH = ["click", "view", "error"]


@query("resample_tumbling", f"WITH {_E} SELECT * FROM (SELECT user_id, CAST((t_us // {3 * DAY} + 1) * {3 * DAY} AS BIGINT) AS bin_end_us, " + ", ".join(f"round(avg(CASE WHEN event_type = '{c}' THEN value END), 6) AS {c}" for c in _CH) + " FROM e GROUP BY 1, 2) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CH))
def resample_tumbling(spark, d):
    df = seq.resampled(events(spark, d), BY, "t_us", "event_type", "value", _CH, 3 * DAY)
    return df.select("user_id", "bin_end_us", *(F.round(c, 6).alias(c) for c in _CH))


@query("rate_meter", f"WITH {_E} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n_window FROM e")
def rate_meter(spark, d):
    return seq.rates(events(spark, d), BY, "t_us", DAY).select("event_id", "n_window")


@query("buffer_ready", f"WITH {_SEG} SELECT event_id, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY t_us, event_id) >= 3 AS ready FROM s")
def buffer_ready(spark, d):
    return _segments(spark, d).select("event_id", (F.row_number().over(seq.rows(["user_id", "segment_id"], ORDER)) >= 3).alias("ready"))


@query("dedupe_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) = 1")
def dedupe_rows(spark, d):
    df = table(spark, d, "lineitem")
    return seq.deduplicated(df, ["l_partkey", "l_quantity"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("reordered_rows", f"WITH {_E} SELECT user_id, count(CASE WHEN a <> b THEN 1 END) AS n_reordered FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS b FROM e) GROUP BY user_id")
def reordered_rows(spark, d):
    a = F.row_number().over(seq.rows(BY, ORDER))
    b = F.row_number().over(seq.rows(BY, ["value", "event_id"]))
    return events(spark, d).select("user_id", a.alias("a"), b.alias("b")).groupBy("user_id").agg(F.count_if(F.col("a") != F.col("b")).alias("n_reordered"))


@query("topk_per_group", f"WITH {_E} SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM e QUALIFY rank <= 3")
def topk_per_group(spark, d):
    return seq.top_k(events(spark, d), BY, [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "value", "rank")


@query("top_values", f"WITH {_E} SELECT k, count(*) AS n FROM e GROUP BY k ORDER BY n DESC, k LIMIT 5")
def top_values(spark, d):
    return events(spark, d).groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(5)


@query("evenly_spaced", f"WITH {_E}, r AS (SELECT event_id, user_id, row_number() OVER {_W.format('')} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id FROM r WHERE (i * 5) // n <> ((i - 1) * 5) // n OR i = 0")
def evenly_spaced(spark, d):
    w = seq.rows(BY, ORDER)
    r = events(spark, d).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy(*BY)).alias("n"))
    return r.where((F.col("i") == 0) | (F.floor(F.col("i") * 5 / F.col("n")) != F.floor((F.col("i") - 1) * 5 / F.col("n")))).select("event_id")


@query("multi_key_order", f"WITH {_E} SELECT event_id, row_number() OVER (ORDER BY event_type, k DESC, t_us, event_id) AS place FROM e")
def multi_key_order(spark, d):
    """Global places without one task for all rows, or for all keys: places within ranges, and the sizes of the ranges before."""
    order = [F.col("event_type"), F.desc("k"), F.col("t_us"), F.col("event_id")]
    return ranks.placed(events(spark, d), order, "place").select("event_id", "place")


@query("set_intersect", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("set_union_distinct", "SELECT user_id AS id FROM events UNION SELECT c_custkey FROM customer")
def set_union_distinct(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("id")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("set_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("set_union_all", "SELECT 's' AS kind, s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT 'c', c_custkey, c_acctbal FROM customer")
def set_union_all(spark, d):
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return s.unionByName(table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))


@query("set_equal", "SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)) AS n_more, (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT ALL SELECT n_regionkey FROM nation)) AS n_less")
def set_equal(spark, d):
    """Counts of each key on both sides in one aggregate over a union: no join at all."""
    side = lambda name, key, x, y: table(spark, d, name).select(F.col(key).alias("key"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    both = side("nation", "n_regionkey", 1, 0).unionByName(side("region", "r_regionkey", 0, 1)).groupBy("key").agg((F.sum("a") - F.sum("b")).alias("more"))
    n = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0))
    return both.agg(n(F.col("more")).alias("n_more"), n(-F.col("more")).alias("n_less"))
