"""Join queries: clicks and purchases of a user play two clocks; orders and days play intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import joins
from wayline.plans.catalog import query
from wayline.plans.tables import events, table

HOUR, DAY = 3_600_000_000, 86_400_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'click')"
_BEFORE = "(SELECT r.event_id FROM r WHERE r.user_id = l.user_id AND r.t_us <= l.t_us ORDER BY r.t_us DESC, r.event_id DESC LIMIT 1)"
_AFTER = "(SELECT r.event_id FROM r WHERE r.user_id = l.user_id AND r.t_us >= l.t_us ORDER BY r.t_us, r.event_id LIMIT 1)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "t_us", "value"), e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", "t_us", "value")


def _asof(spark, d, how: str, tolerance: int | None) -> DataFrame:
    left, right = _sides(spark, d)
    return joins.asof(left, right, ["user_id"], "t_us", "event_id", "rid", ["rid", "value"], how, tolerance).select("event_id", F.col("r_rid").alias("match_id"), F.col("r_value").alias("match_value"))


def _asof_sql(pick: str, tolerance: int | None) -> str:
    near = f"AND abs(r.t_us - m.t_us) <= {tolerance}" if tolerance else ""
    return f"WITH {_E}, m AS (SELECT l.*, {pick} AS mid FROM l) SELECT m.event_id, r.event_id AS match_id, r.value AS match_value FROM m LEFT JOIN r ON r.event_id = m.mid {near}"


_NEAREST = "(SELECT r.event_id FROM r WHERE r.user_id = l.user_id ORDER BY abs(r.t_us - l.t_us), CASE WHEN r.t_us <= l.t_us THEN 0 ELSE 1 END, CASE WHEN r.t_us <= l.t_us THEN -r.event_id ELSE r.event_id END LIMIT 1)"


@query("asof_nearest", _asof_sql(_NEAREST, 6 * HOUR))
def asof_nearest(spark, d):
    return _asof(spark, d, "nearest", 6 * HOUR)


@query("asof_backward_stale", _asof_sql(_BEFORE, DAY))
def asof_backward_stale(spark, d):
    return _asof(spark, d, "backward", DAY)


@query("asof_forward_receipt", _asof_sql(_AFTER, None))
def asof_forward_receipt(spark, d):
    return _asof(spark, d, "forward", None)


@query("interp_join", f"WITH {_E}, m AS (SELECT l.*, {_BEFORE} AS b, {_AFTER} AS a FROM l) SELECT m.event_id, round(CASE WHEN x.value IS NULL THEN y.value WHEN y.value IS NULL OR y.t_us = x.t_us THEN x.value ELSE x.value + (y.value - x.value) * CAST(m.t_us - x.t_us AS DOUBLE) / (y.t_us - x.t_us) END, 6) AS value FROM m LEFT JOIN r x ON x.event_id = m.b LEFT JOIN r y ON y.event_id = m.a")
def interp_join(spark, d):
    left, right = _sides(spark, d)
    return joins.interpolated(left.drop("value"), right, ["user_id"], "t_us", "event_id", "rid", "value").select("event_id", F.round("r_value", 6).alias("value"))


@query("range_membership", f"WITH {_E}, g AS (SELECT event_id AS range_id, user_id, t_us AS a, t_us + k * {HOUR} AS b FROM r) SELECT l.event_id, (SELECT g.range_id FROM g WHERE g.user_id = l.user_id AND l.t_us >= g.a AND l.t_us < g.b ORDER BY g.a, g.range_id LIMIT 1) AS range_id FROM l")
def range_membership(spark, d):
    e = events(spark, d)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "t_us")
    ranges = e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", F.col("t_us").alias("a"), (F.col("t_us") + F.col("k") * HOUR).alias("b"))
    return joins.in_ranges(points, ranges, ["user_id"], "t_us", "a", "b", "rid", DAY).select("event_id", "range_id")


@query("range_mean", f"WITH {_E} SELECT l.event_id, count(r.value) AS n, round(CASE WHEN count(r.value) >= 2 THEN avg(r.value) END, 6) AS mean FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.t_us > l.t_us - {5 * DAY} AND r.t_us <= l.t_us GROUP BY l.event_id")
def range_mean(spark, d):
    """Mean of the clicks in the five days up to each purchase: one range window over both."""
    e = events(spark, d).where("event_type IN ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy("t_us").rangeBetween(-5 * DAY + 1, 0)
    v = F.when(F.col("event_type") == "click", F.col("value"))
    df = e.withColumn("n", F.count(v).over(w)).withColumn("m", F.avg(v).over(w)).where("event_type = 'purchase'")
    return df.select("event_id", "n", F.round(F.when(F.col("n") >= 2, F.col("m")), 6).alias("mean"))


@query("split_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def split_semi(spark, d):
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("leak_anti", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def leak_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("theta_leaks", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority < b.o_orderpriority AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) < 20")
def theta_leaks(spark, d):
    """Pairs of one customer's orders, other priority, under 20 days apart: an equi-join on 20-day cells."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    a = o.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("day").alias("x"), F.floor(F.col("day") / 20).alias("cell"))
    b = o.select(F.col("o_orderkey").alias("b"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("q"), F.col("day").alias("y"), F.floor(F.col("day") / 20).alias("own"))
    b = b.withColumn("cell", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    return a.join(b, ["c", "cell"]).where((F.col("p") < F.col("q")) & (F.abs(F.col("x") - F.col("y")) < 20)).select("a", "b")


@query("positional_join", f"WITH {_E}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS n FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS n FROM r) SELECT a.event_id, b.event_id AS other_id, b.t_us - a.t_us AS wrong_us FROM a JOIN b ON a.user_id = b.user_id AND a.n = b.n")
def positional_join(spark, d):
    left, right = _sides(spark, d)
    right = right.select("rid", "user_id", F.col("t_us").alias("r_us"))
    return joins.positional(left, right, ["user_id"], ["t_us", "event_id"], ["r_us", "rid"]).select("event_id", F.col("rid").alias("other_id"), (F.col("r_us") - F.col("t_us")).alias("wrong_us"))


@query("rounded_time_join", f"WITH {_E} SELECT l.event_id, min(r.event_id) AS other_id FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.t_us // {DAY} = r.t_us // {DAY} GROUP BY l.event_id")
def rounded_time_join(spark, d):
    left, right = _sides(spark, d)
    day = F.floor(F.col("t_us") / DAY).alias("day")
    right = right.groupBy("user_id", day).agg(F.min("rid").alias("other_id"))
    return left.select("event_id", "user_id", day).join(right, ["user_id", "day"], "left").select("event_id", "other_id")


@query("pairwise_lead", f"WITH {_E} SELECT event_id, lead(event_id) OVER w AS next_id, lead(t_us) OVER w - t_us AS step_us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)")
def pairwise_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    return events(spark, d).select("event_id", F.lead("event_id").over(w).alias("next_id"), (F.lead("t_us").over(w) - F.col("t_us")).alias("step_us"))


@query("truth_masked", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def truth_masked(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    truth = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity", truth.alias("truth"))


@query("last_before_end", f"WITH {_E} SELECT r.event_id AS range_id, max_by(e.event_id, (e.t_us, e.event_id)) AS last_id, count(e.event_id) AS n FROM r JOIN e ON e.user_id = r.user_id AND e.t_us >= r.t_us AND e.t_us < r.t_us + {3 * DAY} GROUP BY r.event_id")
def last_before_end(spark, d):
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("t_us").rangeBetween(0, 3 * DAY - 1)
    last = F.max(F.struct("t_us", "event_id")).over(w)
    df = e.withColumn("last", last).withColumn("n", F.count("*").over(w)).where("event_type = 'click'")
    return df.select(F.col("event_id").alias("range_id"), F.col("last.event_id").alias("last_id"), "n")


@query("synced_session", f"WITH {_E}, m AS (SELECT l.*, {_NEAREST} AS mid FROM l), s AS (SELECT m.*, m.t_us - lag(m.t_us) OVER w AS dt FROM m WINDOW w AS (PARTITION BY m.user_id ORDER BY m.t_us, m.event_id)) SELECT s.event_id, CAST(sum(CASE WHEN dt IS NULL OR dt > {5 * DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY s.user_id ORDER BY s.t_us, s.event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS segment_id, r.event_id IS NOT NULL AS gt_valid, r.value AS gt_value FROM s LEFT JOIN r ON r.event_id = s.mid AND abs(r.t_us - s.t_us) <= {6 * HOUR}")
def synced_session(spark, d):
    """The central query: the phone timeline, the nearest truth within a tolerance, and segments by gap."""
    from wayline.operators import sequence as seq

    left, right = _sides(spark, d)
    matched = joins.asof(left, right, ["user_id"], "t_us", "event_id", "rid", ["rid", "value"], "nearest", 6 * HOUR)
    out = seq.segments(matched, ["user_id"], ["t_us", "event_id"], "t_us", 5 * DAY)
    return out.select("event_id", "segment_id", F.col("r_rid").isNotNull().alias("gt_valid"), F.col("r_value").alias("gt_value"))
