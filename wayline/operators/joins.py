"""Joins in time: nearest, backward, forward and interpolating as-of joins, ranges.

An as-of join is a union of both sides and two windows that carry the last and
next row of the other side: one exchange by session and one sort, no matter how
many rows match. A session that outgrows a task is split by time with ``cut``,
each part seeing the other side's rows within the tolerance around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _merged(left: DataFrame, right: DataFrame, by: Keys, at: str, key: str, right_key: str, values: Keys) -> DataFrame:
    kept = list(dict.fromkeys([at, right_key, *values]))
    one = left.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(key).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*kept)).schema[0].dataType).alias("_right"))
    two = right.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(right_key).alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*kept).alias("_right"))
    return one.unionByName(two)


def asof(left: DataFrame, right: DataFrame, by: Keys, at: str, key: str, right_key: str, values: Keys, how: str = "nearest", tolerance: int | None = None, cut: int | None = None) -> DataFrame:
    """left with the row of right nearest in time (or last at or before, or first at or after).

    at: time in whole units on both sides; tolerance in the same unit. Adds match_at
    and the values of right; unmatched rows keep nulls. At equal distance the row
    before wins; rows of right at one time: the last by right_key backward, the first forward.
    cut: length of the parts into which sessions are split by time; it needs a tolerance, and changes no result.
    """
    if cut is not None:
        if tolerance is None:
            raise ValueError("only a join with a tolerance can be cut by time")
        part = lambda c: F.floor(c / F.lit(cut))
        right = right.withColumn("_part", F.explode(F.sequence(part(F.col(at) - tolerance), part(F.col(at) + tolerance))))
        out = asof(left.withColumn("_part", part(F.col(at))), right, [*by, "_part"], at, key, right_key, values, how, tolerance)
        return out.drop("_part")
    all_rows = _merged(left, right, by, at, key, right_key, values)
    w = Window.partitionBy(*by)
    # backward sees right rows of the same instant, so they sort before left ones; forward the other way round
    before = F.last("_right", ignorenulls=True).over(w.orderBy(F.col("_at"), F.col("_side").desc(), F.col("_tie")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_right", ignorenulls=True).over(w.orderBy(F.col("_at"), F.col("_side"), F.col("_tie")).rowsBetween(0, Window.unboundedFollowing))
    found = all_rows.select("_left", "_side", "_at", *([before.alias("_b")] if how != "forward" else []), *([after.alias("_a")] if how != "backward" else []))
    found = found.where("_side = 0")
    if how == "nearest":
        near = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).when(F.col("_at") - F.col(f"_b.{at}") <= F.col(f"_a.{at}") - F.col("_at"), F.col("_b")).otherwise(F.col("_a"))
    else:
        near = F.col("_b") if how == "backward" else F.col("_a")
    found = found.withColumn("_r", near)
    if tolerance is not None:
        found = found.withColumn("_r", F.when(F.abs(F.col("_at") - F.col(f"_r.{at}")) <= tolerance, F.col("_r")))
    return found.select("_left.*", F.col(f"_r.{at}").alias("match_at"), *(F.col(f"_r.{v}").alias(f"r_{v}") for v in values))


def interpolated(left: DataFrame, right: DataFrame, by: Keys, at: str, key: str, right_key: str, value: str) -> DataFrame:
    """left with right's value at its time, linear between the points around it and constant beyond the ends."""
    all_rows = _merged(left, right, by, at, key, right_key, [value])
    w = Window.partitionBy(*by)
    before = F.last("_right", ignorenulls=True).over(w.orderBy(F.col("_at"), F.col("_side").desc(), F.col("_tie")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_right", ignorenulls=True).over(w.orderBy(F.col("_at"), F.col("_side"), F.col("_tie")).rowsBetween(0, Window.unboundedFollowing))
    found = all_rows.select("_left", "_side", "_at", before.alias("_b"), after.alias("_a")).where("_side = 0")
    span = F.col(f"_a.{at}") - F.col(f"_b.{at}")
    line = F.col(f"_b.{value}") + (F.col(f"_a.{value}") - F.col(f"_b.{value}")) * (F.col("_at") - F.col(f"_b.{at}")) / F.nullif(span, F.lit(0))
    return found.select("_left.*", F.coalesce(line, F.col(f"_b.{value}"), F.col(f"_a.{value}")).alias(f"r_{value}"))


def in_ranges(points: DataFrame, ranges: DataFrame, by: Keys, at: str, start: str, end: str, range_key: str, cell: int) -> DataFrame:
    """points with the first range (by start, then key) of their session that holds them: start <= at < end.

    Ranges are cut into cells of time, so the join is an equi-join on session and
    cell; only ranges of the same cell meet.
    """
    row = points.withColumn("_row", F.monotonically_increasing_id())
    firsts = F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))
    cut = ranges.where(F.col(end) > F.col(start)).withColumn("_cell", F.explode(firsts))
    cut = cut.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), "_cell", F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(range_key).alias("_range"))
    p = row.withColumn("_c", F.floor(F.col(at) / cell))
    on = (p["_c"] == cut["_cell"]) & (p[at] >= cut["_start"]) & (p[at] < cut["_end"])
    for i, b in enumerate(by):
        on = on & (p[b] == cut[f"_k{i}"])
    # a point is one row, however often an equal one is there
    best = p.join(cut, on, "left").groupBy(*points.columns, "_row").agg(F.min(F.struct("_start", "_range")).alias("_m"))
    return best.select(*points.columns, F.col("_m._range").alias("range_id"))


def history(left: DataFrame, states: DataFrame, by: Keys, epoch: str, received: str, at: str, key: str, state_key: str, values: Keys, horizon: int) -> DataFrame:
    """left with the state nearest to its epoch among those of the horizon before it was received.

    A bounded history in batch form: a state older than received - horizon is gone,
    a later one is not there yet. Of two states equally near the earlier one counts.
    Adds r_at, and the values as r_<name>; null where the history is empty.
    """
    # before the horizon all states of the history are later, and the first of them is nearest
    asked = left.select(*by, key, F.greatest(F.col(epoch), F.col(received) - horizon).alias(epoch))
    states = states.withColumnRenamed(at, epoch)
    pair = lambda how: asof(asked, states, by, epoch, key, state_key, values, how).select(key, F.struct(F.col("match_at").alias("at"), *(F.col(f"r_{v}").alias(v) for v in values)).alias(how))
    found = left.join(pair("backward"), key).join(pair("forward"), key)
    ok = lambda s: F.when((F.col(f"{s}.at") >= F.col(received) - horizon) & (F.col(f"{s}.at") <= F.col(received)), F.col(s))
    b, a = ok("backward"), ok("forward")
    near = F.when(a["at"].isNull() | (F.col(epoch) - b["at"] <= a["at"] - F.col(epoch)), b).otherwise(a)
    found = found.withColumn("_r", F.coalesce(near, a))
    return found.select(*left.columns, F.col("_r.at").alias("r_at"), *(F.col(f"_r.{v}").alias(f"r_{v}") for v in values))


def positional(left: DataFrame, right: DataFrame, by: Keys, left_order: Keys, right_order: Keys) -> DataFrame:
    """Rows paired by their number within the session."""
    a = left.withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, "row"])
