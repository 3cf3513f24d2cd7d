"""Operators over ordered rows of a session: gaps, segments, fills, rolling statistics, runs.

``by`` names the session key and ``order`` the columns that order its rows; the
last of them must be unique in a session, so that every result is determined.
One exchange by session serves a whole chain of these operators, as all of them
ask for the same partitioning and ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = list[str]


def rows(by: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_dt(df: DataFrame, by: Keys, order: Keys, at: str, out: str = "dt_us") -> DataFrame:
    """Microseconds since the row before; null on a session's first row."""
    return df.withColumn(out, F.col(at) - F.lag(at).over(rows(by, order)))


def segments(df: DataFrame, by: Keys, order: Keys, at: str, gap_us: int, out: str = "segment_id") -> DataFrame:
    """Numbers maximal runs whose steps are at most gap_us, from 0; dt is null where a run starts."""
    w = rows(by, order)
    dt = F.col(at) - F.lag(at).over(w)
    df = df.withColumn("_start", dt.isNull() | (dt > gap_us)).withColumn("_dt", dt)
    number = F.sum(F.col("_start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return df.withColumn(out, number).withColumn("dt_us", F.when(~F.col("_start"), F.col("_dt"))).drop("_start", "_dt")


def changed(df: DataFrame, by: Keys, order: Keys, columns: Keys, out: str = "changed") -> DataFrame:
    """True on the first row and where any column differs from the row before; NaN differs from NaN."""
    w = rows(by, order)
    differs = F.lit(False)
    for c in columns:
        nan = F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False)
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w)) | F.coalesce(nan, F.lit(False))
    return df.withColumn(out, differs | (F.row_number().over(w) == 1))


def filled(df: DataFrame, by: Keys, order: Keys, value: Column, out: str) -> DataFrame:
    """The last value that is not null, at or before each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(rows(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def smoothed(df: DataFrame, by: Keys, order: Keys, column: str, k: int = 10, out: str = "smooth") -> DataFrame:
    """Mean of the k rows around each; an even k reaches one row further back than ahead."""
    return df.withColumn(out, F.avg(column).over(rows(by, order).rowsBetween(-(k // 2), k - k // 2 - 1)))


def trailing_std(df: DataFrame, by: Keys, order: Keys, column: str, k: int = 10, population: bool = False, out: str = "std") -> DataFrame:
    """Standard deviation of the last k rows, null until there are k."""
    w = rows(by, order).rowsBetween(-(k - 1), 0)
    f = F.stddev_pop if population else F.stddev_samp
    return df.withColumn(out, F.when(F.count(column).over(w) == k, f(column).over(w)))


def central_difference(df: DataFrame, by: Keys, order: Keys, column: str, at: str, reach: int, within: str, out: str = "rate") -> DataFrame:
    """Change per second over reach rows to both sides, null where they leave the segment."""
    w = rows(by, order)
    same = F.lead(within, reach).over(w) == F.lag(within, reach).over(w)
    seconds = (F.lead(at, reach).over(w) - F.lag(at, reach).over(w)) / F.lit(1e6)
    return df.withColumn(out, F.when(same & (seconds != 0), (F.lead(column, reach).over(w) - F.lag(column, reach).over(w)) / seconds))


def hops(df: DataFrame, by: Keys, order: Keys, width: int, stride: int, bad: Column) -> DataFrame:
    """End rows of windows of width rows, one each stride rows, with their bad rows counted."""
    w = rows(by, order)
    df = df.withColumn("row", (F.row_number().over(w) - 1).cast("long")).withColumn("n_bad", F.count_if(bad).over(w.rowsBetween(-(width - 1), 0)))
    return df.where((F.col("row") >= width - 1) & ((F.col("row") - (width - 1)) % stride == 0))


def islands(df: DataFrame, by: Keys, order: Keys, flag: Column) -> DataFrame:
    """Adds run: the number of the maximal run of equal flag that a row is in, from 0."""
    w = rows(by, order)
    df = df.withColumn("_flag", flag)
    start = ~F.col("_flag").eqNullSafe(F.lag("_flag").over(w)) | (F.row_number().over(w) == 1)
    df = df.withColumn("_start", start)
    return df.withColumn("run", F.sum(F.col("_start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumnRenamed("_flag", "flag").drop("_start")


def unwrapped(df: DataFrame, by: Keys, order: Keys, column: str, period: float, out: str) -> DataFrame:
    """A periodic value made continuous: each step is the one nearest to zero, half to even."""
    w = rows(by, order)
    step = F.col(column) - F.lag(column).over(w)
    df = df.withColumn("_turn", F.coalesce(-F.rint(step / period), F.lit(0.0)))
    return df.withColumn(out, F.col(column) + period * F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def day_unwrapped(df: DataFrame, by: Keys, order: Keys, tod_s: str, out: str) -> DataFrame:
    """Time of day in seconds with a day added after each fall of over 12 hours."""
    w = rows(by, order)
    df = df.withColumn("_wrap", F.coalesce((F.col(tod_s) - F.lag(tod_s).over(w) < -43200).cast("long"), F.lit(0)))
    return df.withColumn(out, F.col(tod_s) + 86400 * F.sum("_wrap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_wrap")


def gap_to_running_end(df: DataFrame, by: Keys, order: Keys, start: str, end: str, out: str = "gap") -> DataFrame:
    """Start of each interval less the greatest end before it."""
    return df.withColumn(out, F.col(start) - F.max(end).over(rows(by, order).rowsBetween(Window.unboundedPreceding, -1)))


def path_length(df: DataFrame, by: Keys, order: Keys, x: str, y: str, out: str = "travelled") -> DataFrame:
    """Length of the way from the session's first row."""
    w = rows(by, order)
    df = df.withColumn("_step", F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0)))
    return df.withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def resampled(df: DataFrame, by: Keys, at_us: str, channel: str, value: str, channels: Keys, period_us: int) -> DataFrame:
    """Mean of each channel in [k - 1, k) periods, one row a bin in which all channels have rows, stamped at its end."""
    end = (F.floor(F.col(at_us) / period_us) + 1) * period_us
    wide = df.groupBy(*by, end.cast("long").alias("bin_end_us")).agg(*(F.avg(F.when(F.col(channel) == c, F.col(value))).alias(c) for c in channels))
    return wide.where(" AND ".join(f"`{c}` IS NOT NULL" for c in channels))


def rates(df: DataFrame, by: Keys, at_us: str, window_us: int) -> DataFrame:
    """Rows in the trailing time window of each row."""
    w = Window.partitionBy(*by).orderBy(at_us).rangeBetween(-window_us, 0)
    return df.withColumn("n_window", F.count("*").over(w))


def top_k(df: DataFrame, by: Keys, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def deduplicated(df: DataFrame, columns: Keys, order: Keys) -> DataFrame:
    """The first row by order of each distinct set of columns; NaN equals NaN."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy(*order))).where("_n = 1").drop("_n")
