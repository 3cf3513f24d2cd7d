"""Outages of fixes: schedules, their checks, and what they do to fixes, with a log.

A schedule has a row an event: session_id, outage, kind, start, end (seconds). A
kind is full (nothing gets through), tunnel (as full, with worse fixes on the
ramps before and after, and an outlier first), intermittent (fixes get through
now and then), or degraded. All that is random is drawn from a hash of the seed
and the keys, so it is the same in any order and on any cluster.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geodesy as geo

#: Kinds, seconds of a ramp and after it for an outlier, its metres, the factor of a degraded fix, seconds off and on of an intermittent one.
KINDS = ("full", "intermittent", "degraded", "tunnel")
RAMP_S, AFTER_S, OUTLIER_M, DEGRADED, OFF_S, ON_S = 6.0, 30.0, 150.0, 3.0, (5.0, 15.0), (1.0, 4.0)
#: The battery: kinds and seconds in turn, and seconds of fixes between them (fixed values).
BATTERY = (("full", 10), ("full", 30), ("full", 60), ("full", 120), ("full", 300), ("tunnel", 45), ("intermittent", 120), ("degraded", 60))
BATTERY_GAP_S = 150.0

SCHEMA = "session_id long, outage int, kind string, start double, end double"


def periodic(sessions: DataFrame, every: float, lengths: tuple[float, ...], kind: str = "full") -> DataFrame:
    """Events for each session (session_id, first, last) every so many seconds from first on, lengths in turn, while the longest fits before last."""
    n = F.ceil((F.col("last") - F.col("first") - max(lengths)) / every)
    rows = sessions.where(n > 0).select("session_id", "first", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("outage"))
    start = F.col("first") + F.col("outage") * every
    length = F.element_at(F.array(*map(F.lit, map(float, lengths))), (F.col("outage") % len(lengths) + 1).cast("int"))
    return rows.select("session_id", "outage", F.lit(kind).alias("kind"), start.alias("start"), (start + length).alias("end"))


def battery_of(first: float, last: float, gap: float = BATTERY_GAP_S, profile=BATTERY) -> list[tuple[str, float, float]]:
    """Kinds, starts and ends of the battery between two times: the profile in turn; what no longer fits gives way to the shortest that does."""
    out, at = [], first
    while True:
        kind, length = profile[len(out) % len(profile)]
        if at + length + gap > last:
            fitting = [p for p in profile if at + p[1] + gap <= last]
            if not fitting:
                return out
            kind, length = min(fitting, key=lambda p: p[1])
        out.append((kind, at, at + length))
        at += length + gap


def battery(sessions: DataFrame, gap: float = BATTERY_GAP_S) -> DataFrame:
    """The battery's events for each session (session_id, first, last)."""

    def run(parts):
        for pdf in parts:
            rows = [(s, k, *e) for s, a, b in pdf.itertuples(index=False) for k, e in enumerate(battery_of(a, b, gap))]
            yield pd.DataFrame(rows, columns=["session_id", "outage", "kind", "start", "end"])

    return sessions.selectExpr("session_id", "CAST(first AS DOUBLE) AS first", "CAST(last AS DOUBLE) AS last").mapInPandas(run, SCHEMA)


def checked(schedule: DataFrame) -> DataFrame:
    """schedule, which raises on an unknown kind, an event that does not end after it starts, and events that overlap (ramps included)."""
    w = Window.partitionBy("session_id").orderBy("start", "outage")
    ramp = F.when(F.lag("kind").over(w) == "tunnel", RAMP_S).otherwise(0.0)
    wrong = F.when(~F.col("kind").isin(*KINDS), F.lit("unknown kind")).when(~(F.col("end") > F.col("start")), F.lit("end before start")).when(F.col("start") < F.lag("end").over(w) + ramp, F.lit("overlap"))
    out = schedule.withColumn("_wrong", wrong)
    message = F.concat(F.lit("outage "), F.col("outage").cast("string"), F.lit(" of session "), F.col("session_id").cast("string"), F.lit(": "), F.col("_wrong"))
    return out.withColumn("start", F.when(F.col("_wrong").isNotNull(), F.raise_error(message).cast("double")).otherwise(F.col("start"))).drop("_wrong")


def _uniform(*keys) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(*keys) -> Column:
    """A standard normal number from a hash of the keys."""
    return F.sqrt(-2 * F.ln(_uniform(F.lit("a"), *keys))) * F.cos(2 * math.pi * _uniform(F.lit("b"), *keys))


def _lets_through(session: Column, outage: Column, start: Column, t: Column, seed: int) -> Column:
    """Whether an intermittent outage is on at t: rounds of off and on seconds drawn for each round."""
    rounds = F.sequence(F.lit(0), F.lit(400))
    off = lambda k: OFF_S[0] + (OFF_S[1] - OFF_S[0]) * _uniform(F.lit("off"), F.lit(seed), session, outage, k)
    on = lambda k: ON_S[0] + (ON_S[1] - ON_S[0]) * _uniform(F.lit("on"), F.lit(seed), session, outage, k)
    zero = F.struct(start.alias("at"), F.lit(False).alias("in"))
    walk = lambda s, k: F.when(s["at"] > t, s).otherwise(F.struct((s["at"] + off(k) + on(k)).alias("at"), ((t >= s["at"] + off(k)) & (t < s["at"] + off(k) + on(k))).alias("in")))
    return F.aggregate(rounds, zero, walk, lambda s: s["in"])


def applied(fixes: DataFrame, schedule: DataFrame, seed: int = 0) -> DataFrame:
    """fixes (session_id, fix_id, t, lat, lon, h, accuracy, ...) under a schedule: places and accuracies as they come through.

    Adds outage (null: none), withheld, and what, the reason of the log. A fix is
    met by its event in an equi-join on cells of time; events do not overlap.
    """
    cell = 120.0
    reach = schedule.withColumn("_a", F.col("start") - F.when(F.col("kind") == "tunnel", RAMP_S).otherwise(0.0)).withColumn("_b", F.col("end") + F.when(F.col("kind") == "tunnel", RAMP_S + AFTER_S).otherwise(0.0))
    cut = reach.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_b") / cell)))).withColumnRenamed("session_id", "_session")
    f = fixes.withColumn("_c", F.floor(F.col("t") / cell))
    on = (f["session_id"] == cut["_session"]) & (f["_c"] == cut["_cell"]) & (f["t"] >= cut["_a"]) & (f["t"] < cut["_b"])
    met = f.join(cut, on, "left")
    # an event that covers the fix goes before the ramp of another
    first = F.row_number().over(Window.partitionBy("session_id", "fix_id").orderBy(F.when((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")), 0).otherwise(1), "start"))
    met = met.withColumn("_n", first).where("_n = 1")
    t, kind = F.col("t"), F.col("kind")
    covers = (t >= F.col("start")) & (t < F.col("end"))
    through = _lets_through(F.col("session_id"), F.col("outage"), F.col("start"), t, seed)
    exit_ = (kind == "tunnel") & (t >= F.col("end"))
    after = F.row_number().over(Window.partitionBy("session_id", "outage", exit_).orderBy("t", "fix_id"))
    outlier = exit_ & (after == 1)
    withheld = covers & (kind.isin("full", "tunnel") | ((kind == "intermittent") & ~through))
    factor = F.when(covers & ~withheld, DEGRADED).when((kind == "tunnel") & (t < F.col("start")), 1 + 3 * (t - (F.col("start") - RAMP_S)) / RAMP_S).when(exit_ & ~outlier & (t < F.col("end") + RAMP_S), 4 - 3 * (t - F.col("end")) / RAMP_S)
    met = met.withColumn("withheld", F.coalesce(withheld, F.lit(False))).withColumn("_factor", factor).withColumn("_outlier", F.coalesce(outlier, F.lit(False)))
    keys = (F.lit(seed), F.col("session_id"), F.col("fix_id"))
    turn = 2 * math.pi * _uniform(F.lit("turn"), *keys)
    sigma = F.col("accuracy") * (F.col("_factor") - 1)
    east = F.when(F.col("_outlier"), OUTLIER_M * F.cos(turn)).when(F.col("_factor").isNotNull(), sigma * normal(F.lit("e"), *keys)).otherwise(0.0)
    north = F.when(F.col("_outlier"), OUTLIER_M * F.sin(turn)).when(F.col("_factor").isNotNull(), sigma * normal(F.lit("n"), *keys)).otherwise(0.0)
    place = geo.moved(F.col("lat"), F.col("lon"), F.col("h"), east, north)
    what = F.when(F.col("withheld"), "withheld").when(F.col("_outlier"), "outlier").when(covers, "degraded").when(F.col("_factor").isNotNull() & (t < F.col("start")), "approach").when(F.col("_factor").isNotNull(), "exit")
    out = met.withColumn("_place", place)
    new = {"lat": F.col("_place.lat"), "lon": F.col("_place.lon"), "accuracy": F.col("accuracy") * F.coalesce("_factor", F.lit(1.0))}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in fixes.columns), F.when(what.isNotNull(), F.col("outage")).alias("outage"), "withheld", what.alias("what"))


def log(after: DataFrame) -> DataFrame:
    """The fixes that an outage touched, and how."""
    return after.where("what IS NOT NULL").select("session_id", "fix_id", "t", "outage", "what", "accuracy")
