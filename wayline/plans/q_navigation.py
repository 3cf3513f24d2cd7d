"""Navigation: the filter's terms and updates against their formulas, and sessions of a synthetic fleet against their truth.

Customers are places with a speed, a force and a fix beside them. What a query
returns comes from the filter itself, run in Arrow batches; the oracle is the
formula for a level attitude and a diagonal covariance, or the property that the
docstring states.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geodesy as geo
from wayline.plans.catalog import query
from wayline.plans.q_scalars import _E2, _M, _N, _P
from wayline.plans.tables import events, table
from wayline.sources import synthetic
from wayline.streaming import earth
from wayline.streaming.inertial import ACC, GATES, Filter, Fix, Noise, Sample, State, blended_force, carried, error_between
from wayline.streaming.navigator import Options, navigate
from wayline.streaming.recovery import Held, agree, inflated

#: Speeds, forces and offsets of a fix from the key; the same in both languages.
_FORMULAS = {"ve": "(c_custkey * 13 % 400) / 10.0 - 20", "vn": "(c_custkey * 29 % 400) / 10.0 - 20", "fx": "(c_custkey * 7 % 50) / 10.0 - 2.5", "fy": "(c_custkey * 11 % 50) / 10.0 - 2.5", "de": "(c_custkey * 17 % 300) / 10.0 - 15", "dn": "(c_custkey * 23 % 300) / 10.0 - 15", "acc": "3.0 + c_custkey % 7"}
_C = f"{_P.replace('c_acctbal AS h', 'CAST(c_acctbal AS DOUBLE) AS h, ' + ', '.join(f'CAST({f} AS DOUBLE) AS {n}' for n, f in _FORMULAS.items()))}"
_G = f"({geo.GRAVITY_EQUATOR!r} * (1 + {geo.GRAVITY_K!r} * sin(lat)*sin(lat)) / sqrt(1 - {_E2!r} * sin(lat)*sin(lat)) - {geo.FREE_AIR!r} * h)"
_INPUT = ["c_custkey", "lat", "lon", "h", *_FORMULAS]
_STATE = Noise(accel_bias=0.05, gyro_bias=0.002)


def _cases(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.radians((key * 37 % 1600) / 10.0 - 80).alias("lat"), F.radians((key * 91 % 3580) / 10.0 - 179).alias("lon"), F.col("c_acctbal").cast("double").alias("h"))
    return c.selectExpr("*", *(f"CAST({f} AS DOUBLE) AS {n}" for n, f in _FORMULAS.items()))


def _state(r: dict) -> State:
    return State(0.0, np.array([r["lon"], r["lat"], r["h"]]), np.array([r["ve"], r["vn"], 0.0]), np.eye(3))


def _filter(r: dict) -> Filter:
    s = _state(r)
    return Filter.start(0.0, s.place, s.velocity, s.attitude, _STATE, 5.0, 0.3)


def _fix(r: dict, **more) -> Fix:
    return Fix(0.0, 0.0, earth.moved(np.array([r["lon"], r["lat"], r["h"]]), np.array([r["de"], r["dn"], 0.0])), r["acc"], **more)


def _through(spark, d, make: Callable[[dict], tuple], schema: str) -> DataFrame:
    """The key and make's values for each case."""
    names = [c.split(" ")[0] for c in ("c_custkey long, " + schema).split(", ")]

    def run(batches):
        for b in batches:
            rows = [(r["c_custkey"], *make(r)) for r in b.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) if any(v is not None for v in x) else pa.array(x, pa.float64()) for x in zip(*rows)], names=names)

    return _cases(spark, d).select(*_INPUT).mapInArrow(run, "c_custkey long, " + schema)


#: Cases that are carried at once; with more of them a case costs no less time.
_BLOCK = 1024


def _together(spark, d, columns: list[str], make: Callable[[dict], tuple], schema: str) -> DataFrame:
    """As _through, with blocks of cases for make: arrays by name in, arrays out. Rows are spread first, since a small file is one task."""
    names = [c.split(" ")[0] for c in ("c_custkey long, " + schema).split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                part = b.slice(at, _BLOCK)
                made = make({c: part[c].to_numpy(zero_copy_only=False) for c in columns})
                yield pa.RecordBatch.from_arrays([part["c_custkey"], *map(pa.array, made)], names=names)

    return _cases(spark, d).select("c_custkey", *columns).repartition("c_custkey").mapInArrow(run, "c_custkey long, " + schema)


@query("level_terms", f"WITH {_C} SELECT c_custkey, round(-fx, 6) AS east, round(-fy, 6) AS north, round(-(9.81 - {_G}), 6) AS up, round(9.81e0, 6) AS tilt_x FROM p")
def level_terms(spark, d):
    """Innovation of levelling: what specific force leaves beside gravity."""

    def make(r):
        nu, h = _filter(r).level_terms(np.array([r["fx"], r["fy"], 9.81]))
        return (*(round(float(x), 6) for x in nu), round(float(h[0, 7]), 6))

    return _through(spark, d, make, "east double, north double, up double, tilt_x double")


_S = "sqrt(ve*ve + vn*vn)"


@query("speed_terms", f"WITH {_C} SELECT c_custkey, CASE WHEN {_S} >= 1 THEN round(10 - {_S}, 6) END AS innovation, CASE WHEN {_S} >= 1 THEN round(ve / {_S}, 6) END AS h_east, CASE WHEN {_S} >= 1 THEN round(vn / {_S}, 6) END AS h_north FROM p")
def speed_terms(spark, d):
    """A predicted speed of 10 m/s against the state's; null below 1 m/s."""

    def make(r):
        terms = _filter(r).speed_terms(10.0)
        return (None, None, None) if terms is None else (round(float(terms[0][0]), 6), round(float(terms[1][0, 3]), 6), round(float(terms[1][0, 4]), 6))

    return _through(spark, d, make, "innovation double, h_east double, h_north double")


@query("force_blend", f"WITH {_C}, q AS (SELECT *, {_S} AS s, (fx*ve + fy*vn) / nullif({_S}, 0) AS own FROM p) SELECT c_custkey, s >= 3 AS applied, round(CASE WHEN s >= 3 THEN fx + ((own/1.0816 + 0.5/0.25) / (1/1.0816 + 1/0.25) - own) * ve / s ELSE fx END, 6) AS fx, round(CASE WHEN s >= 3 THEN fy + ((own/1.0816 + 0.5/0.25) / (1/1.0816 + 1/0.25) - own) * vn / s ELSE fy END, 6) AS fy FROM q")
def force_blend(spark, d):
    """Along-track acceleration mixed with a predicted 0.5 m/s2, variances 1.0816 and 0.25."""

    def make(r):
        force, done = blended_force(_state(r), np.array([r["fx"], r["fy"], 9.81]), 0.5, 0.25, 1.0816)
        return done, round(float(force[0]), 6), round(float(force[1]), 6)

    return _through(spark, d, make, "applied boolean, fx double, fy double")


@query("state_error", f"WITH {_C} SELECT c_custkey, round(2e-6 * ({_N} + h) * cos(lat), 6) AS east, round(1e-6 * ({_M} + h), 6) AS north, round(3e0, 6) AS up, round(-ve, 6) AS v_east, round(0.25e0, 6) AS yaw FROM p")
def state_error(spark, d):
    """True less estimated: a place, a velocity and a heading beside the estimate."""

    def make(r):
        s = _state(r)
        truth = State(0.0, s.place + np.array([2e-6, 1e-6, 3.0]), np.array([0.0, r["vn"], 0.0]), earth.turn(0.25))
        e = error_between(truth, s)
        return tuple(round(float(x), 6) + 0.0 for x in (e[0], e[1], e[2], e[3], e[8]))

    return _through(spark, d, make, "east double, north double, up double, v_east double, yaw double")


@query("fix_terms", f"WITH {_C} SELECT c_custkey, round(de, 4) AS east, round(dn, 4) AS north, CASE WHEN {_S} >= 2 THEN 5 ELSE 3 END::BIGINT AS n, round(CASE WHEN {_S} >= 2 THEN {_S} * sin(1e0) - ve END, 6) AS v_east, round(acc * acc * 6.25, 4) AS var_up FROM p")
def fix_terms(spark, d):
    """Innovation of a fix, with its velocity from 2 m/s on (course of one radian)."""

    def make(r):
        nu, _, noise = _filter(r).fix_terms(_fix(r, speed=math.hypot(r["ve"], r["vn"]), course=1.0))
        return round(float(nu[0]), 4) + 0.0, round(float(nu[1]), 4) + 0.0, len(nu), round(float(nu[3]), 6) if len(nu) > 3 else None, round(float(noise[2, 2]), 4)

    return _through(spark, d, make, "east double, north double, n long, v_east double, var_up double")


_NIS = "((de*de + dn*dn) / (25 + acc*acc))"


@query("gated_update", f"WITH {_C} SELECT c_custkey, {_NIS} <= {GATES[2]} AS accepted, round({_NIS}, 4) AS nis, round(CASE WHEN {_NIS} <= {GATES[2]} THEN de * 25 / (25 + acc*acc) ELSE 0 END, 4) AS moved_east, round(CASE WHEN {_NIS} <= {GATES[2]} THEN 25 * acc*acc / (25 + acc*acc) ELSE 25 END, 6) AS var_east FROM p")
def gated_update(spark, d):
    """A fix through its gate: normalised innovation squared, gain, and the covariance after Joseph's form."""

    def make(r):
        f = _filter(r)
        ok, nis = f.fix(_fix(r))
        step = earth.apart(f.state.place, np.array([r["lon"], r["lat"], r["h"]]))
        return ok, round(nis, 4), round(float(step[0]), 4) + 0.0, round(float(f.covariance[0, 0]), 6)

    return _through(spark, d, make, "accepted boolean, nis double, moved_east double, var_east double")


@query("zero_velocity", f"WITH {_C}, q AS (SELECT *, (ve*ve + vn*vn) / 0.2525 AS nis FROM p) SELECT c_custkey, nis <= {GATES[2]} AS accepted, round(CASE WHEN nis <= {GATES[2]} THEN ve * 0.0025 / 0.2525 ELSE ve END, 6) AS v_east, round(CASE WHEN nis <= {GATES[2]} THEN 0.25 * 0.0025 / 0.2525 ELSE 0.25 END, 9) AS var_v FROM q")
def zero_velocity(spark, d):
    """No velocity, known to 5 cm/s, against a state that knows its own to 50."""

    def make(r):
        f = _filter(r)
        ok, _ = f.still()
        return ok, round(float(f.state.velocity[0]), 6) + 0.0, round(float(f.covariance[3, 3]), 9)

    return _through(spark, d, make, "accepted boolean, v_east double, var_v double")


@query("straight_reasons", f"WITH {_C} SELECT c_custkey, CASE WHEN {_S} < 2 THEN 'low_speed' WHEN abs(fx) > 2 THEN 'hard_cornering' ELSE 'accepted' END AS reason FROM p")
def straight_reasons(spark, d):
    """The constraint on up and down alone, and why it is left out; a level state never moves up."""

    def make(r):
        return (_filter(r).straight(np.eye(3), False, r["fx"], most_accel=2.0),)

    return _through(spark, d, make, "reason string")


@query("anew_from_fix", f"WITH {_C} SELECT c_custkey, round(de, 4) AS east, round(dn, 4) AS north, round({_S} * cos(1e0), 6) AS v_north, round(acc * acc, 6) AS var_east, 0.25e0 AS var_yaw, 0.25e0 AS var_v FROM p")
def anew_from_fix(spark, d):
    """Position and velocity of a fix; heading keeps its value, four times its variance, half a radian at most."""

    def make(r):
        f = _filter(r)
        f.start_anew(_fix(r, speed=math.hypot(r["ve"], r["vn"]), course=1.0))
        step = earth.apart(f.state.place, np.array([r["lon"], r["lat"], r["h"]]))
        p = f.covariance
        return tuple(round(float(x), k) + 0.0 for x, k in ((step[0], 4), (step[1], 4), (f.state.velocity[1], 6), (p[0, 0], 6), (p[8, 8], 6), (p[3, 3], 6)))

    return _through(spark, d, make, "east double, north double, v_north double, var_east double, var_yaw double, var_v double")


@query("fixes_agree", f"WITH {_C}, q AS (SELECT *, sqrt(pow(de - 10*ve, 2) + pow(dn - 10*vn, 2)) AS off, 10 * {_S} AS way, CASE WHEN c_custkey % 5 = 0 THEN 15 ELSE 10 END AS dt FROM p) SELECT c_custkey, dt <= 14 AND off <= 3 * sqrt(9 + acc*acc + pow(0.05 * way + 3, 2) + 0.5 * dt * dt + way * way * 0.01) AS same FROM q")
def fixes_agree(spark, d):
    """Two fixes against dead reckoning between them: displacement vectors, with accuracy, drift, speed and heading."""

    def make(r):
        place = np.array([r["lon"], r["lat"], r["h"]])
        t = 15.0 if r["c_custkey"] % 5 == 0 else 10.0
        a = Held(Fix(0.0, 0.0, place, 3.0), place, 0.5, 0.01)
        there = earth.moved(place, 10 * np.array([r["ve"], r["vn"], 0.0]))
        fix = _fix(r)
        return (agree(a, Held(Fix(t, t, fix.place, fix.accuracy), there, 0.5, 0.01)),)

    return _through(spark, d, make, "same boolean")


_F0 = f"least(100, 1.05 * (400*de*de + 400*dn*dn) / (25 + acc*acc) / {GATES[2]})"


@query("inflation", f"WITH {_C}, q AS (SELECT *, (400*de*de + 400*dn*dn) / (25 + acc*acc) AS nis, {_F0} AS f0 FROM p), k AS (SELECT q.*, least(100, f0 * pow(2, i)) AS f, i FROM q, range(0, 9) t(i)), g AS (SELECT *, (400*de*de + 400*dn*dn) / (25 * f + acc*acc) <= {GATES[2]} AS passes FROM k) SELECT c_custkey, round(min(CASE WHEN passes THEN f END) * 25, 4) AS var_east FROM g WHERE nis > {GATES[2]} GROUP BY c_custkey")
def inflation(spark, d):
    """The least growth of position variance that lets a far fix in, doubled from a first guess; null beyond a hundredfold."""

    def make(r):
        f = _filter(r)
        far = Fix(0.0, 0.0, earth.moved(f.state.place, 20 * np.array([r["de"], r["dn"], 0.0])), r["acc"])
        nu, h, noise = f.fix_terms(far)
        nis = f.nis(nu, h, noise)
        if nis <= GATES[2]:
            return (False, None)
        p = inflated(f, nu, h, noise, min(100.0, 1.05 * nis / GATES[2]), GATES[2])
        return (True, None if p is None else round(float(p[0, 0]), 4))

    return _through(spark, d, make, "asked boolean, var_east double").where("asked").drop("asked")


@query("rest_stays", f"WITH {_C} SELECT c_custkey, true AS stays, true AS falls FROM p")
def rest_stays(spark, d):
    """Ten seconds at rest on the turning earth, with the rates and force that rest has there, move nothing by a millimetre; without force it falls half g t squared."""

    def make(r):
        lat, place = r["lat"], earth.vector(r["lon"], r["lat"], r["h"])
        gravity, rate = earth.gravity(lat, r["h"]), earth.earth_rate(lat)
        s = free = State(0.0, place, np.zeros(3), np.eye(3))
        for _ in range(5):
            s = carried(s, -gravity, rate, 2.0)
            free = carried(free, np.zeros(3), rate, 2.0)
        moved = np.abs(earth.apart(s.place, place)).max(-1)
        fall = free.place[:, 2] - place[:, 2]
        return moved < 1e-3, np.abs(fall / (50 * gravity[:, 2]) - 1) < 1e-3

    return _together(spark, d, ["lat", "lon", "h"], make, "stays boolean, falls boolean")


@query("unmeasured_axes", f"WITH {_C} SELECT c_custkey, true AS apart, true AS level FROM p")
def unmeasured_axes(spark, d):
    """Axes without a gyro turn with the local level, and their bias stays at its prior, apart from all other errors."""

    def make(r):
        f = Filter.start(0.0, earth.vector(r["lon"], r["lat"], r["h"]), earth.vector(r["ve"], r["vn"], 0.0), np.eye(3), _STATE, 5.0, 0.3)
        for _ in range(5):
            f.propagate(Sample(0.0, -earth.gravity(r["lat"], r["h"]), np.array([9.0, 9.0, 0.0]), (False, False, True)), 0.1)
        bias = f.covariance[:, 12]
        apart = (np.delete(bias, 12, axis=1) == 0).all(1) & np.isclose(bias[:, 12], _STATE.gyro_bias**2, rtol=1e-9, atol=0)
        return apart & (ACC.start == 9), f.state.attitude[:, 2, 2] > 1 - 1e-9

    return _together(spark, d, ["lat", "lon", "h", "ve", "vn"], make, "apart boolean, level boolean")


# ------------------------------------------------------------------ sessions of a synthetic fleet

#: Drives, their seconds.
_DRIVES, _SECONDS = 2, 130


@query("navigated_fleet", f"SELECT i AS session_id, 'NAVIGATING' AS mode, true AS near, true AS sure, true AS heading, 0::BIGINT AS resets FROM range(0, {_DRIVES}) t(i)")
def navigated_fleet(spark, d):
    """Engines over drives without a known heading: at the end each is within 10 m of the truth, within four of its sigmas, and heads where it drives."""
    df = synthetic.fleet(spark, _DRIVES, seconds=_SECONDS).repartition(_DRIVES, "session_id")
    out = navigate(df, "session_id")
    last = out.groupBy("session_id").agg(F.max_by(F.struct("mode", "lat", "lon", "sigma", "v_east", "v_north", "resets", "t"), "t").alias("o")).select("session_id", "o.*")
    joined = last.join(df.select("session_id", "t", "true_lat", "true_lon", "true_yaw"), ["session_id", "t"])
    near = geo.local_delta(F.col("lat"), F.col("lon"), F.col("true_lat"), F.col("true_lon"), F.lit(100.0))
    off = F.hypot(near.e, near.n)
    turn = F.cos(F.atan2("v_north", "v_east") - F.col("true_yaw"))
    return joined.select("session_id", "mode", (off < 10).alias("near"), (off < 4 * F.col("sigma")).alias("sure"), (turn > 0.99).alias("heading"), "resets")


@query("arms_of_fleet", f"SELECT i AS session_id, a AS arm, true AS complete, a = 'plain' AS straight_off FROM range(0, 2) t(i), (VALUES ('all'), ('plain')) v(a)")
def arms_of_fleet(spark, d):
    """The same drives through two arms of options: both give an output for each sample from the start on."""
    arms = {"all": Options(straight_needs_speed=False, speed=False), "plain": Options(straight=False, speed=False, states=False, recovery=False)}
    df = synthetic.fleet(spark, 2, seconds=20)
    out = navigate(df, "session_id", arms=arms)
    g = out.groupBy("session_id", "arm").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.max("gnss_state").alias("s"))
    return g.select("session_id", "arm", (F.col("n") == F.round((F.col("b") - F.col("a")) * synthetic.RATE) + 1).alias("complete"), (F.col("arm") == "plain").alias("straight_off"))


# ------------------------------------------------------------------ columns of the engine's life

_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_O = "(PARTITION BY user_id ORDER BY t_us, event_id{})"


@query("plane_integral", f"WITH {_E}, s AS (SELECT *, (value + lag(value) OVER w) / 2 * (t_us - lag(t_us) OVER w) / 1e9 AS step FROM e WINDOW w AS {_O.format('')}) SELECT event_id, round(coalesce(sum(step) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')}, 0), 4) AS x FROM s")
def plane_integral(spark, d):
    """Trapezoidal integral of a velocity in a fixed plane."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    step = (F.col("value") + F.lag("value").over(w)) / 2 * (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(1e9)
    x = F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return events(spark, d).withColumn("step", step).select("event_id", F.round(x, 4).alias("x"))


@query("tilt_so_far", f"WITH {_E}, m AS (SELECT event_id, row_number() OVER {_O.format('')} AS n, avg(value) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')} AS a, avg(k) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')} AS g FROM e) SELECT event_id, CASE WHEN n >= 50 THEN 'accelerometer' ELSE 'gravity' END AS source, round(acos(98.1 / sqrt(pow(CASE WHEN n >= 50 THEN a ELSE g END, 2) + 98.1 * 98.1)), 6) AS tilt FROM m")
def tilt_so_far(spark, d):
    """Tilt from the mean direction seen so far: fifty rows of the accelerometer (value, 0, 98.1), before that gravity (k, 0, 98.1)."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.row_number().over(w) >= 50
    x = F.when(own, F.avg("value").over(so_far)).otherwise(F.avg("k").over(so_far))
    source = F.when(own, "accelerometer").otherwise("gravity")
    return events(spark, d).select("event_id", source.alias("source"), F.round(F.acos(98.1 / F.sqrt(x * x + 98.1 * 98.1)), 6).alias("tilt"))


@query("latest_outcome", f"WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER {_O.format('')} AS n, lag(k) OVER {_O.format('')} AS pk, lag(CAST(floor(value) AS BIGINT)) OVER {_O.format('')} AS pv, CAST(floor(value) AS BIGINT) AS v FROM e), g AS (SELECT event_id, user_id, t_us, CASE WHEN k >= coalesce(pk, 0) THEN k - coalesce(pk, 0) ELSE k END AS da, CASE WHEN v >= coalesce(pv, 0) THEN v - coalesce(pv, 0) ELSE v END AS db FROM o), h AS (SELECT *, CASE WHEN da > 0 AND da >= db THEN 'accepted' WHEN db > 0 THEN 'gated' END AS what FROM g) SELECT event_id, coalesce(last_value(what IGNORE NULLS) OVER {_O.format(' ROWS UNBOUNDED PRECEDING')}, 'waiting') AS phase FROM h")
def latest_outcome(spark, d):
    """Which of two cumulative counters grew most since the row before; one that shrank counts from nought; without growth the last outcome stays."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = events(spark, d).withColumn("v", F.floor("value"))
    grown = lambda c: F.col(c) - F.when(F.col(c) >= F.coalesce(F.lag(c).over(w), F.lit(0)), F.coalesce(F.lag(c).over(w), F.lit(0))).otherwise(0)
    e = e.withColumn("da", grown("k")).withColumn("db", grown("v"))
    what = F.when((F.col("da") > 0) & (F.col("da") >= F.col("db")), "accepted").when(F.col("db") > 0, "gated")
    e = e.withColumn("what", what)
    return e.select("event_id", F.coalesce(F.last("what", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("waiting")).alias("phase"))


@query("align_progress", f"WITH {_E}, s AS (SELECT *, min(t_us) OVER (PARTITION BY user_id) AS a FROM e) SELECT event_id, CASE event_type WHEN 'purchase' THEN 'LOCKED' WHEN 'click' THEN 'ALIGNING' WHEN 'view' THEN 'WAITING_FOR_GNSS' ELSE 'UNAVAILABLE' END AS phase, CASE event_type WHEN 'purchase' THEN 100 WHEN 'click' THEN least(99, CAST(floor(least(1, greatest(0, (t_us - a) / 1728e9)) * 100) AS BIGINT)) ELSE 0 END AS percent FROM s")
def align_progress(spark, d):
    """Progress of an alignment of twenty days: 0 to 99, and 100 only once the engine navigates."""
    a = F.min("t_us").over(Window.partitionBy("user_id"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t_us") - a) / F.lit(1728e9)))
    mode = F.col("event_type")
    phase = F.when(mode == "purchase", "LOCKED").when(mode == "click", "ALIGNING").when(mode == "view", "WAITING_FOR_GNSS").otherwise("UNAVAILABLE")
    percent = F.when(mode == "purchase", 100).when(mode == "click", F.least(F.lit(99), F.floor(part * 100))).otherwise(0)
    return events(spark, d).select("event_id", phase.alias("phase"), percent.cast("long").alias("percent"))


@query("gnss_only", f"WITH {_E}, f AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN t_us END IGNORE NULLS) OVER w AS fix_us, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS fix FROM e WINDOW w AS {_O.format(' ROWS UNBOUNDED PRECEDING')}) SELECT event_id, fix_us IS NULL OR t_us - fix_us > 90000000000 AS lost, CASE WHEN t_us - fix_us <= 90000000000 THEN fix END AS position FROM f")
def gnss_only(spark, d):
    """Without dead reckoning: the last fix (click), and no position at all once it is lost, 25 hours old."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    fix = F.last(F.when(F.col("event_type") == "click", F.struct("t_us", "value")), ignorenulls=True).over(w)
    e = events(spark, d).withColumn("fix", fix)
    lost = F.col("fix").isNull() | (F.col("t_us") - F.col("fix.t_us") > 90_000_000_000)
    return e.select("event_id", lost.alias("lost"), F.when(~lost, F.col("fix.value")).alias("position"))


@query("course_sigma", "WITH c AS (SELECT c_custkey, CAST((c_custkey * 13 % 400) / 10.0 - 20 AS DOUBLE) AS ve, CAST((c_custkey * 29 % 400) / 10.0 - 20 AS DOUBLE) AS vn FROM customer), s AS (SELECT *, ve*ve + vn*vn AS s2 FROM c) SELECT c_custkey, round(CASE WHEN s2 < 1e-6 THEN 0 ELSE atan2(vn, ve) END, 6) AS course, round(CASE WHEN s2 < 1e-6 THEN pi() ELSE sqrt((vn*vn*0.5 - 2*vn*ve*0.1 + ve*ve*0.3)) / s2 END, 6) AS sigma, round(sqrt(s2), 6) AS speed FROM s")
def course_sigma(spark, d):
    """Direction of travel, its sigma to first order from the velocity's covariance, and speed; too slow: 0, pi."""
    c = _cases(spark, d)
    out = geo.course_and_sigma(F.col("ve"), F.col("vn"), F.lit(0.5), F.lit(0.1), F.lit(0.3))
    return c.select("c_custkey", out.alias("o")).select("c_custkey", *(F.round(f"o.{n}", 6).alias(n) for n in ("course", "sigma", "speed")))


@query("times_of_fixes", f"WITH {_E} SELECT event_id, round((t_us * 1000 - min(t_us) OVER (PARTITION BY user_id) * 1000) / 1e9, 6) AS t_s, round(k * 3600e0, 6) AS latency_s FROM e")
def times_of_fixes(spark, d):
    """Nanoseconds to seconds of the session, and how long a fix was on its way."""
    ns = F.col("t_us") * 1000
    start = F.min("t_us").over(Window.partitionBy("user_id")) * 1000
    received = F.col("t_us") / F.lit(1e6)
    return events(spark, d).select("event_id", F.round((ns - start) / F.lit(1e9), 6).alias("t_s"), F.round(received - (F.col("t_us") - F.col("k") * 3_600_000_000) / F.lit(1e6), 6).alias("latency_s"))


@query("axis_map", "WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT vec_id, round(y, 6) AS bx, round(-x, 6) AS by_, round(z, 6) AS bz, CAST(NULL AS DOUBLE) AS gx, round(-z, 6) AS gz FROM v")
def axis_map(spark, d):
    """Raw columns to the body's axes by signed places; a gyro axis that is not there is null."""
    from wayline.functions import quaternion as q

    e = table(spark, d, "embeddings").select("vec_id", q.vec(*(F.col("embedding")[i].cast("double") for i in range(3))).alias("v"))
    accel, gyro = q.mapped(F.col("v"), (2, -1, 3)), q.mapped(F.col("v"), (None, 1, -3))
    return e.select("vec_id", accel.alias("a"), gyro.alias("g")).select("vec_id", F.round("a.x", 6).alias("bx"), F.round("a.y", 6).alias("by_"), F.round("a.z", 6).alias("bz"), F.col("g.x").alias("gx"), F.round("g.z", 6).alias("gz"))
