"""Scalar functions over table columns: embeddings give quaternions and vectors, keys give places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import features
from wayline.functions import geodesy as geo
from wayline.functions import quaternion as q
from wayline.functions import text
from wayline.plans.catalog import query
from wayline.plans.tables import events, table

_Q = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings),
n AS (SELECT vec_id, m, sqrt(m[1]*m[1]+m[2]*m[2]+m[3]*m[3]+m[4]*m[4]) AS na, sqrt(m[5]*m[5]+m[6]*m[6]+m[7]*m[7]+m[8]*m[8]) AS nb FROM v),
u AS (SELECT vec_id, na, m[1]/na AS aw, m[2]/na AS ax, m[3]/na AS ay, m[4]/na AS az, m[5]/nb AS bw, m[6]/nb AS bx, m[7]/nb AS by_, m[8]/nb AS bz, m[9] AS vx, m[10] AS vy, m[11] AS vz FROM n)"""


def _vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = lambda i: F.col("embedding")[i].cast("double")
    raw = e.select("vec_id", q.quat(c(0), c(1), c(2), c(3)).alias("r"), q.quat(c(4), c(5), c(6), c(7)).alias("s"), q.vec(c(8), c(9), c(10)).alias("v"))
    return raw.select("vec_id", "r", "v", q.normalized(F.col("r")).alias("a"), q.normalized(F.col("s")).alias("b"))


def _flat(c: Column, names: str, digits: int = 6, prefix: str = "") -> list[Column]:
    return [F.round(c[n], digits).alias(f"{prefix}{n}") for n in names]


def _r(**exprs: str) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in exprs.items())


def _quat_query(name: str, select: str, f, names: str = "wxyz") -> None:
    @query(name, f"WITH {_Q} SELECT vec_id, {select} FROM u")
    def run(spark, d, f=f, names=names):
        df = _vectors(spark, d).select("vec_id", f(F.col("a"), F.col("b"), F.col("v")).alias("o"))
        return df.select("vec_id", *_flat(F.col("o"), names))


_PRODUCT = dict(w="aw*bw - ax*bx - ay*by_ - az*bz", x="aw*bx + ax*bw + ay*bz - az*by_", y="aw*by_ - ax*bz + ay*bw + az*bx", z="aw*bz + ax*by_ - ay*bx + az*bw")
_ROT = dict(x="(1-2*(ay*ay+az*az))*vx + 2*(ax*ay-aw*az)*vy + 2*(ax*az+aw*ay)*vz", y="2*(ax*ay+aw*az)*vx + (1-2*(ax*ax+az*az))*vy + 2*(ay*az-aw*ax)*vz", z="2*(ax*az-aw*ay)*vx + 2*(ay*az+aw*ax)*vy + (1-2*(ax*ax+ay*ay))*vz")
_VN = "sqrt(vx*vx+vy*vy+vz*vz)"
_quat_query("quat_normalize", _r(w="aw", x="ax", y="ay", z="az"), lambda a, b, v: a)
_quat_query("quat_canonical", _r(**{n: f"CASE WHEN aw < 0 THEN -a{n} ELSE a{n} END" for n in "wxyz"}), lambda a, b, v: q.canonical(a))
_quat_query("quat_inverse", _r(w="aw", x="-ax", y="-ay", z="-az"), lambda a, b, v: q.inverse(a))
_quat_query("quat_product", _r(**_PRODUCT), lambda a, b, v: q.product(a, b))
_quat_query("quat_rotate", _r(**_ROT), lambda a, b, v: q.rotated(a, v), "xyz")
_quat_query("quat_exp", _r(w=f"cos({_VN}/2)", **{n: f"v{n}*sin({_VN}/2)/{_VN}" for n in "xyz"}), lambda a, b, v: q.exponential(v))
_S = "sqrt(ax*ax+ay*ay+az*az)"
_quat_query("quat_log", _r(**{n: f"2*atan2({_S}, abs(aw))*sign(aw)*a{n}/{_S}" for n in "xyz"}), lambda a, b, v: q.logarithm(a), "xyz")
_quat_query("quat_axis_angle", _r(w="cos(0.35)", **{n: f"sin(0.35)*v{n}/{_VN}" for n in "xyz"}), lambda a, b, v: q.from_axis_angle(v, F.lit(0.7)))
_E = dict(aw="aw", ax="ax", ay="ay", az="az", bw=f"cos({_VN}*0.005)", bx=f"vx*sin({_VN}*0.005)/{_VN}", by_=f"vy*sin({_VN}*0.005)/{_VN}", bz=f"vz*sin({_VN}*0.005)/{_VN}")
_quat_query("quat_integrate", f"{_r(**_PRODUCT)} FROM (SELECT vec_id, {', '.join(f'{e} AS {n}' for n, e in _E.items())} FROM u) --", lambda a, b, v: q.integrated(a, v, F.lit(0.01)))
_D = "(aw*bw+ax*bx+ay*by_+az*bz)"
_TH = f"acos(least(abs({_D}), 1))"
_quat_query("quat_slerp", _r(**{n: f"(sin(0.7*{_TH})*a{n} + sin(0.3*{_TH})*sign({_D})*b{m})/sin({_TH})" for n, m in zip("wxyz", ("w", "x", "y_", "z"))}), lambda a, b, v: q.slerp(a, b, F.lit(0.3)))
_quat_query("quat_euler", _r(yaw="atan2(2*(aw*az+ax*ay), 1-2*(ay*ay+az*az))", pitch="asin(2*(aw*ay-az*ax))", roll="atan2(2*(aw*ax+ay*az), 1-2*(ax*ax+ay*ay))"), lambda a, b, v: q.to_euler(a), ("yaw", "pitch", "roll"))
_quat_query("quat_euler_roundtrip", _r(**{n: f"CASE WHEN aw < 0 THEN -a{n} ELSE a{n} END" for n in "wxyz"}), lambda a, b, v: q.canonical(q.from_euler(q.to_euler(a).yaw, q.to_euler(a).pitch, q.to_euler(a).roll)))
_quat_query("quat_matrix_roundtrip", _r(**{n: f"CASE WHEN aw < 0 THEN -a{n} ELSE a{n} END" for n in "wxyz"}), lambda a, b, v: q.canonical(q.from_matrix(q.matrix(a))))
_quat_query("levelled_up", _r(x="CAST(0 AS DOUBLE)", y="CAST(0 AS DOUBLE)", z=_VN), lambda a, b, v: q.rotated(q.levelling(v), v), "xyz")
_quat_query("skew_roundtrip", _r(x="vx", y="vy", z="vz"), lambda a, b, v: q.unskew(q.skew(v)), "xyz")


@query("quat_checks", f"WITH {_Q} SELECT vec_id, round(na, 6) AS norm, round(2*{_TH}, 6) AS angle, round(acos(greatest(-1, least(1, (4*aw*aw - 1 - 1)/2))), 6) AS matrix_angle, true AS is_unit, true AS is_rotation FROM u")
def quat_checks(spark, d):
    a, b = F.col("a"), F.col("b")
    return _vectors(spark, d).select("vec_id", F.round(q.norm(F.col("r")), 6).alias("norm"), F.round(q.angle_between(a, b), 6).alias("angle"), F.round(q.rotation_angle(q.matrix(a)), 6).alias("matrix_angle"), q.is_unit(a).alias("is_unit"), q.is_rotation(q.matrix(a)).alias("is_rotation"))


@query("rot_compose", f"WITH {_Q} SELECT vec_id, {_r(x='cos(vx)*cos(vy)', y='sin(vx)*cos(vy)', z='-sin(vy)')} FROM u")
def rot_compose(spark, d):
    """Where the Euler rotation takes the forward axis."""
    v = F.col("v")
    o = q.mat_vec(q.from_euler_matrix(v.x, v.y, v.z), q.vec(1, 0, 0))
    return _vectors(spark, d).select("vec_id", o.alias("o")).select("vec_id", *_flat(F.col("o"), "xyz"))


@query("wrap_angles", f"WITH e AS (SELECT event_id, (value - 50) / 7.0 AS a FROM events) SELECT event_id, round(a - {2 * math.pi} * floor((a + {math.pi}) / {2 * math.pi}), 6) AS low, round(atan2(sin(a), cos(a)), 6) AS wrapped, round(({math.pi / 2} - a) - {2 * math.pi} * floor(({math.pi / 2} - a) / {2 * math.pi}), 6) AS heading, round(degrees(a) - 360 * floor((degrees(a) + 180) / 360), 6) AS low_deg FROM e")
def wrap_angles(spark, d):
    a = (F.col("value") - 50) / 7.0
    return table(spark, d, "events").select("event_id", F.round(q.wrapped_low(a), 6).alias("low"), F.round(q.wrapped(a), 6).alias("wrapped"), F.round(q.heading(a), 6).alias("heading"), F.round(F.pmod(F.degrees(a) + 180, F.lit(360.0)) - 180, 6).alias("low_deg"))


# ------------------------------------------------------------------ places

_A, _E2 = geo.A, geo.E2
_P = "p AS (SELECT c_custkey, radians((c_custkey * 37 % 1600) / 10.0 - 80) AS lat, radians((c_custkey * 91 % 3580) / 10.0 - 179) AS lon, c_acctbal AS h FROM customer)"
_N = f"({_A!r} / sqrt(1 - {_E2!r} * sin(lat) * sin(lat)))"
_M = f"({_A * (1 - _E2)!r} / pow(1 - {_E2!r} * sin(lat) * sin(lat), 1.5))"
_X, _Y, _Z = f"(({_N} + h) * cos(lat) * cos(lon))", f"(({_N} + h) * cos(lat) * sin(lon))", f"(({_N} * {1 - _E2!r} + h) * sin(lat))"


def _places(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select("c_custkey", F.radians((key * 37 % 1600) / 10.0 - 80).alias("lat"), F.radians((key * 91 % 3580) / 10.0 - 179).alias("lon"), F.col("c_acctbal").alias("h"))


def _geo(name: str, select: str, columns) -> None:
    """columns: (lat, lon, h) to the columns of the query, made when a session is there."""

    @query(name, f"WITH {_P} SELECT c_custkey, {select} FROM p")
    def run(spark, d, columns=columns):
        return _places(spark, d).select("c_custkey", *columns(F.col("lat"), F.col("lon"), F.col("h")))


def _c(**columns: tuple[Column, int]) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, (c, digits) in columns.items()]


def _step(lat, lon, h):
    return geo.to_enu(lat + 1e-4, lon - 2e-4, h + 5.0, lat, lon, h)


def _near(lat, lon, h):
    return geo.local_delta(lat + 1e-5, lon + 2e-5, lat, lon, h)


def _struct(c: Column, **digits: int) -> list[Column]:
    return [F.round(c[n], k).alias(n) for n, k in digits.items()]


_DX = [f"(({e.replace('lat', '(lat + 1e-4)').replace('lon', '(lon - 2e-4)').replace('+ h)', '+ h + 5)')}) - {e})" for e in (_X, _Y, _Z)]


def _ride(lat, h):
    return geo.transport_rate_enu(lat, h, q.vec(10, 20, 0))


_geo("earth_radii", f"round({_M}, 4) AS meridian_m, round({_N}, 4) AS prime_vertical_m", lambda lat, lon, h: _c(meridian_m=(geo.meridian_radius(lat), 4), prime_vertical_m=(geo.prime_vertical(lat), 4)))
_geo("geodetic_to_ecef", f"round({_X}, 4) AS x, round({_Y}, 4) AS y, round({_Z}, 4) AS z", lambda lat, lon, h: _struct(geo.to_ecef(lat, lon, h), x=4, y=4, z=4))
_geo("geodetic_ecef_roundtrip", "round(lat, 9) AS lat, round(lon, 9) AS lon, round(h, 3) AS h", lambda lat, lon, h: _struct(geo.from_ecef(geo.to_ecef(lat, lon, h)), lat=9, lon=9, h=3))
_geo("enu_roundtrip", "round(lat + 1e-4, 9) AS lat, round(lon - 2e-4, 9) AS lon, round(h + 5, 3) AS h", lambda lat, lon, h: _struct(geo.from_enu(_step(lat, lon, h), lat, lon, h), lat=9, lon=9, h=3))
_geo("enu_project", f"round(-sin(lon)*{_DX[0]} + cos(lon)*{_DX[1]}, 4) AS east, round(-sin(lat)*cos(lon)*{_DX[0]} - sin(lat)*sin(lon)*{_DX[1]} + cos(lat)*{_DX[2]}, 4) AS north, round(-(cos(lat)*cos(lon)*{_DX[0]} + cos(lat)*sin(lon)*{_DX[1]} + sin(lat)*{_DX[2]}), 4) AS down", lambda lat, lon, h: _c(east=(_step(lat, lon, h).x, 4), north=(_step(lat, lon, h).y, 4), down=(geo.enu_ned(_step(lat, lon, h)).z, 4)))
_geo("geodetic_to_ned", f"round(-sin(lat)*cos(lon)*{_DX[0]} - sin(lat)*sin(lon)*{_DX[1]} + cos(lat)*{_DX[2]}, 4) AS x, round(-sin(lon)*{_DX[0]} + cos(lon)*{_DX[1]}, 4) AS y, round(-(cos(lat)*cos(lon)*{_DX[0]} + cos(lat)*sin(lon)*{_DX[1]} + sin(lat)*{_DX[2]}), 4) AS z", lambda lat, lon, h: _struct(geo.enu_ned(_step(lat, lon, h)), x=4, y=4, z=4))
_geo("normal_gravity", f"round({geo.GRAVITY_EQUATOR!r} * (1 + {geo.GRAVITY_K!r} * sin(lat)*sin(lat)) / sqrt(1 - {_E2!r} * sin(lat)*sin(lat)) - {geo.FREE_AIR!r} * h, 9) AS gravity", lambda lat, lon, h: _c(gravity=(geo.gravity(lat, h), 9)))
_geo("frame_rates", f"round({geo.EARTH_RATE!r} * cos(lat) * 1e6, 6) AS earth_n, round({geo.EARTH_RATE!r} * sin(lat) * 1e6, 6) AS earth_u, round(-20 / ({_M} + h) * 1e6, 6) AS ride_e, round(10 / ({_N} + h) * 1e6, 6) AS ride_n, round(10 * tan(lat) / ({_N} + h) * 1e6, 6) AS ride_u", lambda lat, lon, h: _c(earth_n=(geo.earth_rate_enu(lat).y * 1e6, 6), earth_u=(geo.earth_rate_enu(lat).z * 1e6, 6), ride_e=(_ride(lat, h).x * 1e6, 6), ride_n=(_ride(lat, h).y * 1e6, 6), ride_u=(_ride(lat, h).z * 1e6, 6)))
_geo("along_cross", f"round(2e-5 * ({_N} + h) * cos(lat), 4) AS east, round(1e-5 * ({_M} + h), 4) AS north, round(2e-5 * ({_N} + h) * cos(lat) * sin(0.5) + 1e-5 * ({_M} + h) * cos(0.5), 4) AS along, round(2e-5 * ({_N} + h) * cos(lat) * cos(0.5) - 1e-5 * ({_M} + h) * sin(0.5), 4) AS across", lambda lat, lon, h: [*_c(east=(_near(lat, lon, h).e, 4), north=(_near(lat, lon, h).n, 4)), *_struct(geo.along_cross(_near(lat, lon, h).e, _near(lat, lon, h).n, F.lit(0.5)), along=4, across=4)])
_geo("move_fix", f"round(lat - 40 / ({_M} + h), 9) AS lat, round(lon + 30 / (({_N} + h) * cos(lat)), 9) AS lon", lambda lat, lon, h: _struct(geo.moved(lat, lon, h, F.lit(30.0), F.lit(-40.0)), lat=9, lon=9))
_geo("equirectangular", f"round((degrees(lon) - 8) * {math.pi / 180 * _A!r} * cos(radians(50)), 3) AS x, round((degrees(lat) - 50) * {math.pi / 180 * _A!r}, 3) AS y", lambda lat, lon, h: _struct(geo.equirectangular(F.degrees(lat), F.degrees(lon), F.lit(50.0), F.lit(8.0)), x=3, y=3))


# ------------------------------------------------------------------ text, units, validation


@query("header_key", r"SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(replace(t, '°', 'deg'), '[µμ]', 'u', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')), '\( ', '(', 'g'), ' \)', ')', 'g') AS key FROM (SELECT doc_id, 'GPS  ( ' || source || ' °, µT ) ' || chr(9) || text AS t FROM documents)")
def header_key(spark, d):
    raw = F.concat(F.lit("GPS  ( "), F.col("source"), F.lit(" °, µT ) \t"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.header_key(raw).alias("key"))


@query("parse_counts", "SELECT event_id, CASE WHEN k % 3 < 2 THEN k % 12 + 1 END AS used, CASE WHEN k % 3 < 2 THEN k % 17 + 10 END AS visible, k % 3 = 1 AS recovered FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def parse_counts(spark, d):
    k = F.col("k")
    month = F.array(*map(F.lit, text._MONTHS))[(k % 12).cast("int")]
    raw = F.when(k % 3 == 0, F.concat((k % 12 + 1).cast("string"), F.lit(" / "), (k % 17 + 10).cast("string"))).when(k % 3 == 1, F.concat(month, F.lit("-"), (k % 17 + 10).cast("string"))).otherwise(F.lit("n/a"))
    return events(spark, d).select("event_id", text.satellite_counts(raw).alias("s")).select("event_id", "s.*")


@query("strict_datetime", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 END AS ms FROM events")
def strict_datetime(spark, d):
    e = table(spark, d, "events")
    t = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss:SSS")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS"))
    return e.select("event_id", F.unix_millis(text.strict_datetime(raw)).alias("ms"))


@query("local_to_utc", "SELECT o_orderkey, epoch_us(timezone('UTC', timezone('Europe/London', o_orderdate + INTERVAL 12 HOUR))) AS utc_us FROM orders")
def local_to_utc(spark, d):
    t = F.col("o_orderdate").cast("timestamp") + F.expr("interval 12 hours")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(text.local_to_utc(t, "Europe/London")).alias("utc_us"))


@query("route_group", r"SELECT s_suppkey, regexp_replace(n, '^(.*[0-9])[a-z]$', '\1') AS route FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'S' || s_suppkey || 'a' WHEN 1 THEN 'S' || s_suppkey WHEN 2 THEN s_name WHEN 3 THEN s_suppkey || 'ab' ELSE 'b' END AS n FROM supplier)")
def route_group(spark, d):
    """Names with a segment letter, without one, of other forms, with two letters, and of a letter alone."""
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("S"), k, F.lit("a"))).when(k % 5 == 1, F.concat(F.lit("S"), k)).when(k % 5 == 2, F.col("s_name")).when(k % 5 == 3, F.concat(k, F.lit("ab"))).otherwise(F.lit("b"))
    return table(spark, d, "supplier").select("s_suppkey", text.route_group(name).alias("route"))


@query("slug", "SELECT p_partkey, trim(regexp_replace(lower(split_part(n, ',', 1)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_name || ', ' || p_brand ELSE ' ' || p_brand || '--' || p_type || ' ,x' END AS n FROM part)")
def slug(spark, d):
    """Names with a part after a comma, and with signs at both ends."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", "), "p_brand")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit("--"), "p_type", F.lit(" ,x")))
    return table(spark, d, "part").select("p_partkey", text.slug(name).alias("slug"))


@query("file_meta", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'S' ELSE 'V' END END AS kind, CASE WHEN c_custkey % 3 < 2 THEN 'V' || c_custkey END AS session FROM customer")
def file_meta(spark, d):
    k = F.col("c_custkey")
    path = F.concat(F.lit("root/a/"), F.when(k % 3 == 0, "S").when(k % 3 == 1, "V").otherwise("X"), F.lit("-V"), k, F.lit(".csv"))
    return table(spark, d, "customer").select("c_custkey", text.file_meta(path).alias("m")).select("c_custkey", "m.*")


@query("csv_quoting", """SELECT doc_id, CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field FROM (SELECT doc_id, text AS t FROM documents)""")
def csv_quoting(spark, d):
    return table(spark, d, "documents").select("doc_id", text.csv_field(F.col("text")).alias("field"))


@query("unit_convert", f"SELECT event_id, round(value / 3.6, 6) AS speed_mps, round(radians(value), 6) AS rate_radps, round(value * {geo.G0}, 8) AS accel_mps2, round(value * 6894.757293168, 1) AS pressure_pa FROM events")
def unit_convert(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(v / 3.6, 6).alias("speed_mps"), F.round(F.radians(v), 6).alias("rate_radps"), F.round(v * geo.G0, 8).alias("accel_mps2"), F.round(v * 6894.757293168, 1).alias("pressure_pa"))


@query("sample_validation", "WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown type' WHEN value > 90 THEN 'out of range' WHEN k < 3 THEN 'no accuracy' END AS reason FROM e")
def sample_validation(spark, d):
    return _judged(spark, d).select("event_id", "reason")


def _judged(spark, d):
    reason = F.when(F.col("event_type") == "error", "unknown type").when(F.col("value") > 90, "out of range").when(F.col("k") < 3, "no accuracy")
    return events(spark, d).select("event_id", "value", reason.alias("reason"))


@query("exclusion_counts", "WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT coalesce(CASE WHEN event_type = 'error' THEN 'unknown type' WHEN value > 90 THEN 'out of range' WHEN k < 3 THEN 'no accuracy' END, 'kept') AS reason, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM e GROUP BY 1")
def exclusion_counts(spark, d):
    return _judged(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("fix_validation", "SELECT c_custkey, abs(c_acctbal) <= 5000 AND c_acctbal > 0 AND c_nationkey BETWEEN 1 AND 20 AS valid FROM customer")
def fix_validation(spark, d):
    valid = (F.abs("c_acctbal") <= 5000) & (F.col("c_acctbal") > 0) & F.col("c_nationkey").between(1, 20)
    return table(spark, d, "customer").select("c_custkey", valid.alias("valid"))


@query("course_velocity", "SELECT event_id, round(value * sin(radians(k * 3.6)), 6) AS e, round(value * cos(radians(k * 3.6)), 6) AS n FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def course_velocity(spark, d):
    v = geo.course_velocity(F.col("value"), F.radians(F.col("k") * 3.6))
    return events(spark, d).select("event_id", F.round(v.e, 6).alias("e"), F.round(v.n, 6).alias("n"))


@query("circle_probability", f"SELECT event_id, round(1 - exp(-value * value / 1800), 9) AS inside, round(value / {geo.RADIUS_68!r}, 6) AS sigma FROM events")
def circle_probability(spark, d):
    return table(spark, d, "events").select("event_id", F.round(geo.circle_probability(F.col("value"), F.lit(30.0)), 9).alias("inside"), F.round(F.col("value") / geo.RADIUS_68, 6).alias("sigma"))


@query("policy_lookup", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1e0 WHEN 'click' THEN 2e0 WHEN 'view' THEN 3e0 END AS noise, event_type IN ('purchase', 'click', 'view') AS use_gnss, event_type <> 'purchase' AS use_ai FROM events")
def policy_lookup(spark, d):
    noise = F.create_map(*(F.lit(x) for p in {"purchase": 1.0, "click": 2.0, "view": 3.0}.items() for x in p))
    n = F.try_element_at(noise, F.col("event_type"))
    return table(spark, d, "events").select("event_id", n.alias("noise"), n.isNotNull().alias("use_gnss"), (F.col("event_type") != "purchase").alias("use_ai"))


_F13 = [f"v{n} / {geo.G0}" for n in "xyz"] + [f"g{n} / {geo.G0}" for n in "xyz"] + [f"w{n} / 0.5" for n in "xyz"] + [f"n / {geo.G0} - 1", f"(vx*gx+vy*gy+vz*gz)/gn/{geo.G0} - 1", f"sqrt(pow(vy*gz-vz*gy,2)+pow(vz*gx-vx*gz,2)+pow(vx*gy-vy*gx,2))/gn/{geo.G0}", "(wx*gx+wy*gy+wz*gz)/gn/0.5"]


@query("features13", f"WITH {_Q}, f AS (SELECT vec_id, vx, vy, vz, {_VN} AS n, ax AS gx, ay AS gy, az AS gz, {_S} AS gn, bx AS wx, by_ AS wy, bz AS wz FROM u) SELECT vec_id, {', '.join(f'round({e}, 6) AS f{i}' for i, e in enumerate(_F13))} FROM f")
def features13(spark, d):
    """All thirteen channels of a model's input: force, gravity and turn rate by their scales, and four that no turn about the vertical changes."""
    v, g, w = F.col("v"), F.col("a"), F.col("b")
    out = features.channels(v, q.vec(g.x, g.y, g.z), q.vec(w.x, w.y, w.z), geo.G0, 0.5)
    return _vectors(spark, d).select("vec_id", out.alias("f")).select("vec_id", *(F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(13)))


@query("nll_huber", "SELECT event_id, round(0.5 * (e * e * exp(-lv) + lv), 8) AS nll, round(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END, 8) AS huber, round(exp(lv), 8) AS variance FROM (SELECT event_id, (value - 50) / 10 AS e, greatest(-8, least(6, (k - 50) / 5.0)) AS lv FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))")
def nll_huber(spark, d):
    """Eight decimals: the values have seven at most where they are exact, so nothing lies half way."""
    e, lv = (F.col("value") - 50) / 10, F.greatest(F.lit(-8.0), F.least(F.lit(6.0), (F.col("k") - 50) / 5.0))
    return events(spark, d).select("event_id", F.round(0.5 * (e * e * F.exp(-lv) + lv), 8).alias("nll"), F.round(F.when(F.abs(e) <= 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5), 8).alias("huber"), F.round(F.exp(lv), 8).alias("variance"))
