"""Vectors and rotations with frames: the attitude is the first quaternion of an embedding, the mounting the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import frames as fr
from wayline.functions import quaternion as q
from wayline.plans.catalog import query
from wayline.plans.q_scalars import _Q, _ROT, _flat, _geo, _r, _step, _struct, _vectors


def _frame_query(name: str, select: str, f, names: str = "xyz") -> None:
    @query(name, f"WITH {_Q} SELECT vec_id, {select} FROM u")
    def run(spark, d, f=f, names=names):
        df = _vectors(spark, d).select("vec_id", f(F.col("a"), F.col("b"), F.col("v")).alias("o"))
        return df.select("vec_id", *_flat(F.col("o"), names))


_INV = {n: e.replace("aw*", "AW*").replace("ax", "(-ax)").replace("ay", "(-ay)").replace("az", "(-az)").replace("AW*", "aw*") for n, e in _ROT.items()}
_PLUS = {n: f"v{n} + 2*v{n}" for n in "xyz"}
#: The product of the conjugate of b and a: vehicle of body after enu of body the other way round.
_CHAIN = dict(w="bw*aw + bx*ax + by_*ay + bz*az", x="-bw*ax + bx*aw - by_*az + bz*ay", y="-bw*ay + bx*az + by_*aw - bz*ax", z="-bw*az - bx*ay + by_*ax + bz*aw")

_frame_query("framed_sum", _r(**_PLUS), lambda a, b, v: (fr.Framed(v, fr.ENU) + fr.Framed(q.vec(2 * v.x, 2 * v.y, 2 * v.z), fr.ENU)).v)
_frame_query("framed_apply", _r(**_ROT), lambda a, b, v: fr.attitude(a).apply(fr.Framed(v, fr.BODY)).v)
_frame_query("framed_inverse", _r(**_INV), lambda a, b, v: fr.attitude(a).inverse().apply(fr.Framed(v, fr.ENU)).v)
_frame_query("framed_identity", _r(x="vx", y="vy", z="vz"), lambda a, b, v: fr.Rotation.identity(fr.ENU).apply(fr.Framed(v, fr.ENU)).v)
_frame_query("framed_compose", _r(**_CHAIN), lambda a, b, v: (fr.mounting(b) @ fr.attitude(a).inverse()).q, "wxyz")
_frame_query("framed_ned", _r(x="vy", y="vx", z="-vz"), lambda a, b, v: fr.ned_of_enu().apply(fr.Framed(v, fr.ENU)).v)
_frame_query("framed_matrix", _r(**_ROT), lambda a, b, v: q.mat_vec(fr.attitude(a).matrix, v))
_frame_query("framed_of_matrix", _r(**_ROT), lambda a, b, v: fr.Rotation.of_matrix(q.matrix(a), fr.BODY, fr.ENU).apply(fr.Framed(v, fr.BODY)).v)
_geo("ned_to_geodetic", "round(lat + 1e-4, 9) AS lat, round(lon - 2e-4, 9) AS lon, round(h + 5, 3) AS h", lambda lat, lon, h: _struct(fr.from_ned(fr.geo.enu_ned(_step(lat, lon, h)), lat, lon, h), lat=9, lon=9, h=3))
_geo("plane_to_geodetic", "round(lat + 1e-4, 9) AS lat, round(lon - 2e-4, 9) AS lon", lambda lat, lon, h: _struct(fr.geo.from_enu(_step(lat, lon, h), lat, lon, h), lat=9, lon=9))
_geo("enu_of_ecef", "round(-sin(lon) * 3 + cos(lon) * 4, 6) AS x, round(cos(lat) * cos(lon) * 3 + cos(lat) * sin(lon) * 4 + sin(lat) * 5, 6) AS z", lambda lat, lon, h: [F.round(fr.enu_of_ecef(lat, lon).apply(fr.Framed(q.vec(3.0, 4.0, 5.0), fr.ECEF)).v[n], 6).alias(n) for n in "xz"])
