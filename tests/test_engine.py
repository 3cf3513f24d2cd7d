"""Engine, recovery, splits, synthetic fleet, bundles and vectorised functions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.functions import registry, vectorised
from wayline.operators import splits
from wayline.sources import bundle, synthetic
from wayline.streaming import earth
from wayline.streaming.inertial import CovarianceError, Filter, Fix, Noise, Sample, State, carried, error_between
from wayline.streaming.navigator import COLUMNS, Engine, Navigator, Options, navigate, navigate_stream, stepped
from wayline.streaming.recovery import Recovery


def run(engine, drive, observer=None):
    return list(stepped(engine, drive[COLUMNS].itertuples(index=False, name=None)))


def off(out, drive):
    k = round(out.t * synthetic.RATE)
    return np.linalg.norm(earth.apart(np.array([out.lon, out.lat, 0.0]), np.array([drive.true_lon[k], drive.true_lat[k], 0.0]))[:2])


def test_free_inertial_follows_the_ellipsoid():
    d = synthetic.drive(3, 60, noise=0.0, dropout=0.0)
    s = State(0.0, np.array([d.true_lon[0], d.true_lat[0], 100.0]), d.true_speed[0] * np.array([math.cos(d.true_yaw[0]), math.sin(d.true_yaw[0]), 0.0]), earth.turn(d.true_yaw[0]))
    for a, g in zip(d[["acc_x", "acc_y", "acc_z"]].to_numpy()[:-1], d[["gyro_x", "gyro_y", "gyro_z"]].to_numpy()[:-1]):
        s = carried(s, a, g, 0.1)
    assert np.abs(earth.apart(s.place, np.array([d.true_lon.iloc[-1], d.true_lat.iloc[-1], 100.0]))).max() < 0.05
    with pytest.raises(ValueError):
        carried(s, np.zeros(3), np.zeros(3), 0.0)
    with pytest.raises(ValueError):
        State(0.0, np.array([0.0, np.nan, 0.0]), np.zeros(3), np.eye(3))


def states(n):
    """Places up to the date line, some at rest; velocities, attitudes, forces and rates, some of them nought."""
    r = np.random.default_rng(n)
    place = np.stack([r.uniform(-math.pi, math.pi, n), r.uniform(-1.4, 1.4, n), r.uniform(-100, 9000, n)], -1)
    place[0, 0] = math.pi - 1e-9
    velocity, force, rate = r.normal(0, 20, (n, 3)), r.normal(0, 9, (n, 3)), r.normal(0, 0.5, (n, 3))
    velocity[0], velocity[1::3], rate[2::3] = (50, 0, 0), 0, 0
    return place, velocity, np.array([earth.rotation(v) for v in r.normal(size=(n, 3))]), force, rate


@pytest.mark.parametrize("n", [1, 3, 40])
def test_many_states_are_carried_as_each_alone(n):
    place, velocity, attitude, force, rate = states(n)
    many = State(0.0, place, velocity, attitude)
    for _ in range(3):
        many = carried(many, force, rate, 0.5)
    for k in range(n):
        one = State(0.0, place[k], velocity[k], attitude[k])
        for _ in range(3):
            one = carried(one, force[k], rate[k], 0.5)
        assert np.abs(earth.apart(many.place[k], one.place)).max() < 1e-6 and abs(many.place[k, 0] - one.place[0]) < 1e-12
        assert np.allclose(many.velocity[k], one.velocity, rtol=1e-12, atol=1e-10) and np.allclose(many.attitude[k], one.attitude, rtol=0, atol=1e-12)
    assert (carried(many, np.zeros(3), np.zeros(3), 0.5).place == carried(many, np.zeros((n, 3)), np.zeros((n, 3)), 0.5).place).all()
    assert many.place[0, 0] < 0  # over the date line
    place[n - 1, 2] = np.inf
    with pytest.raises(ValueError):
        State(0.0, place, velocity, attitude)
    attitude[n - 1] *= 1.1
    with pytest.raises(ValueError):
        State(0.0, states(n)[0], velocity, attitude)


@pytest.mark.parametrize("measured", [(True, True, True), (False, True, False), (False, False, True)])
def test_many_filters_propagate_as_each_alone(measured):
    place, velocity, attitude, force, rate = states(9)
    start = lambda k: Filter.start(0.0, place[k], velocity[k], attitude[k], Noise(), 5.0, 0.3)
    many = start(slice(None))
    many.accel_bias, many.gyro_bias = force / 100, rate / 100
    for _ in range(4):
        many.propagate(Sample(0.0, force, rate, measured), 0.1)
    for k in range(9):
        one = start(k)
        one.accel_bias, one.gyro_bias = force[k] / 100, rate[k] / 100
        for _ in range(4):
            one.propagate(Sample(0.0, force[k], rate[k], measured), 0.1)
        assert np.abs(earth.apart(many.state.place[k], one.state.place)).max() < 1e-6 and np.allclose(many.state.velocity[k], one.state.velocity, rtol=1e-12, atol=1e-10)
        assert np.allclose(many.state.attitude[k], one.state.attitude, rtol=0, atol=1e-12)
        assert np.allclose(many.covariance[k], one.covariance, rtol=1e-9, atol=1e-15)
    many.covariance[5, 3, 3] = -1.0
    with pytest.raises(CovarianceError):
        many.propagate(Sample(0.0, force, rate, measured), 0.1)


@pytest.mark.parametrize("name", ["rest_stays", "unmeasured_axes"])
def test_cases_in_blocks_are_all_there(spark, name):
    """Blocks that are full, not full and of one row: each customer once, and what the query states holds."""
    from wayline.plans import catalog

    d = "/root/testdata/sf0.01"
    got = catalog.queries()[name](spark, d).collect()
    keys = sorted(r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").collect())
    assert sorted(r[0] for r in got) == keys and len(keys) > 1024 and all(all(r[1:]) for r in got)


def test_engine_finds_the_heading_of_a_turned_phone():
    d = synthetic.drive(5, 135, mount_yaw=2.0, accel_bias=0.02, gyro_bias=0.001, delay=0.5)
    e = Engine()
    out = run(e, d)
    assert out[-1].mode == "NAVIGATING" and len(e.tried) == 1 and off(out[-1], d) < 5 and out[-1].rejected == 0
    x = e.best.filter.state.attitude @ earth.turn(2.0) @ np.array([1.0, 0.0, 0.0])
    assert abs(math.remainder(math.atan2(x[1], x[0]) - d.true_yaw.iloc[-1], 2 * math.pi)) < 0.1
    assert Navigator(e.best.filter, e.options).score() == math.inf


def test_outage_is_recovered_and_the_output_has_no_jumps():
    d = synthetic.drive(7, 120, noise=0.2, dropout=0.0)
    gone = (d.t > 40) & (d.t < 80)
    d.loc[gone, [c for c in d if c.startswith("fix")]] = np.nan
    e = Engine(mount=np.eye(3), options=Options(speed=False, straight_needs_speed=False))
    out = run(e, d)
    states = [o.gnss_state for o in out]
    assert "LOST" in states and states[-1] == "GOOD" and e.best.recovery.counts["confirmed"] == 1 and e.best.recovery.counts["graded"] == 3
    steps = [np.linalg.norm(earth.apart(np.array([b.smooth_lon, b.smooth_lat, 0.0]), np.array([a.smooth_lon, a.smooth_lat, 0.0]))[:2]) for a, b in zip(out, out[1:])]
    assert max(steps) < d.true_speed[0] * 0.1 + 15 * 0.1 + 0.5 and off(out[-1], d) < 10


def test_recovery_gives_back_what_it_held():
    f = Filter.start(0.0, (0.1, 0.5, 0.0), (10, 0, 0), np.eye(3), Noise(), 5.0, 0.1)
    at = lambda t, e, n=0.0: Fix(t, t, earth.moved(np.array([0.1, 0.5, 0.0]), np.array([e, n, 0.0])), 3.0)
    r = Recovery()
    first = at(0, 0)
    assert r.offered(first, f) == ([first], False)
    r.lost()
    f.history.clear()
    for t in range(6):
        f.history.append(State(float(t), earth.moved(np.array([0.1, 0.5, 0.0]), np.array([10.0 * t, 0.0, 0.0])), np.array([10.0, 0, 0]), np.eye(3)))
    f.state = f.history[-1]
    assert r.offered(at(1, 10), f) == ([], False)
    assert r.offered(at(2, 10, 300), f) == ([], False) and r.counts["inconsistent"] == 1  # as far, but in another direction
    got, confirmed = r.offered(at(3, 20, 300), f)
    assert confirmed and [x.t for x in got] == [2, 3]
    assert [round((r.graded_fix(x).accuracy / 3) ** 2) for x in (*got, *got)] == [9, 4, 2, 1] and r.phase == "normal"
    r.lost()
    assert r.offered(at(1, 0), f) == ([], False)
    late = Fix(4.0, 40.0, np.array([0.2, 0.5, 0.0]), 3.0)
    assert r.offered(late, f) == ([late], False) and r.counts["timeouts"] == 1


def test_filter_guards():
    f = Filter.start(0.0, (0.1, 0.5, 0.0), (10, 0, 0), np.eye(3), Noise(), 5.0, 0.1)
    with pytest.raises(ValueError):
        f.update(np.zeros(2), np.zeros((3, 15)), np.eye(2))
    with pytest.raises(ValueError):
        f.fix(Fix(9.0, 9.0, f.state.place, 3.0))
    f.covariance[0, 0] = np.nan
    with pytest.raises(CovarianceError):
        f.propagate(Sample(0.0, np.zeros(3), np.zeros(3)), 0.1)
    with pytest.raises(KeyError):
        Noise.of({})
    assert Noise.of({k: 1.0 for k in ("accel_white_noise_density", "gyro_white_noise_density", "accel_bias_sigma", "accel_bias_tau_s", "gyro_bias_sigma", "gyro_bias_tau_s")}, unmeasured=3.0).unmeasured == 3.0


def test_estimates_are_as_good_as_they_say():
    """Errors of many short drives against their covariance: the mean of the normalised square is that of chi-square."""
    nees = []
    for k in range(12):
        d = synthetic.drive(k, 25, noise=0.1, dropout=0.0, seed=9)
        yaw = d.true_yaw[0]
        r = np.random.default_rng(k)
        f = Filter.start(0.0, earth.moved(np.array([d.true_lon[0], d.true_lat[0], 100.0]), r.normal(0, 3, 3) * [1, 1, 2.5]), d.true_speed[0] * np.array([math.cos(yaw), math.sin(yaw), 0]) + r.normal(0, 0.5, 3), earth.rotation(r.normal(0, 0.035, 3)) @ earth.turn(yaw), Noise(accel=0.1 * 0.1**0.5, gyro=0.001 * 0.1**0.5), 3.0, 0.035)
        for i in range(len(d) - 1):
            f.propagate(Sample(i / 10, d.loc[i, ["acc_x", "acc_y", "acc_z"]].to_numpy(float), d.loc[i, ["gyro_x", "gyro_y", "gyro_z"]].to_numpy(float)), 0.1)
            if i % 10 == 9:
                f.fix(Fix(f.state.t, f.state.t, earth.moved(np.array([d.true_lon[i + 1], d.true_lat[i + 1], 100.0]), r.normal(0, 3, 3) * [1, 1, 2.5]), 3.0))
        last = len(d) - 1
        truth = State(last / 10, np.array([d.true_lon[last], d.true_lat[last], 100.0]), d.true_speed[0] * np.array([math.cos(d.true_yaw[last]), math.sin(d.true_yaw[last]), 0]), earth.turn(d.true_yaw[last]))
        e = error_between(truth, f.state)
        nees.append(e @ np.linalg.solve(f.covariance[:9, :9], e))
    assert 4 < np.mean(nees) < 16


def test_stream_of_engines_equals_batch(spark, tmp_path):
    df = synthetic.fleet(spark, 2, seconds=12).persist()
    for part in range(3):
        df.where(f"t >= {part * 4} AND t < {part * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = navigate_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "session_id")
    q = stream.writeStream.format("memory").queryName("navigated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = navigate(df, "session_id").drop("arm")
    assert sorted(spark.table("navigated").collect()) == sorted(batch.collect()) and batch.count() > 100


def test_models_and_observers():
    d = synthetic.drive(2, 12, noise=0.01, dropout=0.0)
    seen = []
    truth = float(d.true_speed[0])
    e = Engine(mount=np.eye(3), models={"speed": lambda rows: (truth, 0.1)}, options=Options(accel=True, states=True))
    for r in d[COLUMNS].itertuples(index=False, name=None):
        list(stepped(e, [r]))
    e.sample(Sample(99.0, np.array([0, 0, 9.8]), np.zeros(3)), np.zeros(3), [], observer=lambda nav: seen.append(nav.n))
    c = e.best.counts
    assert c["speed_predictions"] > 50 and c["speed_accepted"] >= 1 and c["straight_accepted"] > 50 and len(seen) == 1
    with pytest.raises(KeyError):
        registry.build("nothing")


def test_splits_do_not_leak(spark):
    rows = [(s, f"d{s % 5}", s // 2, 1.0 + s % 3) for s in range(60)]
    rows = [(s, f"d{(drive) % 5}", drive, h) for s, _, drive, h in rows]
    got = splits.assign(spark.createDataFrame(rows, "session_id long, driver string, drive_id long, hours double"))
    assert splits.leaks(got).count() == 0
    hours = {r["split"]: r["h"] for r in got.groupBy("split").agg(F.sum("hours").alias("h")).collect()}
    assert set(hours) == {"train", "val", "test"} and 0.1 <= hours["test"] / sum(hours.values()) <= 0.35


def test_fleet_is_the_same_for_the_same_seed(spark):
    df = synthetic.fleet(spark, 3, seconds=8)
    assert df.count() == 240 and df.exceptAll(synthetic.fleet(spark, 3, seconds=8)).count() == 0


def test_bundle_round_trip(spark, tmp_path):
    data = bundle.pack([(1, 0.5, -0.5), (2, 1.5, 2.5)], [(7, 1, 2), (7, 2, 1)], {"7": {"highway": "primary"}})
    assert bundle.unpack(data) == ([(1, 0.5, -0.5), (2, 1.5, 2.5)], [(7, 1, 2), (7, 2, 1)], {"7": {"highway": "primary"}})
    for bad in (b"XXXX" + data[4:], data + b"x", data[:4] + b"\x00\x09" + data[6:]):
        with pytest.raises(ValueError):
            bundle.unpack(bad)
    (tmp_path / "a.roads").write_bytes(data)
    assert [(r.way_id, r.a, r.b) for r in bundle.read(spark, str(tmp_path)).collect()] == [(7, 1, 2), (7, 2, 1)]


def test_vectorised(spark):
    r = np.random.default_rng(2)
    m = spark.createDataFrame([([float(x) for x in r.normal(size=9)],) for _ in range(5)], "m array<double>")
    for (got,) in m.select(vectorised.nearest_rotation("m")).collect():
        g = np.array(got).reshape(3, 3)
        assert np.allclose(g @ g.T, np.eye(3)) and np.isclose(np.linalg.det(g), 1)
    x = r.normal(size=400)
    rows = [(1, k, float(x[k]), float(x[k - 17] if k >= 17 else 0.0)) for k in range(400)]
    lag = vectorised.fft_lags(spark.createDataFrame(rows, "s long, t long, x double, y double"), "s", "t", "x", "y", 60).collect()[0]
    assert lag.lag == 17 and lag.r > 0.9
    w = spark.createDataFrame([([3.0, 4.0, 1.0],)], "v array<double>")
    turned = vectorised.augmented(w, "v", 5).collect()[0].v
    assert np.isclose(np.hypot(*turned[:2]), 5) and turned[2] == 1.0 and turned != [3.0, 4.0, 1.0]
    with pytest.raises(ValueError):
        vectorised.predicted(w, "v", b"x", "0" * 64)


def test_event_loop(spark, tmp_path):
    """Tagged events of a drive: the place of the navigator, a switched outage, refused events, and the same rows from a stream."""
    from wayline.streaming import events

    d = synthetic.drive(4, 40, noise=0.02, dropout=0.0)
    rows = events.tagged(d)
    extra = pd.DataFrame([(4, 20.05, "OUTAGE", *[None] * 8, True), (4, 30.05, "OUTAGE", *[None] * 8, False), (4, 5.05, "ACCEL", 1e9, 0.0, 0.0, *[None] * 6), (4, 6.05, "RADAR", *[None] * 9), (4, 7.05, "FIX", 0.1, 0.1, 0.0, 99.0, 3.0, None, None, "gps", None), (4, 8.05, "FIX", 0.1, 0.1, 0.0, 8.0, 3.0, None, None, "network", None)], columns=["session_id", *events.COLUMNS])
    rows = pd.concat([rows, extra]).sort_values("t", kind="stable").reset_index(drop=True)
    rows["seq"] = np.arange(len(rows))
    loop = events.EventLoop(mount=np.eye(3), providers=("gps",))
    out = list(events.looped(loop, rows[events.COLUMNS].itertuples(index=False, name=None)))
    last = out[-1]
    assert dict(loop.refused) == {"out of scale": 1, "unknown tag": 1, "fix before its time": 1, "provider": 1}
    assert last.n_withheld == 10 and last.provider == "gps" and last.n_samples > 390
    assert all(b.t - a.t >= events.SNAPSHOT_S - 1e-9 for a, b in zip(out, out[1:]))
    k = round(last.t * synthetic.RATE)
    assert np.linalg.norm(earth.apart(np.array([last.lon, last.lat, 0.0]), np.array([d.true_lon[k], d.true_lat[k], 0.0]))[:2]) < 5
    assert any(o.sigma > 2 * out[80].sigma for o in out[140:152])
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), f"{events.EVENT_SCHEMA}, seq long")
    for part in range(3):
        df.where(f"t >= {part * 14} AND t < {part * 14 + 14}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = events.run_events_stream(events.channel(events.live(spark, str(tmp_path / "in"), 1), "ACCEL", "GYRO", "GRAVITY", "FIX", "OUTAGE"), mount=np.eye(3))
    q = stream.writeStream.format("memory").queryName("snapshots").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.run_events(events.channel(df, "ACCEL", "GYRO", "GRAVITY", "FIX", "OUTAGE"), mount=np.eye(3))
    assert [tuple(r) for r in sorted(spark.table("snapshots").collect())] == [tuple(r) for r in sorted(batch.collect())]
