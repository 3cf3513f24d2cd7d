"""Headers, settings, maps, golden vectors, models, mutations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions import frames as fr
from wayline.functions import quaternion as q
from wayline.functions import registry
from wayline.operators import spatial
from wayline.operators.splits import nearest_subset
from wayline.sources import golden, headers, logs, maps, settings
from wayline.streaming import earth, matching


def test_headers():
    assert headers.repaired("GPS ORIENTATION (Â°)") == "GPS ORIENTATION (°)" and headers.repaired("m/s²") == "m/s²"
    assert headers.key("ORIENTATION (Roll ) (°)") == "orientation (roll) (deg)" and headers.key("ACCELEROMETER X (m/s²) ") == "accelerometer x (m/s2)"
    assert headers.key("MAGNETIC  FIELD\tX (µT)") == "magnetic field x (ut)"
    agreed = [("t", ("time (s)", "time")), ("v", ("speed (m/s)",))]
    assert headers.mapped(headers.first_line("Time (s),SPEED (m/s)\r\n1,2".encode("cp1252")), agreed) == ["t", "v"]
    for bad in (["time"], ["speed (m/s)", "time"], ["time", "velocity"]):
        with pytest.raises(logs.SchemaError):
            headers.mapped(bad, agreed)


def test_csv_headers_and_ragged_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("v", T.LongType())])
    (tmp_path / "a.csv").write_bytes("Time (s),Speed (°)\r\n1.5,2\r\n2.5,x,9,10\r\n3.5\r\n".encode())
    accepted = [("time (s)",), ("speed (deg)",)]
    rows = logs.read_csv(spark, str(tmp_path / "a.csv"), schema, accepted=accepted).collect()
    assert [(r.t, r.v, r.bad_cells, r.extra_cells) for r in rows] == [(1.5, 2, [], []), (2.5, None, ["v"], ["9", "10"]), (3.5, None, [], [])]
    (tmp_path / "b.csv").write_text("v,t\n1,2\n")
    with pytest.raises(logs.SchemaError):
        logs.read_csv(spark, str(tmp_path), schema, accepted=accepted)


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "d.yaml"
    path.write_text("schema_version: 1\ndataset:\n  name: n\n" + "".join(f"  {k}: x/{k}\n" for k in settings.FOLDERS))
    assert settings.data_set(path)["raw_root"] == (tmp_path / "x/raw_root").resolve()
    monkeypatch.setenv(settings.RAW_ROOT, "/elsewhere")
    assert str(settings.data_set(path)["raw_root"]) == "/elsewhere"
    path.write_text("schema_version: 1\ndataset: {name: n}\n")
    with pytest.raises(settings.SettingsError):
        settings.data_set(path)
    doc = {"schema_version": 1, "seed": 3, "models": {m: dict.fromkeys(("arch", "target", "hidden", "dropout"), 1) for m in ("model_a", "model_b")}}
    doc |= {s: dict.fromkeys(names.split(), 1) for s, names in settings.NEEDED.items()}
    doc["augmentation"]["rotation"] = "full"
    path.write_text(json.dumps(doc))
    assert settings.training(path)["seed"] == 3
    for damage in (lambda x: x.update(schema_version=2), lambda x: x["train"].pop("lr"), lambda x: x["augmentation"].update(rotation="up"), lambda x: x["models"]["model_a"].pop("arch")):
        bad = json.loads(json.dumps(doc))
        damage(bad)
        path.write_text(json.dumps(bad))
        with pytest.raises(settings.SettingsError):
            settings.training(path)


def test_maps(tmp_path):
    box = (50.0, 8.0, 50.2, 8.3)
    assert '(50.0,8.0,50.2,8.3)' in maps.query_text(box) and maps.box_of_match({"boundingbox": ["1", "3", "2", "4"]}) == (1.0, 2.0, 3.0, 4.0)
    for bad in ((50.2, 8.0, 50.0, 8.3), (50.0, 8.0, 50.001, 8.3), (50.0, 8.0, 51.0, 8.3), (-91.0, 0.0, 0.0, 0.1)):
        with pytest.raises(ValueError):
            maps.checked_box(bad)
    calls = []
    fetch = lambda text: calls.append(text) or b"<osm><way/></osm>"
    for _ in range(2):
        record = maps.fetched(box, tmp_path / "a.osm", fetch, "nowhere", "2026-01-01")
    assert len(calls) == 1 and record["bytes"] == 17
    with pytest.raises(ValueError):
        maps.fetched((51.0, 8.0, 51.2, 8.3), tmp_path / "a.osm", fetch, "nowhere", "2026-01-01")
    with pytest.raises(ValueError):
        maps.fetched(box, tmp_path / "b.osm", lambda text: b"sorry", "nowhere", "2026-01-01")


def test_golden_and_card(spark, tmp_path):
    vectors = {"turn": {"in": [0.1, 0.2, 0.3], "out": earth.rotation(np.array([0.1, 0.2, 0.3])).tolist()}}
    golden.write(tmp_path, vectors)
    assert golden.differences(tmp_path, vectors) == []
    vectors["turn"]["out"][0][0] += 1e-16 + 1e-9
    assert golden.differences(tmp_path, vectors | {"new": 1}) == ["turn", "new"]
    page = golden.card("A <set>", {"t": spark.createDataFrame([(1, None), (2, 0.5)], "a long, b double")}, ["note"], rows=1)
    assert "A &lt;set&gt;" in page and "<td>—</td>" in page and "first 1 rows" in page


def test_roads_are_kept(spark, tmp_path):
    tables = [spark.range(3), spark.range(2), spark.range(1)]
    spatial.save_roads(str(tmp_path / "g"), *tables)
    assert [t.count() for t in spatial.load_roads(spark, str(tmp_path / "g"))] == [3, 2, 1]


def test_subsets_of_many_drivers():
    hours = {f"d{k:02}": 1 + k % 7 / 10 for k in range(60)}
    got = nearest_subset(hours, 0.2, (0.1, 0.35))
    assert abs(sum(hours[x] for x in got) / sum(hours.values()) - 0.2) < 0.001
    assert nearest_subset({"a": 5.0, "b": 5.0}, 0.2, (0.1, 0.35)) == () and nearest_subset({}, 0.2, (0.1, 0.35)) == ()


def test_frames_raise(spark):
    a, v = fr.attitude(q.quat(1.0, 0, 0, 0)), fr.Framed(q.vec(1.0, 2.0, 3.0), fr.ENU)
    for wrong in (lambda: a.apply(v), lambda: v + fr.Framed(v.v, fr.NED), lambda: a @ a, lambda: fr.Framed(v.v, "geodetic"), lambda: a @ fr.mounting(a.q)):
        with pytest.raises(fr.FrameError):
            wrong()
    for wrong in (lambda: a.apply(v.v), lambda: v + 1, lambda: a @ v):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(Exception, match="unit"):
        spark.range(1).select(fr.attitude(q.quat(2.0, 0, 0, 0)).apply(fr.Framed(q.vec(1.0, 0, 0), fr.BODY)).v).collect()
    with pytest.raises(ValueError):
        q.mapped(v.v, (1, 1, None))


def test_models_by_name():
    assert registry.names() == ["cnn1d", "gru", "lstm", "tcn"]
    x = np.random.default_rng(0).normal(size=(4, 5, 20))
    for name in registry.names():
        m = registry.build(name, channels=5, hidden=6, positive=True, seed=1)
        mean, var = m(x)
        assert mean.shape == var.shape == (4,) and (mean >= 0).all() and (np.abs(var) <= 8).all()
        assert np.array_equal(registry.build(name, channels=5, hidden=6, positive=True, weights=m.weights)(x)[0], mean)
    causal = registry.build("tcn", channels=5, hidden=6)
    late = x.copy()
    late[:, :, : 20 - causal.reach] = 0 if causal.reach < 20 else late[:, :, : 20 - causal.reach]
    assert np.allclose(causal(late)[0], causal(x)[0]) and causal.reach == 29
    with pytest.raises(ValueError):
        registry.build("gru", channels=4, hidden=6, weights=registry.build("gru", channels=5, hidden=6).weights)
    with pytest.raises(KeyError):
        registry.register("gru")(dict)


def test_chain_breaks_stops_and_resets():
    epoch = lambda ids, m2=0.0: matching.Epoch(ids, np.zeros(len(ids)), np.array([[100.0 * i, 0.0] for i in ids]).reshape(-1, 2), np.full(len(ids), m2), np.zeros(len(ids)))
    road = {(a, b): abs(a - b) * 100.0 for a in range(9) for b in range(9) if abs(a - b) < 3}
    chain = matching.Chain(matching.road_ways({k: (k, k, 1.0) for k in range(9)}, road))
    assert [chain.step(epoch([k, k + 1]), 100.0)[0] for k in range(3)] == ["matched"] * 3
    assert len(chain.path()) == 3
    assert chain.step(epoch([8]), 100.0)[0] == "matched" and chain.counts["breaks"] == 1 and chain.path() == [8]
    assert [chain.step(epoch([8], 99.0), 1.0)[0] for _ in range(2)] == ["implausible"] * 2 and chain.step(epoch([]), 1.0)[0] == "suspended"
    assert [chain.step(epoch([8]), 1.0)[0] for _ in range(3)] == ["suspended", "suspended", "matched"]
    chain.reset()
    assert not chain.kept and not chain.counts and not chain.suspended


def _geometry_holds() -> bool:
    """The facts of the conventions that the geometry must keep."""
    z = earth.turn(np.pi / 2)
    active = np.allclose(z @ [1, 0, 0], [0, 1, 0])
    small = np.allclose(earth.rotation(np.array([0, 0, 1e-12])), np.eye(3), atol=1e-11)
    order = np.allclose(earth.rotation_vector(earth.rotation(np.array([0.3, 0, 0])) @ z), earth.rotation_vector(earth.rotation(np.array([0.3, 0, 0])) @ earth.turn(np.pi / 2)))
    east = earth.moved(np.array([0.0, 0.5, 0.0]), np.array([100.0, 0.0, 0.0]))
    place = east[0] > 0 and abs(east[1] - 0.5) < 1e-12
    high = earth.scale(0.5, 1000.0)[1] - earth.scale(0.5, 0.0)[1] == pytest.approx(1000.0)
    down = earth.gravity(0.5, 0.0)[2] < -9.7 and earth.gravity(0.5, 1000.0)[2] > earth.gravity(0.5, 0.0)[2]
    spin = np.allclose(np.cross([1, 2, 3], [4, 5, 6]), earth.skew(np.array([1, 2, 3])) @ [4, 5, 6])
    return bool(active and small and order and place and high and down and spin)


def test_mutations_are_caught(monkeypatch):
    """Five bugs of convention, each of which the facts must notice."""
    assert _geometry_holds()
    rotation, skew, scale, gravity, moved = earth.rotation, earth.skew, earth.scale, earth.gravity, earth.moved
    bugs = {
        "rotation": lambda v: rotation(v).T, "skew": lambda v: skew(v).T, "scale": lambda lat, h: scale(lat, 0.0),
        "gravity": lambda lat, h: -gravity(lat, h), "moved": lambda place, m: moved(place, m[[1, 0, 2]]),
    }
    for name, bug in bugs.items():
        with monkeypatch.context() as m:
            m.setattr(earth, name, bug)
            assert not _geometry_holds(), name


def test_columns_are_exact_percentiles(spark):
    from wayline.operators import ranks

    r = np.random.default_rng(4)
    rows = [(g, float(x) if x > -1.5 else None) for g, n in ((1, 1000), (2, 1), (3, 7)) for x in r.normal(size=n).round(2)] + [(4, None)] + [(5, 1.0)] * 500 + [(5, 2.0)]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {r.g: r for r in ranks.percentiles(df, ["g"], {"a": ("x", 0.5), "b": ("x", 0.95), "c": ("x", 0.0), "d": ("x", 1.0)}).collect()}
    for g in (1, 2, 3, 4, 5):
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == sum(k == g for k, _ in rows)
        want = [None] * 4 if not x else np.percentile(x, [50, 95, 0, 100]).tolist()
        assert [got[g].a, got[g].b, got[g].c, got[g].d] == (want if not x else pytest.approx(want))
    placed = ranks.placed(df.withColumn("i", F.monotonically_increasing_id()), [F.col("x"), F.col("i")], "place", 5).collect()
    assert sorted(r.place for r in placed) == list(range(1, len(rows) + 1))
    known = [r.x for r in sorted(placed, key=lambda r: r.place) if r.x is not None]
    assert known == sorted(known)


def test_dataset_chain(spark):
    from wayline.operators import dataset, sync
    from wayline.plans import q_sync

    d = "/root/testdata/sf0.001"
    phone, vehicle, alignment = q_sync.phone(spark, d), q_sync.vehicle(spark, d), q_sync.alignment(spark, d)
    sessions = phone.select("session_id").distinct().selectExpr("session_id", "concat('d', session_id % 6) AS driver", "session_id AS drive_id", "1.0D + session_id % 3 AS hours")
    made = dataset.prepared(phone, vehicle, alignment, sessions, 1.25, ["acc_x_mps2", "gyro_z_radps"], q_sync.TOLERANCE, q_sync.BREAK)
    dataset.checked(made)
    assert {r.channel for r in made["statistics"].collect()} == {"acc_x_mps2", "gyro_z_radps"}
    assert set(made["synced"].columns) == {"row_idx", *sync.UNITS} and made["synced"].schema["gt_speed_mps"].metadata["unit"] == "m/s"
    with pytest.raises(dataset.GateError):
        dataset.checked(made | {"gate": made["gate"].withColumn("passes", F.lit(False))})


def test_assembly_degrades_visibly():
    import hashlib

    from wayline.streaming.assembly import GnssOnly, assembled
    from wayline.streaming.inertial import Fix
    from wayline.streaming.navigator import Engine

    report = {k: 1.0 for k in ("accel_white_noise_density", "gyro_white_noise_density", "accel_bias_sigma", "accel_bias_tau_s", "gyro_bias_sigma", "gyro_bias_tau_s")}
    data = b"model"
    right = hashlib.sha256(data).hexdigest()
    a = assembled(report, {"speed": (data, right, lambda b: lambda rows: (1.0, 1.0)), "accel": (data, "0" * 64, None)}, [b"r"])
    assert isinstance(a.engine, Engine) and list(a.engine.models) == ["speed"] and a.roads == b"r" and a.notes == ["model accel refused: not the one of its card"]
    b = assembled(None, None, [b"r", b"s"])
    assert isinstance(b.engine, GnssOnly) and b.roads is None and len(b.notes) == 2
    assert isinstance(assembled({}).engine, GnssOnly)
    b.engine.fix(Fix(1.0, 1.0, np.array([0.1, 0.5, 0.0]), 3.0))
    assert b.engine.position() == (0.5, 0.1)
    b.engine.time(99.0)
    assert b.engine.position() is None


def test_agreement_and_latency():
    a = np.array([1.0, 2.0])
    assert registry.agreement(a, a + 1e-6)["passes"] and not registry.agreement(a, a + 1e-3)["passes"]
    m = registry.build("cnn1d", channels=3, hidden=4)
    t = registry.latency(m, np.zeros((1, 3, 10)), runs=5, warmup=1)
    assert 0 < t["p50_ms"] <= t["p90_ms"]
    assert registry.smaller_batch(64, 16) == (32, False) and registry.smaller_batch(16, 16) == (16, True)


def test_files_by_session_and_over_time(spark, tmp_path):
    for name in ("S-V1a.csv", "V-V1a.csv", "notes.txt"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    first = logs.discover(spark, str(tmp_path)).collect()
    df = spark.createDataFrame(first)
    known, aside = logs.grouped(df)
    (row,) = known.collect()
    assert row.session == "V1a" and len(row.S) == len(row.V) == 1 and aside.count() == 1
    (tmp_path / "S-V1a.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "notes.txt").unlink()
    (tmp_path / "V-V2.csv").write_text("a\n")
    changes = {r.path.split("/")[-1]: r.what for r in logs.changed_files(df, logs.discover(spark, str(tmp_path))).collect()}
    assert changes == {"S-V1a.csv": "changed", "notes.txt": "gone", "V-V2.csv": "new"}


def test_turns_and_augmentation(spark):
    from wayline.functions import vectorised

    r = np.random.default_rng(1)
    for kind in vectorised.TURNS:
        m = vectorised.random_turn(r, kind, 0.2)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
        if kind in ("none", "yaw"):
            assert np.allclose(m[2], [0, 0, 1])
        if kind == "yaw_tilt":
            assert m[2, 2] >= np.cos(0.2) - 1e-9
    df = spark.createDataFrame([(k, [float(k), 2.0, 3.0] * 8) for k in (1, 1, 2)], "k long, v array<double>")
    a, b, c = (np.array(x.v).reshape(-1, 3) for x in vectorised.augmented(df, "v", 3, "full", noise=0.1, bias=0.5, jitter=2).orderBy("k").collect())
    assert np.array_equal(a, b) and not np.allclose(a[:, 1:], c[:, 1:]) and a.std(axis=0).max() < 0.3
    with pytest.raises(ValueError):
        vectorised.augmented(df, "v", 3, "up")
    with pytest.raises(ValueError):
        from wayline.operators import splits

        splits.only(spark.range(3).selectExpr("id AS session_id"), spark.range(2).selectExpr("id AS session_id"))
