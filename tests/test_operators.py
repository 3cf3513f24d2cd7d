"""Streams against batches, filters against simulated drives, matching against enumeration, sources."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from wayline.sources import logs
from wayline.streaming import machines, matching


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, t, (u * 7 + t * 13) % 100, 1000 * u + t) for u in range(5) for t in range(40)]
    df = spark.createDataFrame(rows, "user_id long, t long, k long, event_id long")
    for part in range(4):  # in order of time, a file a part
        df.where(f"t >= {part * 10} AND t < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step, schema = machines.gnss_step(3, 9, 50), "user_id long, event_id long, state string, streak long"
    batch = machines.over_batch(df, "user_id", ["t"], ["event_id", "t", "k"], machines.GNSS_START, step, schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = machines.over_stream(stream, "user_id", ["t"], ["event_id", "t", "k"], machines.GNSS_START, step, schema, "state string, streak long, last long")
    q = out.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("states").collect()) == sorted(batch.collect())


def test_matching_against_all_paths():
    r = np.random.default_rng(1)
    epochs = [(list(range(3)), r.normal(size=3)) for _ in range(5)]
    steps = [r.normal(size=(3, 3)) for _ in range(5)]
    steps[2][0, :] = -np.inf
    got = matching.match(epochs, lambda e, a, b: steps[e])
    score = lambda p: sum(epochs[e][1][s] for e, s in enumerate(p)) + sum(steps[e][p[e - 1], p[e]] for e in range(1, 5))
    paths = list(itertools.product(range(3), repeat=5))
    best = max(paths, key=score)
    assert [s for s, _ in got] == list(best)
    weights = np.exp([score(p) for p in paths])
    last = sum(w for p, w in zip(paths, weights) if p[-1] == best[-1]) / weights.sum()
    assert np.isclose(got[-1][1], last)
    broken = matching.match([*epochs[:2], ([], np.zeros(0)), *epochs[3:]], lambda e, a, b: steps[e])
    assert broken[2] == (None, 0.0) and broken[3][0] is not None


def test_matching_of_tables(spark):
    c = spark.createDataFrame([(1, e, s, -float(abs(s - e)), 1.0) for e in range(3) for s in range(3)], "trip long, epoch long, segment_id long, score double, moved double")
    r = spark.createDataFrame([(1, e, a, b, float(abs(a - b))) for e in range(3) for a in range(3) for b in range(3)], "trip long, epoch long, a long, b long, length double")
    assert [(x.epoch, x.segment_id) for x in matching.match_trajectories(c, r, "trip").orderBy("epoch").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_sources(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "S-V1a.csv").write_bytes(b"t,v\r\n1,2.5\r\nx,3\r\n,\r\n4,5,6\r\n")
    (root / "notes.txt").write_bytes(b"hello")
    found = {r.path.split("/")[-1]: (r.kind, r.session, r.length) for r in logs.discover(spark, str(root)).collect()}
    assert found == {"S-V1a.csv": ("S", "V1a", 27), "notes.txt": (None, None, 5)}
    assert {len(r.sha256) for r in logs.digests(spark, str(root)).collect()} == {64}
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])
    df = logs.read_csv(spark, str(root / "a" / "S-V1a.csv"), schema)
    assert [(r.t, r.v) for r in df.collect()] == [(1, 2.5), (None, 3.0), (None, None), (4, 5.0)]
    assert [(r.column, r.n_bad) for r in logs.parse_report(df).collect()] == [("t", 1)]
    audit = logs.raw_audit(spark, str(root / "a"), 2).collect()[0]
    assert (audit.n_rows, audit.n_ragged, audit.n_not_ascii) == (5, 1, 0)
    with pytest.raises(logs.SchemaError):
        logs.checked_header(["a"], ["a", "b"])
    with pytest.raises(logs.SchemaError):
        logs.guard_inputs(["gt_lat"], ["gt_lat"])
    out = str(tmp_path / "table")
    logs.write_table(df.drop("bad_cells", "extra_cells"), out, {"t": "s"}, {"meta": ["t"], "input": ["v"]})
    back = spark.read.parquet(out)
    assert back.schema["t"].metadata == {"unit": "s", "role": "meta"} and logs.inputs_of(back).columns == ["v"]
    with pytest.raises(logs.SchemaError):
        logs.write_table(df, out + "2", {}, {"meta": ["t"]})


def test_road_map(spark, tmp_path):
    (tmp_path / "m.osm").write_text("""<osm><node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.1" lon="2.0"/>
<way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="oneway" v="yes"/></way>
<way id="8"><nd ref="1"/><nd ref="2"/><tag k="highway" v="footway"/></way><way id="9"><nd ref="1"/><tag k="highway" v="primary"/></way></osm>""")
    nodes, ways = logs.read_ways(spark, str(tmp_path / "m.osm"))
    assert nodes.count() == 2 and [(w.way_id, w.refs, w.tags["oneway"]) for w in ways.collect()] == [(7, [1, 2], "yes")]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
