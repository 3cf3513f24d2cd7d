"""Outages and routes beyond the sizes of the given tables, against plain versions."""

from wayline.operators import spatial
from wayline.plans import q_spatial as q


def test_outages_go_on_to_the_end_of_a_session(spark, tmp_path):
    ends = {1: 100 * q.DAY, 2: q.DAY, 3: q.DAY + 1, 4: 45 * q.DAY, 5: 45 * q.DAY + 1, 6: 0}
    rows = [(2 * u + k, t, u, "view", 1.0, '{"k": 1}') for u, end in ends.items() for k, t in enumerate((0, end))]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(timestamp_micros(t) as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    want = []
    for u, end in ends.items():
        k = 0
        while k * 4 * q.DAY + q.DAY < end:
            want.append((u, k, k * 4 * q.DAY, k * 4 * q.DAY + (6 * q.HOUR, 12 * q.HOUR, q.DAY)[k % 3]))
            k += 1
    assert sorted(map(tuple, q.outage_periodic(spark, str(tmp_path)).collect())) == want


def test_routes_of_many_short_edges(spark):
    spatial.checkpoints(spark)
    edges = spark.createDataFrame([(k, k + 1, 10.0) for k in range(70)] + [(0, 66, 665.0)], "a long, b long, w double")
    got = spatial.bounded_routes(edges, spark.createDataFrame([(0,)], "node_id long"), 670.0)
    assert sorted(map(tuple, got.collect())) == [(0, k, 10.0 * k) for k in range(68)]
