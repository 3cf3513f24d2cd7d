"""Road-graph, simulation and scoring queries; nations make a grid of roads, 100 m apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import ranks, spatial
from wayline.plans.catalog import query
from wayline.plans.tables import events, table

_NODES = "n AS (SELECT n_nationkey AS node_id, CAST(n_nationkey % 5 * 100 AS DOUBLE) AS x, CAST(n_nationkey // 5 * 100 AS DOUBLE) AS y FROM nation)"
_EDGES = f"{_NODES}, s AS (SELECT CAST(a.node_id * 100 + b.node_id AS BIGINT) AS segment_id, a.node_id AS a, b.node_id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM n a JOIN n b ON abs(a.x - b.x) + abs(a.y - b.y) = 100)"
_POINTS = "p AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 4000) / 10.0 AS px, (c_custkey * 91 % 4000) / 10.0 AS py FROM customer)"


def _nodes(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("node_id"), (k % 5 * 100).cast("double").alias("x"), (F.floor(k / 5) * 100).cast("double").alias("y"))


def _segments(spark, d) -> DataFrame:
    """Neighbours by shifts of the node number: no node meets all others."""
    a = _nodes(spark, d).select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*map(F.lit, (-5, -1, 1, 5)))).alias("shift")).withColumn("b", F.col("a") + F.col("shift"))
    b = _nodes(spark, d).select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    s = a.join(b, "b").where("abs(ax - bx) + abs(ay - by) = 100")
    return s.select((F.col("a") * 100 + F.col("b")).cast("long").alias("segment_id"), "a", "b", "ax", "ay", "bx", "by")


def _points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("point_id"), (k * 37 % 4000 / 10.0).alias("px"), (k * 91 % 4000 / 10.0).alias("py"))


@query("way_segments", f"WITH {_NODES}, w AS (SELECT r_regionkey AS way_id, node_id, lead(node_id) OVER (PARTITION BY r_regionkey ORDER BY node_id) AS nxt FROM region JOIN n ON node_id // 5 = r_regionkey WHERE node_id <> 7) SELECT way_id, node_id AS a, nxt AS b FROM w WHERE nxt IS NOT NULL AND way_id <> 1 UNION ALL SELECT way_id, nxt, node_id FROM w WHERE nxt IS NOT NULL AND way_id <> 2")
def way_segments(spark, d):
    r = F.col("r_regionkey")
    tag = F.when(r == 1, "-1").when(r == 2, "yes")
    flags = spatial.oneway(tag, F.lit(None).cast("string"), F.lit("residential"))
    refs = F.sequence((r * 5).cast("int"), (r * 5 + 4).cast("int"))
    ways = table(spark, d, "region").select(r.alias("way_id"), refs.alias("refs"), flags.forward.alias("forward"), flags.backward.alias("backward"))
    return spatial.way_segments(ways, _nodes(spark, d).where("node_id <> 7"))


@query("oneway_expand", "SELECT p_partkey, NOT coalesce(p_brand = 'Brand#2', false) AS forward, NOT coalesce(p_brand = 'Brand#1' OR (p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type = 'ECONOMY'), false) AS backward FROM part")
def oneway_expand(spark, d):
    tag = F.when(F.col("p_brand") == "Brand#1", "yes").when(F.col("p_brand") == "Brand#2", "reverse").when(F.col("p_brand") == "Brand#3", "no")
    f = spatial.oneway(tag, F.lit(None).cast("string"), F.when(F.col("p_type") == "ECONOMY", "motorway").otherwise("primary"))
    return table(spark, d, "part").select("p_partkey", f.forward.alias("forward"), f.backward.alias("backward"))


@query("grid_cells", f"WITH {_EDGES} SELECT segment_id, i, j FROM s, range(-1, 10) a(i), range(-1, 10) b(j) WHERE i BETWEEN floor(least(ax, bx) / 50) AND floor(greatest(ax, bx) / 50) AND j BETWEEN floor(least(ay, by_) / 50) AND floor(greatest(ay, by_) / 50)")
def grid_cells(spark, d):
    c = spatial.cells(*(F.col(n) for n in ("ax", "ay", "bx", "by")), 50.0)
    return _segments(spark, d).select("segment_id", F.inline(c))


_T = "greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / 10000.0))"
_DIST = f"sqrt(pow(px - ax - {_T} * (bx - ax), 2) + pow(py - ay - {_T} * (by_ - ay), 2))"


@query("spatial_candidates", f"WITH {_EDGES}, {_POINTS} SELECT point_id, segment_id, round({_T}, 6) AS fraction, round({_DIST}, 6) AS distance FROM p, s WHERE {_DIST} <= 30")
def spatial_candidates(spark, d):
    c = spatial.candidates(_points(spark, d), _segments(spark, d), 30.0, 50.0)
    return c.select("point_id", "segment_id", F.round("fraction", 6).alias("fraction"), F.round("distance", 6).alias("distance"))


_CXY = "(point_id % 4) * 4 - 4"
_H, _HS, _SP = "(point_id % 63) / 10.0 - 3.1", "0.1 + (point_id % 3) / 10.0", "point_id % 5"
_RH = "atan2(by_ - ay, bx - ax)"
_M2 = f"((61.0 * dx * dx - 2 * ({_CXY}) * dx * dy + 50.0 * dy * dy) / (50.0 * 61.0 - ({_CXY}) * ({_CXY})))"
_EMIT = f"c AS (SELECT point_id, segment_id, ax + {_T} * (bx - ax) - px AS dx, ay + {_T} * (by_ - ay) - py AS dy, {_RH} AS rh FROM p, s WHERE {_DIST} <= 60), m AS (SELECT *, {_M2} AS m2 FROM c)"


def _emitted(spark, d):
    """Candidates within 60 m with a covariance, a heading and a speed for each point."""
    seg, points = _segments(spark, d), _points(spark, d)
    c = spatial.candidates(points, seg, 60.0, 50.0).join(points, "point_id").join(seg, "segment_id")
    n = F.col("point_id")
    heading = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    return c.select("point_id", "segment_id", "fraction", "x", "y", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"), F.lit(25.0).alias("cxx"), (n % 4 * 4 - 4).cast("double").alias("cxy"), F.lit(36.0).alias("cyy"), heading.alias("road_heading"), (n % 63 / 10.0 - 3.1).alias("heading"), (0.1 + n % 3 / 10.0).alias("heading_sigma"), (n % 5).cast("double").alias("speed"))


@query("emission_scores", f"WITH {_EDGES}, {_POINTS}, {_EMIT} SELECT point_id, segment_id, round(m2, 6) AS m2, round(-0.5 * m2 + CASE WHEN {_SP} >= 2 THEN (cos(rh - ({_H})) - 1) / (pow({_HS}, 2) + {spatial.ROAD_HEADING**2!r}) ELSE 0 END, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(m2, 9), segment_id) <= 12")
def emission_scores(spark, d):
    """The twelve nearest candidates by Mahalanobis distance, with the term of the heading."""
    e = spatial.emissions(_emitted(spark, d))
    return e.select("point_id", "segment_id", F.round("m2", 6).alias("m2"), F.round("score", 6).alias("score"))


@query("route_lengths", f"WITH RECURSIVE {_EDGES}, r AS (SELECT node_id AS source, node_id AS node, 0 AS length FROM n UNION SELECT r.source, s.b, r.length + 100 FROM r JOIN s ON s.a = r.node WHERE r.length + 100 <= 300), d AS (SELECT source, node, min(length) AS length FROM r GROUP BY ALL), q AS (SELECT o_orderkey AS k, (o_orderkey % 10) / 10.0 AS f, (o_custkey % 10) / 10.0 AS g, o_orderkey * 7 % (SELECT count(*) FROM s) AS i, o_custkey * 11 % (SELECT count(*) FROM s) AS j FROM orders), t AS (SELECT *, row_number() OVER (ORDER BY segment_id) - 1 AS i FROM s) SELECT k, round(CASE WHEN x.segment_id = y.segment_id AND g >= f THEN (g - f) * 100 WHEN (1 - f) * 100 + d.length + g * 100 <= 350 THEN (1 - f) * 100 + d.length + g * 100 END, 6) AS length FROM q JOIN t x ON x.i = q.i JOIN t y ON y.i = q.j LEFT JOIN d ON d.source = x.b AND d.node = y.a")
def route_lengths(spark, d):
    """Ways between points on segments, of at most 350 m; ahead on one segment straight on."""
    spatial.checkpoints(spark)
    seg = _segments(spark, d)
    routes = spatial.bounded_routes(seg.select("a", "b", F.lit(100.0).alias("w")), _nodes(spark, d), 300.0)
    numbered = ranks.placed(seg.select("segment_id"), [F.col("segment_id")], "i", 4)
    count = seg.agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(F.broadcast(count)).select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 10 / 10.0).alias("from_fraction"), (F.col("o_custkey") % 10 / 10.0).alias("to_fraction"), (F.col("o_orderkey") * 7 % F.col("n") + 1).alias("i"), (F.col("o_custkey") * 11 % F.col("n") + 1).alias("j"), F.lit(350.0).alias("cutoff"))
    pairs = o.join(numbered.withColumnRenamed("segment_id", "from_segment"), "i").join(numbered.select(F.col("segment_id").alias("to_segment"), F.col("i").alias("j")), "j")
    return spatial.route_lengths(pairs, seg.withColumn("metres", F.lit(100.0)), routes).select("k", F.round("length", 6).alias("length"))


@query("way_tags", f"WITH {_EDGES} SELECT segment_id, b % 3 AS way_id, CASE WHEN b % 3 < 2 THEN 'road ' || b % 3 END AS name FROM s")
def way_tags(spark, d):
    """The way of a segment and its tags; way 2 has none."""
    seg = _segments(spark, d).withColumn("way_id", F.col("b") % 3)
    ways = spark.range(2).select(F.col("id").alias("way_id"), F.create_map(F.lit("name"), F.concat(F.lit("road "), F.col("id").cast("string"))).alias("tags"))
    return spatial.ways_of(seg.select("segment_id"), seg, ways).select("segment_id", "way_id", F.col("tags")["name"].alias("name"))


@query("matcher_rate", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
o AS (SELECT *, row_number() OVER w AS n, coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(k - lag(k) OVER w, 2)), 0) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
r AS (SELECT user_id, event_id, n, t_us, t_us AS last, true AS emitted, CAST(NULL AS DOUBLE) AS travelled, 0e0 AS way FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.n, o.t_us, CASE WHEN o.t_us - r.last >= 86400000000 THEN o.t_us ELSE r.last END, o.t_us - r.last >= 86400000000, CASE WHEN o.t_us - r.last >= 86400000000 THEN r.way + o.step END, CASE WHEN o.t_us - r.last >= 86400000000 THEN 0 ELSE r.way + o.step END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, round(travelled, 5) AS travelled FROM r WHERE emitted""")
def matcher_rate(spark, d):
    """At most one emission a day, each with the way of all samples since the last."""
    from wayline.streaming import machines as m

    out = m.over_batch(events(spark, d), "user_id", ["t_us", "event_id"], ["event_id", "t_us", "value", "k"], m.RATE_START, m.rate_step(86_400_000_000), "user_id long, event_id long, emitted boolean, travelled double")
    return out.where("emitted").select("event_id", F.round("travelled", 5).alias("travelled"))


@query("matched_trips", "SELECT i AS trip, true AS all_on_road, true AS sure, 1::BIGINT AS n_suspensions FROM range(0, 4) t(i)")
def matched_trips(spark, d):
    """Noisy trips along known roads, with a stretch far off all of them: matched on their road, suspended off it, and sure again after it."""
    from wayline.streaming import matching

    seg = _segments(spark, d)
    t = spark.range(4).select(F.col("id").alias("trip"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(35).cast("long"))).alias("epoch"))
    off = F.col("epoch").between(12, 19)
    wobble = lambda k: (F.pmod(F.xxhash64("trip", "epoch", F.lit(k)), F.lit(1000)) / 1000.0 - 0.5) * 8
    points = t.select("trip", "epoch", (F.col("trip") * 1000 + F.col("epoch")).alias("point_id"), (F.col("epoch") * 11.0 + wobble(1)).alias("px"), (F.col("trip") * 100.0 + F.when(off, 5000.0).otherwise(0.0) + wobble(2)).alias("py"))
    c = spatial.candidates(points.select("point_id", "px", "py"), seg, 40.0, 50.0).join(points, "point_id", "right").join(seg, "segment_id", "left")
    heading = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    c = c.select("trip", "epoch", "point_id", "segment_id", "fraction", "x", "y", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"), F.lit(9.0).alias("cxx"), F.lit(0.0).alias("cxy"), F.lit(9.0).alias("cyy"), heading.alias("road_heading"), F.lit(0.0).alias("heading"), F.lit(0.1).alias("heading_sigma"), F.lit(11.0).alias("speed"), F.lit(11.0).alias("travelled"), (F.col("ay") == F.col("by")).alias("east"))
    spatial.checkpoints(spark)
    routes = spatial.bounded_routes(seg.select("a", "b", F.lit(100.0).alias("w")), _nodes(spark, d), 300.0)
    out = matching.match_online(spatial.emissions(c), seg.withColumn("metres", F.lit(100.0)), routes, "trip")
    m = out.join(seg.select(F.col("segment_id"), "ay", "by"), "segment_id", "left")
    road = (F.col("ay") == F.col("trip") * 100) & (F.col("by") == F.col("trip") * 100)
    g = m.groupBy("trip").agg(F.bool_and(road | (F.col("mode") != "matched")).alias("all_on_road"), (F.min(F.when((F.col("mode") == "matched") & (F.col("epoch") > 25), F.col("confidence"))) > 0.9).alias("sure"), F.max("suspensions").alias("n_suspensions"))
    return g


@query("bounded_routes", f"WITH RECURSIVE {_EDGES}, r AS (SELECT node_id AS source, node_id AS node, 0 AS length FROM n UNION SELECT r.source, s.b, r.length + 100 FROM r JOIN s ON s.a = r.node WHERE r.length + 100 <= 300) SELECT source, node, CAST(min(length) AS DOUBLE) AS length FROM r GROUP BY ALL")
def bounded_routes(spark, d):
    spatial.checkpoints(spark)
    edges = _segments(spark, d).select("a", "b", F.lit(100.0).alias("w"))
    return spatial.bounded_routes(edges, _nodes(spark, d), 300.0)


@query("connected_drives", "WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, lead(o_orderkey) OVER w AS nk, lead(o_orderdate) OVER w AS nd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), g AS (SELECT *, lag(o_orderdate) OVER w AS pd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), h AS (SELECT *, sum(CASE WHEN pd IS NULL OR date_diff('day', pd, o_orderdate) > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, run) AS component FROM h QUALIFY count(*) OVER (PARTITION BY o_custkey, run) > 1")
def connected_drives(spark, d):
    """Orders of a customer at most 100 days after the one before belong together."""
    spatial.checkpoints(spark)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), F.datediff(F.lead("o_orderdate").over(w), F.col("o_orderdate")).alias("gap"))
    return spatial.connected(o.where("b IS NOT NULL AND gap <= 100").select("a", "b"))


# ------------------------------------------------------------------ outages and scores

DAY, HOUR = 86_400_000_000, 3_600_000_000
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("outage_periodic", f"WITH {_E}, s AS (SELECT user_id, min(t_us) AS a, max(t_us) AS b FROM e GROUP BY 1) SELECT user_id, i AS outage, a + i * {4 * DAY} AS start_us, a + i * {4 * DAY} + CASE i % 3 WHEN 0 THEN {6 * HOUR} WHEN 1 THEN {12 * HOUR} ELSE {DAY} END AS end_us FROM s, range(0, 10) t(i) WHERE a + i * {4 * DAY} + {DAY} < b")
def outage_periodic(spark, d):
    """An outage every four days with cycling lengths, while the longest fits before the session's end."""
    s = events(spark, d).groupBy("user_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    last = F.floor((F.col("b") - F.col("a") - DAY) / (4 * DAY))
    s = s.where(F.col("a") + DAY < F.col("b")).select("user_id", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("outage"))
    start = F.col("a") + F.col("outage") * 4 * DAY
    length = F.when(F.col("outage") % 3 == 0, 6 * HOUR).when(F.col("outage") % 3 == 1, 12 * HOUR).otherwise(DAY)
    return s.where(start + DAY < F.col("b")).select("user_id", "outage", start.alias("start_us"), (start + length).alias("end_us"))


@query("outage_apply", f"WITH {_E}, s AS (SELECT user_id, min(t_us) AS a FROM e GROUP BY 1) SELECT e.event_id, (e.t_us - a) % {4 * DAY} < {DAY} AS withheld, CASE WHEN (e.t_us - a) % {4 * DAY} < {DAY} THEN NULL WHEN (e.t_us - a) % {4 * DAY} < {2 * DAY} THEN e.k * 3 ELSE e.k END AS accuracy FROM e JOIN s ON e.user_id = s.user_id")
def outage_apply(spark, d):
    """Fixes inside an outage are withheld; for a day after it accuracy is three times worse."""
    e = events(spark, d).withColumn("a", F.min("t_us").over(Window.partitionBy("user_id")))
    phase = (F.col("t_us") - F.col("a")) % (4 * DAY)
    return e.select("event_id", (phase < DAY).alias("withheld"), F.when(phase < DAY, None).when(phase < 2 * DAY, F.col("k") * 3).otherwise(F.col("k")).alias("accuracy"))


@query("event_scoring", f"WITH {_E}, o AS (SELECT event_id AS outage_id, user_id, t_us AS a, coalesce(lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id), 9e18::BIGINT) AS b FROM e WHERE event_type = 'error') SELECT outage_id, count(e.event_id) AS n, max(e.value) AS worst, min(CASE WHEN e.value < 20 THEN e.t_us - a END) AS reconverged_us FROM o LEFT JOIN e ON e.user_id = o.user_id AND e.t_us > a AND e.t_us < b GROUP BY outage_id")
def event_scoring(spark, d):
    """What follows each error of a user before the next one: rows, worst value, time to a value under 20."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("event_type") == "error"
    e = events(spark, d).withColumn("o", F.last(F.when(bad, F.struct("event_id", "t_us")), ignorenulls=True).over(w)).where("o IS NOT NULL")
    g = e.groupBy(F.col("o.event_id").alias("outage_id"))
    return g.agg(F.count_if(~bad).alias("n"), F.max(F.when(~bad, F.col("value"))).alias("worst"), F.min(F.when(~bad & (F.col("value") < 20), F.col("t_us") - F.col("o.t_us"))).alias("reconverged_us"))


@query("confidence_bins", "SELECT CAST(floor(l_discount * 100 + 1e-6) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def confidence_bins(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_discount") * 100 + 1e-6).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_returnflag") == "N").cast("double")), 6).alias("share"))
