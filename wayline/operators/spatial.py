"""Road-graph operators: segments, grid cells, candidates, routes, components.

Points meet segments over grid cells, an equi-join that grows with the points
and not with points times segments. Routes and components are iterations of
joins; between rounds the frontier is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder where none is set: spark.checkpoint.dir, or one below a warehouse that is shared.

    A cluster without spark.checkpoint.dir is refused if its warehouse is a local folder.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local") and (warehouse.startswith("/") or warehouse.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{warehouse.rstrip('/')}/_checkpoints"
    sc.setCheckpointDir(base)


def oneway(tag: Column, junction: Column, highway: Column) -> Column:
    """struct<forward,backward> that a way's tags allow."""
    only_forward = tag.isin("yes", "true", "1") | (tag.isNull() & (junction.isin("roundabout", "circular") | (highway == "motorway")))
    only_backward = tag.isin("-1", "reverse")
    return F.struct((~F.coalesce(only_backward, F.lit(False))).alias("forward"), (~F.coalesce(only_forward, F.lit(False))).alias("backward"))


def way_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed segments (way_id, a, b) between neighbouring known nodes of each way (way_id, refs, forward, backward)."""
    refs = ways.select("way_id", "forward", "backward", F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id"), "node_id", "left_semi")
    pairs = refs.withColumn("next", F.lead("node_id").over(Window.partitionBy("way_id").orderBy("pos"))).where("next IS NOT NULL")
    ahead = pairs.where("forward").select("way_id", F.col("node_id").alias("a"), F.col("next").alias("b"))
    return ahead.unionByName(pairs.where("backward").select("way_id", F.col("next").alias("a"), F.col("node_id").alias("b")))


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """All cells (i, j) of the box around two points."""
    side = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return F.flatten(F.transform(side(x0, x1), lambda i: F.transform(side(y0, y1), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def projected(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct<fraction,x,y,distance> of the nearest point on a segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length2, F.lit(0.0))))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(t.alias("fraction"), x.alias("x"), y.alias("y"), F.hypot(px - x, py - y).alias("distance"))


def candidates(points: DataFrame, segments: DataFrame, radius: float, cell: float) -> DataFrame:
    """points (point_id, px, py) with the segments (segment_id, ax, ay, bx, by) within radius, each once."""
    p = points.withColumn("c", F.explode(cells(F.col("px") - radius, F.col("py") - radius, F.col("px") + radius, F.col("py") + radius, cell)))
    s = segments.withColumn("c", F.explode(cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), cell)))
    met = p.join(s, "c").dropDuplicates(["point_id", "segment_id"])
    hit = met.withColumn("p", projected(*(F.col(n) for n in ("px", "py", "ax", "ay", "bx", "by"))))
    return hit.where(F.col("p.distance") <= radius).select("point_id", "segment_id", F.col("p.fraction").alias("fraction"), F.col("p.distance").alias("distance"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


#: Fixed values of matching: candidates kept, metres of the map's own error, a road's heading in radians, the speed from which a heading counts.
CANDIDATES, MAP_SIGMA, ROAD_HEADING, HEADING_SPEED = 12, 5.0, 0.3490658503988659, 2.0


def emissions(candidates: DataFrame, map_sigma: float = MAP_SIGMA, keep: int = CANDIDATES) -> DataFrame:
    """Candidates with m2, the squared Mahalanobis distance, and score, its log likelihood; the keep nearest of each point.

    candidates: point_id, segment_id, dx, dy (candidate less observation), the
    covariance of the observation cxx, cxy, cyy, and road_heading, heading,
    heading_sigma, speed. The heading counts from HEADING_SPEED on, as a von Mises term.
    """
    a, b, c = F.col("cxx") + map_sigma**2, F.col("cxy"), F.col("cyy") + map_sigma**2
    dx, dy = F.col("dx"), F.col("dy")
    m2 = (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b)
    kappa = 1 / (F.pow("heading_sigma", 2) + ROAD_HEADING**2)
    turn = F.when(F.col("heading").isNotNull() & (F.col("speed") >= HEADING_SPEED), kappa * (F.cos(F.col("road_heading") - F.col("heading")) - 1)).otherwise(0.0)
    out = candidates.withColumn("m2", m2).withColumn("score", -0.5 * F.col("m2") + turn)
    place = F.row_number().over(Window.partitionBy("point_id").orderBy(F.round("m2", 9), "segment_id"))
    return out.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")


def route_lengths(pairs: DataFrame, segments: DataFrame, routes: DataFrame) -> DataFrame:
    """pairs (from_segment, from_fraction, to_segment, to_fraction, cutoff, ...) with length, the way along permitted directions; null beyond the cutoff.

    segments: segment_id, a, b (its nodes), metres; routes: source, node, length, as
    bounded_routes gives them. Ahead on one segment the way is that part of it.
    """
    one = segments.select(F.col("segment_id").alias("from_segment"), F.col("b").alias("_out"), F.col("metres").alias("_m1"))
    two = segments.select(F.col("segment_id").alias("to_segment"), F.col("a").alias("_in"), F.col("metres").alias("_m2"))
    r = routes.select(F.col("source").alias("_out"), F.col("node").alias("_in"), F.col("length").alias("_mid"))
    p = pairs.join(one, "from_segment").join(two, "to_segment").join(r, ["_out", "_in"], "left")
    ahead = (F.col("from_segment") == F.col("to_segment")) & (F.col("to_fraction") >= F.col("from_fraction"))
    whole = (1 - F.col("from_fraction")) * F.col("_m1") + F.col("_mid") + F.col("to_fraction") * F.col("_m2")
    length = F.when(ahead, (F.col("to_fraction") - F.col("from_fraction")) * F.col("_m1")).when(whole <= F.col("cutoff"), whole)
    return p.select(*pairs.columns, length.alias("length"))


def ways_of(df: DataFrame, segments: DataFrame, ways: DataFrame) -> DataFrame:
    """df (segment_id, ...) with the way and its tags; a way without tags has null."""
    return df.join(segments.select("segment_id", "way_id"), "segment_id", "left").join(ways.select("way_id", "tags"), "way_id", "left")


def save_roads(path: str, nodes: DataFrame, segments: DataFrame, ways: DataFrame) -> None:
    """The graph as three tables below a folder."""
    for name, df in (("nodes", nodes), ("segments", segments), ("ways", ways)):
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")


def load_roads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "segments", "ways"))


def bounded_routes(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """Shortest lengths (source, node, length) up to cutoff over edges (a, b, w > 0), by relaxation until nothing changes."""
    known = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0.0).alias("length"))
    frontier = known
    while True:
        step = frontier.join(edges, frontier["node"] == edges["a"]).select("source", F.col("b").alias("node"), (F.col("length") + F.col("w")).alias("length"))
        step = step.where(F.col("length") <= cutoff).groupBy("source", "node").agg(F.min("length").alias("length"))
        old = known.withColumnRenamed("length", "old")
        better = step.join(old, ["source", "node"], "left").where("old IS NULL OR length < old - 1e-9").select("source", "node", "length").checkpoint()
        if better.isEmpty():
            return known
        known = known.unionByName(better).groupBy("source", "node").agg(F.min("length").alias("length")).checkpoint()
        frontier = better


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the least node reachable, by least-label rounds."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("least"))
        after = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "least").alias("component"), (F.col("least") < F.col("component")).alias("moved")).checkpoint()
        # a label's own label: halves long paths
        jump = after.select(F.col("node").alias("via"), F.col("component").alias("to"))
        label = after.join(jump, after["component"] == jump["via"]).select("node", F.col("to").alias("component")).checkpoint()
        if after.where("moved").isEmpty():
            return label
