"""Global places and exact percentiles without one task for a group of any size.

Values are cut into ranges by approximate quantiles, a sketch of fixed size that
is merged on the way. Places within a range are counted in the task of that
range, and the sizes of the ranges before it, PARTS rows a group, are added.
Wherever the cuts fall, the places are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group.
PARTS = 64


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a group: by, n, and for each name the percentile (column, share), linear between the two values around it.

    n counts all rows; nulls have no place, and a column without values gives null.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x")).select(*by, "x.i", "x.v")
    group = [*by, "i"]
    # equal values are one row from here on, so a value that a third of all rows hold is no burden
    values = long.groupBy(*group, "v").agg(F.count("*").alias("c"))
    shares = F.array(*(F.lit(k / PARTS) for k in range(1, PARTS)))
    cuts = long.groupBy(*group).agg(F.percentile_approx("v", shares, F.lit(1000)).alias("cuts"), F.count("*").alias("n"), F.count("v").alias("total"))
    part = F.size(F.filter("cuts", lambda e: e < F.col("v")))
    cut = values.join(cuts, group).withColumn("part", F.when(F.col("v").isNull(), -1).otherwise(part))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut.groupBy(*group, "part").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("size")).select(*group, "part", before.alias("before"))
    w = Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("upto", F.sum("c").over(w)).join(sizes, [*group, "part"]).withColumn("last", F.col("before") + F.col("upto")).withColumn("first", F.col("last") - F.col("c"))
    out = [F.max("n").alias("n")]
    for name, (column, share) in wanted.items():
        at = F.lit(float(share)) * (F.col("total") - 1)
        mine = (F.col("i") == columns.index(column)) & F.col("v").isNotNull()
        value = lambda k, mine=mine: F.max(F.when(mine & (F.col("first") <= k) & (k < F.col("last")), F.col("v")))
        low, high = value(F.floor(at)), value(F.ceil(at))
        rest = F.max(F.when(mine, at - F.floor(at)))
        out.append((low + (high - low) * rest).alias(name))
    return placed.groupBy(*by).agg(*out)


def placed(df: DataFrame, order: list[Column], out: str, parts: int = PARTS) -> DataFrame:
    """df with the place of each row, from 1, in a total order.

    Rows are sorted into ranges once (checkpointed, so that both readers see the
    same ranges); each range adds the sizes of those before it.
    """
    from wayline.operators.spatial import checkpoints

    checkpoints(df.sparkSession)
    cut = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(out, (F.col("_r") + F.col("_before")).cast("long")).drop("_part", "_r", "_before")
