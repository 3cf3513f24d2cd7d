"""Sources and sinks of sensor logs: discovery, typed CSV, validation, digests, Parquet with units.

Schemas are fixed, never inferred: a header must map position by position, or
the read is refused. Reading and judging files is distributed; the driver sees
file names and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.text import file_meta


#: Cells beyond the last column that are kept.
EXTRA = 8


class SchemaError(ValueError):
    """A header or a set of columns that is not the agreed one."""


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files below root: path, length, modified, kind and session; unknown names have nulls and are not fatal."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", "length", F.col("modificationTime").alias("modified"), file_meta(F.col("path")).alias("m")).select("path", "length", "modified", "m.kind", "m.session")


def grouped(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discovered files by session: (session, the paths of each kind), and those whose names say nothing, which are set aside."""
    known = files.where("kind IS NOT NULL AND session IS NOT NULL")
    paths = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("path")))).alias(kind)
    return known.groupBy("session").agg(paths("S"), paths("V")), files.where("kind IS NULL OR session IS NULL").select("path", "length")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, length, modified) that are gone, new, or not of the length and time they had."""
    old = before.select("path", F.col("length").alias("l0"), F.col("modified").alias("m0"))
    both = after.select("path", "length", "modified").join(old, "path", "full")
    what = F.when(F.col("length").isNull(), "gone").when(F.col("l0").isNull(), "new").when((F.col("length") != F.col("l0")) | (F.col("modified") != F.col("m0")), "changed")
    return both.select("path", what.alias("what")).where("what IS NOT NULL")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """path and SHA-256 of the bytes of each file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", F.sha2("content", 256).alias("sha256"))


def checked_header(found: list[str], expected: list[str]) -> None:
    """Raises SchemaError unless the header is the expected one, name by name."""
    if len(found) != len(expected):
        raise SchemaError(f"{len(found)} columns, expected {len(expected)}")
    wrong = [(a, b) for a, b in zip(found, expected) if a.strip().lower() != b.lower()]
    if wrong:
        raise SchemaError(f"unexpected columns: {wrong}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", accepted: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Typed rows of CSV files; a cell that does not parse is null and named in bad_cells, cells beyond the last column are kept in extra_cells.

    accepted: for each column the header keys it may have; every file's header must
    map, position by position, or the read is refused.
    """
    if accepted is not None:
        _check_headers(spark, path, [(f.name, keys) for f, keys in zip(schema, accepted, strict=True)], encoding)
    more = [f"_extra{k}" for k in range(EXTRA)]
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*(f.name for f in schema), *more]])
    raw = spark.read.csv(path, schema=text, header=True, encoding=encoding, enforceSchema=True, mode="PERMISSIVE")
    raw = raw.withColumn("extra_cells", F.filter(F.array(*more), lambda x: x.isNotNull()))
    typed = {f.name: F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})") for f in schema}
    bad = F.filter(F.array(*(F.when(typed[f.name].isNull() & (F.trim(f.name) != ""), F.lit(f.name)) for f in schema)), lambda x: x.isNotNull())
    return raw.select(*(c.alias(n, metadata=schema[n].metadata) for n, c in typed.items()), bad.alias("bad_cells"), "extra_cells")


def _check_headers(spark: SparkSession, path: str, agreed: list[tuple[str, tuple[str, ...]]], encoding: str) -> None:
    """Raises unless the header of every file maps; distinct headers are few, and only they come to the driver."""
    from wayline.sources import headers

    heads = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.decode(F.substring(F.substring_index(F.col("content").cast("string"), "\n", 1).cast("binary"), 1, 1 << 16), "ISO-8859-1").alias("head"))
    for (head,) in heads.distinct().collect():
        raw = (head or "").rstrip("\r").encode("latin-1")
        headers.mapped(headers.first_line(raw, "cp1252" if encoding.upper() == "UTF-8" else encoding), agreed)


def parse_report(df: DataFrame) -> DataFrame:
    """Bad cells by column."""
    return df.select(F.explode("bad_cells").alias("column")).groupBy("column").agg(F.count("*").alias("n_bad"))


def raw_audit(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Per file: rows, ragged rows and rows with bytes beyond ASCII, without parsing it."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"))
    ragged = F.size(F.split("value", ",")) != columns
    return lines.groupBy("path").agg(F.count("*").alias("n_rows"), F.count_if(ragged).alias("n_ragged"), F.count_if(F.col("value").rlike(r"[^\x00-\x7F]")).alias("n_not_ascii"))


def write_table(df: DataFrame, path: str, units: dict[str, str], roles: dict[str, list[str]], partition: str | None = None) -> None:
    """Parquet with a unit and role in each column's metadata; refuses other columns than the roles name."""
    role_of = {c: r for r, names in roles.items() for c in names}
    if set(role_of) != set(df.columns):
        raise SchemaError(f"columns differ from the roles: {sorted(set(role_of) ^ set(df.columns))}")
    out = df
    for c in df.columns:
        out = out.withMetadata(c, {"unit": units.get(c, ""), "role": role_of[c]})
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def inputs_of(df: DataFrame, role: str = "input") -> DataFrame:
    """The columns of one role."""
    return df.select(*(f.name for f in df.schema if f.metadata.get("role") == role))


def guard_inputs(columns: list[str], allowed: list[str], forbidden: tuple[str, ...] = ("gt_", "wheel", "can_", "vbox")) -> None:
    """Raises where an input is undeclared or names ground truth."""
    bad = [c for c in columns if c not in allowed or any(x in c for x in forbidden)]
    if bad:
        raise SchemaError(f"not inputs: {bad}")


def read_ways(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of a road map in XML: drivable highways with two nodes or more, tags as a map."""
    node = "_id long, _lat double, _lon double"
    way = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path).select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat_deg"), F.col("_lon").alias("lon_deg"))
    ways = spark.read.format("xml").option("rowTag", "way").schema(way).load(path)
    tags = F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"])))
    ways = ways.select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tags.alias("tags"))
    drivable = F.col("tags")["highway"].isin("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street")
    open_ = (F.coalesce(F.col("tags")["area"], F.lit("no")) != "yes") & (F.coalesce(F.col("tags")["access"], F.lit("yes")) != "no")
    return nodes, ways.where(drivable & open_ & (F.size("refs") >= 2))


def write_session(df: DataFrame, path: str, checkpoint: str, partition: str = "session_id"):
    """A streaming sink of session rows as CSV, one folder a session, each row exactly once."""
    return df.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).partitionBy(partition).trigger(availableNow=True).outputMode("append").start()
