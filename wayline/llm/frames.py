"""Small helpers shared by the operators: reading tables, passing batches, sizing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.operators.spatial import checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text and the named columns, so that no other column can clash with a result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """Each Arrow batch of df to a batch of schema; make returns arrays by column name."""
    names = schema.names if isinstance(schema, StructType) else [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = make(b)
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], (pa.Array, pa.ChunkedArray)) else pa.array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows of df that keep marks, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(keep(b))

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir where it is set.

    In a session without that setting (tests, one machine) a folder below the
    warehouse is set once; a cluster with a local warehouse is refused.
    """
    checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: a later failure recomputes nothing before it.

    The table goes when the session ends, or with dropped().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and no later step reads."""
    for t in tables:
        hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written)
        hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_bytes(docs: DataFrame) -> int:
    """The bytes of all texts of docs, from one pass over that column."""
    return int(docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).head()[0] or 0)
