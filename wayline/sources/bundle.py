"""Big-endian road bundles: magic, version, node places, directed segments, tags as JSON."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"WLRB", 1


def pack(nodes: list[tuple[int, float, float]], segments: list[tuple[int, int, int]], tags: dict[str, dict[str, str]]) -> bytes:
    text = json.dumps(tags, sort_keys=True).encode()
    return b"".join([MAGIC, struct.pack(">HIII", VERSION, len(nodes), len(segments), len(text)), *(struct.pack(">qdd", *n) for n in nodes), *(struct.pack(">qqq", *s) for s in segments), text])


def unpack(data: bytes) -> tuple[list[tuple[int, float, float]], list[tuple[int, int, int]], dict]:
    """Raises on another magic or version, on a short file and on bytes after the end."""
    if data[:4] != MAGIC:
        raise ValueError("not a road bundle")
    version, n, s, size = struct.unpack_from(">HIII", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version}")
    at = 18
    if len(data) != at + 24 * (n + s) + size:
        raise ValueError("wrong length")
    nodes = list(struct.iter_unpack(">qdd", data[at : at + 24 * n]))
    segments = list(struct.iter_unpack(">qqq", data[at + 24 * n : at + 24 * (n + s)]))
    return nodes, segments, json.loads(data[at + 24 * (n + s) :])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Directed segments (path, way_id, a, b) of the bundles at path."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, w, a, b) for p, c in zip(pdf["path"], pdf["content"]) for w, a, b in unpack(bytes(c))[1]]
            yield pd.DataFrame(rows, columns=["path", "way_id", "a", "b"])

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInPandas(run, "path string, way_id long, a long, b long")
