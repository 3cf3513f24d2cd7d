"""The training-corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads what it wrote. All but the last return the columns of documents, and any
others that docs has, whatever their names (the last one replaces columns called
token_ids or decoded_sha256).

Rows with null or empty text fail the quality rules. Near-duplicates are
documents whose sets of five-word shingles are similar at 0.8 or more; the least
doc_id of each group stays. Rows that repeat a doc_id count as one document, and
one of them stays; rows of a null doc_id are never near-duplicates and hold no
benchmark item. Very long texts pass whole through every stage. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import frames, op03_pii, op06_decontaminate, op07_minhash, op08_bpe, op10_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the target is what labels call good."""
    weight = op10_quality.weights(docs, op10_quality.target_ids(frames.table(spark, sf_dir, "labels")))
    return op10_quality.keep_good(docs, weight)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op07_minhash.keep_firsts(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return op06_decontaminate.keep_clean(docs, frames.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return op03_pii.mask_personal_data(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, without their text, and the digest of what the ids decode to."""
    return op08_bpe.encoded(docs, op08_bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]

#: SQL cannot express hashed ratios, MinHash, the field or BPE; tests/llm hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is written to the shared checkpoint folder."""
    docs = frames.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frames.written(docs)
    return docs
