"""The pipeline against plain versions of its stages, and its shape."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from wayline.llm import op03_pii, op08_bpe, op10_quality
from tests.llm.test_op07_minhash import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    names = pq.read_schema(f"{SF}/documents.parquet").names
    assert all(df.columns == names for df in stages[:-1])
    assert stages[-1].columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "decoded_sha256"]


def plain_scores(texts, good):
    """Scores by dictionaries of 4-byte strings' buckets."""
    bucket = lambda g: (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 % 2**64) >> 49
    raw, target = np.zeros(op10_quality.BUCKETS), np.zeros(op10_quality.BUCKETS)
    grams = {}
    for i, t in texts.items():
        b = t.encode()
        grams[i] = [bucket(b[k : k + 4]) for k in range(len(b) - 3)]
        for g in grams[i]:
            raw[g] += 1
            target[g] += i in good
    base = (raw + 1) / (raw.sum() + len(raw))
    ratio = np.log((target + len(raw) * base) / (target.sum() + len(raw)) / base)
    return {i: float(np.mean(ratio[g])) if g else 0.0 for i, g in grams.items()}


def test_quality_stage(stages):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    texts = {d["doc_id"]: d["text"] for d in docs}
    good = {x["doc_id"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["quality"] == 1}
    score = plain_scores(texts, good)
    kept = set()
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = set()
        for k, x in enumerate(windows):
            if windows.count(x) > 1:
                again |= set(range(k, k + 8))
        if len(w) >= 20 and 100 * len(again) <= 30 * len(w) and score[i] >= op10_quality.THRESHOLD:
            kept.add(i)
    assert set(rows(stages[0])) == kept and 0 < len(kept) < len(texts)


def test_near_duplicate_stage(stages):
    before, after = rows(stages[0]), rows(stages[1])
    sets = {i: shingle_set(r.text) for i, r in before.items()}
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and similar(a, b) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert set(after) == set(group.values()) and all(after[i] == before[i] for i in after)


def test_decontamination_stage(stages):
    norm = lambda t: " ".join(t.split()).lower()
    items = [norm(x["text"]) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    before, after = rows(stages[1]), rows(stages[2])
    assert set(after) == {i for i, r in before.items() if not any(x in norm(r.text) for x in items)}


def test_masking_and_encoding_stages(stages):
    before, masked, ids = rows(stages[2]), rows(stages[3]), rows(stages[4])
    weights = op03_pii.known_weights()
    library = Tokenizer.from_file(op08_bpe.default_path())
    library.no_truncation()
    assert set(before) == set(masked) == set(ids)
    for i, r in before.items():
        assert masked[i].text == op03_pii.masked(r.text, weights) and not op03_pii.base_spans(masked[i].text)
        want = library.encode(masked[i].text, add_special_tokens=False).ids
        assert ids[i].token_ids == want
        assert ids[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_and_empty_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "the quick brown fox jumps over the lazy dog and then it runs home to eat some of the good food there"
    for name, data in (("a", [(None, None, None, None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, "", None, None, 0)]), ("b", [])):
        docs = spark.createDataFrame(data, schema)
        for _, f in corpus_pipeline.STAGES:
            f(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{f.__name__}"))
            if f is not corpus_pipeline.encoding:
                docs = spark.read.parquet(str(tmp_path / f"{name}{f.__name__}"))
        assert [r.doc_id for r in docs.collect()] == ([1] if data else [])  # a null fails the rules, a repeated row counts once


def test_clashing_names_and_long_texts(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    r = np.random.default_rng(5)
    long = " ".join(f"word{x}" for x in r.integers(0, 5000, 150_000))
    other = " ".join(f"word{x}" for x in r.integers(0, 5000, 300))
    docs = spark.createDataFrame([(1, long, "en", "s", 5), (2, long + " end", "en", "s", 5), (3, other, "en", "s", 5)], schema)
    docs = docs.selectExpr("*", "7 as gone", "8 as c0", "9 as component_id", "10 as kept", "11 as token_ids", "12 as _id")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert f is corpus_pipeline.encoding or docs.columns == before.columns
    assert {"gone", "c0", "component_id", "kept", "_id", "token_ids", "decoded_sha256"} <= set(docs.columns) and {r.doc_id for r in docs.collect()} <= {1, 3}


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])
