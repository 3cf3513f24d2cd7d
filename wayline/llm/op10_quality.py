"""Quality rules: base counts per document and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams: a trusted target
and the raw corpus. A document's score is the sum of log(target / raw) over its
n-grams, divided by their number, so that long and short texts compare. It is
kept if it passes the base rules and its score is at or above the threshold.

Raw counts cover every document and target counts every trusted one: documents
meet the trusted ids in a join, and one pass over the texts counts both. What is
sent to executors has a fixed size, 8 bytes per bucket.

Null text counts as empty; an empty text fails the base rules and scores 0. An
empty table returns no rows. Repeated rows are judged one by one. Without any
trusted document every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import frames
from wayline.llm.words import TRAILING, Words, classes, covered, repeated, slices, span_hashes, sums

#: Bytes of an n-gram, buckets, the least score of a kept document.
NGRAM, BUCKETS, THRESHOLD = 4, 1 << 15, -0.3
#: Weights are whole multiples of 1 / UNIT: sums of them are exact in any order and any batch.
UNIT = 1 << 20

#: Sets the keys of different texts apart.
_TEXT = np.uint64(0xD6E8FEB86659FD93)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def grams(data: np.ndarray, cut: np.ndarray, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram within a text, and the offsets of the texts in them."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(len(cut), np.int64)
    v = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        v |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    h = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    inside = np.ones(len(h), bool)
    for k in range(1, n):  # those that reach into the next text
        edge = cut[1:-1] - k
        inside[edge[(edge >= 0) & (edge < len(h))]] = False
    at = np.zeros(len(h) + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    return h[inside], at[np.minimum(cut, len(h))]


def target_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids (doc_id) of all documents labelled good."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket in units of 1 / UNIT, from one pass over all documents; trusted has distinct ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            mine = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, w in slices(b.column(0)):
                g, at = grams(w.data, w.cut)
                raw += np.bincount(g, minlength=buckets)
                for k in np.flatnonzero(mine[i:j]):
                    good += np.bincount(g[at[k] : at[k + 1]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(good[some]), pa.array(raw[some])], names=["bucket", "good", "raw"])

    known = trusted.select(F.col("doc_id").alias("trusted_id")).hint("shuffle_hash")  # the ids grow with the corpus; texts are not sorted
    marked = frames.texts(docs).join(known, F.col("doc_id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("good"))
    rows = marked.mapInArrow(count, "bucket int, good long, raw long").groupBy("bucket").agg(F.sum("good"), F.sum("raw")).collect()
    good, raw = np.zeros(buckets), np.zeros(buckets)
    for k, g, r in rows:
        good[k], raw[k] = g, r
    if not good.sum():
        return np.zeros(buckets, np.int64)
    return to_weights(good, raw)


def to_weights(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratios of the counts; the target is smoothed towards the raw corpus, so a small target says little."""
    base = (raw + 1) / (raw.sum() + len(raw))
    ratio = np.log((good / base + len(raw)) / (good.sum() + len(raw)))
    return np.rint(ratio * UNIT).astype(np.int64)


def judge(texts: pa.Array, weight: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """All columns of SCHEMA but doc_id, for each text."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")}
    for _, _, w in slices(texts):
        total = len(w.starts)
        head = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(~TRAILING[w.data], out=head[1:])
        out["n_words"].append(w.n)
        out["word_chars"].append(sums(head[w.ends] - head[w.starts], w.first))
        out["n_symbols"].append(sums(_SYMBOL[w.data], w.cut))
        at, h = w.windows(8)
        text = w.text_of_word()
        out["n_repeat_words"].append(sums(covered(_twice(w, at, h, text), 8, total), w.first))
        out["n_dup_lines"].append(_dup_lines(w))
        g, cut = grams(w.data, w.cut)
        n = np.diff(cut)
        out["score"].append(sums(weight[g], cut) / np.maximum(n, 1) / UNIT)
    done = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    done["score"] = done["score"].astype(float)
    done["base_failed"] = (done["n_words"] < 20) | (100 * done["n_repeat_words"] > 30 * done["n_words"])
    done["kept"] = ~done["base_failed"] & (done["score"] >= threshold)
    return done


def _twice(w: Words, at: np.ndarray, h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The starts, among at, of windows of eight words that are there twice or more in their text: hashes propose, words decide."""
    if not len(at):
        return at
    keys = h + text[at].astype(np.uint64) * _TEXT
    some = np.flatnonzero(repeated(keys))
    if not len(some):
        return at[:0]
    data, to = w.joined()
    same = classes(keys[some], text[at[some]], data, to[at[some]], to[at[some] + 8])
    return at[some[repeated(same)]]


def _dup_lines(w: Words) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line of it."""
    n = len(w.n)
    breaks = np.flatnonzero(w.data == 10)
    starts = np.union1d(w.cut[:-1], breaks + 1)
    starts = starts[starts < len(w.data)]
    if not len(starts):
        return np.zeros(n, np.int64)
    ends = np.minimum(np.append(starts[1:], len(w.data)), len(w.data))
    tail = (w.data[ends - 1] == 10) & (ends > starts)
    ends = ends - tail
    word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[word], ends[word]
    text = np.searchsorted(w.cut, starts, "right") - 1
    keys = span_hashes(w.data, starts, ends) + text.astype(np.uint64) * _TEXT
    some = np.flatnonzero(repeated(keys))
    _, first = np.unique(classes(keys[some], text[some], w.data, starts[some], ends[some]), return_index=True)
    later = np.ones(len(some), bool)
    later[first] = False
    return np.bincount(text[some[later]], minlength=n)


def quality_rules(docs: DataFrame, weight: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(weight)

    def make(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0)} | judge(b.column(1), sent.value, threshold)

    return frames.by_batch(frames.texts(docs), make, SCHEMA)


def keep_good(docs: DataFrame, weight: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns."""
    sent, k = docs.sparkSession.sparkContext.broadcast(weight), docs.columns.index("text")
    return frames.filtered(docs, lambda b: pa.array(judge(b.column(k), sent.value, threshold)["kept"]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    out = quality_rules(docs, weights(docs, target_ids(frames.table(spark, sf_dir, "labels"))))
    return out.withColumn("score", F.round("score", 6))


#: The whole of it for the parameters above: base counts, buckets of 4-byte strings, their log ratios, scores and verdicts.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
word AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM words),
win AS (SELECT r, p, CASE WHEN count(*) OVER w = 8 THEN string_agg(word, ' ') OVER w END AS s FROM word WINDOW w AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
again AS (SELECT r, p, s IS NOT NULL AND count(*) OVER (PARTITION BY r, s) > 1 AS twice FROM win),
inside AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM again),
repeats AS (SELECT r, count(CASE WHEN hit THEN 1 END) AS n FROM inside GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
bytes AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS x FROM (SELECT r, doc_id, regexp_extract_all(hex(encode(t)), '..') AS l FROM docs)),
gram AS (SELECT r, doc_id, lead(x, 3) OVER w || lead(x, 2) OVER w || lead(x) OVER w || x AS g FROM bytes WINDOW w AS (PARTITION BY r ORDER BY p)),
bucket AS (SELECT r, doc_id, CAST((CAST(CAST('0x' || g AS UBIGINT) AS HUGEINT) * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT // 562949953421312::HUGEINT AS BIGINT) AS b FROM gram WHERE g IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (SELECT b, count(*) AS n, count(g.doc_id) AS g FROM bucket LEFT JOIN good g ON g.doc_id = bucket.doc_id GROUP BY b),
sums AS (SELECT sum(n) AS n, sum(g) AS g FROM counts),
weight AS (SELECT b, CASE WHEN sums.g = 0 THEN 0 ELSE round_even(ln((counts.g / ((counts.n + 1) / (sums.n + 32768)) + 32768) / (sums.g + 32768)) * 1048576, 0) END AS w FROM counts, sums),
score AS (SELECT r, sum(w) / count(*) / 1048576 AS s FROM bucket JOIN weight ON weight.b = bucket.b GROUP BY r),
base AS (SELECT d.r, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(s, 0) AS score
  FROM docs d JOIN words ON words.r = d.r LEFT JOIN lines ON lines.r = d.r LEFT JOIN repeats ON repeats.r = d.r LEFT JOIN score ON score.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, round(score, 6) AS score, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND score >= -0.3 AS kept FROM base
"""
