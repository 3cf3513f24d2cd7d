import random
import re

import numpy as np
import pyarrow as pa

from wayline.llm import op10_quality as q
from wayline.llm.words import classes


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k : k + 8]), []).append(k)
    again = {p for ks in where.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_base_counts_against_plain_versions():
    r = random.Random(1)
    alphabet = ["a", "b", "é", "漢", "#", "<", " ", " ", "\n", "\n", "\t", "\x0b", "\x1c", "x y z"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice((0, 3, 40, 300)))) for _ in range(400)]
    texts += ["a " * 50, "a b c d e f g h\n" * 4, "", None, "\n\n", "a\r\na\r\n", " a\na\n a"]
    got = q.judge(pa.array(texts, pa.string()), np.zeros(q.BUCKETS, np.int64))
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [plain(t) for t in texts]


def test_different_words_of_equal_structure(thue_morse):
    texts = []
    for size in (1024, 2048):
        a, b = thue_morse(size)
        texts += [f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([a] * 8 + [b] * 8), " ".join([a] * 8 + [b] + [a] * 8)]
    texts.append("long " * 300_000 + "\n" + "line " * 200_000)
    got = q.judge(pa.array(texts, pa.string()), np.zeros(q.BUCKETS, np.int64))
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [plain(t) for t in texts]


def test_equal_keys_of_different_spans_are_told_apart():
    data = np.frombuffer(b"abcdabxyabcd", np.uint8)
    starts, ends = np.array([0, 4, 8, 2, 6, 0]), np.array([2, 6, 10, 4, 8, 2])
    got = classes(np.zeros(6, np.uint64), np.array([0, 0, 0, 0, 0, 1]), data, starts, ends)
    assert got[0] == got[1] == got[2] and len(set(got.tolist())) == 4


def test_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(0)
    weight = r.integers(-(10**6), 10**6, q.BUCKETS)
    texts = ["".join(chr(c) for c in r.integers(32, 300, n)) for n in (0, 1, 3, 4, 5, 900, 70)]
    whole = q.judge(pa.array(texts), weight)["score"]
    for i, t in enumerate(texts):
        assert q.judge(pa.array([t]), weight)["score"][0] == whole[i]


def test_query_on_tables(spark, docs_of):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    good = " ".join(f"word{i}" for i in range(4000))
    df = docs_of([good, "### $$$ " * 30 + " ".join(f"%%{i}&&" for i in range(9000)), None, "", good]).selectExpr("*", "1 as kept", "2 as score")
    rows = {r.doc_id: r for r in q.quality_rules(df, q.weights(df, q.target_ids(labels))).collect()}
    assert rows[0].kept and rows[4].kept and rows[0].score > 0 and rows[1].score < q.THRESHOLD and not rows[1].kept and rows[2].base_failed and rows[3].score == 0
    assert q.keep_good(df, q.weights(df, q.target_ids(labels))).columns == df.columns
    none = df.where("false")
    assert q.quality_rules(none, q.weights(none, q.target_ids(labels.where("false")))).count() == 0


def test_target_counts_every_trusted_document(spark):
    n = 25_000
    docs = spark.range(n).selectExpr("CASE WHEN id % 100 > 0 THEN id END AS doc_id", "concat('text ', hex(id * 7919)) AS text")
    labels = spark.range(-1, n).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 9 THEN 1 ELSE 0 END AS quality")
    good, raw = np.zeros(q.BUCKETS), np.zeros(q.BUCKETS)
    for k in range(n):
        data = np.frombuffer(f"text {k * 7919:X}".encode(), np.uint8)
        counts = np.bincount(q.grams(data, np.array([0, len(data)]))[0], minlength=q.BUCKETS)
        raw += counts
        good += counts * (k % 100 > 0 and k % 10 < 9)
    assert (q.weights(docs, q.target_ids(labels.unionByName(labels))) == q.to_weights(good, raw)).all()
