import zlib

import numpy as np
import pytest

from wayline.llm import op04_classifier as net


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy_and_split(tables):
    docs, labels = tables
    model = net.fitted(docs, labels)
    got = {r.doc_id: r for r in net.classify(docs, model).collect()}
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    s, y = np.array(held).T
    assert ((s >= net.CUTOFF) == (y == 1)).mean() > 0.9 and (s[y == 1] >= net.CUTOFF).mean() > 0.95
    texts, y = net.sample(docs, labels, rows=10**6, size=10**9)
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(texts) == sorted(want[r.doc_id] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    few, _ = net.sample(docs, labels, rows=50, size=20_000)
    assert 10 < len(few) <= 100 and sum(map(len, few)) <= 40_000
    assert len(y) == sum(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in labels.collect())


def test_scores_against_a_plain_network():
    """Filters, chunk maxima and the combination, byte by byte."""
    m = net._start(3)
    m["filter_bias"] += 0.1
    texts = [b"", b"a", b"abc" * 100, bytes(range(1, 256)) * 5, b"x" * 248, b"y" * 249]

    def plain(t):
        n = (len(t) + net.KERNEL + net.HALF - 1) // net.HALF
        t = t + bytes(n * net.HALF + net.KERNEL - len(t))
        half = []
        for k in range(n):
            rows = [m["embed"][list(t[p : p + net.KERNEL])].reshape(-1) @ m["filters"] for p in range(k * net.HALF, (k + 1) * net.HALF, net.STRIDE)]
            half.append(np.maximum(np.max(rows, axis=0) + m["filter_bias"], 0))
        chunks = [np.maximum(half[k], half[k + 1]) for k in range(n - 1)] or half
        logit = [float(np.maximum(c @ m["hidden"] + m["hidden_bias"], 0) @ m["out"] + m["out_bias"][0]) for c in chunks]
        x = m["mix"][0] * np.mean(logit) + m["mix"][1] * min(logit) + m["mix"][2]
        return 1 / (1 + np.exp(-x))

    assert np.allclose(net.scores(m, texts), [plain(t) for t in texts], atol=2e-5)


def test_gradient_by_differences():
    m, r = net._start(5), np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in m.items()}
    texts = [[bytes(r.integers(1, 256, 300, dtype=np.uint8)) for _ in range(k)] for k in (1, 3, 2)]
    y, w = np.array([1, 0, 1]), np.ones(3)

    def loss():
        total = 0.0
        for t, label in zip(texts, y):
            logit = []
            for c in t:
                c = c + bytes(2 * net.HALF + net.KERNEL - len(c))
                rows = np.array([m["embed"][list(c[p : p + net.KERNEL])].reshape(-1) for p in range(0, 2 * net.HALF, net.STRIDE)]) @ m["filters"]
                logit.append((np.maximum(np.maximum(rows.max(axis=0) + m["filter_bias"], 0) @ m["hidden"] + m["hidden_bias"], 0) @ m["out"] + m["out_bias"])[0])
            x = m["mix"][0] * np.mean(logit) + m["mix"][1] * min(logit) + m["mix"][2]
            total += np.log1p(np.exp(-x if label else x)) / len(y)
        return total

    g = net._gradient(m, texts, y, w, np.concatenate([np.full(len(t), 1 / len(t)) for t in texts]))
    for name, v in m.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        slope = (up - loss()) / 2e-5
        v[at] = old
        assert np.isclose(slope, g[name][at], rtol=1e-2, atol=1e-5), name


def test_every_chunk_of_a_long_text_has_its_turn():
    n, low = 40, np.array([7, 30, 2])
    seen = set()
    for epoch in range(14):
        own, share = net._chosen(n, low, epoch)
        assert len(own) == len(set(own)) == net.STEP_CHUNKS and set(low) <= set(own) and abs(sum(share) - 1) < 1e-12
        seen |= set(own)
    assert seen == set(range(n)) and net._chosen(4, None, 3) == ([0, 1, 2, 3], [0.25] * 4)


def test_junk_deep_in_a_long_text_counts():
    """Long bad texts differ from good ones in one chunk of 40 only, anywhere."""
    r = np.random.default_rng(2)
    good = lambda n: " ".join(r.choice(["river", "stone", "light", "water", "garden", "letter"], n)).encode()
    texts = [good(1700) for _ in range(60)]
    for k in range(30):
        at = int(r.integers(0, len(texts[k]) - 600))
        texts[k] = texts[k][:at] + b"$$$ ### " * 70 + texts[k][at + 560 :]
    m = net.train(texts, np.array([0] * 30 + [1] * 30), epochs=60)
    s = net.scores(m, texts)
    assert ((s >= 0.5) == (np.arange(60) >= 30)).mean() > 0.95


def test_tables(docs_of, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    df = docs_of(["abc", None, "abc"], ids=[1, 2, 1]).selectExpr("*", "1 as score", "2 as quality")
    assert net.fitted(df, labels) is None
    assert [r.score for r in net.classify(df, None).collect()] == [0.5] * 3
    rows = {(r.doc_id, r.score, r.predicted) for r in net.classify(df, net._start(1)).collect()}
    assert len(rows) == 2 and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in rows)
    assert net.classify(df.where("false"), net._start(1)).count() == 0
