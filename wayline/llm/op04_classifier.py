"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of KERNEL bytes slide over the text in steps
of STRIDE, and each filter's maximum is taken over overlapping chunks of two
halves of HALF bytes that cover the whole document. A hidden layer turns each
chunk into a logit; a document's logit combines the mean and the least of its
chunks. Every byte is read once: a half's maxima serve both of its chunks.

Training (Adam, on the driver) takes at most TRAIN_ROWS labelled documents of
each class, those with the smallest hash of their id, never the held-out ones,
as long as their texts together stay within TRAIN_BYTES, so its cost and memory
are fixed. Whole texts are used: every few epochs all chunks are scored; a step
then takes a document's lowest chunks and others in turn, each weighted by the
share of the document it stands for; at last the mixture of mean and least is
fitted on all chunks of all sampled documents. Scoring covers all documents and
all bytes, in batches of bounded size.

Null and empty texts are scored as a text of no bytes (the network's bias).
Without labels of both classes every score is 0.5. Of labels that clash the
greater counts. Of rows that repeat a labelled doc_id the least text is trained
on. Repeated rows are scored one by one; a very long text is a batch of its own;
other columns are not read; an empty table returns no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import frames
from wayline.llm.words import buffers

KERNEL, STRIDE, HALF, WIDTH, FILTERS, HIDDEN = 8, 2, 256, 8, 32, 16
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH = 2500, 12 << 20, 14, 64
#: Chunks of a text in one step, the lowest among them, and the epochs before which all chunks are scored.
STEP_CHUNKS, LOWEST, RESCORED = 6, 3, (3, 6, 9, 12)
CUTOFF = 0.7
#: Weight of the good class in the loss, and the share of good documents that are shown again as a few words.
GOOD_SHARE, SHORT_SHARE = 0.65, 0.35
#: Half chunks convolved at once.
STRIPE = 128

SCHEMA = "doc_id long, score double, predicted int"
Model = dict[str, np.ndarray]


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """[halves, HALF + KERNEL] bytes of texts, padded with zeros, and each text's offset in them."""
    count = np.array([(len(t) + KERNEL + HALF - 1) // HALF for t in texts])
    cut = np.append(0, np.cumsum(count))
    data = np.zeros(int(cut[-1]) * HALF + KERNEL, np.uint8)
    for k, t in enumerate(texts):
        at = int(cut[k]) * HALF
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    rows = np.lib.stride_tricks.as_strided(data, (int(cut[-1]), HALF + KERNEL), (HALF, 1)).copy()
    rows[cut[1:] - 1, HALF:] = 0  # not the next text
    return rows, cut


def _windows(m: Model, rows: np.ndarray) -> np.ndarray:
    """[rows, positions, KERNEL * WIDTH] of the embedded bytes under each filter position."""
    e = m["embed"][rows]  # rows, bytes, WIDTH
    n, s = len(rows), e.strides
    return np.lib.stride_tricks.as_strided(e, (n, HALF // STRIDE, KERNEL * WIDTH), (s[0], STRIDE * s[1], s[2]))


def pooled(m: Model, rows: np.ndarray) -> np.ndarray:
    """[rows, FILTERS] maxima over each half."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for i in range(0, len(rows), STRIPE):
        w = _windows(m, rows[i : i + STRIPE])
        y = np.ascontiguousarray(w).reshape(-1, KERNEL * WIDTH) @ m["filters"]
        out[i : i + STRIPE] = y.reshape(len(w), -1, FILTERS).max(axis=1)
    return np.maximum(out + m["filter_bias"], 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(m: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The logits of all chunks of some texts, and the offsets of the texts in them."""
    rows, cut = halves(texts)
    half = pooled(m, rows)
    # chunk k of a text joins its halves k and k + 1; a text of one half is one chunk
    last = np.zeros(len(half), bool)
    last[cut[1:] - 1] = True
    chunk = np.maximum(half, np.where(last[:, None], half, np.roll(half, -1, axis=0)))
    logit = np.maximum(chunk @ m["hidden"] + m["hidden_bias"], 0) @ m["out"] + m["out_bias"]
    single = np.diff(cut) == 1
    use = ~last
    use[cut[1:][single] - 1] = True
    return logit[use], np.append(0, np.cumsum(use))[cut]


def summary(m: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the least logit of each text's chunks."""
    logit, cut = logits(m, texts)
    return np.add.reduceat(logit.astype(float), cut[:-1]) / np.diff(cut), np.minimum.reduceat(logit, cut[:-1])


def scores(m: Model, texts: list[bytes]) -> np.ndarray:
    mean, least = summary(m, texts)
    return np.round(_sigmoid(m["mix"][0] * mean + m["mix"][1] * least + m["mix"][2]).astype(float), 6)


def _start(seed: int) -> Model:
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
    m = {
        "embed": f(256, WIDTH, scale=0.5), "filters": f(KERNEL * WIDTH, FILTERS, scale=(2 / (KERNEL * WIDTH)) ** 0.5), "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": f(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": f(HIDDEN, scale=(1 / HIDDEN) ** 0.5), "out_bias": np.zeros(1, np.float32), "mix": np.array([0.5, 0.5, 0.0], np.float32),
    }
    m["embed"][0] = 0
    return m


def _slices(texts: list[bytes], size: int = 1 << 20):
    """(i, j) of neighbouring texts of about size bytes."""
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= size:
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _chosen(n: int, low: np.ndarray | None, epoch: int) -> tuple[list[int], list[float]]:
    """Chunks of a text of n that a step takes, and their weights in the mean; low: its lowest chunks."""
    if n <= STEP_CHUNKS:
        return list(range(n)), [1 / n] * n
    low = [] if low is None else low.tolist()
    others, room = [k for k in range(n) if k not in low], STEP_CHUNKS - len(low)
    rest = [others[k % len(others)] for k in range(epoch * room, min((epoch + 1) * room, epoch * room + len(others)))]
    return low + rest, [1 / n] * len(low) + [(1 - len(low) / n) / len(rest)] * len(rest)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 17, epochs: int = EPOCHS) -> Model:
    """A model of whole texts and their labels 0 or 1."""
    m, r = _start(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    texts, labels = _with_short(texts, labels, r)
    weight = np.where(labels == 1, GOOD_SHARE / max(1, (labels == 1).sum()), (1 - GOOD_SHARE) / max(1, (labels == 0).sum())) * len(labels)
    count = [max(1, -(-(len(t) + KERNEL) // HALF) - 1) for t in texts]  # as many as scoring has
    shift = r.permutation(len(texts))  # so that the turns of texts differ
    low: list[np.ndarray | None] = [None] * len(texts)
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for epoch in range(epochs):
        if epoch in RESCORED:
            long = [k for k in range(len(texts)) if count[k] > STEP_CHUNKS]
            for i, j in _slices([texts[k] for k in long]):
                logit, cut = logits(m, [texts[k] for k in long[i:j]])
                for k, a, b in zip(long[i:j], cut, cut[1:]):
                    low[k] = np.argsort(logit[a:b], kind="stable")[:LOWEST]
        order = r.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            chosen = [_chosen(count[k], low[k], epoch + int(shift[k])) for k in pick]
            chunks = [[texts[k][HALF * c : HALF * c + 2 * HALF] for c in own] for k, (own, _) in zip(pick, chosen)]
            g = _gradient(m, chunks, labels[pick], weight[pick], np.array([x for _, shares in chosen for x in shares]))
            step += 1
            rate = 0.004 * (1 - step / (total + 1))
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
            m["embed"][0] = 0
    return m | {"mix": _mixture(m, texts, labels, weight)}


def _mixture(m: Model, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The mixture of mean and least over all chunks of all texts: a logistic fit by Newton's steps, drawn towards the trained one."""
    parts = [summary(m, texts[i:j]) for i, j in _slices(texts)]
    x = np.stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.ones(len(texts))], axis=1)
    start = m["mix"].astype(float)
    w = start.copy()
    for _ in range(12):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - labels)) + 1.0 * (w - start)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3)
        w = w - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return w.astype(np.float32)


def _with_short(texts: list[bytes], labels: np.ndarray, r: np.random.Generator) -> tuple[list[bytes], np.ndarray]:
    """texts and, for a share of the good ones, a few words of them: that a text is short says nothing against it."""
    more = []
    for k in np.flatnonzero((labels == 1) & (r.random(len(texts)) < SHORT_SHARE)).tolist():
        at = int(r.integers(max(1, len(texts[k]) - 2 * HALF)))
        words = texts[k][at : at + 2 * HALF].split()[1:-1]
        if len(words) > 2:
            n = int(r.integers(1, 16))
            at = int(r.integers(0, max(1, len(words) - n)))
            more.append(b" ".join(words[at : at + n]))
    return texts + more, np.append(labels, np.ones(len(more), labels.dtype))


def _gradient(m: Model, texts: list[list[bytes]], labels: np.ndarray, weight: np.ndarray, share: np.ndarray) -> Model:
    """The gradient of texts given as chunks; share: of each chunk in its text's mean."""
    chunks = [c for t in texts for c in t]
    cut = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.zeros((len(chunks), 2 * HALF + KERNEL), np.uint8)
    for k, c in enumerate(chunks):
        data[k, : len(c)] = np.frombuffer(c, np.uint8)
    e = m["embed"][data]
    s, positions = e.strides, 2 * HALF // STRIDE
    w = np.lib.stride_tricks.as_strided(e, (len(chunks), positions, KERNEL * WIDTH), (s[0], STRIDE * s[1], s[2]))
    y = (np.ascontiguousarray(w).reshape(-1, KERNEL * WIDTH) @ m["filters"]).reshape(len(chunks), positions, FILTERS)
    best = y.argmax(axis=1)
    v = np.maximum(np.take_along_axis(y, best[:, None, :], 1)[:, 0] + m["filter_bias"], 0)
    a = v @ m["hidden"] + m["hidden_bias"]
    h = np.maximum(a, 0)
    logit = h @ m["out"] + m["out_bias"]
    n = np.diff(cut)
    mean = np.add.reduceat(logit * share, cut[:-1])
    low = np.array([cut[k] + logit[cut[k] : cut[k + 1]].argmin() for k in range(len(n))])
    least = logit[low]
    d = ((_sigmoid(m["mix"][0] * mean + m["mix"][1] * least + m["mix"][2]) - labels) * weight / len(labels)).astype(np.float32)
    g = {"mix": np.array([d @ mean, d @ least, d.sum()], np.float32)}
    dl = np.repeat(d * m["mix"][0], n) * share
    dl[low] += d * m["mix"][1]
    dl = dl.astype(np.float32)
    g["out"], g["out_bias"] = h.T @ dl, dl.sum(keepdims=True)
    da = dl[:, None] * m["out"] * (a > 0)
    g["hidden"], g["hidden_bias"] = v.T @ da, da.sum(axis=0)
    dv = (da @ m["hidden"].T) * (v > 0)
    g["filter_bias"] = dv.sum(axis=0)
    row = np.arange(len(chunks))[:, None]
    under = w[row, best]  # chunks, FILTERS, KERNEL * WIDTH
    g["filters"] = np.einsum("cf,cfk->kf", dv, under)
    de = np.einsum("cf,kf->cfk", dv, m["filters"]).reshape(len(chunks), FILTERS, KERNEL, WIDTH)
    letters = data[row[:, :, None], best[:, :, None] * STRIDE + np.arange(KERNEL)]
    g["embed"] = np.stack([np.bincount(letters.reshape(-1), de[..., k].reshape(-1), 256) for k in range(WIDTH)], axis=1).astype(np.float32)
    return g


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most rows documents and size bytes of each class that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    picked = known.where("quality = 0").orderBy(*by_hash).limit(rows).unionByName(known.where("quality = 1").orderBy(*by_hash).limit(rows))
    # at most two times rows ids are sent, and as many lengths come back
    mine = frames.texts(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    found = mine.groupBy("id", "quality").agg(F.min(F.octet_length("text")).alias("n")).orderBy(*by_hash).collect()
    left, taken = {0: size, 1: size}, []
    for r in found:
        if r["n"] <= left[r["quality"]]:
            left[r["quality"]] -= r["n"]
            taken.append(r["id"])
    if not taken:
        return [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(x,) for x in taken], "taken long")
    least = F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("t")
    got = mine.join(F.broadcast(chosen), F.col("id") == F.col("taken")).groupBy("id", "quality").agg(least).orderBy("id").collect()
    return [r["t"]["text"].encode() for r in got], np.array([r["quality"] for r in got])


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    texts, y = sample(docs, labels)
    return train(texts, y) if len(set(y.tolist())) == 2 else None


def classify(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(b: pa.RecordBatch) -> dict:
        m = sent.value
        data, cut = buffers(b.column(1))
        out = np.full(b.num_rows, 0.5)
        i = 0
        while m is not None and i < b.num_rows:
            j = min(b.num_rows, max(i + 1, int(np.searchsorted(cut, cut[i] + (1 << 20), "right")) - 1))
            out[i:j] = scores(m, [data[cut[k] : cut[k + 1]].tobytes() for k in range(i, j)])
            i = j
        return {"doc_id": b.column(0), "score": out, "predicted": (out >= cutoff).astype(np.int32)}

    return frames.by_batch(frames.texts(docs), make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    out = classify(docs, fitted(docs, frames.table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
