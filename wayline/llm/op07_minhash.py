"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles of five words (A-Z lower-cased);
with fewer words the whole sequence is the one shingle. Two documents are linked
if the Jaccard similarity of their sets reaches the threshold, and a document's
component is the smallest doc_id reachable over links.

1. One pass makes each document's MinHash signature and a digest of its words.
   Documents of equal words are one class, its least id the representative.
2. Bands of the signature put representatives into buckets. There are as many
   bands as leave a pair at the threshold unseen with probability MISS at most.
3. In each bucket every member is a candidate of the least one. Signatures are
   compared batch by batch; a pair is pruned as soon as the posterior
   probability that it reaches the threshold is under PRUNE. Survivors are
   confirmed on full sets. Their components join whole groups of copies with one
   pair for each member, however large the group.
4. Buckets that still hold two components or more are searched in full, pairs of
   one component left out: in blocks of at most BLOCK members, so that a bucket
   is many tasks. The same bounds prune on signatures; what is left is confirmed
   on full sets, with the intersections of a block as one matrix product.
5. Of such buckets, those of over LARGE members (texts that share a frequent
   shingle or two) are not searched by pairs: their members get longer bands of
   LONG_ROWS values, again with a miss of MISS at most, and go through 3 and 4.

Hashes of shingles propose; a link counts only once the true words of both
documents confirm it. Set sizes are counts of distinct 62-bit hashes: one in a
document of a million shingles is off with probability 1e-7. Signatures, buckets
and links stay in tables of the shared checkpoint folder; the driver sees counts
only. Null and empty texts have no shingles, stand alone and are kept. A null
doc_id is never linked: its component is null, and it is kept. Rows that repeat
a doc_id count as one document: their links unite, and keep_firsts leaves one of
them. A very long text is one row of each step and is never cut. Clashing names
of other columns play no part: only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import frames, graphs
from wayline.llm.words import LOWER, Words, classes, mix, slices, window_hashes

SHINGLE, ROWS = 5, 5
#: Probability at most that a pair at the threshold shares no band, and that a comparison prunes it.
MISS, PRUNE = 1e-7, 1e-9
#: Signature values compared at once, and members of a bucket searched in one task.
BATCH, BLOCK = 32, 512
#: Members of a mixed bucket above which its members get longer bands, and the values of such a band.
LARGE, LONG_ROWS = 8192, 10

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _counts(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.where(w.n >= size, w.n - size + 1, np.minimum(w.n, 1))
    return count, np.append(0, np.cumsum(count))


def linked(a: bytes, b: bytes, percent: int, size: int = SHINGLE) -> bool:
    """Whether the shingle sets of two texts, compared word by word, are as similar as percent."""
    w = Words(LOWER[np.frombuffer(a + b, np.uint8)], np.array([0, len(a), len(a) + len(b)]))
    h, cut = shingles(w, size)
    count, _ = _counts(w, size)
    at = np.repeat(w.first[:-1] - cut[:-1], count) + np.arange(cut[-1])
    data, to = w.joined()
    same = classes(h, np.zeros(len(h), np.int64), data, to[at], to[at + np.repeat(np.minimum(w.n, size), count)])
    x, y = np.unique(same[: cut[1]]), np.unique(same[cut[1] :])
    union = len(np.unique(same))
    return 100 * (len(x) + len(y) - union) >= percent * union


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, in order, and the offsets of the texts in them."""
    count, cut = _counts(w, size)
    out = np.empty(cut[-1], np.uint64)
    long = np.repeat(w.n >= size, count)
    out[long] = w.windows(size)[1]
    for k in range(1, size):
        texts = np.flatnonzero(w.n == k)
        out[cut[texts]] = window_hashes(w.hashes, w.first[texts], k)
    return out, cut


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7041)
    return r.integers(0, 1 << 63, n, dtype=np.uint64), r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(h: np.ndarray, cut: np.ndarray, n: int) -> np.ndarray:
    """[texts, n] MinHash values of 32 bits; texts without shingles get zeros."""
    flip, times = _constants(n)
    full = np.flatnonzero(np.diff(cut))
    out = np.zeros((len(cut) - 1, n), np.uint32)
    if len(full):
        heads = cut[full]
        for k in range(n):
            y = h ^ flip[k]
            y *= times[k]
            out[full, k] = np.minimum.reduceat(y, heads) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """[texts, bands] keys of 64 bits; the number of the band is part of a key."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sig), 1))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def least_matches(threshold: float, n: int, prune: float = PRUNE, batch: int = BATCH) -> list[tuple[int, int]]:
    """(values compared, the fewest matches that are not pruned) after each batch.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) posterior,
    which is above the threshold t with probability P(Binomial(n + 1, t) <= m).
    """
    out = []
    for done in [*range(batch, n, batch), n]:
        total, m = 0.0, 0
        while True:
            total += math.comb(done + 1, m) * threshold**m * (1 - threshold) ** (done + 1 - m)
            if total >= prune:
                break
            m += 1
        out.append((done, m))
    return out


def _survive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of signatures that no batch prunes."""
    left, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for upto, least in steps:
        matches = matches + (a[left, done:upto] == b[left, done:upto]).sum(axis=1)
        keep = matches >= least
        left, matches, done = left[keep], matches[keep], upto
    return left


def _sets(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, w in slices(texts, lower=True):
        h, cut = shingles(w)
        out += [np.unique(h[cut[k] : cut[k + 1]]) for k in range(j - i)]
    return out


def _matrix(column, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), n)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """Set size, digest of all words and signature of n values for each row; null where a text has no words."""

    def sign(b: pa.RecordBatch) -> dict:
        count, digest, sig = [], [], []
        for i, j, w in slices(b.column(1), lower=True):
            h, cut = shingles(w)
            own = signatures(h, cut, n)
            data, to = w.joined()
            edge = to[w.first]
            for k in range(j - i):
                u = len(np.unique(h[cut[k] : cut[k + 1]]))
                count.append(u)
                digest.append(hashlib.blake2b(data[edge[k] : edge[k + 1]], digest_size=16).digest() if u else None)
                sig.append(own[k].tobytes() if u else None)
        return {"doc_id": b.column(0), "n_shingles": pa.array(count, pa.int64()), "digest": pa.array(digest, pa.binary()), "sig": pa.array(sig, pa.binary())}

    return frames.by_batch(docs, sign, "doc_id long, n_shingles long, digest binary, sig binary")


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, rep, pivot, members) of the buckets of two members or more."""

    def bucketed(b: pa.RecordBatch) -> dict:
        keys = band_keys(_matrix(b.column(1), bands * rows), bands, rows)
        return {"rep": np.repeat(b.column(0).to_numpy(), bands), "key": keys.reshape(-1).view(np.int64)}

    banded = frames.by_batch(reps, bucketed, "rep long, key long")
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    return banded.join(shared, "key")


def near_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text); linked at a similarity of percent / 100 or more."""
    docs = frames.texts(docs)
    threshold = percent / 100
    signed = frames.written(_signed(docs, bands_for(threshold) * ROWS))
    copies = signed.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"))
    copies = frames.written(copies)
    reps, near, named, used = copies.select("rep", "sig"), None, None, []
    for rows in (ROWS, LONG_ROWS):
        bands = bands_for(threshold, rows)
        n = bands * rows
        steps = least_matches(threshold, n)
        buckets = frames.written(_buckets(reps, bands, rows))
        if near is None:
            near = frames.written(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep").distinct())
        links = frames.written(_star_links(buckets, reps, near, n, steps, percent))
        before = links if named is None else links.unionByName(named)
        stars = frames.written(graphs.components(before))
        mixed = frames.written(_mixed(buckets, stars))
        last = rows == LONG_ROWS
        more = frames.written(_block_links(mixed if last else mixed.where(F.col("members") <= LARGE), reps, near, n, bands, rows, steps, percent))
        named = stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        used += [buckets, links, stars, mixed, more]
        rest = mixed.where(F.col("members") > LARGE).select("rep").distinct()
        if last or rest.isEmpty():
            break
        again = near.join(rest, "rep", "left_semi").withColumnRenamed("rep", "doc_id")
        # rows that repeat a doc_id have texts of their own; one of them stands for the document here, as above
        extra = _signed(again, bands_for(threshold, LONG_ROWS) * LONG_ROWS).where("n_shingles > 0")
        reps = frames.written(extra.groupBy(F.col("doc_id").alias("rep"), "digest").agg(F.max("sig").alias("sig")).select("rep", "sig"))
        used.append(reps)

    # a doc_id with several texts joins their classes
    several = frames.written(signed.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"))
    used.append(several)
    if not several.isEmpty():
        named = named.unionByName(signed.join(several, "doc_id", "left_semi").join(copies, "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    parts = graphs.components(named).select(F.col("node").alias("rep"), "component")
    final = frames.written(copies.select("digest", "rep").join(parts, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")))
    frames.dropped(*used, near, copies)
    wordy = signed.where("digest is not null").select("doc_id", "n_shingles", "digest").join(final, "digest").select("doc_id", "n_shingles", "component")
    out = wordy.unionByName(signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _mixed(buckets: DataFrame, stars: DataFrame) -> DataFrame:
    """(key, rep, members, component) of the buckets that hold two components or more."""
    named = stars.select(F.col("node").alias("rep"), "component")
    members = buckets.select("key", "rep", "members").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return members.join(mixed, "key")


def _star_links(buckets: DataFrame, reps: DataFrame, near: DataFrame, n: int, steps, percent: int) -> DataFrame:
    """Confirmed links (u, v) of members with the least member of a bucket."""

    def prune(b: pa.RecordBatch) -> dict:
        left = pa.array(_survive(_matrix(b.column(2), n), _matrix(b.column(3), n), steps))
        return {"u": b.column(0).take(left), "v": b.column(1).take(left)}

    def confirm(b: pa.RecordBatch) -> dict:
        a, c = _sets(b.column(2)), _sets(b.column(3))
        link = []
        for k, (x, y) in enumerate(zip(a, c, strict=True)):
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            near_enough = 100 * both >= percent * (len(x) + len(y) - both)
            link.append(near_enough and linked(b.column(2)[k].as_py().encode(), b.column(3)[k].as_py().encode(), percent))
        keep = pa.array(np.flatnonzero(link))
        return {"u": b.column(0).take(keep), "v": b.column(1).take(keep)}

    pairs = buckets.where("rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct()
    sigs = lambda id, sig: reps.select(F.col("rep").alias(id), F.col("sig").alias(sig))
    texts = lambda id, text: near.select(F.col("rep").alias(id), F.col("text").alias(text))
    left = frames.by_batch(pairs.join(sigs("u", "s"), "u").join(sigs("v", "t"), "v").select("u", "v", "s", "t"), prune, "u long, v long")
    return frames.by_batch(left.join(texts("u", "s"), "u").join(texts("v", "t"), "v").select("u", "v", "s", "t"), confirm, "u long, v long").distinct()


def _block_links(members: DataFrame, reps: DataFrame, near: DataFrame, n: int, bands: int, rows: int, steps, percent: int) -> DataFrame:
    """Confirmed links (u, v) between the components that meet in a bucket, one for each two components and task."""
    # A bucket of k blocks makes k * (k + 1) / 2 tasks, each of two blocks.
    k = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), k).cast("int")
    dealt = members.select("key", "rep", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component")

    def involved(t: pa.Table) -> pa.Table:
        sig, comp = _matrix(t["sig"], n), t["component"].to_numpy()
        keys = band_keys(sig, bands, rows)
        band = int(np.flatnonzero(keys[0] == np.uint64(t["key"][0].as_py() & (1 << 64) - 1))[0])
        hit = np.zeros(len(comp), bool)
        for a in range(len(comp) - 1):
            b = a + 1 + np.flatnonzero(comp[a + 1 :] != comp[a])
            if band:  # each pair counts in the first band that it shares
                b = b[~(keys[b, :band] == keys[a, :band]).any(axis=1)]
            if len(b):
                b = b[_survive(np.broadcast_to(sig[a], (len(b), n)), sig[b], steps)]
            if len(b):
                hit[a] = True
                hit[b] = True
        return t.select(["key", "i", "j", "rep", "component"]).filter(pa.array(hit))

    def confirm(t: pa.Table) -> pa.Table:
        ids, comp = t["rep"].to_numpy(), t["component"].to_numpy()
        sets = _sets(t["text"])
        texts = [x.encode() for x in t["text"].to_pylist()]
        size = np.array([len(s) for s in sets])
        values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        useful = count > 1
        column = np.cumsum(useful) - 1
        owner = np.repeat(np.arange(len(ids)), size)
        u, v = [], []
        both = np.zeros((len(ids), len(ids)), np.float32)
        width = int(useful.sum())
        for lo in range(0, width, 8192):  # a stripe of shared shingles at a time
            x = np.zeros((len(ids), min(8192, width - lo)), np.float32)
            inside = useful[at] & (column[at] >= lo) & (column[at] < lo + 8192)
            x[owner[inside], column[at][inside] - lo] = 1
            both += x @ x.T
        inter = np.rint(both).astype(np.int64)
        link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
        link &= comp[:, None] != comp[None, :]
        seen = set()
        for a, b in zip(*np.nonzero(np.triu(link)), strict=True):
            pair = (min(comp[a], comp[b]), max(comp[a], comp[b]))
            if pair not in seen and linked(texts[a], texts[b], percent):
                seen.add(pair)
                u.append(pair[0])
                v.append(pair[1])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = dealt.join(reps, "rep").groupBy("key", "i", "j").applyInArrow(involved, "key long, i int, j int, rep long, component long")
    return found.join(near, "rep").groupBy("key", "i", "j").applyInArrow(confirm, "u long, v long").distinct()


def keep_firsts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that near_components keeps: one row of each group, all columns as they were.

    Of rows that repeat a doc_id the one of the least text stays; rows of a null doc_id all stay.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)  # so that no column's name clashes
    key, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    gone = near_components(docs, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = plain.join(gone, F.col(key) == F.col("gone"), "left_anti")
    twice = frames.written(plain.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("twice")).count().where("count > 1").select("twice"))
    if not twice.isEmpty():
        repeats = left.join(twice, F.col(key) == F.col("twice"), "left_semi").groupBy(key).agg(F.min_by(F.struct(*names), F.struct(text)).alias("row")).select("row.*")
        left = left.join(twice, F.col(key) == F.col("twice"), "left_anti").unionByName(repeats)
    return left.toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_components(frames.table(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM docs),
win AS (SELECT doc_id, p, count(*) OVER w AS n, string_agg(word, ' ') OVER w AS s, count(*) OVER (PARTITION BY doc_id) AS words
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, s FROM win WHERE n = 5 OR (words < 5 AND p = 1)),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
