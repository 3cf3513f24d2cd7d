"""Substring dedup: difference-cover anchors find repeated passages, then extend to exact windows.

A window is WINDOW consecutive words of one document. A word is removed if a
window that covers it starts anywhere else too, in this document or another.

With a difference cover D modulo a period P, any two positions i and j have a
shift d < P such that i + d and j + d both fall on D. So two equal windows share
an anchor of WINDOW - P + 1 words that starts on a cover position in both. The
plan, all of it lazy and recoverable:

1. Documents go to blocks by the hash of their id and text (one exchange of the
   text, which the later steps reuse), so that null or repeated ids spread.
2. Each block hashes its anchors, settles repeats within itself, and sends one
   entry for each distinct hash, so a passage that a third of all documents
   share gives one entry a block, not one a document.
3. Anchor hashes met in two blocks or more go back to their blocks.
4. Each block extends its repeated anchors to the windows around them and sends
   128-bit BLAKE2b digests of their true words, again one for each distinct window.
5. Repeated windows go back to their blocks, which remove the words covered.

Hashes only propose; digests of the words themselves decide. Entries travel as
packed arrays, a row for each pair of block and part. Blocks and parts grow in
number with the input, and slowly in size (with its root, up to MOST_BYTES), so
that a row carries many entries. Null and empty texts have no words; repeated
rows of a document count as copies of each other; a very long text is one slice
of its block and is never cut; an empty table returns no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import frames
from wayline.llm.words import Words, covered, repeated, slices, sums, window_hashes

WINDOW, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text for each block of documents and for each part of the hash space, and the most of either.
BLOCK_BYTES, PART_BYTES, MOST_BYTES = 6 << 20, 16 << 20, 64 << 20
#: Entries of one row at least, and bytes of text for each entry (five anchors to PERIOD words).
ROW_ENTRIES, ENTRY_BYTES = 50, 25

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SENT = "part int, blk int, n int, keys binary, local binary"
_BACK = "blk int, part int, hits binary"


def _cover_flags() -> np.ndarray:
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    assert all(any(on[(i + d) % PERIOD] and on[(j + d) % PERIOD] for d in range(PERIOD)) for i in range(PERIOD) for j in range(PERIOD))
    return on


_ON = _cover_flags()


def _anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the anchors; positions count from the start of each document."""
    last = np.repeat(w.first[1:], w.n)
    at = np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.n)
    long_enough = np.repeat(w.n >= WINDOW, w.n)
    pos = np.flatnonzero(_ON[at % PERIOD] & long_enough & (np.arange(len(at)) + ANCHOR <= last)) if len(at) else np.zeros(0, np.int64)
    return pos, window_hashes(w.hashes, pos, ANCHOR)


def _ordered(keys: np.ndarray) -> np.ndarray:
    return np.lexsort((keys["b"], keys["a"])) if keys.dtype.names else np.argsort(keys, kind="stable")


def dealt(size: int) -> tuple[int, int]:
    """Numbers of blocks and parts for size bytes of text."""
    # a block of b bytes sends b / ENTRY_BYTES entries in size / p rows, p the bytes of a part
    even = math.isqrt(ROW_ENTRIES * ENTRY_BYTES * size)
    return tuple(max(8, math.ceil(size / min(MOST_BYTES, max(least, even)))) for least in (BLOCK_BYTES, PART_BYTES))


def _sent(keys: np.ndarray, blk: int, parts: int) -> pa.Table:
    """The distinct keys of a block dealt to parts, with a flag for those met twice within the block."""
    order = _ordered(keys)
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    distinct = s[head]
    many = np.diff(np.append(np.flatnonzero(head), len(s))) > 1
    part = _part(distinct, parts)  # ordered, as keys are
    rows, start = np.unique(part, return_index=True)
    rows, edge = rows.tolist(), np.append(start, len(part)).tolist()
    spans = list(zip(edge[:-1], edge[1:], strict=True))
    return pa.table(
        {
            "part": pa.array(rows, pa.int32()),
            "blk": pa.array([blk] * len(rows), pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int32()),
            "keys": pa.array([distinct[a:b].tobytes() for a, b in spans], pa.binary()),
            "local": pa.array([np.packbits(many[a:b]).tobytes() for a, b in spans], pa.binary()),
        }
    )


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    first = keys["a"] if keys.dtype.names else keys
    return ((first >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _shared(dtype: np.dtype):
    """A function of one part: which keys of each block another block has too, or the block itself twice."""

    def run(t: pa.Table) -> pa.Table:
        blocks, counts = t["blk"].to_numpy(), t["n"].to_numpy()
        keys = np.concatenate([np.frombuffer(x, dtype) for x in t["keys"].to_pylist()])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["local"].to_pylist(), counts.tolist(), strict=True)])
        hit = _repeated(keys) | many.astype(bool)
        cut = np.append(0, np.cumsum(counts))
        return pa.table(
            {
                "blk": pa.array(blocks, pa.int32()),
                "part": pa.array(t["part"].to_numpy(), pa.int32()),
                "hits": pa.array([np.packbits(hit[cut[i] : cut[i + 1]]).tobytes() for i in range(len(blocks))], pa.binary()),
            }
        )

    return run


def _repeated(keys: np.ndarray) -> np.ndarray:
    if not keys.dtype.names:
        return repeated(keys)
    order = _ordered(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _found(keys: np.ndarray, back: pa.Table, parts: int) -> np.ndarray:
    """A mask of this block's keys that the parts found repeated."""
    order = _ordered(keys)
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    group = np.cumsum(head) - 1
    part = _part(s[head], parts)
    hit = np.zeros(len(part), bool)
    asked = back["part"].to_numpy()
    lo, hi = np.searchsorted(part, asked), np.searchsorted(part, asked, "right")
    for a, b, bits in zip(lo.tolist(), hi.tolist(), back["hits"].to_pylist(), strict=True):
        hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    out = np.zeros(len(keys), bool)
    out[order] = hit[group]
    return out


#: A window's key: the two halves of a digest of its words.
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


def window_keys(w: Words, at: np.ndarray, m: int = WINDOW) -> np.ndarray:
    """Digests of the true words of the windows at[k]:at[k] + m, joined by one space."""
    if not len(at):
        return np.zeros(0, _KEY)
    data, to = w.joined()
    view, digest = memoryview(data), hashlib.blake2b
    spans = zip(to[at].tolist(), (to[at + m] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in spans]), _KEY)


class _Block:
    """The documents of a block, in an order that every step repeats: by id, then text."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if t.num_rows > 1 else t
        self.ids, self.texts = t["doc_id"], t["text"]

    def words(self):
        return slices(self.texts)

    def anchors(self) -> np.ndarray:
        found = [_anchors(w)[1] for _, _, w in self.words()]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def candidates(self, anchor_hit: np.ndarray):
        """For each slice: its words, the candidate windows' first words, and their keys."""
        k = 0
        for i, j, w in self.words():
            pos, _ = _anchors(w)
            hit = pos[anchor_hit[k : k + len(pos)]]
            k += len(pos)
            total = len(w.starts)
            start = np.zeros(total, bool)
            if len(hit):  # windows that start up to PERIOD - 1 words before a repeated anchor
                text = np.searchsorted(w.first, hit, "right") - 1
                low = np.maximum(hit - PERIOD + 1, w.first[text])
                edge = np.bincount(low, minlength=total + 1) - np.bincount(hit + 1, minlength=total + 1)
                start = np.cumsum(edge[:total]) > 0
            last = np.repeat(w.first[1:], w.n)
            at = np.flatnonzero(start & (np.arange(total) + WINDOW <= last))
            yield i, j, w, at, window_keys(w, at)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: SCHEMA and the kept text."""
    docs = frames.texts(docs)
    blocks, parts = dealt(frames.text_bytes(docs))
    base = docs.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send_anchors(key, t):
        return _sent(_Block(t).anchors(), key[0].as_py(), parts)

    def send_windows(key, t, back):
        keys = _windows(t, back)
        return _sent(keys, key[0].as_py(), parts)

    def _windows(t: pa.Table, back: pa.Table) -> np.ndarray:
        block = _Block(t)
        hit = _found(block.anchors(), back, parts)
        found = [key for *_, key in block.candidates(hit)]
        return np.concatenate(found) if found else np.zeros(0, _KEY)

    def finish(key, t, back):
        first = back.filter(pc.equal(back["step"], 1))
        block = _Block(t)
        hit = _found(block.anchors(), first, parts)
        found = list(block.candidates(hit))
        keys = np.concatenate([x[4] for x in found]) if found else np.zeros(0, _KEY)
        twice = _found(keys, back.filter(pc.equal(back["step"], 2)), parts)
        n_words, n_removed, texts, k = [], [], [], 0
        for _, _, w, at, own in found:
            gone = covered(at[twice[k : k + len(at)]], WINDOW, len(w.starts))
            k += len(at)
            n_words.append(w.n)
            n_removed.append(sums(gone, w.first))
            texts += _kept(w, gone)
        return pa.table(
            {
                "doc_id": block.ids.cast(pa.int64()),
                "n_words": pa.array(np.concatenate(n_words).astype(np.int64)),
                "n_removed": pa.array(np.concatenate(n_removed).astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    anchors = base.groupBy("blk").applyInArrow(send_anchors, _SENT)
    back = anchors.groupBy("part").applyInArrow(_shared(np.dtype(np.uint64)), _BACK)
    windows = base.groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(send_windows, _SENT)
    again = windows.groupBy("part").applyInArrow(_shared(_KEY), _BACK)
    both = back.withColumn("step", F.lit(1)).unionByName(again.withColumn("step", F.lit(2)))
    return base.groupBy("blk").cogroup(both.groupBy("blk")).applyInArrow(finish, SCHEMA + ", kept_text string")


def _kept(w: Words, gone: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    keep = ~gone
    out, to = w.joined(keep)
    edge = to[np.searchsorted(np.flatnonzero(keep), w.first)]
    data = out.tobytes()
    return [data[edge[k] : max(edge[k], edge[k + 1] - 1)] for k in range(len(w.n))]


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(frames.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM docs),
win AS (SELECT doc_id, p, word, CASE WHEN count(*) OVER w = 35 THEN string_agg(word, ' ') OVER w END AS passage
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT passage FROM win WHERE passage IS NOT NULL GROUP BY passage HAVING count(*) > 1),
gone AS (SELECT doc_id, p, word, max(CASE WHEN passage IN (SELECT passage FROM twice) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS removed FROM win),
done AS (SELECT doc_id, count(*) AS n_words, CAST(sum(removed) AS BIGINT) AS n_removed,
  coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE removed = 0), '') AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id
"""
