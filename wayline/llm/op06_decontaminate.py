"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Items are the indexed side, training passages the queries. Every document is cut
into passages of PASSAGE words that start every STEP words, so all words are searched. Impacts are stored relative to the item's own
threshold: SHARE of its score against itself, less for items longer than a
passage. A passage retrieves every item whose relative score is 1 or more.

The commonest terms of an item are light: together they reach at most LIGHT of
its threshold, so a passage must hold the rest in heavier terms of that item.
This bound is taken at once for all passages of a slice, from the heavy postings
of their words; what it leaves goes through WAND: cursors
over postings in order of item, a pivot by list bounds, a second look by block
bounds, then the exact score. A retrieved pair is verified on the words about the
passage: enough of the item's question shingles and enough of its answer's must
be there. An item's answer is its last sentence (of three words or more, else
with those before it), or the last quarter of its words where it has one sentence.

The index holds at most SHARD_BYTES of item text; a larger benchmark is indexed
in shards, one pass over the documents each, with document frequencies of the
whole benchmark. Null and empty texts match nothing; items without words are
left out; repeated rows of a document or an item give the pair once; a null
doc_id or item_id gives no pair; a very long text is one slice and is searched
whole; of other columns none is read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import frames
from wayline.llm.words import LOWER, Words, slices, window_hashes

PASSAGE, STEP, BLOCK = 64, 32, 16
K1, B, SHARE, LIGHT = 1.2, 0.75, 0.5, 0.6
#: Shares of an item's question and answer shingles (of SHINGLE words; a shorter answer's words) to be found.
QUESTION, ANSWER, SHINGLE = 0.7, 0.6, 3
SHARD_BYTES = 8 << 20
_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0x20


def fold(data: np.ndarray) -> np.ndarray:
    """Letters of ASCII and Latin-1 in lower case, ASCII signs as spaces: so words are compared."""
    out = _PLAIN[data]
    if len(data) > 1:
        second = data[1:]
        out[1:][(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


class Index:
    """Postings with relative impacts, list and block bounds, and what verification needs of each item."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], total: int, average: float):
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.question: list[np.ndarray] = []
        self.answer: list[np.ndarray] = []
        self.need: list[float] = []
        lists: dict[int, list[tuple[int, float]]] = {}
        heavy: list[tuple[int, int, float]] = []
        for item, text in sorted(items):
            w = next(slices(pa.array([text]), fold=fold))[2]
            h, n = w.hashes, len(w.hashes)
            if not n:
                continue
            k = len(self.ids)
            terms, tf = np.unique(h, return_counts=True)
            df = np.array([frequency.get(int(t), 1) for t in terms.tolist()])
            impact = np.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average))
            least = SHARE * impact.sum() * min(1.0, 0.75 * PASSAGE / n)
            impact = impact / least
            for t, x in zip(terms.tolist(), impact.tolist()):
                lists.setdefault(t, []).append((k, x))
            common = np.argsort(-df, kind="stable")
            light = np.cumsum(impact[common]) <= LIGHT
            self.need.append(1 - float(impact[common][light].sum()))
            heavy += [(t, k, x) for t, x in zip(terms[common][~light].tolist(), impact[common][~light].tolist())]
            self.ids.append(item)
            self.lengths.append(n)
            cut = _answer_start(text, n)
            self.question.append(np.unique(_shingles(h[:cut])))
            self.answer.append(np.unique(_shingles(h[cut:]) if n - cut >= SHINGLE else h[cut:]))
        self.terms = np.array(sorted(lists), np.uint64)
        self.postings = [lists[int(t)] for t in self.terms.tolist()]
        self.bound = np.array([max(x for _, x in p) for p in self.postings])
        self.blocks = [[max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.postings]
        number = {int(t): k for k, t in enumerate(self.terms.tolist())}
        heavy = sorted((number[t], k, x) for t, k, x in heavy)
        self.heavy_item = np.array([k for _, k, _ in heavy], np.int64)
        self.heavy_impact = np.array([x for *_, x in heavy])
        self.heavy_cut = np.searchsorted(np.array([t for t, *_ in heavy]), np.arange(len(self.terms) + 1))
        self.least = np.array(self.need)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def term(self, h: np.ndarray) -> np.ndarray:
        """The number of each word's list, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def hopeful(self, term: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
        """Cells of words at which a passage (the cell and the next) may reach an item; term: each word's list, or -1."""
        known = np.flatnonzero(term >= 0)
        count = self.heavy_cut[term[known] + 1] - self.heavy_cut[term[known]]
        total = int(count.sum())
        out = np.zeros(cells + 1, bool)
        if not total:
            return out[:cells]
        at = np.repeat(self.heavy_cut[term[known]] - (np.cumsum(count) - count), count) + np.arange(total)
        n = len(self.ids)
        key, place = np.unique(np.repeat(cell[known], count) * n + self.heavy_item[at], return_inverse=True)
        mass = np.bincount(place, self.heavy_impact[at])
        need = self.least[key % n] - 1e-9
        own = key[mass >= need] // n
        out[own] = True
        out[np.maximum(own - 1, 0)] = True
        following = np.minimum(np.searchsorted(key, key + n), len(key) - 1)
        both = mass + np.where(key[following] == key + n, mass[following], 0.0)
        out[key[both >= need] // n] = True
        return out[:cells]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, relative score) of all items that the distinct terms score 1 or more."""
        end = len(self.ids)
        lists = [(self.postings[t], float(self.bound[t]), self.blocks[t]) for t in terms]
        cursor = [0] * len(lists)
        order = sorted(range(len(lists)), key=lambda k: lists[k][0][0][0])
        now = lambda k: lists[k][0][cursor[k]][0] if cursor[k] < len(lists[k][0]) else end
        found = []

        def advance(k: int, item: int) -> None:
            p, c = lists[k][0], cursor[k]
            while c + BLOCK < len(p) and p[c + BLOCK][0] <= item:
                c += BLOCK
            while c < len(p) and p[c][0] < item:
                c += 1
            cursor[k] = c

        while order:
            order = sorted((k for k in order if now(k) < end), key=now)
            total, pivot = 0.0, -1
            for at, k in enumerate(order):
                total += lists[k][1]
                if total >= 1 - 1e-9:
                    pivot = at
                    break
            if pivot < 0:
                break
            item = now(order[pivot])
            while pivot + 1 < len(order) and now(order[pivot + 1]) == item:
                pivot += 1
            front = order[: pivot + 1]
            # bounds of the blocks in which the item falls
            bound, nearest = 0.0, end
            for k in front:
                p, c = lists[k][0], cursor[k]
                b = c // BLOCK
                while (b + 1) * BLOCK < len(p) and p[min(len(p), (b + 1) * BLOCK) - 1][0] < item:
                    b += 1
                bound += lists[k][2][b]
                last = p[min(len(p), (b + 1) * BLOCK) - 1][0]
                nearest = min(nearest, max(last, item) + 1)
            if bound < 1 - 1e-9:  # no item before the nearest block end can reach 1
                target = max(item + 1, min(nearest, now(order[pivot + 1]) if pivot + 1 < len(order) else end))
                for k in front:
                    advance(k, target)
            elif now(order[0]) == item:
                score = sum(lists[k][0][cursor[k]][1] for k in front)
                if score >= 1 - 1e-9:
                    found.append((item, score))
                for k in front:
                    cursor[k] += 1
            else:
                for k in front:
                    if now(k) < item:
                        advance(k, item)
        return found

    def verify(self, item: int, h: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question shingles and answer words among the words h."""
        q, a = self.question[item], self.answer[item]
        share = lambda x, of: float(np.isin(x, of).mean()) if len(x) else 1.0
        either = np.concatenate([_shingles(h), h])
        return share(q, either), share(a, either)


def _shingles(h: np.ndarray) -> np.ndarray:
    if len(h) < SHINGLE:
        return h[:0]
    return window_hashes(h, np.arange(len(h) - SHINGLE + 1), SHINGLE)


def _answer_start(text: str, n: int) -> int:
    """The first of n words that is in the answer: the last sentences that have three words or more, or the last quarter."""
    for m in reversed(list(re.finditer(r"[.!?:]\s", text))):
        before = len(next(slices(pa.array([text[: m.end()]]), fold=fold))[2].starts)
        if n - before >= 3 and before:
            return before
    return max(1, n - max(1, n // 4)) if n > 1 else 0


def cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The cell of STEP words that each word is in, counted over all texts, and the text of each cell."""
    per_text = -(-w.n // STEP)
    first = np.cumsum(per_text) - per_text
    inside = np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.n)
    return np.repeat(first, w.n) + inside // STEP, np.repeat(np.arange(len(w.n)), per_text)


def _matches(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of verified pairs, the best score of each."""
    for base, _, w in slices(texts, fold=fold):
        term = index.term(w.hashes)
        cell, text_of = cells(w)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for c in np.flatnonzero(index.hopeful(term, cell, len(text_of))).tolist():
            text = int(text_of[c])
            a = int(np.searchsorted(cell, c))
            b = min(a + PASSAGE, int(w.first[text + 1]))
            own = np.unique(term[a:b])
            own = own[own >= 0]
            for item, score in index.search(own.tolist()):
                reach = index.lengths[item]
                low, high = max(int(w.first[text]), a - reach), min(int(w.first[text + 1]), b + reach)
                q, x = index.verify(item, w.hashes[low:high])
                if q >= QUESTION and x >= ANSWER and (score, q, x) > best.get((text, item), (0.0, 0.0, 0.0)):
                    best[text, item] = score, q, x
        for (text, item), (score, q, x) in sorted(best.items()):
            yield base + text, index.ids[item], round(score, 6), round(q, 6), round(x, 6)


def _indices(items: DataFrame) -> Iterator[Index]:
    """One index for each shard of the benchmark, with statistics of all of it; one is held at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in slices(batch.column(1), fold=fold):
                for k in range(len(w.n)):
                    h = w.hashes[w.first[k] : w.first[k + 1]]
                    terms = np.append(np.unique(h), np.uint64(0)).view(np.int64)  # the last row has the item's length
                    words = np.zeros(len(terms), np.int64)
                    words[-1] = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(words)], names=["term", "words"])

    counted = items.mapInArrow(count, "term long, words long")
    total, words = counted.where("words > 0").agg(F.count("*"), F.sum("words")).head()
    if not total:
        return
    frequency = counted.where("words = 0").groupBy("term").agg(F.count("*").alias("n"))
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        own = part.mapInArrow(count, "term long, words long").where("words = 0").select("term").distinct()
        df = {r[0] & ((1 << 64) - 1): r[1] for r in frequency.join(own, "term").collect()}
        yield Index([(r[0], r[1]) for r in part.collect()], df, total, words / total)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row of SCHEMA for each pair of a document and an item that it holds."""
    docs = frames.texts(docs).where("doc_id is not null and text is not null")
    out = None
    for index in _indices(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(b: pa.RecordBatch, sent=sent) -> dict:
            found = list(_matches(sent.value, b.column(1)))
            text, item, score, q, a = zip(*found, strict=True) if found else ((),) * 5
            return {"doc_id": b.column(0).take(pa.array(text, pa.int64())), "item_id": pa.array(item, pa.int64()), "score": pa.array(score, pa.float64()), "question_overlap": pa.array(q, pa.float64()), "answer_overlap": pa.array(a, pa.float64())}

        part = frames.by_batch(docs, make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item, all columns as they were."""
    at = docs.columns.index("text")
    for index in _indices(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(b: pa.RecordBatch, sent=sent) -> pa.Array:
            clean = np.ones(b.num_rows, bool)
            clean[[m[0] for m in _matches(sent.value, b.column(at).cast(pa.string()))]] = False
            return pa.array(clean)

        docs = frames.filtered(docs, keep)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


#: The whole of it without an index: every passage against every item (K1 1.2, B 0.75, passages of 64 words each 32).
_SQL = r"""
WITH d0 AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words_text} AS ws FROM d0),
i0 AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT row_number() OVER () AS i, item_id, text, {words_text} AS ws FROM i0),
known AS (SELECT *, CAST(len(ws) AS BIGINT) AS n FROM items WHERE len(ws) > 0),
total AS (SELECT count(*) AS m, sum(n) / count(*) AS average FROM known),
tf AS (SELECT i, n, term, count(*) AS tf FROM (SELECT i, n, unnest(ws) AS term FROM known) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
impact AS (SELECT tf.i, tf.n, tf.term, ln(1 + (m - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * tf.n / average)) AS x FROM tf JOIN df ON df.term = tf.term, total),
least AS (SELECT i, 0.5 * sum(x) * least(1.0, 0.75 * 64 / any_value(n)) AS least FROM impact GROUP BY i),
rel AS (SELECT impact.i, term, x / least AS x FROM impact JOIN least ON least.i = impact.i),
pass AS (SELECT r, doc_id, len(ws) AS n, unnest(range(0, len(ws), 32)) AS a, ws FROM docs),
terms AS (SELECT DISTINCT r, a, unnest(list_slice(ws, a + 1, a + 64)) AS term FROM pass),
hits AS (SELECT r, a, i, sum(x) AS score FROM terms JOIN rel ON rel.term = terms.term GROUP BY ALL HAVING sum(x) >= 1 - 1e-9),
marks AS (SELECT i, n, p, {words_mark} AS before FROM (SELECT i, n, text, unnest(range(1, length(text))) AS p FROM known) WHERE regexp_matches(substr(text, p, 2), '^[.!?:][\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]$')),
cuts AS (SELECT i, max_by(before, p) AS cut FROM marks WHERE n - before >= 3 AND before > 0 GROUP BY i),
parts AS (SELECT k.i, item_id, n, ws, coalesce(cut, CASE WHEN n > 1 THEN greatest(1, n - greatest(1, n // 4)) ELSE 0 END) AS cut FROM known k LEFT JOIN cuts ON cuts.i = k.i),
sides AS (SELECT i, item_id, n, {shingles_q} AS q, CASE WHEN n - cut >= 3 THEN {shingles_a} ELSE list_distinct(list_slice(ws, cut + 1, n)) END AS a FROM parts),
near AS (SELECT h.r, h.i, p.doc_id, s.item_id, score, q, s.a AS ans, list_slice(ws, greatest(0, h.a - s.n) + 1, least(p.n, least(p.n, h.a + 64) + s.n)) AS ws FROM hits h JOIN pass p ON p.r = h.r AND p.a = h.a JOIN sides s ON s.i = h.i),
either AS (SELECT * EXCLUDE ws, list_concat(ws, {shingles_n}) AS e FROM near),
share AS (SELECT r, i, doc_id, item_id, score, CASE WHEN len(q) = 0 THEN 1e0 ELSE len(list_filter(q, lambda x: list_contains(e, x))) / len(q) END AS q, CASE WHEN len(ans) = 0 THEN 1e0 ELSE len(list_filter(ans, lambda x: list_contains(e, x))) / len(ans) END AS a FROM either),
best AS (SELECT * FROM share WHERE q >= 0.7 AND a >= 0.6 QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY score DESC, q DESC, a DESC) = 1)
SELECT doc_id, item_id, max(round(score, 6)) AS score, max(round(q, 6)) AS question_overlap, max(round(a, 6)) AS answer_overlap FROM best GROUP BY doc_id, item_id
"""


def _oracle() -> str:
    """_SQL with words folded as fold does, and shingles as sets of three words joined by spaces."""
    upper = "".join(map(chr, [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]))
    lower = "".join(chr(ord(c) + 32) for c in upper)
    words = lambda t: rf"regexp_extract_all(regexp_replace(translate({t}, '{upper}', '{lower}'), '[!-/:-@\[-`{{-~]', ' ', 'g'), '[^\x20\x09-\x0D]+')"
    shingles = lambda low, high: f"list_distinct(list_transform(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT)), lambda j: ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2]))"
    return _SQL.format(words_text=words("text"), words_mark=f"len({words('substr(text, 1, p + 1)')})", shingles_q=shingles("1", "cut - 1"), shingles_a=shingles("cut + 1", "n - 1"), shingles_n=shingles("1", "len(ws) - 1"))


ORACLE = _oracle()
