"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves hold runs of up
to LEAF pre-tokens with their lengths and token counts, inner nodes the sums of
their two children. An edit replaces the code points [start, end) of the text as
it is then. Only the pre-tokens that the edit touches are split and encoded
again, with as much context as can change them: on the left from the last
boundary whose match looked at no changed character, on the right until a
boundary of the new split falls on one of the old. Sums are updated on the way
to the root: what is encoded again and updated does not grow with the document
(its text is one string, which an edit copies once).

Trees are kept: ``trees`` makes a table of texts with their packed trees, and
``apply_edits`` takes such a table and edits, and returns the next one. A tree
is loaded from its bytes, so nothing but the edited regions is split or encoded
after the first count.

The split is that of the vocabulary's pattern, the counts those of its merges
(``byte_bpe_50k.tiktoken``); special tokens count as ordinary text. Edits with
offsets beyond the text are cut to it. Null text counts as empty; a document
without edits keeps its count; rows that repeat a doc_id all get the same edits,
in order of ``seq`` (edits of equal seq by start, end, then text); a very long
text is one row; other columns are not read; an empty table returns no rows.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.llm import frames

LEAF = 32
#: Code points beyond its end that a match of the pattern may look at.
LOOKAHEAD = 2
REMEMBERED = 200_000

SCHEMA = "doc_id long, n_chars long, n_tokens long, n_pretokens long, n_edits long, n_chars_after long, n_tokens_after long, n_pretokens_after long, n_encoded_again long"
EDITS = "array<struct<start:long,end:long,text:string>>"


class Counter:
    """Splits text into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) < 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@functools.lru_cache(maxsize=2)
def counter(ranks_path: str, pattern: str) -> Counter:
    return Counter(ranks_path, pattern)


class Tree:
    """A document as a segment tree of pre-tokens.

    A leaf holds rows (length, tokens): a view of one array for the whole document,
    or a list of pairs once an edit has touched it. ``sums`` holds code points, tokens
    and pre-tokens over an implicit binary tree of a power of two of leaves.
    """

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        parts = counter.split(text)
        pieces = np.empty((len(parts), 2), np.uint32)
        pieces[:, 0] = np.fromiter(map(len, parts), np.uint32, len(parts))
        pieces[:, 1] = np.fromiter(map(counter.count, parts), np.uint32, len(parts))
        self._build(pieces)

    def packed(self) -> bytes:
        """The sizes of the leaves, and the lengths and token counts of their pre-tokens."""
        sizes = np.array([len(x) for x in self.leaves], np.uint32)
        return b"".join([np.uint32(len(sizes)).tobytes(), sizes.tobytes(), *(x.tobytes() if isinstance(x, np.ndarray) else np.array(x, np.uint32).tobytes() for x in self.leaves)])

    @staticmethod
    def loaded(text: str, data: bytes, counter: Counter) -> Tree:
        """The tree that packed() wrote for this text; nothing is split or encoded."""
        tree = object.__new__(Tree)
        tree.text, tree.counter, tree.encoded = text, counter, 0
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        cut = np.append(0, np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64))
        tree._grow(np.frombuffer(data, np.uint32, offset=4 + 4 * n).reshape(-1, 2), cut)
        return tree

    def _build(self, pieces: np.ndarray) -> None:
        self._grow(pieces, np.append(np.arange(0, max(1, len(pieces)), LEAF), len(pieces)))

    def _grow(self, pieces: np.ndarray, cut: np.ndarray) -> None:
        """Leaves of the rows cut[k]:cut[k + 1] of pieces, and all sums, level by level."""
        count = len(cut) - 1
        self.width = 1 << (count - 1).bit_length()
        at = cut.tolist()
        self.leaves = [pieces[a:b] for a, b in zip(at, at[1:])] + [[] for _ in range(self.width - count)]
        upto = np.zeros((len(pieces) + 1, 2), np.int64)
        np.cumsum(pieces, axis=0, out=upto[1:])
        sums = np.zeros((2 * self.width, 3), np.int64)
        sums[self.width : self.width + count, :2] = upto[cut[1:]] - upto[cut[:-1]]
        sums[self.width : self.width + count, 2] = np.diff(cut)
        k = self.width
        while k > 1:
            sums[k // 2 : k] = sums[k : 2 * k : 2] + sums[k + 1 : 2 * k : 2]
            k //= 2
        self.sums = list(map(tuple, sums.tolist()))

    def _leaf(self, k: int) -> list[tuple[int, int]]:
        """Leaf k as a list, which it is from now on."""
        if isinstance(self.leaves[k], np.ndarray):
            self.leaves[k] = list(map(tuple, self.leaves[k].tolist()))
        return self.leaves[k]

    @property
    def total(self) -> tuple[int, int, int]:
        """Code points, tokens and pre-tokens of the document."""
        return self.sums[1]

    def _update(self, leaf: int) -> None:
        k = self.width + leaf
        self.sums[k] = _sum(self.leaves[leaf])
        while k > 1:
            k //= 2
            self.sums[k] = _add(self.sums[2 * k], self.sums[2 * k + 1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a code point, and the leaf's first code point."""
        k, at = 1, 0
        while k < self.width:
            left = self.sums[2 * k][0]
            if char < at + left or not self.sums[2 * k + 1][2]:
                k = 2 * k
            else:
                at, k = at + left, 2 * k + 1
        return k - self.width, at

    def edit(self, start: int, end: int, new: str) -> None:
        n = len(self.text)
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        # the first pre-token whose match looked at a changed character
        leaf, at = self.find(max(0, start - LOOKAHEAD - 1))
        while leaf and at > max(0, start - LOOKAHEAD - 1):
            leaf -= 1
            at -= self.sums[self.width + leaf][0]
        i, rows = 0, self._leaf(leaf)
        while i < len(rows) and at + rows[i][0] <= start - LOOKAHEAD:
            at += rows[i][0]
            i += 1
        first, offset, begin = leaf, i, at
        delta = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # old boundaries at or after the edit's end, in places of the new text
        old = at
        fresh: list[tuple[int, int]] = []
        place = begin
        while True:
            while old + delta < place or old < end:  # pass the old pre-tokens that the new ones have covered
                while i >= len(rows) and leaf + 1 < self.width:
                    leaf, i = leaf + 1, 0
                    rows = self._leaf(leaf)
                if i >= len(rows):
                    break
                old += rows[i][0]
                i += 1
            if old >= end and old + delta == place:
                break
            m = self.counter.pattern.match(self.text, place)
            if m is None:
                break
            fresh.append((m.end() - place, self.counter.count(m[0])))
            place = m.end()
        self.encoded += len(fresh)
        rest = rows[i:]
        if leaf == first:
            self.leaves[first] = rows[:offset] + fresh + rest
        else:
            self.leaves[first] = self._leaf(first)[:offset] + fresh
            for k in range(first + 1, leaf):
                if len(self.leaves[k]):
                    self.leaves[k] = []
                    self._update(k)
            self.leaves[leaf] = rest
            self._update(leaf)
        if len(self.leaves[first]) > 8 * LEAF:  # a large insertion: level the leaves again
            self._build(np.concatenate([np.asarray(x, np.uint32).reshape(-1, 2) for x in self.leaves]))
        else:
            self._update(first)


def _sum(leaf: list[tuple[int, int]]) -> tuple[int, int, int]:
    return sum(n for n, _ in leaf), sum(t for _, t in leaf), len(leaf)


def _add(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


TREES = "doc_id long, text string, tree binary, n_chars long, n_tokens long, n_pretokens long"
_AFTER = "doc_id long, text string, tree binary, n_chars long, n_tokens long, n_pretokens long, n_edits long, n_chars_after long, n_tokens_after long, n_pretokens_after long, n_encoded_again long"


def trees(docs: DataFrame, vocabulary: tuple[str, str], *more: str) -> DataFrame:
    """One row of TREES for each row of docs (doc_id, text): what a table of kept trees holds; more: columns to carry."""
    docs = frames.texts(docs, *more)

    def make(b: pa.RecordBatch) -> dict:
        c = counter(*vocabulary)
        packed, totals = [], []
        for x in b.column(1):  # one tree at a time: a batch of them would fill the memory
            tree = Tree(x.as_py() or "", c)
            packed.append(tree.packed())
            totals.append(tree.total)
        sums = {n: pa.array(v, pa.int64()) for n, v in zip(("n_chars", "n_tokens", "n_pretokens"), zip(*totals, strict=True), strict=True)}
        return {"doc_id": b.column(0), "text": b.column(1).fill_null(""), "tree": pa.array(packed, pa.binary())} | sums | {n: b.column(n) for n in more}

    return frames.by_batch(docs, make, StructType([*StructType.fromDDL(TREES), *(docs.schema[n] for n in more)]))


def apply_edits(kept: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """The rows of kept (TREES and edits: EDITS or null) after their edits: text, tree and sums before and after."""

    def make(b: pa.RecordBatch) -> dict:
        c = counter(*vocabulary)
        rows = []
        for text, tree, edits in zip(b.column(1), b.column(2), b.column(6)):
            t = Tree.loaded(text.as_py() or "", tree.as_py(), c)
            edits = [e for e in edits.as_py() or [] if e is not None]
            for e in edits:
                t.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["text"] or "")
            rows.append((t.text, t.packed(), len(edits), *t.total, t.encoded))
        texts, packed, *numbers = zip(*rows, strict=True)
        names = ("n_edits", "n_chars_after", "n_tokens_after", "n_pretokens_after", "n_encoded_again")
        out = {n: b.column(n) for n in ("doc_id", "n_chars", "n_tokens", "n_pretokens")}
        return out | {"text": pa.array(texts, pa.string()), "tree": pa.array(packed, pa.binary())} | {n: pa.array(v, pa.int64()) for n, v in zip(names, numbers, strict=True)}

    return frames.by_batch(kept.select("doc_id", "text", "tree", "n_chars", "n_tokens", "n_pretokens", F.col("edits").cast(EDITS)), make, _AFTER)


def count_tokens(docs: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text, edits: EDITS or null)."""
    docs = docs.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits"))
    return apply_edits(trees(docs, vocabulary, "edits"), vocabulary).drop("text", "tree")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the edits (doc_id, seq, start, end, text) of each, in order of seq.

    The texts are shuffled by doc_id; edits are gathered by document first.
    """
    gathered = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("_edits"))
    one = F.transform("_edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["text"].alias("text")))
    docs = frames.texts(docs)
    return docs.join(gathered, docs["doc_id"] == gathered["_id"], "left").select("doc_id", "text", one.alias("edits"))


def revised(docs: DataFrame) -> DataFrame:
    """docs with three edits of each, drawn from its id: a deletion, an insertion and a replacement."""
    n = F.length("text")
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1)
    edit = lambda a, size, text: F.struct(a.cast("long").alias("start"), (a + size).cast("long").alias("end"), text.alias("text"))
    edits = F.array(
        edit(place(1), F.lit(7), F.lit("")),
        edit(place(2), F.lit(0), F.concat(F.lit(" rev"), F.pmod(F.xxhash64("doc_id"), F.lit(1000)).cast("string"), F.lit("'s"))),
        edit(place(3), F.lit(3), F.lit("  \n  é ")),
    )
    return frames.texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text", edits.alias("edits"))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(revised(frames.table(spark, sf_dir, "documents")), default_vocabulary())
