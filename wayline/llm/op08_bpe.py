"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never be
merged: the place between them is a certain cut. A word is split at its cuts,
each fragment is encoded on its own by rank order, and the ids are concatenated.
White space and the pre-tokenizer's pieces are cuts already. Fragments repeat
far more often than words, so both are remembered, in tables of bounded size.

The result equals that of the tokenizers library for the vocabularies of this
shape (byte-level BPE with word ends, NFC, white space folded, lower case), with
add_special_tokens=False. Special tokens written in a text become their ids.
Decoding joins the tokens with one space, as a tokenizer without a decoder does.

Null text counts as empty: no ids, an empty decoded text. A very long word costs
n log n. Repeated rows are encoded one by one; an empty table returns no rows.
The vocabulary file is read by each Python worker from ``path``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayline.llm import frames

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words and fragments that a worker remembers.
REMEMBERED = 250_000
_NONE = 1 << 60
#: What \s is to the vocabulary's normalizer.
_SPACES = "\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.spelled = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(self.tokens) + 1
        self.ranks = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.joined: set[int] = set()  # pairs of bytes that a token holds side by side
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.end)]
            for a, b in zip(raw, raw[1:]):
                self.joined.add(a << 8 | b)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACES))
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.spaces = re.compile(f"[{_SPACES}]+")
        # what was met lately, and before that: together they hold twice REMEMBERED entries at most
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fragments: dict[tuple[bytes, bool], bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.marks.split(text))

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-cased letter by letter: no final sigma
            text = text.replace("Σ", "σ")
        text = text.lower()
        words = self.spaces.split(text) if self.odd_space.search(text) else text.split()
        known, out = self.words, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                known = self.words
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            pieces = self.pieces.findall(word)
            if len(pieces) == 1:
                ids = self._piece(pieces[0].encode())
            else:
                found = [self.words.get(p) or self.older.get(p) for p in pieces]
                ids = b"".join([x or self._remember(p, self._piece(p.encode())) for p, x in zip(pieces, found)])
        return self._remember(word, ids)

    def _remember(self, word: str, ids: bytes) -> bytes:
        if len(word) < 64:
            if len(self.words) >= REMEMBERED:
                self.words, self.older = {}, self.words
            self.words[word] = ids
        return ids

    def cuts(self, piece: bytes) -> list[int]:
        """Where the piece is certainly cut, its ends included."""
        joined, n = self.joined, len(piece)
        return [0, *[k for k in range(1, n) if (piece[k - 1] << 8 | piece[k]) not in joined], n]

    def _piece(self, piece: bytes) -> bytes:
        cut = self.cuts(piece)
        if len(cut) == 2:
            return _packed(self._merge(piece, True))
        known, out = self.fragments, []
        for a, b in zip(cut, cut[1:]):
            part = piece[a:b], b == len(piece)
            ids = known.get(part)
            if ids is None:
                ids = _packed(self._merge(*part))
                if b - a < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def _merge(self, raw: bytes, ends_word: bool) -> list[int]:
        """Merges by rank, the leftmost of equal rank first."""
        inner = self.inner
        ids = [inner[b] for b in raw]
        if ends_word:
            ids[-1] = self.last[raw[-1]]
        if len(ids) > 100:
            return self._merge_long(ids)
        rank_of, size, made = self.ranks.get, self.size, self.made
        ranks = [rank_of(a * size + b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            k = ranks.index(best)
            ids[k] = new = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] * size + new, _NONE)
            if k < len(ranks):
                ranks[k] = rank_of(new * size + ids[k + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, size, n = self.ranks.get, self.size, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank_of(ids[k] * size + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (r := rank_of(ids[left] * size + ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids in the form that encode returns."""
        return b" ".join([self.spelled[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, name: str = "token_ids", back: str = "decoded_sha256") -> DataFrame:
    """docs without its text, the ids of the text as an array of integers, and the SHA-256 of what they decode to.

    Null text counts as empty; columns of the two names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", name, back)]
    at, places = docs.columns.index("text"), {k: docs.columns.index(k) for k in keep}

    def make(b: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = [c.encode(t or "") for t in b.column(at).to_pylist()]
        cut = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
        digests = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())
        return {k: b.column(i) for k, i in places.items()} | {name: pa.ListArray.from_arrays(pa.array(cut), values), back: digests}

    schema = docs.select(*keep).schema.add(name, T.ArrayType(T.IntegerType())).add(back, T.StringType())

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = make(b)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str, name: str = "token_ids") -> DataFrame:
    """doc_id and the text of the ids in the column name."""

    def make(b: pa.RecordBatch) -> dict:
        c = codec(path)
        return {"doc_id": b.column(0), "text": pa.array([c.decode(np.array(x or [], "<u4").tobytes()).decode() for x in b.column(1).to_pylist()], pa.string())}

    return frames.by_batch(tokens.selectExpr("cast(doc_id as long) doc_id", f"`{name}`"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row of SCHEMA for each row of docs: both directions in one pass."""

    def make(b: pa.RecordBatch) -> dict:
        c, n, a, d = codec(path), [], [], []
        for t in b.column(1):
            ids = c.encode(t.as_py() or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            d.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": d}

    return frames.by_batch(frames.texts(docs), make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(frames.table(spark, sf_dir, "documents"), default_path())
