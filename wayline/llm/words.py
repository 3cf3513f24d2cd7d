"""Vectorised words, lines and n-gram hashes over Arrow string columns.

A word is a maximal run of characters other than space and 0x09-0x0D. These are
single bytes in UTF-8 and never part of another character, so words are found
on the bytes. Hashes are polynomials over two prime fields of 31 bits, from
prefix sums shifted to a common origin: two different spans of n values agree
with probability (n / 2**31)**2 over the choice of bases, whatever the values.
(A polynomial modulo 2**64 would give some different spans equal hashes for
every base.) Where equality decides a result, ``classes`` and ``joined`` compare
the true words. Texts are taken in slices of bounded size, so memory does not
follow the length of a text or the number of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
SLICE = 1 << 20
#: The prime of the fields, and a base for each.
_P = np.uint64((1 << 31) - 1)
_BASES = (1_284_865_837, 1_752_073_949)
#: Odd multipliers of the mixer.
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Not the first byte of a character.
TRAILING = np.zeros(256, bool)
TRAILING[0x80:0xC0] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240611).integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base in the field."""
    if len(_powers.get(base, ())) < n:
        p = np.ones(1, np.uint64)
        while len(p) < max(SLICE + 64, n):
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), int(_P))) % _P])
        _powers[base] = p
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX1
    h ^= h >> np.uint64(33)
    h *= _MIX2
    h ^= h >> np.uint64(33)
    return h


def runs(fields: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values [start:end] for each pair; fields: the values below 2**31 in each field, at most SLICE or so."""
    out = np.zeros(len(starts), np.uint64)
    prefix = np.zeros(len(fields[0]) + 1, np.uint64)
    for base, values in zip(_BASES, fields, strict=True):
        x = values * powers(base, len(values))
        x = (x & _P) + (x >> np.uint64(31))  # below 2**33: sums of SLICE of them stay below 2**64
        np.cumsum(x, out=prefix[1:])
        down = powers(pow(base, -1, int(_P)), len(prefix))
        out = (out << np.uint64(31)) | (prefix[ends] - prefix[starts]) % _P * down[starts] % _P
    return mix(out + (ends - starts).astype(np.uint64) * _LENGTH)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for ordered, disjoint spans of bytes, in slices of SLICE bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + SLICE, "right")))
        if int(ends[i]) - at > SLICE:  # so for every occurrence of this span
            out[i] = int.from_bytes(hashlib.blake2b(data[at : int(ends[i])].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = data[at : int(ends[j - 1])]
        out[i:j] = runs([v[part] for v in _VALUES], starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


class Words:
    """The words of some texts: ``first[k]:first[k+1]`` are those of text k.

    data: all bytes; cut: byte offsets of the texts; starts, ends: byte offsets of words.
    """

    def __init__(self, data: np.ndarray, cut: np.ndarray):
        self.data, self.cut = data, cut
        inside = ~SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        heads = cut[:-1][cut[:-1] < len(data)]
        before[heads] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        tails = cut[1:][cut[1:] > 0] - 1
        after[tails] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, cut)
        self.n = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends)
        return self._hashes

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def windows(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of m words within one text, and the windows' hashes."""
        h = self.hashes
        total = len(h)
        last = np.repeat(self.first[1:], self.n)
        at = np.flatnonzero(np.arange(total) + m <= last)
        return at, window_hashes(h, at, m)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words (those that keep marks), each with one space behind it, and their offsets, with the end."""
        starts, ends = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        size = ends - starts + 1
        to = np.append(0, np.cumsum(size))
        out = np.full(int(to[-1]), 0x20, np.uint8)
        word = np.ones(len(out), bool)
        word[to[1:] - 1] = False
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[starts] = 1  # words of neighbouring texts may touch: one ends where the next starts
        inside[ends] -= 1
        out[word] = self.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        return out, to


def window_hashes(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the windows h[i:i+m] for the ordered starts i, in slices."""
    out = np.empty(len(at), np.uint64)
    i = 0
    while i < len(at):
        base = int(at[i])
        j = int(np.searchsorted(at, base + SLICE, "left"))
        part = h[base : int(at[j - 1]) + m]
        out[i:j] = runs([part >> np.uint64(33), part & _P], at[i:j] - base, at[i:j] - base + m)
        i = j
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, null as empty, and the offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n, at = len(texts), texts.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    cut = np.frombuffer(offsets, np.int64, n + 1, at * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[cut[0] : cut[-1]], cut - cut[0]


def slices(texts: pa.Array, lower: bool = False, size: int = SLICE, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, Words]]:
    """(i, j, words of texts i to j) in slices of about size bytes; a longer text is a slice of its own.

    fold: bytes to those that are read in their place; lower: A-Z as a-z.
    """
    fold = LOWER.__getitem__ if lower else fold
    data, cut = buffers(texts)
    i, n = 0, len(cut) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(cut, cut[i] + size, "right")) - 1))
        part = data[cut[i] : cut[j]]
        yield i, j, Words(part if fold is None else fold(part), cut[i : j + 1] - cut[i])
        i = j


def repeated(keys: np.ndarray) -> np.ndarray:
    """A mask of the keys that are there twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] are equal, for each triple, in pieces of about SLICE bytes."""
    out = np.ones(len(a), bool)
    full = np.flatnonzero(size)
    cut = np.append(0, np.cumsum(size[full]))
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + SLICE, "right")) - 1)
        some, n = full[i:j], cut[i:j] - cut[i]
        if j == i + 1:
            k = int(size[some[0]])
            out[some[0]] = np.array_equal(data[a[some[0]] : a[some[0]] + k], data[b[some[0]] : b[some[0]] + k])
        else:
            step = np.arange(int(cut[j] - cut[i]))
            same = data[np.repeat(a[some] - n, size[some]) + step] == data[np.repeat(b[some] - n, size[some]) + step]
            out[some] = np.logical_and.reduceat(same, n)
        i = j
    return out


def classes(keys: np.ndarray, text: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of spans, equal where text and bytes are; equal spans must have equal keys.

    Neighbours of one key are compared byte by byte. Where a key holds different spans, these are told apart one by one.
    """
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = group
    again = np.flatnonzero(~new)
    a, b = order[again - 1], order[again]
    size = ends - starts
    alike = (text[a] == text[b]) & (size[a] == size[b])
    alike[alike] = equal_spans(data, starts[a[alike]], starts[b[alike]], size[a[alike]])
    number = len(keys)
    for g in np.unique(group[again[~alike]]):
        seen: dict[tuple[int, bytes], int] = {}
        lo, hi = np.searchsorted(group, [g, g + 1])
        for i in order[lo:hi].tolist():
            key = int(text[i]), hashlib.blake2b(data[starts[i] : ends[i]]).digest()
            out[i] = seen.setdefault(key, number + len(seen))
        number += len(seen)
    return out


def covered(starts: np.ndarray, m: int, n: int) -> np.ndarray:
    """A mask of n positions: those in [s, s+m) for any s."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + m, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of values[cut[k]:cut[k+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]
