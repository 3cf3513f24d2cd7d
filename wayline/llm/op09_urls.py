"""URL filters: all glob rules run at once over each URL as a bit-parallel automaton.

Rules are packed one after the other into the bits of 64-bit words (extended
Shift-And): a bit stands for one symbol of one rule. ``*`` matches any run of
characters but ``/``, ``**`` any run at all, every other character itself; a
rule must match the whole canonical URL. A step of the automaton is a shift, an
or and two ands for each word of bits; it is done for all URLs of a batch
together, column of characters by column.

The canonical URL is ``host`` + ``path``: the host after the first ``://`` up to
``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path then up to ``?``, ``#``
or the end. Between the two the automaton reads one byte that no UTF-8 text
holds: host rules name it, so that they end where the host ends; globs pass over
it. The automaton alone decides which rules fit.

A null URL or one without ``://`` has an empty host and path; no rule fits it. Of
the host rules that fit, the longest decides, and of equally long ones the first
of the list; where none fits, a URL is blocked if a glob of the block list
matches it, else allowed. Repeated rows are judged one by one; a very long URL
is one row of its batch; other columns, whatever their names, are not read; an
empty table returns no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayline.llm import frames

SCHEMA = "page_id long, host string, path string, rule string, verdict string"

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What the method itself blocks: hosts of spam farms, shops for pills, casinos, and downloads of programs.
BLOCKED = ("**spam-farm.**", "**cheap-pills.**", "**casino*.*/**", "*/**.exe", "*/**.apk")


#: Between host and path.
EDGE = 0xFF


@dataclass(frozen=True)
class Automaton:
    """Masks of n rules over w words: what each byte lets pass, where runs may stay, where rules start and end."""

    step: np.ndarray  # [256, w] positions that a byte moves into
    stay: np.ndarray  # [256, w] positions in which a byte may remain (wildcards)
    start: np.ndarray  # [w]
    final: np.ndarray  # [n] bit of each rule's end

    @staticmethod
    def of(hosts: list[tuple[str, str]], globs: list[str]) -> Automaton:
        """One rule for each (host, path), on the host and its subdomains, then one for each glob."""
        edge = bytes([EDGE])
        symbols: list[tuple[list[bytes | str], bool]] = []  # wildcards are str; and whether a rule passes over the edge
        for host, path in hosts:
            own = [bytes([c]) for c in host.encode() + edge + path.encode()] + ["**"]
            symbols += [(own, False), (["**", b".", *own], False)]
        symbols += [(_symbols(g), True) for g in globs]
        # position 0 of each rule is its start; a wildcard is a loop on the position before it
        size = sum(1 + sum(isinstance(s, bytes) for s in r) for r, _ in symbols)
        w = max(1, -(-size // 64))
        step, stay = np.zeros((256, w), np.uint64), np.zeros((256, w), np.uint64)
        start, final = np.zeros(w, np.uint64), []
        text = np.arange(256) != EDGE
        at = 0
        for r, over in symbols:
            first = at
            start[at // 64] |= np.uint64(1 << (at % 64))
            for s in r:
                bit = np.uint64(1 << (at % 64))
                if s == "**":
                    stay[text if not over else slice(None), at // 64] |= bit
                elif s == "*":
                    stay[text & (np.arange(256) != 0x2F), at // 64] |= bit
                else:
                    at += 1
                    step[s[0], at // 64] |= np.uint64(1 << (at % 64))
            if over:
                for k in range(first, at + 1):
                    stay[EDGE, k // 64] |= np.uint64(1 << (k % 64))
            final.append(at)
            at += 1
        return Automaton(step, stay, start, np.array(final))

    def match(self, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """[texts, rules]: whether a rule matches a whole text of bytes."""
        n = len(cut) - 1
        length = np.diff(cut)
        order = np.argsort(-length, kind="stable")
        state = np.tile(self.start, (n, 1))
        cut0, length = cut[:-1][order], length[order]
        one, top = np.uint64(1), np.uint64(63)
        alive = n
        for k in range(int(length[0]) if n else 0):
            while alive and length[alive - 1] <= k:
                alive -= 1
            c = data[cut0[:alive] + k]
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.step[c]) | (now & self.stay[c])
        out = np.empty((n, len(self.final)), bool)
        out[order] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & one
        return out


def _symbols(glob: str) -> list[bytes | str]:
    """The symbols of a glob: wildcards, and every byte of all else."""
    return [x for s in re.findall(r"\*\*|\*|[^*]", glob) for x in ([s] if s[0] == "*" else [bytes([c]) for c in s.encode()])]


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, both empty without ``://``."""
    if url is None or (k := url.find("://")) < 0:
        return "", ""
    m = re.compile(r"([^/?#]*)([^?#]*)", re.S).match(url, k + 3)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def url_filters(pages: DataFrame, rules=RULES, blocked=BLOCKED, batch: int = 4096) -> DataFrame:
    """One row of SCHEMA for each row of pages (page_id, url). Rules are few and sent with the code."""
    # by falling priority: the longest rule first, of equals the first of the list
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = [f"{host}{path}" for _, host, path in rules]
    verdicts = [v for v, _, _ in rules]
    machine = Automaton.of([r[1:] for r in rules], list(blocked))
    n = len(rules)

    def judge(urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        parts = [canonical(u) for u in urls]
        raw = [h.encode() + bytes([EDGE]) + p.encode() for h, p in parts]
        cut = np.cumsum([0, *map(len, raw)])
        hit = machine.match(np.frombuffer(b"".join(raw), np.uint8), cut)
        bad = hit[:, 2 * n :].any(axis=1)
        fits = hit[:, : 2 * n].reshape(len(urls), n, 2).any(axis=2)
        rule = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if n else np.full(len(urls), -1)
        return [(h, p, names[r] if r >= 0 else None, verdicts[r] if r >= 0 else "block" if b else "allow") for (h, p), r, b in zip(parts, rule.tolist(), bad.tolist(), strict=True)]

    def make(b: pa.RecordBatch) -> dict:
        urls, rows = b.column(1).to_pylist(), []
        for i in range(0, len(urls), batch):
            rows += judge(urls[i : i + batch])
        host, path, rule, verdict = zip(*rows, strict=True)
        return {"page_id": b.column(0), "host": pa.array(host, pa.string()), "path": pa.array(path, pa.string()), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}

    return frames.by_batch(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url"), make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return url_filters(frames.table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
  WHEN regexp_matches(host, '^(.*\.)?example\.net$') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN regexp_matches(host, '^(.*\.)?example\.com$') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN regexp_matches(host, '^(.*\.)?org$') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN regexp_matches(host, '^(.*\.)?net$') AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host || path, 'spam-farm.') OR contains(host || path, 'cheap-pills.')
    OR regexp_matches(host || path, 'casino[^/]*\.[^/]*/') OR regexp_matches(host || path, '^[^/]*/.*\.(exe|apk)$') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
