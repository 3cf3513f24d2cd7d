"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are leftmost, non-overlapping matches per kind that pass their check.
The field scores whole candidate segments of up to MAX_TOKENS tokens for each
kind by features of the span as a whole (digit groups, separators, Luhn, at and
dot words, cue words before it, what touches its ends), and a dynamic program
over tokens chooses boundaries and kinds jointly. A span of the best labelling
is added if the posterior of an entity of its kind in that place is at least
CERTAIN, that of its own bounds at least BOUNDS, and no base span overlaps it.

The field is trained here, by maximum likelihood on SENTENCES generated
sentences with known spans (fixed seed; no corpus rows); ``write_weights`` does
so and keeps the weights in WEIGHTS beside this module, so that no session has to
train (a test trains again and compares). Only stretches of text
around digits, ``@`` and spelled-out ``at``/``dot`` can hold an entity, so the
program runs there; elsewhere every token is outside. Every text is searched
whole; patterns are linear in its length. Offsets are code points, end
exclusive. Null text counts as empty and has no spans; repeated rows are
searched one by one; other columns are not read; an empty table returns no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayline.llm import frames

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

MAX_TOKENS, CERTAIN, BOUNDS, SENTENCES, REACH = 24, 0.9, 0.4, 1500, 48
#: The trained weights, [kinds][features], as JSON.
WEIGHTS = pathlib.Path(__file__).with_name("op03_weights.json")

# ---------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = nxt = m.end()
        else:
            low = at + 1  # no local part reaches over this sign
        at = text.find("@", nxt)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """Four numbers joined by dots, from the left of each dotted run of numbers."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), ordered."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, a, b) for a, b in _ips(text)]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_TRIGGER = re.compile(r"[0-9@]+")
_SPOKEN = re.compile(r"[\[({]\s?at\s?[\])}]|\bdot\b", re.I)
_CUES = {
    "email": ("email", "mail", "e-mail", "contact", "write", "correo"),
    "ip": ("ip", "host", "server", "address", "ping", "node"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "ring"),
}
_AT, _DOT = ("at",), ("dot",)
#: Ends of host names that are words of their own in addresses.
_ENDS = frozenset(("com", "org", "net", "edu", "gov", "io", "de", "uk", "fr", "es", "eu", "info"))
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_NAMES = (
    "bias", "digits<7", "digits7", "digits8", "digits9", "digits10", "digits11", "digits12", "digits13-15", "digits16", "digits17-19", "digits>19",
    "luhn", "not luhn", "letters", "no letters", "@", "spelled at", "two ats", "dot in host", "spelled dot", "letters end", "four parts", "part>255",
    "groups 3-3-4", "groups 3-4", "groups 4x4", "starts +", "starts (", "separators none", "separators one kind", "separators mixed", "other signs", "other words",
    "touches left", "touches right", "brackets balance", "tokens>14", "cue email", "cue ip", "cue card", "cue phone", "any cue", "runs of space", "digit before", "digit after", "groups like date", "long local", "bracketed at", "bracketed dot", "known end",
)
_AT_FEATURE = {n: k for k, n in enumerate(_NAMES)}
N_FEATURES = len(_NAMES)


def _in_brackets(toks: list[str], k: int) -> bool:
    before = toks[k - 1] if k and not toks[k - 1].isspace() else toks[k - 2] if k > 1 else ""
    after = toks[k + 1] if k + 1 < len(toks) and not toks[k + 1].isspace() else toks[k + 2] if k + 2 < len(toks) else ""
    return before in _OPEN and after in _CLOSE and before != "" and after != ""


class Lattice:
    """The tokens of a stretch of text and its candidate segments with their features."""

    def __init__(self, text: str, low: int = 0, high: int | None = None):
        high = len(text) if high is None else high
        self.tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, low, high)]
        self.low, self.high, self.text = low, high, text
        self.segments: list[tuple[int, int]] = []
        self.rows: list[list[int]] = []
        n = len(self.tokens)
        digits = [0]
        marks = [0]
        for t, _, _ in self.tokens:
            digits.append(digits[-1] + (len(t) if "0" <= t[0] <= "9" else 0))
            marks.append(marks[-1] + (t == "@" or t.lower() in ("at", "dot")))
        for i, (t, _, _) in enumerate(self.tokens):
            if not (t[0].isalnum() or t in "+("):
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                last = self.tokens[j - 1][0]
                if not last[0].isalnum():
                    if last == "\n":
                        break
                    continue
                if digits[j] - digits[i] >= 7 or marks[j] - marks[i] and j - i >= 3 and t[0].isalpha() | t[0].isdigit() or digits[j] - digits[i] >= 4 and j - i >= 7:
                    self.segments.append((i, j))
                    self.rows.append(self.features(i, j))

    def features(self, i: int, j: int) -> list[int]:
        f = _AT_FEATURE
        toks = [t for t, _, _ in self.tokens[i:j]]
        groups = [t for t in toks if "0" <= t[0] <= "9"]
        raw = "".join(groups)
        n = len(raw)
        words = [t.lower() for t in toks if t[0].isalpha()]
        signs = [t for t in toks if not t[0].isalnum()]
        out = [f["bias"]]
        out.append(f["digits<7"] if n < 7 else f["digits>19"] if n > 19 else f["digits17-19"] if n > 16 else f["digits16"] if n == 16 else f["digits13-15"] if n > 12 else f[f"digits{n}"])
        if 13 <= n <= 19:
            out.append(f["luhn"] if raw.isascii() and luhn(raw) else f["not luhn"])
        out.append(f["letters"] if words else f["no letters"])
        ats = sum(t == "@" for t in signs) + sum(w in _AT for w in words)
        if "@" in signs:
            out.append(f["@"])
        elif ats:
            out.append(f["spelled at"])
        if ats > 1:
            out.append(f["two ats"])
        at = next((k for k, t in enumerate(toks) if t == "@" or t.lower() in _AT), None)
        if at is not None:
            host = toks[at + 1 :]
            if "." in host:
                out.append(f["dot in host"])
            if any(t.lower() in _DOT for t in host):
                out.append(f["spelled dot"])
            if at > 7:
                out.append(f["long local"])
            spoken = set(_AT) | set(_DOT)
            # a local part or host of more than one unjoined word is a sentence, not an address
            joined = [t for k, t in enumerate(toks) if t[0].isalnum() and k and toks[k - 1].isspace() and t.lower() not in spoken and not (k >= 2 and (toks[k - 2].lower() in spoken or toks[k - 2] in "@])}."))]
            if joined:
                out.append(f["other words"])
            for name, marks in (("bracketed at", _AT), ("bracketed dot", _DOT)):
                if any(t.lower() in marks and _in_brackets(toks, k) for k, t in enumerate(toks)):
                    out.append(f[name])
            if toks[-1].lower() in _ENDS:
                out.append(f["known end"])
        elif words:
            out.append(f["other words"])
        if 2 <= len(toks[-1]) <= 6 and toks[-1].isalpha():
            out.append(f["letters end"])
        if len(groups) == 4 and not words and all(len(g) <= 3 for g in groups):
            out.append(f["four parts"])
            if any(int(g) > 255 for g in groups):
                out.append(f["part>255"])
        sizes = [len(g) for g in groups]
        if sizes[-3:] == [3, 3, 4]:
            out.append(f["groups 3-3-4"])
        if sizes == [3, 4]:
            out.append(f["groups 3-4"])
        if sizes == [4, 4, 4, 4]:
            out.append(f["groups 4x4"])
        if len(sizes) >= 3 and sorted(sizes[:3]) == [2, 2, 4]:
            out.append(f["groups like date"])
        if toks[0] in "+(":
            out.append(f["starts +"] if toks[0] == "+" else f["starts ("])
        if not words:
            kinds = set(signs) - set("+()")
            out.append(f["separators none"] if not kinds else f["separators one kind"] if len(kinds) == 1 else f["separators mixed"])
        if set(signs) - set(" -.()[]{}@+_"):
            out.append(f["other signs"])
        if signs.count("(") != signs.count(")") or signs.count("[") != signs.count("]"):
            out.append(f["brackets balance"])
        if any(a.isspace() and b.isspace() for a, b in zip(toks, toks[1:])):
            out.append(f["runs of space"])
        if j - i > 14:
            out.append(f["tokens>14"])
        before = self.text[max(0, self.tokens[i][1] - 1) : self.tokens[i][1]]
        after = self.text[self.tokens[j - 1][2] : self.tokens[j - 1][2] + 2]
        if before and (before.isalnum() or before in "+-_@.#$/"):
            out.append(f["touches left"])
        if after and (after[0].isalnum() or after[0] in "@_%/$" or after[0] in "-.:," and after[1:].isalnum()):
            out.append(f["touches right"])
        near = [t.lower() for t, _, _ in self.tokens[max(0, i - 4) : i] if not t.isspace()]
        if near and near[-1][0].isdigit():
            out.append(f["digit before"])
        following = [t for t, _, _ in self.tokens[j : j + 2] if not t.isspace()]
        if following and following[0][0].isdigit():
            out.append(f["digit after"])
        for kind, cues in _CUES.items():
            if any(w in cues for w in near):
                out += [f[f"cue {kind}"], f["any cue"]]
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """[segments, kinds] of the linear scores."""
        return np.array([weights[:, r].sum(axis=1) for r in self.rows]).reshape(-1, len(KINDS))

    def by_end(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(len(self.tokens) + 1)]
        for k, (_, j) in enumerate(self.segments):
            out[j].append(k)
        return out

    def marginals(self, score: np.ndarray) -> tuple[np.ndarray, float]:
        """Posterior of each segment and kind, and the log partition sum; a token outside scores 0."""
        n, ends = len(self.tokens), self.by_end()
        forward = np.zeros(n + 1)
        whole = np.logaddexp.reduce(score, axis=1) if len(score) else np.zeros(0)
        for j in range(1, n + 1):
            parts = [forward[j - 1]] + [forward[self.segments[k][0]] + whole[k] for k in ends[j]]
            forward[j] = _log_sum(parts)
        backward = np.zeros(n + 1)
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(self.segments):
            starts[i].append(k)
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1]] + [backward[self.segments[k][1]] + whole[k] for k in starts[i]])
        if not len(score):
            return score, float(forward[n])
        a, b = np.array(self.segments).T
        return np.exp(forward[a][:, None] + score + backward[b][:, None] - forward[n]), float(forward[n])

    def best(self, score: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, start token, kind) of the best labelling."""
        n, ends = len(self.tokens), self.by_end()
        value, choice = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ends[j]:
                kind = int(score[k].argmax())
                if (s := value[self.segments[k][0]] + score[k, kind]) > value[j]:
                    value[j], choice[j] = s, (k, kind)
        out, j = [], n
        while j:
            k, kind = choice[j]
            if k < 0:
                j -= 1
            else:
                out.append((k, self.segments[k][0], kind))
                j = self.segments[k][0]
        return out[::-1]


def _log_sum(parts: list[float]) -> float:
    if len(parts) == 1:
        return parts[0]
    top = max(parts)
    return top + math.log(sum(math.exp(x - top) for x in parts))


# ---------------------------------------------------------------- training


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its entities (kind, start, end)."""
    word = lambda: "".join(r.choice(("an", "re", "tio", "le", "ber", "con", "est", "ing", "ou", "mo", "sti", "da")) for _ in range(r.randint(1, 3)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    octet = lambda: str(r.randint(0, 255))

    def email() -> str:
        local, host, end = r.choice((word(), word() + "." + word(), word() + number(2))), word(), r.choice(("com", "org", "net", "io", "de", "edu"))
        return r.choice((f"{local}@{host}.{end}", f"{local}@{host}.{word()}.{end}", f"{local} at {host} dot {end}", f"{local} at {host} dot {end}", f"{local} AT {host} DOT {end}", f"{local} [at] {host} [dot] {end}", f"{local} {{at}} {host} {{dot}} {end}", f"{local}(at){host}.{end}", f"{local} @ {host}.{end}", f"{local} (at) {host} (dot) {end}", f"{local}[at]{host}[dot]{end}"))

    def ip() -> str:
        return r.choice((".", ".", "[.]", " . ", "(.)")).join(octet() for _ in range(4))

    def card() -> str:
        n = r.choice((13, 15, 16, 16, 16))
        body = r.choice("3456") + number(n - 2)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(("", "", " ", "-", ".", "_"))
        return sep.join(full[k : k + 4] for k in range(0, n, 4)) if sep else full

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}"))

    def other() -> str:
        return r.choice((
            lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
            lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 999)},{number(3)},{number(3)}.{number(2)}", lambda: number(r.randint(1, 12)), lambda: number(r.choice((16, 20, 24, 30))) + "0",
            lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 16, 32, 40)))), lambda: f"{r.randint(256, 999)}.{octet()}.{octet()}.{octet()}", lambda: f"ISBN 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
            lambda: f"{number(4)}-{number(4)}", lambda: f"{r.randint(1990, 2020)}-{r.randint(1990, 2020)}", lambda: f"#{number(7)}", lambda: f"at {word()} {r.randint(2, 9)} dot {r.randint(2, 9)}", lambda: f"{word()} at the dot of {word()}", lambda: f"@{word()}", lambda: f"{number(3)} {number(3)} {number(2)} {number(4)}",
            lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"{octet()}.{octet()}.{octet()}", lambda: f"{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}", lambda: f"{octet()} {octet()} {octet()} {octet()}", lambda: f"{octet()}.{octet()}.{octet()}.{octet()}.{octet()}", lambda: f"{word()} dot {word()}", lambda: f"stay at {word()}",
        ))()

    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        text += "".join(word() + r.choice((" ", " ", ", ", ". ", "\n")) for _ in range(r.randint(1, 6)))
        if r.random() < 0.55:
            kind = r.randrange(4)
            if r.random() < 0.3:
                text += r.choice(_CUES[KINDS[kind]]) + r.choice((": ", " ", " is "))
            e = (email, ip, card, phone)[kind]()
            spans.append((kind, len(text), len(text) + len(e)))
            text += e
        else:
            text += other()
        text += r.choice((" ", ", ", ". ", "\n", "### ", "!! "))
    return text, spans


@functools.lru_cache(maxsize=1)
def trained(sentences: int = SENTENCES, epochs: int = 24) -> np.ndarray:
    """[kinds, features] of the field, by Adam on the regularised log likelihood of generated sentences."""
    r = random.Random(331)
    examples = []
    for _ in range(sentences):
        text, spans = _sentence(r)
        lattice = Lattice(text)
        places = {(lattice.tokens[i][1], lattice.tokens[j - 1][2]): k for k, (i, j) in enumerate(lattice.segments)}
        gold = [(places[a, b], kind) for kind, a, b in spans if (a, b) in places]
        if len(gold) < len(spans) or not lattice.segments:
            continue
        x = np.zeros((len(lattice.rows), N_FEATURES), np.float32)
        for k, row in enumerate(lattice.rows):
            np.add.at(x[k], row, 1)
        examples.append((lattice, x, gold))
    w = np.zeros((len(KINDS), N_FEATURES))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        r.shuffle(examples)
        for at in range(0, len(examples), 100):
            grad = 0.002 * w
            for lattice, x, gold in examples[at : at + 100]:
                post, _ = lattice.marginals(x @ w.T)
                grad += (post.T @ x) / 100
                for k, kind in gold:
                    grad[kind] -= x[k] / 100
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w = w - 0.25 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def _sure(lattice: Lattice, post: np.ndarray, k: int, kind: int) -> bool:
    """Whether an entity of the kind is about there with CERTAIN, and these are its bounds with BOUNDS."""
    if post[k, kind] < BOUNDS:
        return False
    i, j = lattice.segments[k]
    bounds = np.array(lattice.segments)
    return float(post[(bounds[:, 0] < j) & (bounds[:, 1] > i), kind].sum()) >= CERTAIN


def write_weights() -> None:
    """Trains the field and writes WEIGHTS."""
    WEIGHTS.write_text(json.dumps([[round(float(x), 5) for x in row] for row in trained()]) + "\n")


@functools.lru_cache(maxsize=1)
def known_weights() -> np.ndarray:
    """The weights that write_weights left, [kinds, features]."""
    w = np.array(json.loads(WEIGHTS.read_text()))
    if w.shape != (len(KINDS), N_FEATURES):
        raise ValueError("the weights are of other features: run write_weights")
    return w


def added_spans(text: str, weights: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field that no base span overlaps."""
    out: list[tuple[int, int, int]] = []
    stretch: list[list[int]] = []
    found = list(_TRIGGER.finditer(text))
    lowered = text.lower()
    if "dot" in lowered or "at]" in lowered or "at)" in lowered or "at}" in lowered or "at " in lowered and any(c in text for c in "[({"):
        found = sorted([*found, *_SPOKEN.finditer(text)], key=lambda m: m.start())
    for m in found:
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if stretch and a <= stretch[-1][1]:
            stretch[-1][1] = b
        else:
            stretch.append([a, b])
    taken = sorted((a, b) for _, a, b in base)
    for a, b in stretch:
        while a and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        lattice = Lattice(text, a, b)
        if not lattice.segments:
            continue
        score = lattice.scores(weights)
        chosen = lattice.best(score)
        if not chosen:
            continue
        post, _ = lattice.marginals(score)
        for k, _, kind in chosen:
            i, j = lattice.segments[k]
            s, e = lattice.tokens[i][1], lattice.tokens[j - 1][2]
            if _sure(lattice, post, k, kind) and not any(x < e and s < y for x, y in taken):
                out.append((kind, s, e))
    return out


def find(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each ordered by kind and start."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, weights, base))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text)."""
    weights = known_weights()

    def make(b: pa.RecordBatch) -> dict:
        count, digest, spans = [], [], []
        for t in b.column(1):
            base, every = find(t.as_py(), weights)
            count.append([sum(k == x for k, _, _ in base) for x in range(len(KINDS))])
            digest.append(hashlib.sha256(_named(base).encode()).hexdigest())
            spans.append(_named(every))
        n = np.array(count, np.int64).reshape(-1, len(KINDS))
        return {"doc_id": b.column(0)} | {f"n_{k}": n[:, i].copy() for i, k in enumerate(KINDS)} | {"base_sha256": digest, "spans": spans}

    return frames.by_batch(frames.texts(docs), make, SCHEMA)


def masked(text: str, weights: np.ndarray) -> str:
    """text with each span replaced by its kind; of overlapping spans the first, and longest, counts."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in find(text, weights)[1]), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars, if there, counted anew; null stays null."""
    weights, at = known_weights(), docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            text = [None if t is None else masked(t, weights) for t in b.column(at).to_pylist()]
            out = list(b.columns)
            out[at] = pa.array(text, b.schema.field(at).type)
            if size is not None:
                out[size] = pa.array([None if t is None else len(t) for t in text], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(frames.table(spark, sf_dir, "documents"))
