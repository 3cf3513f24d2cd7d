"""Main text of web pages by composite text density.

The page is parsed into a tree in one pass over its tags. Each node has its
characters C, tags T, link characters LC and link tags LT, and the composite
density

    C / T * log(C * T / (LC * LT)) to the base log(C * LC / (C - LC) + LCb * C / Cb + e)

with b the body and empty counts taken as 1. A node's density sum is the sum of
its children's densities. The node of the greatest sum marks the way to the
body; the least density on that way is the threshold. Among nodes at or above
it, the one of the greatest density sum is the core of the article. Beside the
core, on the way up to the body, headings and blocks at or above the threshold
belong to the article, and within containers of the core plain paragraphs too.

Elements that are never article text (scripts, styles, forms, nav, header,
footer, aside and the like, or such a role) count nowhere. Weaker signs only
count for subtrees that hold less than half of the body's text (five sixths,
where an article or main element stands beside them), and never for headings: class and id words (state words such as has-sidebar apart), lists of
links (LC over half of C), and comment threads (alike children that begin with a
short name and a date, or what follows a heading such as "Comments").

References are decoded, white space inside a block becomes one space (all that
Unicode calls white space), blocks are trimmed and joined by one newline in page
order. Tags and attributes are read by the states of the HTML tokenizer;
unclosed and stray tags are taken as browsers do, as far as that moves text
between blocks. Null and empty pages have an empty text; a page without a body
is a body as a whole; repeated rows are taken one by one; other columns are not
read; an empty table returns no rows. Depth and length are bounded by no stack:
the tree is a list in page order, and sums run over it backwards.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayline.llm import frames

SCHEMA = "page_id long, url string, text string, n_chars long"

#: A name, and a value that is quoted, or runs to white space or the tag's end. A quote elsewhere is a letter.
_ONE = r"[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*))?"
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_ONE})*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?", re.S)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup up to the end tag.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}
_NEVER = frozenset(
    "script style noscript template textarea title iframe noembed noframes object embed applet svg canvas math audio video map head select option button input label fieldset form nav header footer aside menu dialog datalist output progress meter".split()
)
_BLOCK = frozenset(
    "address article blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
#: An open p ends where one of these begins.
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"} | {"li", "dd", "dt", "table"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var nobr".split())
_PART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hgroup".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog tablist toolbar".split())
#: Words of class and id of what surrounds an article, and state words that say nothing about their element.
_AROUND = re.compile(
    r"(?:^|[_-])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget\w*|cookies?|consent|gdpr|notice|disclaimer|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|disqus|toolbar|pagination|pager|skip|hidden|copyright)(?:$|[_-])",
    re.I,
)
_STATE = re.compile(r"^(?:has|no|not|with|without|is|js)[_-]|[_-](?:on|off|open|closed|enabled|disabled|fixed|sticky|visible|active)$", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PLAIN = frozenset("p blockquote pre ul ol dl figure table".split()) | _HEADINGS
_TALK = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|responses?|replies|discussion)(?: \(?\d+\)?)?:?|leave a (?:reply|comment)", re.I)
_DATED = re.compile(r"\bago\b|\b\d{1,2}:\d\d\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b(?:said|says|wrote|writes|replied)\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d", re.I)
_KEEP_ANYWAY = frozenset(("html", "body", "article", "main"))
#: Letters of a comment's first block at most (its author and date).
_BYLINE = 60


class Node:
    __slots__ = ("tag", "parent", "chars", "tags", "link_chars", "link_tags", "never", "around", "kind", "index", "density", "total", "end", "in_link")

    def __init__(self, tag: str, parent: Node | None, never: bool, around: bool, kind: str, index: int):
        self.tag, self.parent, self.never, self.around, self.kind, self.index = tag, parent, never, around, kind, index
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.end = index + 1
        self.in_link = parent is not None and parent.in_link or tag == "a"


def _signs(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is never article text, whether its class or id words speak against it, and its classes."""
    never, around, kind = False, False, ""
    if not attributes.strip(" /\t\r\n\f"):
        return never, around, kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            around = around or any(_AROUND.search(w) and not _STATE.search(w) for w in value.split())
            kind = value if name == "class" else kind
        elif name == "role":
            never = never or value.strip().lower() in _ROLES
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            never = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            never = True
    return never and tag not in ("html", "body"), around and tag not in _KEEP_ANYWAY and tag not in _HEADINGS, kind


class Page:
    """nodes: in page order; runs: (node, text, block number) in page order."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.runs: list[tuple[Node, str, int]] = []
        self.block = 0
        root = self._open("html", None, False, False, "")
        self.stack = [root]
        self.body: Node | None = None
        at = 0
        n = len(source)
        scan = _MARKUP.search
        while at < n:
            m = scan(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"), decode=False)
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in _RAW:
                stop = _RAW[name].search(source, at)
                at = stop.start() if stop else n
        for node in self.stack:
            node.end = len(self.nodes)
        self.body = self.body or root
        self.children: dict[int, list[Node]] = {}
        for node in self.nodes[1:]:
            self.children.setdefault(node.parent.index, []).append(node)

    def _open(self, tag: str, parent: Node | None, never: bool, around: bool, kind: str) -> Node:
        node = Node(tag, parent, never, around, kind, len(self.nodes))
        self.nodes.append(node)
        return node

    def _pop_to(self, k: int) -> None:
        for node in self.stack[k:]:
            node.end = len(self.nodes)
            if node.tag in _BLOCK:
                self.block += 1
        del self.stack[k:]

    def _start(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if tag == "html" or tag == "body" and self.body is not None:
            return
        if tag == "body":
            self._pop_to(1)
        elif stack[-1].tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template", "object"):
            self._pop_to(len(stack) - 1)
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == "p":
                    self._pop_to(k)
                    break
                if t not in _INLINE:
                    break
        if tag in _SIBLINGS:
            close, stop = _SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in close:
                    self._pop_to(k)
                    if tag != "tr":
                        break
                    if k <= len(stack) - 1:
                        continue
        if tag in _BLOCK:
            self.block += 1
        parent = stack[-1]
        never, around, kind = _signs(tag, attributes)
        never = never or parent.never or tag in _NEVER and not (tag == "header" and any(x.tag in ("article", "main") for x in stack))
        node = self._open(tag, parent, never, around, kind)
        if tag == "body":
            self.body = node
        if tag == "br":
            self.runs.append((parent, " ", self.block))
        if tag not in _VOID:  # a slash before the end closes nothing in HTML
            stack.append(node)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        stack = self.stack
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k].tag
            if t == tag:
                self._pop_to(k)
                return
            if t in ("td", "th", "table", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot") or tag in _INLINE and t not in _INLINE and t != "p":
                break
        if tag in ("p", "br"):
            self.block += 1

    def _text(self, text: str, decode: bool = True) -> None:
        if decode and "&" in text:
            text = html.unescape(text)
        node = self.stack[-1]
        if node.tag == "head" and text.strip():
            self._pop_to(len(self.stack) - 1)
            node = self.stack[-1]
        self.runs.append((node, text, self.block))

    def count(self) -> None:
        """Characters and tags of all nodes; what is never article text counts nowhere."""
        for node in self.nodes:
            node.chars = node.tags = node.link_chars = node.link_tags = 0
        for node, text, _ in self.runs:
            if not node.never:
                size = len("".join(text.split()))
                node.chars += size
                if node.in_link:
                    node.link_chars += size
        for node in reversed(self.nodes):
            p = node.parent
            if p is not None and not node.never:
                p.chars += node.chars
                p.link_chars += node.link_chars
                p.tags += node.tags + 1
                p.link_tags += node.link_tags + (node.tag == "a")

    def drop_surroundings(self) -> bool:
        """Marks the subtrees that weaker signs speak against; True if there are any."""
        half, some = self.body.chars / 2, False
        talk = self._threads()
        whole = [x for x in self.nodes if x.tag in ("article", "main") and x.chars and not x.never]
        for node in self.nodes[self.body.index + 1 : self.body.end]:
            if node.never:
                continue
            links = node.link_tags >= 3 and 2 * node.link_chars > node.chars and node.tag not in _INLINE
            # beside an article element a subtree may hold more text than that, though not nearly all
            beside = 3 * node.chars < 5 * half and any(x.end <= node.index or node.end <= x.index for x in whole[:8])
            if node.parent.around or (node.around or links or node.index in talk) and (node.chars < half or beside):
                # around now says: left out, with all below
                node.never = node.around = some = True
            else:
                node.around = False
        return some

    def _threads(self) -> set[int]:
        """Numbers of the nodes that hold reader comments, by their form."""
        out: set[int] = set()
        alike: list[list[Node]] = []
        for nodes in self.children.values():
            shapes: dict[tuple[str, str], list[Node]] = {}
            for x in nodes:
                if not x.never and x.tag in ("div", "li", "article", "section", "dd"):
                    shapes.setdefault((x.tag, x.kind), []).append(x)
            alike += [group for group in shapes.values() if len(group) > 1]
        wanted = {x.index for group in alike for x in group}
        heads = [x for x in self.nodes if x.tag in _HEADINGS and not x.never]
        if not wanted and not heads:
            return out
        text: dict[int, list[str]] = {x: [] for x in wanted | {h.index for h in heads}}
        size = dict.fromkeys(text, 0)
        for node, run, _ in self.runs:
            up: Node | None = node
            while up is not None and run.strip():
                if up.index in text:
                    if size[up.index] >= 4 * _BYLINE:
                        break  # so have all above it
                    text[up.index].append(run)
                    size[up.index] += len(run)
                up = up.parent
        for group in alike:
            signed = [x for x in group if (t := text[x.index]) and 0 < len(t[0].strip()) <= _BYLINE and len(t) > 1 and _DATED.search(" ".join(t)[: 2 * _BYLINE])]
            if len(signed) == len(group):
                out |= {x.index for x in group}
        for h in heads:
            if _TALK.fullmatch(" ".join("".join(text[h.index]).split())):
                # up to the next heading of its level
                for x in self.children[h.parent.index]:
                    if x.index < h.index:
                        continue
                    if x is not h and x.tag in _HEADINGS and x.tag <= h.tag:
                        break
                    out.add(x.index)
        return out

    def score(self) -> None:
        """Counts, then densities and density sums of all nodes that count."""
        self.count()
        if self.drop_surroundings():
            self.count()
        share = self.body.link_chars / max(1, self.body.chars)
        for node in self.nodes:
            if not node.never:
                node.density = _density(node, share)
                if node.parent is not None:
                    node.parent.total += node.density

    def article(self) -> tuple[Node, list[Node]]:
        """The core of the article, and the nodes beside it that belong to it."""
        self.score()
        inside = [x for x in self.nodes[self.body.index : self.body.end] if not x.never]
        if not inside:
            return self.body, []
        top = max(inside, key=lambda x: (x.total, -x.index))
        threshold, node = math.inf, top
        while node is not None:
            threshold = min(threshold, node.density)
            if node is self.body:
                break
            node = node.parent
        core = max((x for x in inside if x.density >= threshold), key=lambda x: (x.total, -x.index), default=self.body)
        # parts of text, such as a paragraph or a table row, stand in a container that is the core
        while core is not self.body and core.parent is not None and (core.tag in _PART or core.tag in _INLINE):
            core = core.parent
        beside, below = [], core
        while below is not self.body:
            up = below.parent
            for x in self.children[up.index]:
                if x is below or x.never:
                    continue
                heading = x.tag in _HEADINGS or x.tag == "header" and any(y.tag in _HEADINGS for y in self.nodes[x.index : x.end])
                if heading and x.index < below.index or x.density >= threshold or up is not self.body and x.tag in _PLAIN:
                    beside.append(x)
            beside.append(up)  # its own text, no more
            below = up
        return core, beside

    def text(self) -> str:
        core, beside = self.article()
        mine = np.zeros(len(self.nodes), bool)
        mine[core.index : core.end] = True
        way = set()
        node = core
        while node is not self.body:
            node = node.parent
            way.add(node.index)
        for x in beside:
            if x.index not in way:
                mine[x.index : x.end] = True
            elif x is not self.body:
                mine[x.index] = True
        keep = mine.tolist()
        blocks: list[str] = []
        parts: list[str] = []
        now = -1
        for node, text, block in self.runs:
            if node.never or not keep[node.index]:
                continue
            if block != now:
                if parts:
                    blocks.append("".join(parts))
                parts, now = [], block
            parts.append(text)
        blocks.append("".join(parts))
        done = (_SPACE.sub(" ", b).strip(" ") for b in blocks)
        return "\n".join(b for b in done if b)


def _density(node: Node, share: float) -> float:
    c, t, lc, lt = max(1, node.chars), max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
    if not node.chars:
        return 0.0
    rest = max(1, node.chars - node.link_chars)
    base = math.log(c * lc / rest + share * c + math.e)
    ratio = c * t / (lc * lt)
    return c / t * (math.log(ratio) / base if ratio > 0 else 0.0)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of pages (page_id, url, html)."""

    def make(b: pa.RecordBatch) -> dict:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        return {"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return frames.by_batch(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(frames.table(spark, sf_dir, "pages"))
