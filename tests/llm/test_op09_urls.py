import random
import re

import numpy as np

from wayline.llm.op09_urls import BLOCKED, RULES, Automaton, canonical, url_filters


def regex_of(glob):
    return re.compile("".join({"**": ".*", "*": "[^/]*"}.get(s, re.escape(s)) for s in re.findall(r"\*\*|\*|.", glob)), re.S)


def test_automaton_against_regular_expressions():
    r = random.Random(3)
    globs = ["".join(r.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts = ["".join(r.choice("ab/.") for _ in range(r.randint(0, 14))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    got = Automaton.of([], globs).match(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[bool(regex_of(g).fullmatch(t)) for g in globs] for t in texts]
    assert got.tolist() == want and got.any() and not got.all()


def plain(url):
    host, path = canonical(url)
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    return host, path, None, "block" if any(regex_of(g).fullmatch(host + path) for g in BLOCKED) else "allow"


def test_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net", "https://x.net/", "http://net/a", "http://notnet/", "ftp://example.com/de/", "http://example.com/de",
            "http://w.org/fr/#a", "http://w.org/en/", None, "", "no scheme", "http://", "http://spam-farm.example.org/en/1", "http://www.cheap-pills.example.com/en/a",
            "http://casino1.example.com/a", "http://a.com/x/y.exe", "a://b://c/d", "http://é.net/en/", "http://u@x.net:80/", "http://x.org/a/.net/", "http://\n.net/\n"]
    urls += urls[:2]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters(df).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filters(df.where("false")).count() == 0


def test_random_rules_against_a_plain_version(spark):
    r = random.Random(8)
    part = lambda n: "".join(r.choice("ab.é*") for _ in range(r.randint(1, n)))
    rules = [(r.choice(("block", "allow")), part(3).strip(".") or "a", "/" + part(2) * r.randint(0, 1)) for _ in range(40)]
    rules += [("block" if v == "allow" else "allow", h, p) for v, h, p in rules[:5]]  # ties: the first of the list decides
    urls = [f"x://{part(6)}/{part(4)}{r.choice(['', '?q', '#f'])}" for _ in range(600)] + ["x://a/" + "b" * 100_000]

    def plain(url):
        host, path = canonical(url)
        fit = [(len(h + p), -k) for k, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = rules[-max(fit)[1]] if fit else None
        return (best[1] + best[2], best[0]) if best else (None, "allow")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filters(df, rules, blocked=()).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert sum(x is not None for x, _ in got.values()) > 100
