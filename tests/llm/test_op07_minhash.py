import random
import re

import numpy as np

from wayline.llm import graphs
from wayline.llm.op07_minhash import bands_for, keep_firsts, least_matches, near_components


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts, percent):
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(5, 150))] for _ in range(25)]
    texts = []
    for base in bases:
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w = w[: r.randint(0, len(w))]
            texts.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    r.shuffle(texts)
    return texts + [None, "", " ", "a b", "A  b", "a b c d e", "É b", "é b"]


def test_against_brute_force(docs_of):
    for percent in (85, 80):
        texts = corpus(percent)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_components(docs_of(texts), percent).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(brute(texts, percent))}


def test_a_dense_group_over_many_blocks(docs_of, monkeypatch):
    from wayline.llm import op07_minhash

    monkeypatch.setattr(op07_minhash, "BLOCK", 8)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(80):  # similarities about the threshold
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in near_components(docs_of(texts), 85).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(texts, 85))}


def test_a_large_bucket_gets_longer_bands(docs_of, monkeypatch):
    from wayline.llm import op07_minhash

    monkeypatch.setattr(op07_minhash, "LARGE", 6)
    r = random.Random(11)
    frequent = [f"f{i}" for i in range(60)]
    texts = []
    for k in range(60):  # half of each text is shared by all: similar at about a third, so buckets are large and mixed
        own = [f"x{k // 2}y{i}" for i in range(60)]
        if k % 2:
            own[r.randrange(60)] = "other"
        texts.append(" ".join(frequent + own))
    texts.append("a very long text " + " ".join(f"l{i}" for i in range(200_000)))
    got = {d.doc_id: d.component_id for d in near_components(docs_of(texts), 85).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(texts, 85))}


def test_different_words_of_equal_structure_are_not_linked(docs_of, thue_morse):
    for size in (1024, 2048):
        a, b = thue_morse(size)
        got = {d.doc_id: (d.n_shingles, d.component_id) for d in near_components(docs_of([a, b, a + " x " + b, b + " x " + a]), 80).collect()}
        assert got == {k: (1, k) for k in range(4)}


def test_rows_without_use(docs_of, spark):
    text = "one two three four five six"
    rows = near_components(docs_of([text, text, text], ids=[None, 4, 4])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == [(-1, None, True), (4, 4, True), (4, 4, True)]
    rows = near_components(docs_of([text, text, "seven eight nine ten", "seven eight nine ten", "alone"], ids=[1, 4, 4, 9, 10])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (4, 1), (4, 1), (9, 1), (10, 10)]
    assert near_components(docs_of([])).count() == 0
    kept = keep_firsts(docs_of([text, "other", text, None], ids=[5, 6, 7, None]).selectExpr("*", "1 as rep", "2 as kept"))
    assert kept.columns[-2:] == ["rep", "kept"] and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "6", "None"]
    again = keep_firsts(docs_of([text, text, "other words", None], ids=[4, 4, 4, 9]).selectExpr("*", "1 as c0", "2 as gone", "3 as twice"))
    assert again.columns[-3:] == ["c0", "gone", "twice"] and sorted((r.doc_id, r.text) for r in again.select("doc_id", "text").collect()) == [(4, text), (9, None)]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_bounds():
    assert bands_for(0.85) == 28 and 0.5563**28 < 1e-7
    steps = least_matches(0.85, 140)
    assert steps[-1][0] == 140 and 80 < steps[-1][1] < 119
    # simulated pairs at the threshold survive
    r = np.random.default_rng(0)
    m = (r.random((20000, 140)) < 0.85).cumsum(axis=1)
    assert all((m[:, n - 1] >= least).all() for n, least in steps)
