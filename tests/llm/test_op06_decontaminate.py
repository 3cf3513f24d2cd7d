import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from wayline.llm import op06_decontaminate as bm
from wayline.llm.words import slices


def make_index(texts):
    words = [next(slices(pa.array([t]), fold=bm.fold))[2].hashes for t in texts]
    df = {}
    for h in words:
        for t in set(h.tolist()):
            df[t] = df.get(t, 0) + 1
    return bm.Index(list(enumerate(texts)), df, len(texts), sum(map(len, words)) / len(texts)), words


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{int(r.paretovariate(0.7)) % vocabulary if r.random() < 0.4 else r.randrange(vocabulary)}" for _ in range(n))


def test_search_against_scores_of_all_items():
    r = random.Random(2)
    texts = [sentence(r, r.randint(5, 60)) for _ in range(150)]
    index, _ = make_index(texts)
    some = 0
    for k in range(300):
        q = sentence(r, 50) if k % 2 else texts[k // 2] + " " + sentence(r, 10)
        own = np.unique(index.term(next(slices(pa.array([q]), fold=bm.fold))[2].hashes))
        own = own[own >= 0].tolist()
        scores = {}
        for t in own:
            for item, x in index.postings[t]:
                scores[item] = scores.get(item, 0) + x
        want = {i: s for i, s in scores.items() if s >= 1 - 1e-9}
        got = dict(index.search(own))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        some += len(want)
    assert some > 150


def test_index_of_a_table(spark):
    r = random.Random(3)
    texts = [sentence(r, r.randint(5, 60)) for _ in range(80)]
    one, other = bm._indices(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartition(3)).__next__(), make_index(texts)[0]
    assert one.ids == other.ids and np.allclose(one.least, other.least) and np.allclose(one.bound, other.bound)


def test_planted_passages(docs_of, spark):
    r = random.Random(7)
    items = [(i, f"Question {i} {sentence(r, r.randint(12, 150), 3000)}. The answer {sentence(r, 6, 3000)}.") for i in range(60)] + [(60, None), (61, ""), (3, "again nothing of this")]
    texts, want = [], set()
    for d in range(200):
        words = sentence(r, r.randint(0, 400), 3000).split()
        if d % 4 == 0:
            i = r.randrange(60)
            k = r.randint(0, len(words))
            words[k:k] = items[i][1].upper().split() if d % 8 else items[i][1].split()
            want.add((d, i))
        if d % 4 == 1:  # the question alone
            words[0:0] = items[d % 60][1].split(". The answer")[0].split()
        texts.append(" ".join(words))
    df = docs_of([*texts, None, ""]).selectExpr("*", "1 as item_id", "2 as score")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in bm.contaminated(df, bench).collect()}
    assert got == want
    assert sorted(r.doc_id for r in bm.keep_clean(df, bench).collect()) == sorted(set(range(202)) - {d for d, _ in want})
    assert bm.contaminated(df, bench.where("false")).count() == 0 and bm.keep_clean(df, bench.where("false")).count() == 202


def test_shards_agree(docs_of, spark, monkeypatch):
    r = random.Random(9)
    items = [(i, sentence(r, 30, 3000)) for i in range(40)]
    df = docs_of([sentence(r, 50, 3000) + " " + items[i][1] for i in range(40)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(bm.contaminated(df, bench).collect())
    monkeypatch.setattr(bm, "SHARD_BYTES", 2000)
    assert sorted(bm.contaminated(df, bench).collect()) == one and len(one) == 40


def plain(docs, items):
    """Every passage against every item, by the formulas, without an index."""
    words = lambda t: re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()))
    shingles = lambda w: {tuple(w[i : i + bm.SHINGLE]) for i in range(len(w) - bm.SHINGLE + 1)}
    known = {i: words(t) for i, t in items if words(t)}
    df = Counter(t for w in known.values() for t in set(w))
    average, out = sum(map(len, known.values())) / len(known), set()
    for i, w in known.items():
        n, tf = len(w), Counter(w)
        impact = {t: math.log(1 + (len(known) - df[t] + 0.5) / (df[t] + 0.5)) * c * (bm.K1 + 1) / (c + bm.K1 * (1 - bm.B + bm.B * n / average)) for t, c in tf.items()}
        least = bm.SHARE * sum(impact.values()) * min(1.0, 0.75 * bm.PASSAGE / n)
        text, cut = dict(items)[i], None
        for m in reversed(list(re.finditer(r"[.!?:]\s", text))):
            before = len(words(text[: m.end()]))
            if n - before >= 3 and before:
                cut = before
                break
        cut = cut if cut is not None else (max(1, n - max(1, n // 4)) if n > 1 else 0)
        question, answer = shingles(w[:cut]), shingles(w[cut:]) if n - cut >= bm.SHINGLE else set(w[cut:])
        for d, t in enumerate(docs):
            x = words(t)
            for a in range(0, len(x), bm.STEP):
                if sum(impact.get(y, 0) for y in set(x[a : a + bm.PASSAGE])) < least - 1e-9:
                    continue
                near = x[max(0, a - n) : a + bm.PASSAGE + n] if a + bm.PASSAGE <= len(x) else x[max(0, a - n) :]
                both = shingles(near) | set(near)
                share = lambda s, both=both: sum(y in both for y in s) / len(s) if s else 1.0
                if share(question) >= bm.QUESTION and share(answer) >= bm.ANSWER:
                    out.add((d, i))
    return out


def test_the_whole_against_a_plain_version(docs_of, spark):
    """Damaged, cut and whole copies of items in natural mixes of words: the same pairs, so a recall of 1."""
    r = random.Random(21)
    items = [(i, f"Which {sentence(r, r.randint(4, 120), 900)}? It is {sentence(r, r.randint(1, 12), 900)}.") for i in range(50)] + [(50, "one"), (51, "two words"), (52, "A: b c d")]
    texts = []
    for d in range(240):
        x = sentence(r, r.randint(0, 300), 900).split()
        if d % 2 == 0:
            w = items[r.randrange(len(items))][1].split()
            for _ in range(r.randint(0, len(w) // 14)):
                w[r.randrange(len(w))] = "other"
            k = r.randint(0, len(x))
            x[k:k] = w[: r.randint(max(1, len(w) * 3 // 4), len(w))]
        texts.append(" ".join(x))
    texts.append(" ".join(sentence(r, 30_000, 900).split()) + " " + items[7][1])
    got = {(x.doc_id, x.item_id) for x in bm.contaminated(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain(texts, items)
    assert got == want and len(want) > 20
