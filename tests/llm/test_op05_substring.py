import hashlib
import random
import re
from collections import Counter

from wayline.llm.op05_substring import ENTRY_BYTES, MOST_BYTES, ROW_ENTRIES, WINDOW, dealt, substring_dedup


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if count[tuple(w[i : i + WINDOW])] > 1:
                gone |= set(range(i, i + WINDOW))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 3)))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80, 35)]
    texts = []
    for _ in range(60):
        parts = [word() for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(parts))
            parts[k:k] = r.choice(passages)
        texts.append("".join(w + r.choice([" ", "\n", "\t", " \x0b "]) for w in parts))
    return texts + texts[:3] + [None, "", " \n ", "a", "b " * 40, "c " * 35, "x\u00a0y z"]


def run(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_against_brute_force(docs_of):
    texts = corpus()
    assert run(substring_dedup(docs_of(texts))) == dict(enumerate(brute(texts)))


def test_repeated_rows_and_empty_table(docs_of, spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring_dedup(docs_of([text, text], ids=[7, 7])).collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in rows] == [(7, 40, 40)] * 2
    assert substring_dedup(docs_of([])).count() == 0
    more = docs_of(["a b"]).selectExpr("*", "1 as blk", "'x' as n_words", "2 as part")
    assert substring_dedup(more).count() == 1


def test_different_words_of_equal_structure_stay(docs_of, thue_morse):
    a, b = thue_morse(1024)
    texts = [" ".join([f"w{i}" for i in range(34)] + [x]) for x in (a, b)]
    assert run(substring_dedup(docs_of(texts))) == dict(enumerate(brute(texts)))


def test_a_very_long_text(docs_of):
    r = random.Random(3)
    w = [str(r.randrange(50_000)) for _ in range(300_000)]
    w[250_000:250_060] = w[1_000:1_060]
    assert run(substring_dedup(docs_of([" ".join(w), "a b", " ".join(w[5_000:5_040])]))) == dict(enumerate(brute([" ".join(w), "a b", " ".join(w[5_000:5_040])])))


def test_rows_carry_many_entries_at_any_size():
    for size in (0, 10**8, 10**10, 10**12, 10**14):
        blocks, parts = dealt(size)
        assert size / blocks <= MOST_BYTES and size / parts <= MOST_BYTES
        if 10**9 < size <= 10**12:
            assert size / blocks / ENTRY_BYTES / parts >= ROW_ENTRIES / 2
