import random

from wayline.llm import frames
from wayline.llm.op01_tokens import Tree, apply_edits, count_tokens, counter, default_vocabulary, revised, trees, with_edits


def plain(text, c):
    pieces = c.split(text)
    return len(text), len(c.encoding.encode_ordinary(text)), len(pieces)


def test_edits_against_counting_anew():
    c, r = counter(*default_vocabulary()), random.Random(6)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'", "'ll", "'s", "1", "22", "é", "漢", "!", "...", "\t ", "'v", "e"]
    text_of = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    for _ in range(150):
        text = text_of(r.choice((0, 1, 5, 80, 900)))
        tree = Tree(text, c)
        assert tree.total == plain(text, c)
        for _ in range(15):
            a = r.randint(0, len(text) + 1)
            b = a + r.choice((0, 0, 1, 3, 200))
            new = text_of(r.choice((0, 1, 2, 5, 400 if r.random() < 0.1 else 3)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.total == plain(text, c), (text, a, b, new)


def test_only_the_edited_region_is_encoded_again():
    c = counter(*default_vocabulary())
    tree = Tree("some words of a long text " * 5000, c)
    tree.edit(60_000, 60_004, "other")
    assert tree.encoded < 8 and tree.total == plain(tree.text, c)


def test_tables(docs_of, spark):
    df = docs_of(["one two three", None, "", "one two three"], ids=[1, 2, 3, 1]).selectExpr("*", "1 as edits", "2 as n_tokens", "3 as seq")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 4, 7, "second"), (2, 1, 0, 99, "new"), (9, 1, 0, 1, "x")], "doc_id long, seq int, start int, end int, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_edits, r.n_chars_after, r.n_tokens_after) for r in count_tokens(with_edits(df, edits), default_vocabulary()).collect())
    c = counter(*default_vocabulary())
    one = (1, 3, 2, 14, plain("1 second three", c)[1])
    assert got == [one, one, (2, 0, 1, 3, 1), (3, 0, 0, 0, 0)]
    rows = count_tokens(revised(df), default_vocabulary()).collect()
    assert len(rows) == 4 and all(r.n_edits == 3 and r.n_tokens_after > 0 for r in rows)
    assert count_tokens(revised(df.where("false")), default_vocabulary()).count() == 0


def test_kept_trees_take_edits_again_and_again(spark, docs_of):
    """Two rounds of edits on stored trees: the sums are those of a recount, and only edited regions are encoded."""
    v = default_vocabulary()
    texts = ["one two three four " * 400, "", None, "l'été 1234567 " * 5, "x" * 200_000 + " end"]
    kept = frames.written(trees(docs_of(texts).selectExpr("*", "1 as tree", "2 as n_chars"), v))
    for step in range(2):
        edits = spark.createDataFrame([(i, k, 3 + step, 5 + 7 * k, "new's " * k) for i in range(5) for k in range(3)], "doc_id long, seq int, start long, end long, text string")
        after = apply_edits(kept.join(with_edits(kept.select("doc_id", "text"), edits).select("doc_id", "edits"), "doc_id"), v)
        kept = frames.written(after.selectExpr("doc_id", "text", "tree", "n_chars_after n_chars", "n_tokens_after n_tokens", "n_pretokens_after n_pretokens"))
        again = {r.doc_id: r for r in trees(kept.select("doc_id", "text"), v).collect()}
        for r in after.collect():
            a = again[r.doc_id]
            assert (r.n_chars_after, r.n_tokens_after, r.n_pretokens_after) == (a.n_chars, a.n_tokens, a.n_pretokens)
            assert r.n_encoded_again < 60
